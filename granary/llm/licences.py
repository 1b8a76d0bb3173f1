"""Licence scans by sentence rules.

A text is normalised (lower case, runs of anything but letters and digits become one space; line ends and sentence ends stay
as marks), and known licence sentences in it are mapped to their identifiers. A sentence of RULES has to stand between
such marks; a full sentence of a real notice (VARIANTS) may follow and precede anything, as notices are also quoted in one run. Both
may be wrapped over lines, with or without comment leaders, but never reach over a sentence's end. The identifiers of a
text in order form its sequence, and every licence rule is an ordered list of identifiers: it matches where they follow each other in the
sequence, whatever unknown sentences stand between. A rule that another matched rule contains as a part is not reported besides it.

Only DataFrame functions are used. The tables of sentences and rules are fixed and small, and are literals of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence -> its sentences in order. The wording of public licence notices.
RULES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "Apache-2.0-notice": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at",
        "distributed under the License is distributed on an AS IS BASIS",
    ],
    "MIT": ["Released under the MIT License"],
    "MIT-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "The above copyright notice and this permission notice shall be included in all copies",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "GPL-3.0-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is distributed in the hope that it will be useful",
        "You should have received a copy of the GNU General Public License",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice",
        "Redistributions in binary form must reproduce the above copyright notice",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["Released under CC0 1.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
#: Licences that are told from those of RULES by more sentences. oracle_sql() holds RULES alone.
MORE_RULES = {
    "BSD-3-Clause": [*RULES["BSD-2-Clause"], "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD-4-Clause": [
        *RULES["BSD-2-Clause"],
        "All advertising materials mentioning features or use of this software must display the following acknowledgement",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
}
#: Sentence of RULES or MORE_RULES -> the full sentences of real notices that stand for it.
VARIANTS = {
    "Licensed under the Apache License, Version 2.0": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "You may obtain a copy of the License at": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "distributed under the License is distributed on an AS IS BASIS": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    ],
    "Permission is hereby granted, free of charge, to any person obtaining a copy": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ],
    "The above copyright notice and this permission notice shall be included in all copies": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    ],
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    ],
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": [
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    ],
    "This program is distributed in the hope that it will be useful": ["is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "You should have received a copy of the GNU General Public License": ["You should have received a copy of the GNU General Public License along with"],
    "Redistribution and use in source and binary forms, with or without modification, are permitted": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "Redistributions of source code must retain the above copyright notice": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "Redistributions in binary form must reproduce the above copyright notice": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    MORE_RULES["BSD-4-Clause"][3]: [MORE_RULES["BSD-4-Clause"][3]],
    MORE_RULES["BSD-3-Clause"][-1]: [
        MORE_RULES["BSD-3-Clause"][-1],
        "nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
}
#: Stands for a sentence's end in a normalised text. Sentences end at a mark followed by white space; marks that begin a line lead a comment. A full
#: stop inside a number or an abbreviated "v." ends none. A line's end stays a line feed, which a sentence may reach over.
END = "\x01"
MARK = r"(?m)(?=[.!?;])(?<!\bv)(?<!^[\x20\t.!?;]{0,64})[.!?;]++(?=[\x20\t\n\r]|\z)"


def plain(sentence: str) -> str:
    """The normal form of a known sentence; of a text's sentences normal() makes the same."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def normal(text: Column) -> Column:
    """Words of a-z and 0-9 with spaces, line feeds and ENDs between them."""
    text = F.regexp_replace(F.replace(text, F.lit(END), F.lit(" ")), MARK, END)
    return F.concat(F.lit("\n"), F.regexp_replace(F.lower(text), rf"[^a-z0-9\n\r{END}]+", " "), F.lit("\n"))


def pattern(sentences: list[str], full: list[str]) -> str:
    """Finds normalised sentences between ends of lines or sentences, and full ones between any words; the longest first."""
    any_of = lambda found: "|".join(x.replace(" ", r"[ \n\r]+") for x in sorted(found, key=len, reverse=True)) or "(?!)"
    return rf"(?<![a-z0-9])(?:(?:{any_of(full)})(?![a-z0-9])|(?<=[\n\r{END}] ?)(?:{any_of(sentences)})(?= ?[\n\r{END}]))"


def sentence_ids(rules: dict[str, list[str]]) -> dict[str, int]:
    """Normalised sentence -> identifier."""
    return {s: k for k, s in enumerate(dict.fromkeys(plain(x) for rule in rules.values() for x in rule), 1)}


def scan(docs: DataFrame, rules: dict[str, list[str]] = RULES | MORE_RULES, id_col: str = "doc_id", text_col: str = "text", variants: dict[str, list[str]] = VARIANTS) -> DataFrame:
    """One row per row of docs: id, n_sentences (known ones), sequence, licences (names joined by commas, in name order).

    A null or empty text has no sentence and the empty sequence. A sentence that occurs again counts again. Rows repeated are judged alike;
    other columns are not read. An empty table gives an empty result. A text without any known sentence gives empty strings.
    """
    known = sentence_ids(rules)
    full = {plain(x): known[plain(s)] for s, more in variants.items() if plain(s) in known for x in more}
    table = F.create_map(*(F.lit(x) for pair in (known | full).items() for x in (pair[0], str(pair[1]))))
    hits = F.regexp_extract_all(normal(F.coalesce(F.col(text_col), F.lit(""))), F.lit(pattern(list(known), list(full))), F.lit(0))
    found = F.transform(hits, lambda s: table[F.regexp_replace(s, r"[ \n\r]+", " ")])
    rows = docs.select(F.col(id_col), F.concat(F.lit(","), F.concat_ws(",", found), F.lit(",")).alias("sequence"), F.size(found).cast("long").alias("n_sentences"))
    orders = {name: [str(known[plain(x)]) for x in rule] for name, rule in rules.items()}
    names = []
    for name, order in sorted(orders.items()):
        match = _follows(order)
        for o in orders.values():
            if len(o) > len(order) and _part_of(order, o):
                match = match & ~_follows(o)
        names.append(F.when(match, F.lit(name)))
    return rows.select(id_col, "n_sentences", F.when(F.col("n_sentences") > 0, F.trim(F.translate("sequence", ",", " "))).otherwise("").alias("sequence"), F.concat_ws(",", *names).alias("licences"))


def _part_of(order: list[str], wider: list[str]) -> bool:
    """Whether the sentences of a rule stand in another in their order."""
    rest = iter(wider)
    return all(x in rest for x in order)


def _follows(order: list[str]) -> Column:
    return F.col("sequence").like("%," + ",%,".join(order) + ",%") if len(order) == 1 else F.col("sequence").rlike("," + ",(?:[0-9]+,)*".join(order) + ",")


def oracle_sql(rules: dict[str, list[str]] = RULES) -> str:
    """DuckDB SQL for scan() over documents: the same rules by its own list functions. It cuts at every line's end and knows no VARIANTS."""
    known = sentence_ids(rules)
    orders = {name: [str(known[plain(x)]) for x in rule] for name, rule in rules.items()}
    values = ", ".join(f"('{s}', {k})" for s, k in known.items())
    follows = lambda o: "regexp_matches(sequence, '," + ",([0-9]+,)*".join(o) + ",')"
    names = []
    for name, order in sorted(orders.items()):
        wider = [o for o in orders.values() if len(o) > len(order) and any(o[k : k + len(order)] == order for k in range(len(o)))]
        names.append(f"CASE WHEN {' AND '.join([follows(order), *('NOT ' + follows(o) for o in wider)])} THEN '{name}' END")
    return f"""
WITH known(s, k) AS (VALUES {values}),
lines AS (SELECT doc_id, row_number() OVER () AS r, regexp_split_to_array(coalesce(text, ''), '[\\n\\r]+') AS ls FROM documents),
parts AS (SELECT doc_id, r, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM lines),
marked AS (SELECT doc_id, r, i, string_split(regexp_replace(regexp_replace(l || ' ', '\\bv\\.', 'v', 'g'), '[.!?;]+[ \\t]', chr(10), 'g'), chr(10)) AS ss FROM parts),
sentences AS (SELECT doc_id, r, i, generate_subscripts(ss, 1) AS j, unnest(ss) AS s FROM marked),
hits AS (SELECT r, i, j, k FROM sentences JOIN known ON trim(regexp_replace(lower(sentences.s), '[^a-z0-9]+', ' ', 'g')) = known.s),
seqs AS (SELECT r, count(*) AS n, string_agg(k, ',' ORDER BY i, j) AS q FROM hits GROUP BY r),
rows AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, ',' || coalesce(q, '') || ',' AS sequence FROM lines LEFT JOIN seqs USING (r))
SELECT doc_id, n_sentences, trim(replace(sequence, ',', ' ')) AS sequence, concat_ws(',', {', '.join(names)}) AS licences FROM rows"""
