"""Verbatim notices, as their publishers print them."""

import textwrap

import pytest

from granary.llm import licences

MIT = [
    "Copyright (c) 2020 Jane Doe",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
APACHE = [
    "Copyright 2020 Jane Doe",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
]
GPL2 = [GPL[0].replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), *GPL[1:]]
BSD = [
    "Copyright (c) 2020, Jane Doe",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.',
]
NEITHER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Jane Doe."
NOTICES = {
    "MIT-text": (MIT, 3),
    "Apache-2.0-notice": (APACHE, 4),
    "GPL-3.0-notice": (GPL, 3),
    "BSD-2-Clause": (BSD, 3),
    "BSD-3-Clause": ([*BSD[:4], NEITHER, BSD[4]], 4),
    "BSD-4-Clause": ([*BSD[:4], ADVERTISING, NEITHER.replace("3.", "4."), BSD[4]], 5),
    "MPL-2.0": (["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."], 1),
}
LAYOUTS = {
    "paragraphs": "\n\n".join,
    "lines": "\n".join,
    "one run": " ".join,
    **{f"wrapped {width} {leader!r}{end!r}": lambda ps, width=width, leader=leader, end=end: end.join(leader + line for p in ps for line in [*textwrap.wrap(p, width), ""]) for width in (30, 72, 79) for leader, end in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), (";; ", "\n"))},
}


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [(r.licences, r.n_sentences) for r in sorted(licences.scan(df).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_verbatim_notices(spark, layout):
    texts = [LAYOUTS[layout](paragraphs) for paragraphs, _ in NOTICES.values()]
    assert scan(spark, texts) == [(name, n) for name, (_, n) in NOTICES.items()]


def test_what_is_no_notice(spark):
    texts = ["\n".join(textwrap.wrap(" ".join(GPL2), 72)), "Released. under the MIT License", "Released under\nthe MIT License.", "We said Released under the MIT License.", "a\x01Released under the\x01MIT License. b"]
    assert [x for x, _ in scan(spark, texts)] == ["", "", "MIT", "", ""]
