"""Granary: byte blobs, archives and training text as ordinary Spark DataFrames."""
