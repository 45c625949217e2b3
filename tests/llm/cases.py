"""Odd documents that every operator and stage must stand, and plain helpers for brute force."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, kept string, size string"
LONG = " ".join(f"w{k % 5003}x{k}" for k in range(60_000))


def odd_rows() -> list[tuple]:
    def row(doc, text, source="a", lang="en"):
        return (doc, text, lang, source, None if text is None else len(text), 1.0, 7, "x", "y")

    near = [f"word{k}" for k in range(200)]
    changed = near[:150] + ["other"] + near[151:]
    return [
        row(1, "Plain words in a row, nothing else to see here at all."),
        row(2, "plain words IN a row, nothing else to see here at all."),
        row(2, "plain words IN a row, nothing else to see here at all."),  # a repeated row
        row(2, "the same id with another text of enough words to count here"),
        row(3, None, None), row(4, "", "b"), row(5, " \t\n ", "b", None), row(None, "no id on this one, yet words enough to be a text"),
        row(None, None), row(6, "Été İstanbul  nbsp  € \U0001f600 naïve", "\U0001f600"),
        row(7, LONG, "b"), row(8, LONG.upper(), "b"), row(9, "x" * 200_000, "c"),
        row(10, " ".join(near)), row(11, " ".join(changed)), row(12, "one two"), row(13, "one two"),
    ]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
