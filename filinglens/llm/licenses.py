"""Licence scan: fuzzy search for short notices, and exact phrases.

A text becomes its words, A-Z lower-cased, joined by single blanks.  A notice of m characters may be off by
k = m // 12 edits; cut into k + 1 parts, at least one part of any such occurrence is intact (pigeonhole), so an
Aho-Corasick automaton over all parts finds every candidate place.  The regex library's bounded-error matching
then verifies each candidate stretch and gives the span and its edits: the best occurrence of the stretch first, then
those of what is left before and behind it, so copies that stand close together are all found.

Null and empty texts have no words, no labels ("") and score 0.  Repeated rows are scanned each on its own; an
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import bounded_batches, documents, kept_in_process, whole_text

# Phrases that are looked for exactly, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of public licence notices, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def every_match(pattern, text: str, lo: int, hi: int, shortest: int) -> Iterator:
    """The best match of a stretch, then those of what is left before and behind it."""
    open_ = [(lo, hi)]
    while open_:
        a, b = open_.pop()
        if b - a >= shortest and (m := pattern.search(text, a, b)) is not None:
            yield m
            open_ += [(a, m.start()), (max(m.end(), m.start() + 1), b)]


class NoticeSearch:
    """All notices with their seeds; built once per Python worker."""

    def __init__(self, notices: dict[str, str], chars_per_edit: int = 12):
        import ahocorasick

        self.notices = []
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for number, (notice, label) in enumerate(notices.items()):
            k = len(notice) // chars_per_edit
            cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((number, a, b - a))
            self.notices.append((notice, label, k, regex.compile(rf"(?be)(?:{regex.escape(notice)}){{e<={k}}}")))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, where)
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the merged stretches of the text where it may stand."""
        out: dict[int, list[list[int]]] = {}
        for end, where in self.automaton.iter(text):
            for number, at, size in where:
                notice, _, k, _ = self.notices[number]
                lo = max(0, end + 1 - size - at - k)
                hi = min(len(text), lo + len(notice) + 3 * k)
                mine = out.setdefault(number, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][1] = max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        return out

    def find(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """Verified occurrences: label, first and last character, edits, similarity; of overlapping ones those with fewest edits."""
        found = []
        for number, stretches in self.windows(text).items():
            notice, label, k, pattern = self.notices[number]
            for lo, hi in stretches:
                for m in every_match(pattern, text, lo, hi, len(notice) - k):
                    edits = sum(m.fuzzy_counts)
                    found.append((label, m.start(), m.end(), edits, 1 - edits / len(notice)))
        better = [x for x in found if not any(y[3] < x[3] and y[1] < x[2] and x[1] < y[2] for y in found)]
        return sorted(better, key=lambda x: (x[1], x[2], x[0]))


def exact_places(text: bytes, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Word index and label of every exact phrase."""
    padded, found = b" " + text + b" ", []
    for phrase, label in phrases.items():
        needle = f" {phrase} ".encode()
        at = padded.find(needle)
        while at >= 0:
            found.append((padded.count(b" ", 0, at + 1) - 1, label))
            at = padded.find(needle, at + 1)
    return found


SCANNED = ("doc_id long, n_words long, base array<struct<word: long, label: string>>, "
           "spans array<struct<label: string, first_word: long, last_word: long, edits: int, similarity: double>>")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, base (exact places) and spans (verified fuzzy occurrences, in words)."""
    def run(batches):
        search = kept_in_process(f"notices_{hash(tuple(notices.items()))}", lambda: NoticeSearch(notices))
        for batch in batches:
            sizes, base, spans = [], [], []
            for text in batch.column("text"):
                words = WORD.findall(text.as_buffer().to_pybytes().lower())
                joined = b" ".join(words)
                sizes.append(len(words))
                base.append([{"word": w, "label": l} for w, l in exact_places(joined, phrases)])
                read = joined.decode("utf-8")
                spans.append([{"label": l, "first_word": read.count(" ", 0, a), "last_word": read.count(" ", 0, b), "edits": e, "similarity": s} for l, a, b, e, s in search.find(read)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(base, kinds[2]), pa.array(spans, kinds[3])], ["doc_id", "n_words", "base", "spans"])

    kinds = [None, None, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])),
             pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))]
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")).mapInArrow(run, SCANNED)


def labelled(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_fuzzy."""
    def joined(column):
        return F.array_join(F.array_sort(F.array_distinct(column)), ",")

    s = scan(docs, **options)
    best = F.array_max(F.transform("spans", lambda x: x["similarity"]))
    return s.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
                    joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "spans.label")).alias("labels"),
                    F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), F.size("spans").cast("long").alias("n_fuzzy"))


def op2_license_search(spark, sf_dir):
    return labelled(documents(spark, sf_dir))


QUERIES = {"op2_license_search": op2_license_search}
SQL = {}
