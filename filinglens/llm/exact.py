"""Exact deduplication by Grace hash partitioning with tables that compare complete contents.

1. Every task folds its own rows in an open-addressing table, so a text that a third of all rows share
   leaves each task a few times at most.
2. What is left is dealt out by hash.  A task admits contents to its table until ``table_bytes`` are held;
   rows whose content is in the table are folded into it, rows of contents not admitted go to a spill table
   in the shared folder.  A content is either resident or spilled as a whole, since a full table admits
   nothing later.
3. Spilled rows are dealt out anew by other hash bits, again and again, until no bucket spills.

Nulls: a null text is an empty text; a null doc_id is smaller than any other, and a group of null ids only
keeps a null id.  Repeated rows: all rows that carry the largest doc_id of their group count as kept, and
``top_rows`` says how many there are.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import bounded_batches, documents, parts_of, stored, whole_text

FOLDED = pa.schema([("hash", pa.int64()), ("content", pa.binary()), ("keep_id", pa.int64()), ("top_rows", pa.int64()), ("group_size", pa.int64()), ("sha", pa.string())])
FOLDED_SQL = "hash long, content binary, keep_id long, top_rows long, group_size long, sha string"


class ContentTable:
    """Open addressing with linear probing; an entry matches only if hash and complete content do."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.folded: list[list] = []
        self.slots = [-1] * 1024

    def place(self, h: int, content: bytes) -> int:
        """The slot of this content, or the free slot where it would go."""
        mask = len(self.slots) - 1
        i = (h ^ h >> 29) & mask
        while (e := self.slots[i]) >= 0 and not (self.hashes[e] == h and self.contents[e] == content):
            i = i + 1 & mask
        return i

    def add(self, h: int, content: bytes, keep: int | None, top: int, size: int) -> bool:
        """Fold one record in; False if its content is new and the table is full."""
        i = self.place(h, content)
        if (e := self.slots[i]) >= 0:
            mine = self.folded[e]
            if keep == mine[0]:
                mine[1] += top
            elif mine[0] is None or keep is not None and keep > mine[0]:
                mine[0], mine[1] = keep, top
            mine[2] += size
            return True
        if self.held >= self.limit:
            return False
        self.slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.folded.append([keep, top, size])
        self.held += len(content) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for k, (hash_, text) in enumerate(zip(self.hashes, self.contents)):
                self.slots[self.place(hash_, text)] = k
        return True


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("hash", "content", "keep_id", "top_rows", "group_size")))


def _batches(rows: list[tuple], size: int = 500) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + size]), FOLDED)], schema=FOLDED)


def _fold(limit: int) -> Callable:
    """Fold the records of a task before they travel; a full table is sent on and begun anew."""
    def run(batches):
        table = ContentTable(limit)
        for batch in batches:
            for record in _records(batch):
                if not table.add(*record):
                    yield from _batches([(h, c, *f, None) for h, c, f in zip(table.hashes, table.contents, table.folded)])
                    table = ContentTable(limit)
                    table.add(*record)
        yield from _batches([(h, c, *f, None) for h, c, f in zip(table.hashes, table.contents, table.folded)])
    return run


def _settle(limit: int) -> Callable:
    """One bucket: contents that fit leave as finished groups, the others as spilled records."""
    def run(batches):
        table = ContentTable(limit)
        for batch in batches:
            yield from _batches([(*r, None) for r in _records(batch) if not table.add(*r)])
        yield from _batches([(h, None, *f, hashlib.sha256(c).hexdigest()) for h, c, f in zip(table.hashes, table.contents, table.folded)])
    return run


def content_groups(docs: DataFrame, table_bytes: int = 64 << 20, fanout: int | None = None) -> DataFrame:
    """Groups of equal texts: sha (SHA-256 of the text), keep_id, top_rows, group_size."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fanout = fanout or parts_of(spark)
    one = F.lit(1).cast("long")
    records = docs.select(F.xxhash64(whole_text()).alias("hash"), whole_text().cast("binary").alias("content"), F.col("doc_id").cast("long").alias("keep_id"),
                          one.alias("top_rows"), one.alias("group_size"))
    records = records.mapInArrow(_fold(table_bytes // 2), FOLDED_SQL)
    done, level = None, 0
    while True:
        dealt = records.repartition(fanout, F.xxhash64(F.lit(level), "hash"))
        settled = stored(dealt.mapInArrow(_settle(table_bytes), FOLDED_SQL), f"grace-{level}")
        part = settled.filter("sha is not null").select("sha", "keep_id", "top_rows", "group_size")
        done = part if done is None else done.unionByName(part)
        spilled = settled.filter("sha is null")
        if spilled.isEmpty():
            return done
        records, level = spilled, level + 1


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = content_groups(docs, **options)
    mine = docs.select("doc_id", F.sha2(whole_text().cast("binary"), 256).alias("text_sha256"))
    return (mine.join(groups.withColumnRenamed("sha", "text_sha256"), "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of fully equal candidates one stays."""
    groups = content_groups(docs, **options)
    rows = docs.select(F.struct("*").alias("row"), F.sha2(whole_text().cast("binary"), 256).alias("sha"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(groups.select("sha", F.col("keep_id").alias("keep"), "top_rows"), "sha").filter(F.col("id").eqNullSafe(F.col("keep")))
    single, several = kept.filter("top_rows = 1"), kept.filter("top_rows > 1")
    # Equal doc_id and text: one row of them, whichever sorts first on all its columns.
    first = several.groupBy("sha").agg(F.min(F.to_json("row")).alias("pick"), F.first("row").alias("any"))
    again = several.join(first.select("sha", "pick"), "sha").filter(F.to_json("row") == F.col("pick")).dropDuplicates(["sha"])
    return single.select("row.*").unionByName(again.select("row.*"))


def op4_grace_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


QUERIES = {"op4_grace_dedup": op4_grace_dedup}
SQL = {"op4_grace_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  (doc_id IS NOT DISTINCT FROM max(doc_id) OVER w) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""}
