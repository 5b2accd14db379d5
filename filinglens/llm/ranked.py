"""Ranked lexical search with pair-bound MaxScore.

The index cuts the documents into blocks of whole texts; a block has the postings of its terms (document, count) in
one packed row, so building it shuffles nothing.  Terms that no item asks for are left out while the items' terms
number at most ``VOCABULARY``; beyond that all terms are indexed.

Each item's terms are taken in pairs, heaviest first.  For every pair and block the intersection list is made
beforehand: the documents that hold both terms, with their joint impact.  It serves twice:

* a document's joint impacts are a lower bound of its score, so the lists alone give every item a score that its
  last hit reaches at least, before any scoring;
* the bound of a pair in a block is the largest of the joint maximum and the two single maxima, which is below the
  sum of the single maxima wherever the terms' best documents differ.  The bounds of an item's pairs add up to the
  block's bound: blocks below the item's threshold are skipped, and inside a block only documents of pairs whose
  remaining bounds reach the threshold are candidates; the rest of the pairs only add to those.

Items travel in lanes of ``LANE`` items, blocks stream past them; tasks keep the ``k`` best of each item.

Nulls: a null text has no terms, in documents and items; a null doc_id comes last among equal scores.  Every row of
the items is an item, every row of the documents a document, repeated ones too.  Without terms on either side the
result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, parts_of, stored, whole_text
from filinglens.llm.kernel import LETTERS, LOWER, Hashes, words
from filinglens.llm.lanes import laid, parts_for, streamed
from filinglens.operators.ordering import number_rows, top_per_group

K = 20
LANE = 256
VOCABULARY = 1 << 20
BLOCK_BYTES = 4 << 20


def counted(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Number of terms of each text; distinct term hashes, where their postings begin, texts and counts."""
    low = LOWER[buf]
    s, e, first = words(low, offsets, LETTERS)
    lengths = np.diff(first)
    who, term = np.repeat(np.arange(len(lengths)), lengths), Hashes(low).span(s, e).view(np.int64)
    if wanted is not None:
        at = np.searchsorted(wanted, term)
        mine = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == term) if len(wanted) else np.zeros(0, np.int64)
        who, term = who[mine], term[mine]
    order = np.lexsort((who, term))
    who, term = who[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    who, of, tf = who[at], term[at], np.diff(at, append=len(term))
    heads = np.ones(len(of), bool)
    heads[1:] = of[1:] != of[:-1]
    starts = np.flatnonzero(heads)
    return lengths, of[starts], np.append(starts, len(of)), who, tf


def index_of(docs: DataFrame, wanted: np.ndarray | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """Blocks: block, ids, filled (texts with terms), total (all terms), lengths, terms, starts, who, tf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column("text"), size):
                lengths, terms, starts, who, tf = counted(buf, offsets, wanted)
                row = [number, batch.column("doc_id").slice(lo, hi - lo).to_pylist(), int((lengths > 0).sum()), int(lengths.sum()), lengths.astype(np.int64).tobytes(), terms.tobytes(),
                       starts.astype(np.int64).tobytes(), who.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    names = ["block", "ids", "filled", "total", "lengths", "terms", "starts", "who", "tf"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "block long, ids array<long>, filled long, total long, lengths binary, terms binary, starts binary, who binary, tf binary")


def terms_of(items: DataFrame) -> DataFrame:
    """(query, term, times) for every distinct term of every item."""
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                _, terms, starts, who, tf = counted(buf, offsets, None)
                yield pa.RecordBatch.from_arrays([batch.column("query").slice(lo, hi - lo).take(pa.array(who)), pa.array(np.repeat(terms, np.diff(starts))), pa.array(tf.astype(np.int64))], ["query", "term", "times"])

    return items.select("query", whole_text().alias("text")).mapInArrow(run, "query long, term long, times long")


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df): documents that hold the term."""
    def run(batches):
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(starts, np.int64)))], ["term", "df"])

    return index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Block:
    """Impacts of a block's postings and, for each term, the largest."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = row["ids"]
        lengths, tf = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        self.terms, self.starts, self.who = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["starts"], np.int64), np.frombuffer(row["who"], np.int32)
        m = 75 + 25 * lengths * n // total
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.who])
        self.most = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand among the block's ones, -1 for those it lacks."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[at], self.starts[at + 1])
        return self.who[part], self.impact[part]


class Items:
    """The items of a lane: terms in the order of their weights (two in a row form a pair), and their best documents so far."""

    def __init__(self, rows: list[dict], k: int):
        self.k, self.query = k, [r["query"] for r in rows]
        self.terms = [np.array([t["term"] for t in r["terms"]], np.int64) for r in rows]
        self.weights = [np.array([t["weight"] for t in r["terms"]], np.int64) for r in rows]
        self.least = [r["least"] or 0 for r in rows]
        self.best: list[list[tuple]] = [[] for _ in rows]

    def lists(self, block: Block) -> tuple[list, list, list, list]:
        """Intersection lists of a block: item, pair, documents, joint impacts."""
        out = ([], [], [], [])
        for i, (terms, weights) in enumerate(zip(self.terms, self.weights)):
            at = block.places(terms)
            for p in range(len(terms) // 2):
                a, b = at[2 * p], at[2 * p + 1]
                if a < 0 or b < 0:
                    continue
                (x, gx), (y, gy) = block.postings(a), block.postings(b)
                both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                if len(both):
                    for column, value in zip(out, (i, p, both, weights[2 * p] * gx[ix] + weights[2 * p + 1] * gy[iy])):
                        column.append(value)
        return out

    def bounded_below(self, lists: tuple[list, list, list, list], docs: int) -> None:
        """Keep each item's best lower bounds that the lists of a block give."""
        item = np.array(lists[0])
        for i in np.unique(item):
            sums = np.zeros(docs, np.int64)
            for j in np.flatnonzero(item == i):
                sums[lists[2][j]] += lists[3][j]
            self.best[i] = sorted([*self.best[i], *[(int(v),) for v in np.sort(sums[sums > 0])[-self.k :]]], reverse=True)[: self.k]

    def score(self, block: Block, joint: dict[tuple[int, int], int]) -> None:
        """Take the block's best documents in, under the bounds of pairs; ``joint``: largest joint impact by item and pair."""
        for i, (terms, weights) in enumerate(zip(self.terms, self.weights)):
            at = block.places(terms)
            single = np.where(at >= 0, weights * block.most[at] if len(block.most) else 0, 0)
            pairs = -(-len(terms) // 2)
            bound = np.zeros(pairs, np.int64)
            bound[: len(terms[::2])] = single[::2]
            bound[: len(terms[1::2])] = np.maximum(bound[: len(terms[1::2])], single[1::2])
            for p in range(len(terms) // 2):
                bound[p] = max(bound[p], joint.get((i, p), 0))
            least = max(1, self.least[i])
            if bound.sum() < least:
                continue
            order = np.argsort(-bound, kind="stable")
            rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
            sums, inside = np.zeros(len(block.ids), np.int64), None
            for step, p in enumerate(order.tolist()):
                if not bound[p]:
                    break
                if rest[step] < least:
                    inside = (sums > 0) & (sums + rest[step] >= least)
                    if not inside.any():
                        break
                for t in range(2 * p, min(2 * p + 2, len(terms))):
                    if at[t] >= 0:
                        who, impact = block.postings(at[t])
                        if inside is not None:
                            mine = inside[who]
                            who, impact = who[mine], impact[mine]
                        sums[who] += weights[t] * impact
            hits = np.flatnonzero(sums >= least)
            if len(hits):
                # Beyond the k largest only scores equal to the last of them can matter.
                if len(hits) > self.k:
                    hits = hits[sums[hits] >= np.partition(sums[hits], -self.k)[-self.k]]
                new = [(-int(sums[d]), block.ids[d] is None, block.ids[d] or 0) for d in hits.tolist()]
                self.best[i] = sorted([*self.best[i], *new])[: self.k]
                if len(self.best[i]) == self.k:
                    self.least[i] = max(self.least[i], -self.best[i][-1][0])

    def bounds(self) -> list:
        rows = [(q, v[0]) for q, best in zip(self.query, self.best) for v in best]
        return [[r[0] for r in rows], [r[1] for r in rows]]

    def found(self) -> list:
        rows = [(q, -s, None if null else d) for q, best in zip(self.query, self.best) for s, null, d in best]
        return [[r[c] for r in rows] for c in range(3)]


def search(docs: DataFrame, items: DataFrame, k: int = K, lane: int = LANE, vocabulary: int = VOCABULARY, size: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of every item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = stored(number_rows(items.select("item_id", "text"), [F.col("item_id"), F.col("text")], "query"), "items")
    terms = stored(terms_of(asked), "terms")
    distinct = terms.select("term").distinct()
    some = distinct.limit(vocabulary + 1)
    wanted = np.sort(np.array([r.term for r in some.collect()], np.int64))
    index = stored(index_of(docs, wanted if len(wanted) <= vocabulary else None, size), "index")
    n, total, n_blocks = index.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    if not n or not len(wanted):
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = terms.join(frequencies(index), "term").select("query", "term", (weight * F.col("times")).alias("weight"))
    heaviest = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "term", "weight")))
    packed = stored(weighted.groupBy("query").agg(heaviest.alias("terms")), "weights")

    def in_lanes(rows):
        return rows.groupBy(F.floor((F.col("query") - 1) / lane).cast("long").alias("lane")).agg(F.struct(F.sort_array(F.collect_list(F.struct("query", "terms", "least"))).alias("rows")).alias("small"))

    first = stored(in_lanes(packed.withColumn("least", F.lit(None).cast("long"))), "lanes")
    lanes = first.select("lane")
    parts = parts_for(n_blocks, lanes.count(), parts_of(spark))
    # Every lane needs every block's lists; blocks meet the lanes by the parts they are dealt to.
    spread = lanes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def beside(frame):
        return spread.join(frame.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))), "part")

    columns = ["block", "ids", "lengths", "terms", "starts", "who", "tf"]
    asking = beside(index.select(*columns)).select("lane", F.col("block").alias("name"), F.struct(*columns).alias("large"))

    def begin(name, small):
        return name, Items(small["rows"], k)

    def intersect(state, row):
        lists = state[1].lists(Block(row, n, total))
        if not lists[0]:
            return None
        state[1].bounded_below(lists, len(row["ids"]))
        return [[state[0]], [row["block"]], [np.array(lists[0], np.int32).tobytes()], [np.array(lists[1], np.int32).tobytes()], [np.cumsum([len(w) for w in lists[2]]).astype(np.int64).tobytes()],
                [np.concatenate(lists[2]).astype(np.int32).tobytes()], [np.concatenate(lists[3]).tobytes()], [None], [None]]

    def floors(state):
        query, bound = state[1].bounds()
        return [[state[0]] * len(query), *[[None] * len(query)] * 6, query, bound]

    shape = pa.schema([("lane", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("item", "pair", "ends", "docs", "joint")], ("query", pa.int64()), ("bound", pa.int64())])
    lists = stored(streamed(laid(first, asking, parts), begin, intersect, floors, shape, "lane long, block long, item binary, pair binary, ends binary, docs binary, joint binary, query long, bound long"), "pairs")
    last = top_per_group(lists.filter("block IS NULL").select("query", "bound"), ["query"], [F.desc("bound")], k).filter(F.col("rank") == k).select("query", F.col("bound").alias("least"))
    second = stored(in_lanes(packed.join(last, "query", "left")), "lanes")
    large = asking.join(lists.filter("block IS NOT NULL").select("lane", F.col("block").alias("name"), F.struct("item", "pair", "ends", "joint").alias("lists")), ["lane", "name"], "left")
    large = large.select("lane", "name", F.struct("large.*", "lists").alias("large"))

    def score(state, row):
        joint, lists = {}, row["lists"]
        if lists:
            ends, values = np.frombuffer(lists["ends"], np.int64), np.frombuffer(lists["joint"], np.int64)
            most = np.maximum.reduceat(values, np.concatenate([[0], ends[:-1]]))
            joint = dict(zip(zip(np.frombuffer(lists["item"], np.int32).tolist(), np.frombuffer(lists["pair"], np.int32).tolist()), most.tolist()))
        state[1].score(Block(row, n, total), joint)

    out = pa.schema([("query", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())])
    hits = streamed(laid(second, large, parts), begin, score, lambda s: s[1].found(), out, "query long, score long, doc_id long")
    ranked = top_per_group(hits, ["query"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_pair_maxscore(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_pair_maxscore": op13_pair_maxscore}
SQL = {"op13_pair_maxscore": r"""
WITH item_terms AS (
  SELECT item_id, q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
doc_terms AS (
  SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
lengths AS (SELECT r, count(*) AS n FROM doc_terms GROUP BY r),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
postings AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
scored AS (
  SELECT q, item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT AS score
  FROM item_terms JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r), totals GROUP BY q, item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20"""}
