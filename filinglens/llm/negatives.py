"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are sorted along a Hilbert curve through the dimensions that spread most and written as Parquet blocks of
``BLOCK`` rows; each block carries its least and largest value in every dimension and the labels it holds.  Interval
arithmetic on these zone maps bounds the inner product of an anchor with all rows of a block from both sides:

* positives: a block is read for an anchor if it holds the anchor's label and its upper bound reaches the score of
  the anchor's last positive so far (at first that of the anchor's own block);
* negatives: a block is read for a window [half, 95 %] of a positive's score if it holds another label and its
  bounds meet the window; while blocks stream past, the window's lower end rises to its last negative so far.

Anchors travel in lanes of ``LANE`` rows, blocks are joined to the lanes that chose them and stream past them, so a
task holds one lane and one block.  Bounds leave no row out; on data without any structure they choose all blocks.

Nulls: rows without label, vector or with a null or non-finite component take no part; a row without vec_id is never
an anchor and comes last among ties.  Repeated vec_ids: each row counts, an anchor's other rows are all rows but
itself.  Vectors of different lengths: shorter ones count as filled up with zeros.  Components of 2**26 and more
(after scaling) stay at 2**26, so that scores fit a long.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import bounded_batches, parts_of, stored
from filinglens.llm.lanes import laid, parts_for, streamed
from filinglens.operators.ordering import number_rows, top_per_group

BLOCK, LANE = 512, 4096
CURVE_DIMS, CURVE_BITS = 16, 4
CURVE_SAMPLE = 4096
LIMIT = 1 << 26
NONE = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, scale: int = 256, anchor_step: int = 50, shift_step: int = 7, classes: int = 10) -> DataFrame:
    """Rows that take part: vec_id, label, q (whole components), anchor."""
    x = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % shift_step == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return vectors.filter("label IS NOT NULL AND embedding IS NOT NULL").filter(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("q"),
        F.coalesce(F.col("vec_id") % anchor_step == 0, F.lit(False)).alias("anchor"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of the cells (rows x dimensions, values below 2**bits) on the Hilbert curve, as signed longs in curve order."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        one, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            up = (x[i] & one) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(up, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & np.uint64(1 << b), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << np.uint64(1) | x[i] >> np.uint64(b) & np.uint64(1)
    return (place ^ np.uint64(1 << 63)).view(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def curve_of(rows: DataFrame, dims: int) -> tuple[list[int], np.ndarray]:
    """The dimensions of the curve and the cell borders in each, from at most ``CURVE_SAMPLE`` rows; they order rows and change no result."""
    sample = np.array([r.q for r in rows.select("q").orderBy(F.xxhash64("vec_id", "q")).limit(CURVE_SAMPLE).collect()], np.int64).reshape(-1, dims)
    which = np.argsort(-sample.var(0), kind="stable")[:CURVE_DIMS].tolist()
    return which, np.quantile(sample[:, which], np.arange(1, 1 << CURVE_BITS) / (1 << CURVE_BITS), axis=0)


def blocks_of(rows: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """Blocks along the curve: block, n, lo, hi, labels, ids, own (labels by row), anchors (by row), vectors (int32)."""
    which, borders = curve_of(rows, dims)

    def keyed(batches):
        for batch in batches:
            q = _matrix(batch.column("q"), dims)
            cells = np.stack([np.searchsorted(borders[:, k], q[:, d], "right") for k, d in enumerate(which)], 1) if len(which) else np.zeros((len(q), 1), np.int64)
            yield batch.append_column("key", pa.array(hilbert(cells, CURVE_BITS)))

    def packed(batches):
        held, base, number = [], TaskContext.get().partitionId() << 32, 0

        def block(rows):
            nonlocal number
            q = _matrix(rows.column("q").combine_chunks(), dims).astype(np.int32)
            label, ids = rows.column("label").to_numpy(), rows.column("vec_id").to_pylist()
            out = [base + number, len(q), q.min(0).tobytes(), q.max(0).tobytes(), np.unique(label).tolist(), ids, label.tobytes(), rows.column("anchor").to_pylist(), q.tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds)], names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                cut = table.num_rows // size * size
                for lo in range(0, cut, size):
                    yield block(table.slice(lo, size))
                held = table.slice(cut).to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield block(table)

    names = ["block", "n", "lo", "hi", "labels", "ids", "own", "anchors", "vectors"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.bool_()), pa.binary()]
    order = ["key", "vec_id", "label"]
    placed = rows.mapInArrow(keyed, "vec_id long, label long, q array<int>, anchor boolean, key long")
    placed = placed.repartitionByRange(parts_of(rows.sparkSession), *order).sortWithinPartitions(*order)
    return placed.mapInArrow(packed, "block long, n long, lo binary, hi binary, labels array<long>, ids array<long>, own binary, anchors array<boolean>, vectors binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, by the fastest arithmetic that holds them."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a.astype(np.int64)).max()) * float(np.abs(b.astype(np.int64)).max()) * a.shape[1]
    if top < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with anything between ``lo`` and ``hi``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    lo, hi = lo[None, :], hi[None, :]
    return (products(up, lo) + products(down, hi))[:, 0], (products(up, hi) + products(down, lo))[:, 0]


def anchors_of(blocks: DataFrame, dims: int, positives: int) -> DataFrame:
    """Anchors with the score that the last of their positives has in their own block (null if it has fewer)."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = np.flatnonzero(row["anchors"])
                q, label = np.frombuffer(row["vectors"], np.int32).reshape(-1, dims), np.frombuffer(row["own"], np.int64)
                s = products(q[at], q)
                s[(label[at, None] != label[None, :]) | (at[:, None] == np.arange(len(q)))] = NONE
                s.sort(1)
                last = s[:, -positives] if s.shape[1] >= positives else np.full(len(at), NONE)
                out += [(row["block"] << 16 | int(i), row["ids"][i], int(label[i]), q[i].tobytes(), None if t == NONE else int(t)) for i, t in zip(at.tolist(), last)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                                             ["row", "vec_id", "label", "vector", "least"])

    return blocks.select("block", "ids", "own", "anchors", "vectors").mapInArrow(run, "row long, vec_id long, label long, vector binary, least long")


def in_lanes(anchors: DataFrame, lane: int = LANE) -> DataFrame:
    """Packed rows (lane, small) of at most ``lane`` anchors that follow each other on the curve."""
    numbered = number_rows(anchors, [F.col("row")], "place")
    columns = [c for c in anchors.columns if c != "row"]
    return numbered.groupBy(F.floor((F.col("place") - 1) / lane).cast("long").alias("lane")).agg(
        F.struct(F.sort_array(F.collect_list(F.struct("row", *columns))).alias("rows")).alias("small"))


class Lane:
    """Anchors of a lane, the range of scores each looks for, and the best rows found so far."""

    def __init__(self, rows: list[dict], dims: int, windows: list[list[tuple[int, int]]], k: int, same: bool):
        self.rows, self.k, self.same = rows, k, same
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.q = np.frombuffer(b"".join(r["vector"] for r in rows), np.int32).reshape(len(rows), dims)
        width = max([1, *map(len, windows)])
        self.low, self.high = np.full((len(rows), width), 1, np.int64), np.full((len(rows), width), 0, np.int64)  # empty windows
        for i, w in enumerate(windows):
            for j, (lo, hi) in enumerate(w):
                self.low[i, j], self.high[i, j] = lo, hi
        self.best = np.full((len(rows), width, k), NONE, np.int64)
        self.who = np.full((len(rows), width, k), -1, np.int64)
        self.ids = np.full((len(rows), width, k), np.iinfo(np.int64).max, np.int64)
        self.null = np.zeros((len(rows), width, k), bool)

    def wanted(self, lo: np.ndarray, hi: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which anchors need a block with this zone map."""
        least, most = bounds(self.q, lo, hi)
        low = np.maximum(self.low, self.best[:, :, -1])
        meets = ((most[:, None] >= low) & (least[:, None] <= self.high) & (self.low <= self.high)).any(1)
        return meets & (np.isin(self.label, labels) if self.same else (len(labels) > 1) | (self.label != labels[0]))

    def take(self, block: dict) -> None:
        q = np.frombuffer(block["vectors"], np.int32).reshape(block["n"], -1)
        lo, hi = np.frombuffer(block["lo"], np.int32), np.frombuffer(block["hi"], np.int32)
        need = np.flatnonzero(self.wanted(lo, hi, np.array(block["labels"])))
        label = np.frombuffer(block["own"], np.int64)
        rows = (np.int64(block["block"]) << 16) + np.arange(len(q))
        null = np.array([i is None for i in block["ids"]])
        ids = np.array([0 if i is None else i for i in block["ids"]], np.int64)
        for at in range(0, len(need), 1024):
            some = need[at : at + 1024]
            s = products(self.q[some], q)
            fits = (self.label[some, None] == label[None, :]) if self.same else (self.label[some, None] != label[None, :])
            fits &= self.row[some, None] != rows[None, :]
            for j in range(self.low.shape[1]):
                low = np.maximum(self.low[some, j], self.best[some, j, -1])
                a, b = np.nonzero(fits & (s >= low[:, None]) & (s <= self.high[some, j, None]))
                if len(a):
                    self.merge(some, j, a, s[a, b], null[b], ids[b], rows[b])

    def merge(self, some: np.ndarray, j: int, a: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Best ``k`` of those held and those found, for the anchors ``some[a]``."""
        hit = np.unique(a)
        old = some[hit]
        anchor = np.concatenate([np.searchsorted(hit, a), np.repeat(np.arange(len(hit)), self.k)])
        parts = [np.concatenate([new, held[old, j].ravel()]) for new, held in ((score, self.best), (null, self.null), (ids, self.ids), (rows, self.who))]
        order = np.lexsort((parts[3], parts[2], parts[1], -parts[0].astype(np.float64) if abs(parts[0][parts[0] != NONE]).max(initial=0) < 1 << 53 else _descending(parts[0]), anchor))
        place = np.arange(len(order)) - np.searchsorted(anchor[order], anchor[order])
        keep = order[place < self.k]
        for held, part in zip((self.best, self.null, self.ids, self.who), parts):
            held[old, j] = part[keep].reshape(len(hit), self.k)

    def found(self) -> list | None:
        i, j, _ = at = np.nonzero(self.best != NONE)
        if not len(i):
            return None
        ids = np.ma.array(self.ids[at], mask=self.null[at])
        return [self.row[i], j, self.best[at], pa.array(ids.data, mask=np.ma.getmaskarray(ids)), self.who[at]]


def _descending(x: np.ndarray) -> np.ndarray:
    """Whole numbers as ranks, largest first, without passing through floats."""
    return -np.unique(x, return_inverse=True)[1]


def searched(anchors: DataFrame, blocks: DataFrame, n_blocks: int, dims: int, windows_of, k: int, same: bool, lane: int = LANE) -> DataFrame:
    """(row, window, score, vec_id, who): candidates for the best ``k`` rows of each window of each anchor."""
    spark = blocks.sparkSession
    lanes = stored(in_lanes(anchors, lane), "lanes")
    parts = parts_for(n_blocks, lanes.count(), parts_of(spark))

    def begin(name, small):
        return name, Lane(small["rows"], dims, [windows_of(r) for r in small["rows"]], k, same)

    def choose(state, zone):
        need = state[1].wanted(np.frombuffer(zone["lo"], np.int32), np.frombuffer(zone["hi"], np.int32), np.array(zone["labels"]))
        return [[state[0]], [zone["block"]]] if need.any() else None

    zones = blocks.select("block", F.struct("block", "lo", "hi", "labels").alias("large"))
    names = lanes.select("lane")
    every = zones.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    asked = names.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(every, "part").select("lane", F.col("block").alias("name"), "large")
    chosen = streamed(laid(lanes, asked, parts), begin, choose, lambda s: None, pa.schema([("lane", pa.int64()), ("block", pa.int64())]), "lane long, block long")
    chosen = stored(chosen, "chosen")
    read = chosen.join(blocks, "block").select("lane", F.col("block").alias("name"), F.struct("block", "n", "lo", "hi", "labels", "ids", "own", "vectors").alias("large"))
    out = pa.schema([("row", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("who", pa.int64())])
    return streamed(laid(lanes, read, parts), begin, lambda s, block: s[1].take(block), lambda s: s[1].found(), out,
                    "row long, window long, score long, vec_id long, who long")


def _every(row: dict) -> list[tuple[int, int]]:
    return [(NONE + 1 if row["least"] is None else row["least"], -(NONE + 1))]


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), size: int = BLOCK, lane: int = LANE, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive."""
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    bounded_batches(spark)
    rows = stored(whole_vectors(vectors, **options), "vectors")
    least, most = rows.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    if not most:
        return spark.createDataFrame([], schema)
    if least < most:
        rows = rows.withColumn("q", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.coalesce(F.get("q", i), F.lit(0))))
    blocks = stored(blocks_of(rows, most, size), "blocks")
    n_blocks = blocks.count()
    anchors = stored(anchors_of(blocks, most, positives), "anchors")
    first = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("who")]
    near = top_per_group(searched(anchors, blocks, n_blocks, most, _every, positives, True, lane), ["row"], first, positives, "place")
    near = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("near"))
    asked = stored(anchors.drop("least").join(near, "row"), "windows")

    def windows(row):
        return [(-(-percent[0] * p["score"] // 100), percent[1] * p["score"] // 100) for p in row["near"]]

    found = top_per_group(searched(asked, blocks, n_blocks, most, windows, negatives, False, lane), ["row", "window"], first, negatives)
    positive = F.get("near", F.col("window").cast("int"))
    return found.withColumnRenamed("vec_id", "negative_id").join(asked, "row").select(
        F.col("vec_id").alias("anchor_id"), positive["vec_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hilbert_zones(spark, sf_dir):
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_hilbert_zones": op11_hilbert_zones}
SQL = {"op11_hilbert_zones": """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""}
