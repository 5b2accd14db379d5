"""Inverted-file index over vectors, with exact top-k.

Vectors are dealt to the cells of a clustering that is fitted on a bounded sample and cut into blocks by their distance
to the centre, inside each group where the index has groups.  A block is one packed row with its mean ``m``, the
greatest distance ``r`` of its vectors to it, its greatest norm and the values of the filter columns it holds.  For a
query q every score x·q of a block is at most min(m·q + r |q|, max |x| |q|) by the triangle inequality.

Search without groups: each query first reads the blocks with the best bounds (``PROBES``), which gives a score its k-th
hit reaches at least; then only blocks whose bound reaches that score are read.  Search within groups streams the
blocks of each group in turn and skips those that cannot reach the group's k-th hit so far.  The clustering and the
bounds decide what is read, never the result: scores are rounded to ``digits`` and ties go to the smaller key.

The index is a table: ``build(..., path)`` writes it, ``load`` reads it.  Null vectors take no part.

A table that is asked once needs no index: :func:`scan` reads its rows where they lie, past queries that are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from filinglens.operators.lanes import laid, parts_for, streamed
from filinglens.operators.ordering import top_per_group
from filinglens.session import materialise, scratch_path

BLOCK, CELLS, SAMPLE = 2048, 1024, 8192
LANE, PROBES = 2048, 2
POOL = 1 << 20


@dataclass
class VectorIndex:
    blocks: DataFrame
    key: str
    columns: list[str]
    groups: list[str]


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``cells`` clusters (Lloyd's rounds from evenly spaced vectors)."""
    if cells < 2 or len(sample) <= cells:
        return sample[:1] if len(sample) else np.zeros((1, 0))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        count = np.bincount(near, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and the distance to it."""
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    at = square.argmin(1)
    return at, np.sqrt(np.maximum(square[np.arange(len(x)), at], 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build(corpus: DataFrame, key: str, columns: list[str] = (), groups: list[str] = (), path: str | None = None, block: int = BLOCK, cells: int | None = None) -> VectorIndex:
    """Index of ``corpus`` (key, embedding, filter ``columns``, ``groups``); all vectors must have one length."""
    spark, columns, groups = corpus.sparkSession, list(columns), list(groups)
    names = list(dict.fromkeys([key, *columns, *groups]))
    rows = corpus.filter(F.col("embedding").isNotNull()).select(F.struct(*names).alias("row"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = np.array([r.embedding for r in rows.select("embedding").orderBy(F.xxhash64("row")).limit(SAMPLE).collect()], np.float64)
    many = len(sample) if len(sample) < SAMPLE else rows.count()
    centres = centres_of(sample if len(sample) else np.zeros((0, 1)), min(CELLS, max(1, many // block)) if cells is None else cells)
    group_type = T.StructType([corpus.schema[g] for g in groups])
    row_type = T.StructType([corpus.schema[c] for c in names])

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest(_matrix(batch.column("embedding")), centres)
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("far", pa.array(far))

    def packed(batches):
        held, last = [], None

        def block_of(held):
            x = np.concatenate([h[1] for h in held])
            m = x.mean(0)
            made = [held[0][2], [r for h in held for r in h[0]], m.tobytes(), float(np.sqrt(((x - m) ** 2).sum(1)).max()), float(np.sqrt((x * x).sum(1)).max()), x.tobytes()]
            return made

        def batch_of(made):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made, shape)], schema=shape)

        for batch in batches:
            if not batch.num_rows:
                continue
            x, who, cell = _matrix(batch.column("embedding")), batch.column("row").to_pylist(), batch.column("cell").to_numpy()
            group = [tuple(r[g] for g in groups) for r in who]
            at = 0
            while at < len(who):
                name = (group[at], cell[at])
                if last != name and held:
                    yield batch_of(block_of(held))
                    held = []
                last, room = name, block - sum(len(h[0]) for h in held)
                end = at + 1
                while end < len(who) and end - at < room and group[end] == group[at] and cell[end] == cell[at]:
                    end += 1
                held.append((who[at:end], x[at:end], {g: who[at][g] for g in groups} if groups else None))
                if sum(len(h[0]) for h in held) >= block:
                    yield batch_of(block_of(held))
                    held = []
                at = end
        if held:
            yield batch_of(block_of(held))

    empty = T.StructType([T.StructField("none", T.IntegerType())])
    kind = T.StructType([T.StructField("group", group_type if groups else empty), T.StructField("rows", T.ArrayType(row_type)), T.StructField("m", T.BinaryType()),
                         T.StructField("r", T.DoubleType()), T.StructField("norm", T.DoubleType()), T.StructField("x", T.BinaryType())])
    shape = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind])
    by = [F.col(f"row.{g}") for g in groups] + [F.col("cell"), F.col("far"), F.col(f"row.{key}")]
    laid_out = rows.mapInArrow(placed, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))
    laid_out = laid_out.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    blocks = laid_out.mapInArrow(packed, kind).withColumn("block", F.monotonically_increasing_id())
    path = path or scratch_path(spark, "index")
    blocks.write.parquet(path)
    return VectorIndex(spark.read.schema(blocks.schema).parquet(path), key, columns, groups)


def load(spark: SparkSession, path: str, key: str, columns: list[str] = (), groups: list[str] = ()) -> VectorIndex:
    return VectorIndex(spark.read.parquet(path), key, list(columns), list(groups))


class Asked:
    """The queries of a lane, what each must reach, and the best rows of the group at hand."""

    def __init__(self, rows: list[dict], k: int, key: str, filters: dict[str, str], digits: int):
        self.ids, self.k, self.key, self.filters, self.digits = [r["query_id"] for r in rows], k, key, filters, digits
        self.q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
        self.norms = np.sqrt((self.q * self.q).sum(1))
        self.wanted = {c: [r["filters"][q] for r in rows] for c, q in filters.items()}
        self.floor = np.array([-np.inf if r["least"] is None else r["least"] for r in rows])
        self.fresh()

    def fresh(self):
        self.group, self.least = None, self.floor.copy()
        self.pool: list[tuple] = []
        self.held = 0

    def bounds(self, m: bytes, r: float, norm: float) -> np.ndarray:
        slack = 0.5 * 10.0**-self.digits + 1e-9 * (1 + norm * self.norms)
        return np.minimum(self.q @ np.frombuffer(m, np.float64) + r * self.norms, norm * self.norms) + slack

    def allowed(self, values: dict[str, list]) -> np.ndarray | None:
        """Queries x rows whose filter values agree; a null agrees with nothing."""
        ok = None
        for c, wanted in self.wanted.items():
            names = {v: i for i, v in enumerate(dict.fromkeys([*wanted, *values[c]])) if v is not None}
            a, b = np.array([names.get(v, -1) for v in wanted]), np.array([names.get(v, -2) for v in values[c]])
            ok = (a[:, None] == b[None, :]) if ok is None else ok & (a[:, None] == b[None, :])
        return ok

    def take(self, block: dict):
        need = np.flatnonzero(self.bounds(block["m"], block["r"], block["norm"]) >= self.least)
        if not len(need):
            return
        rows = block["rows"]
        self.add(need, np.frombuffer(block["x"], np.float64).reshape(len(rows), -1), [r[self.key] for r in rows], {c: [r[c] for r in rows] for c in self.wanted})

    def add(self, need: np.ndarray, x: np.ndarray, keys: list, values: dict[str, list]):
        """Vectors met by the queries ``need``."""
        s = np.round(x @ self.q[need].T, self.digits).T
        ok = self.allowed(values)
        if ok is not None:
            s = np.where(ok[need], s, -np.inf)
        best = s if s.shape[1] <= self.k else np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k :]
        least = np.maximum(self.least[need], best.min(1) if s.shape[1] >= self.k else -np.inf)
        a, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        self.pool.append((need[a], s[a, b], [keys[i] for i in b.tolist()]))
        self.held += len(a)
        self.least[need] = np.maximum(self.least[need], least)
        if self.held > POOL:
            self.shrink()

    def shrink(self):
        if not self.pool:
            return np.zeros(0, np.int64), np.zeros(0), []
        who, score = np.concatenate([p[0] for p in self.pool]), np.concatenate([p[1] for p in self.pool])
        keys = [x for p in self.pool for x in p[2]]
        rank = {x: i for i, x in enumerate(sorted(set(keys), key=lambda x: (x is None, x)))}
        order = np.lexsort((np.array([rank[x] for x in keys], np.int64), -score, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[who[last]] = np.maximum(self.least[who[last]], score[last])
        self.pool, self.held = [(who[keep], score[keep], [keys[i] for i in keep.tolist()])], len(keep)
        return self.pool[0]

    def found(self):
        who, score, keys = self.shrink()
        group = self.group
        return [[group] * len(who), [self.ids[i] for i in who.tolist()], keys, score] if len(who) else None


def search(index: VectorIndex, queries: DataFrame, k: int, filters: dict[str, str] | None = None, digits: int = 6, lane: int = LANE) -> DataFrame:
    """Best ``k`` rows per query — per group and query where the index has groups — by dot product, ties by key.

    ``queries``: query_id, embedding and, per ``filters`` entry (indexed column → query column), a value the row must
    equal.  Result: the groups, query_id, key, score, rank.
    """
    filters, blocks, key, groups, spark = filters or {}, index.blocks, index.key, list(index.groups), queries.sparkSession
    row_type = {f.name: f for f in blocks.schema["rows"].dataType.elementType}
    value = F.struct(*[F.col(q) for q in dict.fromkeys(filters.values())]) if filters else F.lit(None).cast("struct<none:int>")
    asked = materialise(queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), value.alias("filters")))
    n_queries, n_blocks = asked.count(), blocks.count()
    id_type, key_type, group_type = queries.schema["query_id"].dataType, row_type[key].dataType, blocks.schema["group"].dataType
    out_type = T.StructType([T.StructField("group", group_type), T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("score", T.DoubleType())])
    named = [F.col(f"group.{g}").alias(g) for g in groups]
    if not n_queries or not n_blocks:
        return spark.createDataFrame([], out_type).select(*named, "query_id", key, "score", F.lit(1).cast("bigint").alias("rank"))
    lanes_of = max(1, -(-n_queries // lane))

    def packed(rows):
        return rows.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(lanes_of)).alias("lane")).agg(F.struct(F.collect_list(F.struct("query_id", "embedding", "filters", "least")).alias("rows")).alias("small"))

    parts = parts_for(n_blocks, lanes_of, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lanes = materialise(packed(asked.withColumn("least", F.lit(None).cast("double"))))
    names = lanes.select("lane")
    shape = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out_type])

    def begin(name, small):
        return name, Asked(small["rows"], k, key, filters, digits)

    def read(state, block):
        asked, out = state[1], None
        if groups and asked.group != block["group"]:
            out = asked.found() if asked.group is not None else None
            asked.fresh()
        asked.group = block["group"]
        asked.take(block)
        return out

    def scored(lanes, chosen):
        part = [F.col("block"), F.struct("group", "rows", "m", "r", "norm", "x").alias("large")]
        pairs = chosen.join(blocks.select(*part), "block").select("lane", (F.xxhash64("large.group") if groups else F.col("block")).alias("next"), F.col("block").alias("name"), "large")
        return streamed(laid(lanes, pairs, parts), begin, read, lambda s: s[1].found(), shape, out_type)

    every = names.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(
        blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part")), "part").select("lane", "block")
    if groups or n_blocks <= PROBES:
        chosen = every
    else:
        # The filter values of a block tell which queries it can serve at all.
        held = [F.array_distinct(F.col(f"rows.{c}")).alias(c) for c in filters]
        zones = blocks.select("block", F.struct("block", "m", "r", "norm", (F.struct(*held) if held else F.lit(None).cast("struct<none:int>")).alias("held")).alias("large"))

        def reach(asked, zone):
            bound = asked.bounds(zone["m"], zone["r"], zone["norm"])
            ok = asked.allowed(zone["held"]) if asked.filters else None
            return bound if ok is None else np.where(ok.any(1), bound, -np.inf)

        def first(name, small):
            asked = Asked(small["rows"], k, key, filters, digits)
            return name, asked, [], np.full((len(asked.ids), PROBES), -np.inf), np.full((len(asked.ids), PROBES), -1, np.int64)

        def best(state, zone):
            name, asked, _, bound, who = state
            new = reach(asked, zone)
            worst = bound.argmin(1)
            rows = np.flatnonzero(new > bound[np.arange(len(new)), worst])
            bound[rows, worst[rows]], who[rows, worst[rows]] = new[rows], zone["block"]

        pair = pa.schema([("lane", pa.int64()), ("block", pa.int64())])
        meet = laid(lanes, every.join(zones, "block").select("lane", F.col("block").alias("name"), "large"), parts)
        probes = streamed(meet, first, best, lambda s: [[s[0]] * len(u := np.unique(s[4][s[4] >= 0])), u], pair, "lane long, block long").distinct()
        hits = top_per_group(scored(lanes, probes), ["query_id"], [F.desc("score"), F.asc_nulls_last(key)], k)
        floors = hits.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        lanes = materialise(packed(asked.join(floors, "query_id", "left")))
        meet = laid(lanes, every.join(zones, "block").select("lane", F.col("block").alias("name"), "large"), parts)

        def needed(state, zone):
            bound = reach(state[1], zone)
            return [[state[0]], [zone["block"]]] if ((bound >= state[1].least) & (bound > -np.inf)).any() else None

        chosen = materialise(streamed(meet, begin, needed, lambda s: None, pair, "lane long, block long"))
    hits = scored(lanes, chosen).select(*named, "query_id", key, "score")
    return top_per_group(hits, [*groups, "query_id"], [F.desc("score"), F.asc_nulls_last(key)], k)


def scan(corpus: DataFrame, key: str, queries: DataFrame, k: int, filters: dict[str, str] | None = None, digits: int = 6, lane: int = LANE) -> DataFrame:
    """:func:`search` without groups over rows that are read once and neither stored nor shuffled.

    ``queries`` must be few enough to be broadcast.  A task keeps the best ``k`` of each query and scores ``BLOCK`` rows
    against ``lane`` queries at a time.
    """
    filters, wanted = filters or {}, list(dict.fromkeys((filters or {}).values()))
    id_type, key_type = queries.schema["query_id"].dataType, corpus.schema[key].dataType
    asked = [{"query_id": r.query_id, "embedding": r.embedding, "filters": {c: r[f"_{c}"] for c in wanted}, "least": None}
             for r in queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding", *[F.col(c).alias(f"_{c}") for c in wanted]).collect()]
    out_type = T.StructType([T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("score", T.DoubleType())])
    shape = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out_type])
    sent = queries.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        lanes = [Asked(sent.value[i : i + lane], k, key, filters, digits) for i in range(0, len(sent.value), lane)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, keys, values = _matrix(part.column("embedding")), part.column("key").to_pylist(), {c: part.column(f"_{c}").to_pylist() for c in filters}
                for asked in lanes:
                    asked.add(np.arange(len(asked.ids)), x, keys, values)
        for asked in lanes:
            found = asked.found()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found[1:], shape)], schema=shape)

    rows = corpus.filter(F.col("embedding").isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(f"_{c}") for c in filters], "embedding")
    return top_per_group(rows.mapInArrow(run, out_type), ["query_id"], [F.desc("score"), F.asc_nulls_last(key)], k)
