"""MinHash near-deduplication with an LSH forest.

A text's set are its distinct five-word shingles.  Equal sets are one node.  Each of ``TREES`` orders sorts all
nodes by their MinHash values, starting at another value: a region is a run of nodes that agree in the first
``DEPTH`` values.  The orders are laid out by range partitioning, so a large region covers many tasks.

Candidates are found in two waves, both confirmed on the full sets:

1. each node with the first nodes of its regions, and with the neighbour in some order that shares the longest
   prefix with it, if their sketches (``SKETCH`` MinHash values) agree in ``LIKELY`` of their places.  Near copies of
   one text, however many, become one component or a few.  Each node is tried with its ``TRIES`` likeliest partners, so
   that components grow together; the others stand in its regions too;
2. regions that still hold several components go whole to tiles (``tiles``): the sets of a tile's nodes stand next to
   it, all pairs of different components are counted there, and only edges that join components leave the task.
   Regions with equal members count once; large ones are cut into parts of which every two meet.

At similarity s a pair shares a region of some order with probability 1 - (1 - s**4)**24: 0.9999 at 0.75, 0.999997 at
0.8.  The tiles of a region are quadratic in its nodes outside one component, their output is not.

Nulls, empty texts: no set, linked with nothing, kept.  Repeated rows: same component; by the digest each of
them is kept if its doc_id is the smallest.  A null doc_id is never the smallest unless all are null.  An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, parts_of, row_key, stored, whole_text
from filinglens.llm.kernel import U, mix, shingle_sets
from filinglens.llm.links import component_sql, components, labelled
from filinglens.llm.tiles import TILE, edges_in, linked_to_hubs, merged, regions_of, sets_of, tiles_of
from filinglens.operators.ordering import top_per_group

WORDS = 5
PERCENT = 75
TREES, DEPTH, DEEPER = 24, 4, 8
SKETCH, LIKELY, TRIES = 256, 0.63, 3


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return seed[:n] | U(1), seed[n:]


def signed(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, k1, k2, n_shingles, node (128-bit hash of the set), heads and tails (first and further values by order), sketch (all values)."""
    def run(batches):
        a, b = _coefficients(SKETCH)
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                sets = shingle_sets(buf, offsets, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                nodes, heads, tails, sketches = ([None] * len(sets) for _ in range(4))
                if len(full):
                    values = np.concatenate(sets)
                    at = np.cumsum(sizes[full]) - sizes[full]
                    key = np.stack([np.add.reduceat(mix(values), at), np.add.reduceat(mix(values ^ U(0x5555555555555555)), at)], 1).astype(">u8")
                    least = np.stack([np.minimum.reduceat((values * x + y) >> U(32), at) for x, y in zip(a, b)], 1)
                    around = np.concatenate([least[:, : TREES * DEPTH], least[:, : DEPTH + DEEPER], least[:, TREES * DEPTH :]], 1)
                    head = np.zeros((len(full), TREES), U)
                    for d in range(DEPTH):
                        head = mix(head * U(0x9E3779B97F4A7C15) + least[:, d : TREES * DEPTH : DEPTH])
                    short = (mix(around) >> U(48)).astype(">u2")
                    sketch = np.delete(short, np.s_[TREES * DEPTH : TREES * DEPTH + DEPTH + DEEPER], axis=1)
                    for row, i in enumerate(full):
                        nodes[i] = key[row].tobytes()
                        heads[i] = head[row].view(np.int64)
                        sketches[i] = sketch[row].tobytes()
                        tails[i] = [short[row, t * DEPTH + DEPTH : t * DEPTH + DEPTH + DEEPER].tobytes() for t in range(TREES)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "k1", "k2")], pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                                                  pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.binary())), pa.array(sketches, pa.binary())],
                                                 ["doc_id", "k1", "k2", "n_shingles", "node", "heads", "tails", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, k1 long, k2 long, n_shingles long, node binary, heads array<long>, tails array<binary>, sketch binary")


def _scan(batches):
    """Walk sorted (tree, head, tail, node): every node of a region of several, with the region's first node and its predecessor.

    ``edge`` marks the regions that touch the border of the task's range; their first nodes are linked afterwards.
    """
    last = None  # tree, head, tail, node, pivot, pred, pred_tail, joined, edge
    out: list[tuple] = []

    def batch_of(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:6]], pa.array(cols[6], pa.int32()), pa.array(cols[7], pa.bool_())],
                                          ["tree", "head", "tail", "node", "pivot", "pred", "shared", "edge"])

    def shared(x: bytes, y: bytes) -> int:
        k = 0
        while k < len(x) and x[k : k + 2] == y[k : k + 2]:
            k += 2
        return DEPTH + k // 2

    for batch in batches:
        for tree, head, tail, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "head", "tail", "node"))):
            if last is not None and last[0] == tree and last[1] == head:
                if last[3] == node:
                    continue
                row = (tree, head, tail, node, last[4], last[3], shared(tail, last[2]), True, last[8])
                out.append(last[:7] + (last[8],))
            else:
                if last is not None and (last[7] or last[8]):
                    out.append(last[:7] + (last[8],))
                row = (tree, head, tail, node, node, None, 0, False, last is None)
            last = row
            if len(out) >= 4000:
                yield batch_of(out)
                out = []
    if last is not None:
        out.append(last[:7] + (True,))
    if out:
        yield batch_of(out)


def forest(signatures: DataFrame) -> DataFrame:
    """Members of all regions with at least two nodes, and the rows at the borders of the ranges."""
    spark = signatures.sparkSession
    n = parts_of(spark)
    rows = signatures.filter("node is not null").select("node", F.posexplode(F.arrays_zip("heads", "tails")).alias("tree", "at")).select(
        "tree", F.col("at.heads").alias("head"), F.col("at.tails").alias("tail"), "node")
    keys = ["tree", "head", "tail", "node"]
    laid = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return laid.mapInArrow(_scan, "tree int, head long, tail binary, node binary, pivot binary, pred binary, shared int, edge boolean")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, SKETCH)


def promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (node, hub) whose sketches agree often enough, and in how many places."""
    both = pairs.join(sketches.select("node", F.col("sketch").alias("a")), "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("b")), "hub")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                agree = (_sketches(batch.column("a")) == _sketches(batch.column("b"))).sum(1)
                keep = pa.array(agree >= LIKELY * SKETCH)
                yield batch.select(["node", "hub"]).append_column("agree", pa.array(agree, pa.int64())).filter(keep)

    return both.select("node", "hub", "a", "b").mapInArrow(run, "node binary, hub binary, agree long")


def _rooted(rows: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """``rows`` with the root of ``node``; without links a node is its own."""
    known = roots.select(F.col("node").alias(node), F.col("root").alias("known"))
    return rows.join(known, node, "left").withColumn(root, F.coalesce("known", node)).drop("known")


def clustered(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (node, root) of the nodes that have links."""
    spark = docs.sparkSession
    bounded_batches(spark)
    signatures = stored(signed(docs, width), "signatures")
    members = stored(forest(signatures), "forest")
    nodes = stored(signatures.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("k1", "k2")).alias("k"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).select("node", "k.k1", "k.k2", "n", "sketch"), "nodes")

    def sets_for(some):
        return stored(sets_of(docs, nodes.select("node", "k1", "k2").join(some, "node", "left_semi"), width), "sets")

    border = members.filter("edge").select("tree", "head", "pivot").distinct()
    across = border.join(border.groupBy("tree", "head").agg(F.min("pivot").alias("hub")), ["tree", "head"]).select(F.col("pivot").alias("node"), "hub")
    nearest = members.filter("pred is not null").groupBy("node").agg(F.max(F.struct("shared", "pred")).alias("best")).select("node", F.col("best.pred").alias("hub"))
    wave = members.select("node", F.col("pivot").alias("hub")).unionByName(across).unionByName(nearest).filter("node != hub").distinct()
    wave = stored(promising(wave, nodes), "wave")
    sets = sets_for(wave.select("node").unionByName(wave.select(F.col("hub").alias("node"))).distinct())
    first = top_per_group(wave, ["node"], [F.desc("agree"), F.col("hub")], TRIES).select("node", "hub")
    links = stored(linked_to_hubs(first, sets, percent), "links")
    roots = stored(components(links), "roots")
    regions = regions_of(_rooted(members.select(F.xxhash64("tree", "head").alias("region"), "node").join(nodes.select("node", "n"), "node"), roots))
    regions = merged(regions, tile)
    edges = stored(edges_in(tiles_of(regions, tile), sets_for(regions.select("node").distinct()), percent), "edges")
    if not edges.isEmpty():
        roots = stored(components(links.unionByName(edges)), "roots")
    return signatures, roots


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return labelled(*clustered(docs, **options)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns: one of each component (smallest doc_id) and all without a set."""
    signatures, roots = clustered(docs, **options)
    named = signatures.select("doc_id", "k1", "k2", "node").join(roots, signatures["node"] == roots["node"], "left").select(
        "doc_id", "k1", "k2", F.coalesce(roots["root"], signatures["node"]).alias("root"))
    # Nulls come last; of equal ids the smaller key, so that one row key stays for each component.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    keep = named.filter("root is not null").groupBy("root").agg(F.min(order).alias("m"), F.count("*").alias("n")).select("m.k1", "m.k2", "n")
    bare = named.filter("root is null").select("k1", "k2").distinct().select("k1", "k2", F.lit(0).cast("long").alias("n"))
    rows = docs.select(*row_key(), F.struct("*").alias("row")).join(keep.unionByName(bare), ["k1", "k2"])
    copies = rows.filter("n > 1").groupBy("k1", "k2").agg(F.count("*").alias("c")).filter("c > 1").select("k1", "k2")
    repeated = rows.filter("n > 1").join(copies, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return rows.join(copies, ["k1", "k2"], "left_anti").select("row.*").unionByName(repeated.select("row.*"))


def op3_lsh_forest(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op3_lsh_forest": op3_lsh_forest}
SQL = {"op3_lsh_forest": component_sql(WORDS, PERCENT, ", doc_id IS NOT DISTINCT FROM component_id AS kept")}
