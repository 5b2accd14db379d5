"""Jaccard join in metric space: pivots, Voronoi regions, windows by the triangle inequality.

A document is the set of its distinct three-word shingles; equal sets are one node.  1 - similarity is a metric d, and
two nodes link when d <= e (e = 0.1).  The join goes down in regions and is exact at every step:

1. The first pivots are single shingles.  Nearly all documents of a corpus are at distance 1 from each other, where
   windows around document pivots hold everything; a shingle is near only to the documents that have it.  In one order
   of all shingles (rare ones first by hashed counts of the whole corpus), a node's home is its first shingle, and
   since a linked node can lack at most a tenth of its shingles, its window is its first ``n - ceil(0.9 n) + 1``
   shingles: linked nodes share one of these.  Regions with one node and repeated regions go.  So do nodes without a
   partner in reach: shingles folded into ``FOLDS`` counts give a vector whose L1 distance to another one is at most
   the number of shingles in which the two sets differ, and linked sets differ in few.
2. Regions of more than ``TILE`` nodes are split by ``PIVOTS`` of their documents.  A node's home is the nearest pivot
   p; it also goes to every pivot q with d(x, q) <= d(x, p) + 2 e.  For linked x and y this holds for y at x's home,
   so they meet there.  Nodes linked to one pivot have one root and need no look at each other.  Regions so made are
   split again; one whose parts would be nearly as large as itself (its nodes are equally far from each other) is cut
   into tiles of which every two meet.
3. A task splits its regions the same way in memory down to ``LEAF`` nodes and counts all intersections there.

Tasks return edges that join components, not pairs.  Order and pivots change the work, never the result; contents are
told apart by 64-bit hashes of shingles and 128-bit hashes of sets.

Nulls, empty texts: no set, linked with nothing.  Fewer than three words: the whole sequence is the one shingle.
Repeated rows and ids: one component with the smallest id; a null doc_id is never the smallest unless all are null.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, parts_of, row_key, stored, whole_text
from filinglens.llm.kernel import U, mix, shingle_sets
from filinglens.llm.lanes import laid, streamed
from filinglens.llm.links import component_sql, components, labelled
from filinglens.llm.tiles import TILE, common, edges_in, joining, linked_to_hubs, merged, regions_of, sets_of, similar, tile_edges, tiles_of
from filinglens.operators.ordering import top_per_group

WORDS, PERCENT = 3, 90
SLOTS, CHUNK = 1 << 20, 1 << 14
FOLDS = 256
PIVOTS, LEAF, STUCK = 16, 64, 0.8


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(20)).astype(np.int64) & (SLOTS - 1)


def shingle_counts(docs: DataFrame, width: int = WORDS) -> np.ndarray:
    """How many shingle sets of the corpus fall on each of ``SLOTS`` hashed slots: 4 MB whatever the corpus."""
    def count(batches):
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, buf, offsets in blocks(batch.column("text")):
                for s in shingle_sets(buf, offsets, width):
                    if len(s) > SLOTS // 8:
                        held += np.bincount(_slots(s), minlength=SLOTS)
                    else:
                        np.add.at(held, _slots(s), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS // CHUNK), pa.int32()), pa.array([part.tobytes() for part in held.reshape(-1, CHUNK)])], ["chunk", "counts"])

    def add(batches):
        held = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                held[chunk] = held.get(chunk, 0) + np.frombuffer(data, np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([np.minimum(v, np.iinfo(np.int32).max).astype(np.int32).tobytes() for v in held.values()])], ["chunk", "counts"])

    parts = docs.select(whole_text().alias("text")).mapInArrow(count, "chunk int, counts binary").repartition(parts_of(docs.sparkSession), "chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(SLOTS, np.int32).reshape(-1, CHUNK)
    for row in parts.collect():
        out[row.chunk] = np.frombuffer(row.counts, np.int32)
    return out.reshape(-1)


def signed(docs: DataFrame, counts: np.ndarray, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, k1, k2, n_shingles, node (128-bit hash of the set), folded (counts of its shingles), window (those among which linked sets share one)."""
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts = held.value
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                sets = shingle_sets(buf, offsets, width)
                nodes, folded, windows = [], [], []
                for s in sets:
                    if not len(s):
                        nodes.append(None)
                        folded.append(None)
                        windows.append(None)
                        continue
                    nodes.append(np.array([mix(s).sum(), mix(s ^ U(0x5555555555555555)).sum()], ">u8").tobytes())
                    folded.append(np.minimum(np.bincount((s >> U(56)).astype(np.int64), minlength=FOLDS), 255).astype(np.uint8).tobytes())
                    take = len(s) - -(-percent * len(s) // 100) + 1
                    order = counts[_slots(s)]
                    if take < len(s):
                        first = np.flatnonzero(order <= np.partition(order, take - 1)[take - 1])
                        s = s[first][np.lexsort((s[first], order[first]))[:take]]
                    windows.append(s.view(np.int64))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "k1", "k2")], pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(folded, pa.binary()), pa.array(windows, pa.list_(pa.int64()))],
                                                 ["doc_id", "k1", "k2", "n_shingles", "node", "folded", "window"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, k1 long, k2 long, n_shingles long, node binary, folded binary, window array<long>")


def reached(distance: np.ndarray, percent: int) -> np.ndarray:
    """To which pivots each node goes, by its distances to all of them: its home and its window."""
    return distance <= distance.min(1, keepdims=True) + 2 * (1 - percent / 100) + 1e-9


def voronoi_edges(sets: list[np.ndarray], roots: np.ndarray, cut: int, percent: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Edges of a tile, its one side split by pivots again and again; tiles of two sides are counted whole."""
    if cut < len(sets):
        return tile_edges(sets, roots, cut, percent)
    sizes, roots, edges = np.array([len(s) for s in sets], np.int64), roots.copy(), []

    def join(rows, others):
        shared = common(sets, rows, others)
        links = similar(shared, sizes[rows], sizes[others], percent) & (roots[rows][:, None] != roots[others][None, :])
        for i, j in joining(links, roots, rows, others):
            edges.append((i, j))
            roots[roots == roots[j]] = roots[i]
        return 1 - shared / (sizes[rows][:, None] + sizes[others][None, :] - shared)

    regions = [np.arange(len(sets))]
    while regions:
        rows = regions.pop()
        if len(np.unique(roots[rows])) < 2:
            continue
        if len(rows) <= leaf:
            join(rows, rows)
            continue
        distance = join(rows, rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(np.int64)])
        cells = [rows[inside] for inside in reached(distance, percent).T]
        if max(map(len, cells)) > STUCK * len(rows):
            join(rows, rows)
        else:
            regions += cells
    return edges


def split(regions: DataFrame, sets: DataFrame, level: int, percent: int = PERCENT) -> DataFrame:
    """Members of the regions around ``PIVOTS`` documents of each region: region, node, root, n, was (nodes of the region before)."""
    picked = top_per_group(regions, ["region"], [F.xxhash64(F.lit(level), "node"), F.col("node")], PIVOTS).select("region", "node").join(sets, "node")
    lanes = picked.groupBy(F.col("region").alias("lane")).agg(F.struct(F.sort_array(F.collect_list(F.struct("node", "set"))).alias("pivots")).alias("small"))
    rows = regions.select("region", "node", "root", "n", "m").join(sets, "node").select(
        F.col("region").alias("lane"), F.xxhash64("node").alias("name"), F.struct("node", "root", "n", "m", "set").alias("large"))
    most = regions.agg(F.max("m")).first()[0]

    def begin(lane, small):
        pivots = [np.frombuffer(p["set"], np.uint64) for p in small["pivots"]]
        tokens = np.unique(np.concatenate(pivots))
        return lane, [p["node"] for p in small["pivots"]], tokens, np.stack([np.isin(tokens, p) for p in pivots]), np.array([len(p) for p in pivots])

    def step(state, row):
        lane, names, tokens, have, sizes = state
        mine = np.frombuffer(row["set"], np.uint64)
        at = np.minimum(np.searchsorted(tokens, mine), len(tokens) - 1)
        shared = have[:, at[tokens[at] == mine]].sum(1)
        linked = [names[p] for p in np.flatnonzero((shared > 0) & (100 * shared >= percent * (sizes + len(mine) - shared)))]
        root = min([row["root"], *linked]) if linked else row["root"]
        to = np.flatnonzero(reached((1 - shared / (sizes + len(mine) - shared))[None, :], percent)[0])
        edges = [x for x in linked if x != row["node"]]
        n = len(to) + len(edges)
        return [[lane] * n, [int(p) for p in to] + [None] * len(edges), [row["node"]] * n, [root] * len(to) + edges, [row["n"]] * n, [row["m"]] * n]

    shape = pa.schema([("lane", pa.int64()), ("pivot", pa.int32()), *[(c, pa.int64()) for c in ("node", "root", "n", "was")]])
    return streamed(laid(lanes, rows, max(1, -(-most // 4096))), begin, step, lambda state: None, shape, "lane long, pivot int, node long, root long, n long, was long")


def first_regions(nodes: DataFrame) -> DataFrame:
    """Regions around single shingles, as ``regions_of`` gives them: those with several nodes, once for equal ones."""
    rows = nodes.select(F.explode("window").alias("region"), "node", "n")
    held = rows.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("m > 1")
    once = stored(held.groupBy("m", "x", "weight").agg(F.min("region").alias("region")).select("region", "m", "weight"), "region-names")
    return stored(rows.join(once, "region").select("region", "node", "n", F.col("node").alias("root"), "m", "weight"), "regions")


def within_reach(regions: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``regions`` whose node has a partner that its folded counts don't rule out; a region is read in one task."""
    def partners(rows):
        size = np.array([r[2] for r in rows], np.int64)
        counts = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), FOLDS).astype(np.int16)
        some = np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            apart = np.abs(counts[i + 1 :] - counts[i]).sum(1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * (size[i] + size[i + 1 :])
            if near.any():
                some[i] = True
                some[i + 1 :] |= near
        return [(rows[i][0], rows[i][1], rows[i][2]) for i in np.flatnonzero(some)]

    def run(batches):
        held = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("region", "node", "n", "folded"))):
                if held and held[0][0] != row[0]:
                    out += partners(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["region", "node", "n"])
        if held and (out := partners(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["region", "node", "n"])

    rows = regions.select("region", "node", "n").join(nodes.select("node", "folded"), "node")
    rows = rows.repartition(parts_of(regions.sparkSession), "region").sortWithinPartitions("region", "node")
    return rows.select("region", "node", "n", "folded").mapInArrow(run, "region long, node long, n long").withColumn("root", F.col("node"))


def clustered(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of all rows, and (node, root) of the nodes that have links."""
    spark = docs.sparkSession
    bounded_batches(spark)
    signatures = stored(signed(docs, shingle_counts(docs, width), width, percent), "signatures")
    distinct = signatures.filter("node IS NOT NULL").dropDuplicates(["node"]).withColumnRenamed("node", "content")
    nodes = stored(distinct.select("content", F.monotonically_increasing_id().alias("node"), "k1", "k2", F.col("n_shingles").alias("n"), "folded", "window"), "nodes")
    first = first_regions(nodes)
    small = F.col("m") <= tile
    near = stored(within_reach(first.filter(small), nodes, percent), "reach")
    regions = regions_of(near.unionByName(first.filter(~small).select("region", "node", "n", "root")))
    sets = stored(sets_of(docs, nodes.select("node", "k1", "k2").join(regions.select("node").distinct(), "node", "left_semi"), width), "sets")
    # The first node of a region is its first pivot: what links with it needs no look at each other.
    hubs = regions.join(regions.groupBy("region").agg(F.min("node").alias("hub")), "region").filter("node <> hub").select("node", "hub").distinct()
    links = stored(linked_to_hubs(stored(hubs, "hubs"), sets, percent), "links")
    roots = stored(components(links), "roots")
    regions = regions.select("region", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    regions = merged(regions_of(regions), tile)
    done, large, level = regions.filter(small), regions.filter(~small), 0
    while not large.isEmpty():
        parted = stored(split(large, sets, level, percent), "split")
        links = links.unionByName(parted.filter("pivot IS NULL").select(F.col("node").alias("u"), F.col("root").alias("v")))
        cells = parted.filter("pivot IS NOT NULL")
        held = cells.groupBy("lane", "pivot").agg(F.count("*").alias("m"), F.max("was").alias("was"))
        stuck = stored(held.filter(F.col("m") > STUCK * F.col("was")).select(F.col("lane").alias("region")).distinct(), "stuck")
        done = done.unionByName(large.join(stuck, "region", "left_semi"))
        cells = cells.withColumnRenamed("lane", "region").join(stuck, "region", "left_anti")
        made = regions_of(cells.select(F.xxhash64(F.lit(level), "region", "pivot").alias("region"), "node", "root", "n"))
        done = done.unionByName(made.filter(small))
        large, level = made.filter(~small), level + 1
    links = stored(links.unionByName(edges_in(tiles_of(done, tile), sets, percent, voronoi_edges)), "edges")
    numbered = signatures.select("doc_id", "n_shingles", F.col("node").alias("content")).join(nodes.select("content", "node"), "content", "left")
    return numbered, stored(components(links), "roots")


def joined(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return labelled(*clustered(docs, **options))


def op12_voronoi_regions(spark, sf_dir):
    return joined(documents(spark, sf_dir))


QUERIES = {"op12_voronoi_regions": op12_voronoi_regions}
SQL = {"op12_voronoi_regions": component_sql(WORDS, PERCENT)}
