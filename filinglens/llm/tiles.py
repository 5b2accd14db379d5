"""Links between full sets inside regions of any size, without a pair of a region leaving its task unconfirmed.

A region is a group of nodes of which any two may link.  Each node carries the root of what it is known to be
connected with; pairs of one root need no look.  Regions with one root are done, regions of equal members count once,
and regions that overlap much are put together.
A region that is small enough is one tile.  A larger one is cut into parts, each component larger than a tile into
parts of its own, and every two parts meet in a tile, but for those of one component.  The sets of a tile's nodes
stand next to the tile; a tile counts the intersections of all its pairs at once and returns the edges that join
components: never more than it has nodes times the steps of the joining, however many pairs link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, parts_of, row_key, stored, whole_text
from filinglens.llm.kernel import shingle_sets
from filinglens.llm.links import components

TILE, TILE_ITEMS = 512, 1 << 21
WORTH_ITEMS = 1 << 24
BROADCAST_KEYS = 1 << 18
COLUMNS = 4096


def sets_of(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(node, set) for ``keys`` (node, k1, k2), one text of each node; a set is its sorted 64-bit shingle hashes.

    Up to ``BROADCAST_KEYS`` counted keys go to the texts (10 MB), so that only wanted texts travel; more meet them by an ordinary join.
    """
    keys = stored(keys, "keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.select(*row_key(), whole_text().alias("text")).join(keys, ["k1", "k2"]).select("node", "text").dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(buf, offsets, width)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array(sets, pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, f"node {docs_type(keys)}, set binary")


def docs_type(frame: DataFrame, column: str = "node") -> str:
    return frame.schema[column].dataType.simpleString()


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), np.int64)
    rows = np.concatenate([left, right]) if left is not right else left
    tokens = np.concatenate([sets[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    which = np.cumsum(new) - 1
    shared = np.bincount(which)[which] > 1  # what only one row has adds nothing
    which, owner = which[shared], owner[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    for lo in range(0, len(starts), COLUMNS):
        a, b = starts[lo], starts[lo + COLUMNS] if lo + COLUMNS < len(starts) else len(which)
        have = np.zeros((len(rows), COLUMNS), np.float32)
        have[owner[a:b], np.cumsum(np.diff(which[a:b], prepend=which[a] if a < b else 0) != 0)] = 1
        out += have[: len(left)] @ (have[len(left):] if left is not right else have).T
    return out.astype(np.int64)


def joining(links: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges among ``links`` (left x right) that connect what is connected by them, given what has one root already."""
    group = np.unique(roots, return_inverse=True)[1]
    label = np.arange(group.max(initial=-1) + 1)
    edges: list[tuple[int, int]] = []
    active = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    links = links[np.ix_(*active)]
    left, right = left[active[0]], right[active[1]]
    if not links.size:
        return edges
    far = len(label)
    while True:
        before = len(edges)
        for a, b, m in ((left, right, links), (right, left, links.T)):
            theirs = np.where(m, label[group[b]][None, :], far)
            at = theirs.argmin(1)
            best = theirs[np.arange(len(a)), at]
            order = np.argsort(best, kind="stable")
            first = np.unique(group[a][order], return_index=True)[1]
            for k in order[first].tolist():
                if best[k] < label[group[a[k]]]:
                    label[group[a[k]]] = best[k]
                    edges.append((int(a[k]), int(b[at[k]])))
        if len(edges) == before:
            return edges


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (shared > 0) & (100 * shared >= percent * (a[:, None] + b[None, :] - shared))


def tile_edges(sets: list[np.ndarray], roots: np.ndarray, cut: int, percent: int) -> list[tuple[int, int]]:
    """Edges of one tile: between the rows before ``cut`` and those from it on, or among all rows if it is at the end."""
    rows = np.arange(len(sets))
    left, right = rows[:cut], rows[cut:] if cut < len(sets) else rows[:cut]
    sizes = np.array([len(s) for s in sets], np.int64)
    if cut == len(sets):
        right = left
    links = similar(common(sets, left, right), sizes[left], sizes[right], percent) & (roots[left][:, None] != roots[right][None, :])
    return joining(links, roots, left, right)


def regions_of(members: DataFrame) -> DataFrame:
    """Stored ``members`` (region long, node, root, n = set size) of regions with several roots, once for equal regions, with m nodes and weight items each."""
    regions = members.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min(F.xxhash64("root")).alias("a"), F.max(F.xxhash64("root")).alias("b"),
                                            F.bit_xor(F.xxhash64("node", "root")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node", "root")).alias("y")).filter("a != b")
    regions = regions.groupBy("m", "x", "y").agg(F.min(F.struct("region", "weight")).alias("r")).select("r.region", "m", "r.weight")
    return stored(members.join(regions, "region"), "regions")


def merged(regions: DataFrame, tile: int = TILE, worth_items: int = WORTH_ITEMS) -> DataFrame:
    """``regions`` with those that overlap put together where that makes less work; every two nodes of a region still share one.

    Regions that hang together by their nodes form a whole of N nodes.  As one region its nodes travel once for every
    part they meet; if the regions by themselves have more rows than that, the whole replaces them.  To find the wholes
    takes several rounds over all regions, which pays from ``WORTH_ITEMS`` items of sets (128 MB) on.
    """
    if (regions.agg(F.sum("n")).first()[0] or 0) < worth_items:
        return regions
    hubs = regions.groupBy("region").agg(F.min("node").alias("v"))
    star = stored(regions.join(hubs, "region").select(F.col("node").alias("u"), "v").filter("u <> v").distinct(), "stars")
    whole = stored(components(star).withColumnRenamed("root", "whole"), "wholes")
    placed = regions.join(whole, "node")
    sizes = placed.groupBy("whole").agg(F.count("*").alias("rows"), F.countDistinct("node").alias("nodes"))
    worth = stored(sizes.filter(F.col("rows") > 1.5 * F.col("nodes") * F.ceil(F.col("nodes") / tile)).select("whole"), "worth")
    placed = placed.join(worth.withColumn("one", F.lit(True)), "whole", "left").withColumn("region", F.when(F.col("one"), F.xxhash64("whole")).otherwise(F.col("region")))
    return regions_of(stored(placed.select("region", "node", "root", "n").distinct(), "merged"))


def tiles_of(regions: DataFrame, tile: int = TILE, items: int = TILE_ITEMS) -> DataFrame:
    """(tile, side, node, root) for the rows of ``regions_of``."""
    whole = (F.col("m") <= tile) & (F.col("weight") <= items)
    laid = regions.filter(whole).select(F.col("region").alias("tile"), F.lit(0).alias("side"), "node", "root")
    large = regions.filter(~whole).select("region", "node", "root", "n")
    if large.isEmpty():
        return laid
    held = large.groupBy("region", "root").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    own = F.when((F.col("m") > tile) | (F.col("weight") > items), F.xxhash64("root")).otherwise(F.lit(0).cast("long"))
    held = held.withColumn("own", own)
    cuts = F.greatest(F.ceil(F.sum("m") / tile), F.ceil(F.sum("weight") / items)).cast("int")
    numbered = large.join(held.select("region", "root", "own"), ["region", "root"]).join(held.groupBy("region", "own").agg(cuts.alias("cuts")), ["region", "own"])
    numbered = stored(numbered.select("region", F.struct("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("part")).alias("at"), "node", "root"), "parts")
    parts = stored(numbered.select("region", "at").distinct(), "part-names")
    meet = parts.withColumnRenamed("at", "x").join(parts.withColumnRenamed("at", "y"), "region").filter("x <= y").filter("x.own != y.own OR x.own = 0")
    meet = stored(meet.withColumn("tile", F.xxhash64("region", "x", "y")), "tiles")
    for side, which in enumerate("xy"):
        some = meet.filter("x != y") if side else meet
        laid = laid.unionByName(some.select("region", "tile", F.col(which).alias("at")).join(numbered, ["region", "at"]).select("tile", F.lit(side).alias("side"), "node", "root"))
    return laid


def edges_in(laid: DataFrame, sets: DataFrame, percent: int, edges=tile_edges) -> DataFrame:
    """Edges (u, v) that the tiles of ``laid`` (tile, side, node, root) find."""
    kind = docs_type(laid)
    rows = laid.join(sets, "node").repartition(parts_of(laid.sparkSession), "tile").sortWithinPartitions("tile", "side", "node")

    def found(held):
        node = [r[1] for r in held]
        at = edges([np.frombuffer(r[3], np.uint64) for r in held], np.unique([r[2] for r in held], return_inverse=True)[1], sum(r[0] == 0 for r in held), percent)
        return [(min(node[i], node[j]), max(node[i], node[j])) for i, j in at]

    def run(batches):
        held, tile = [], None
        for batch in batches:
            out = []
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "node", "root", "set"))):
                if name != tile:
                    out += found(held)
                    held, tile = [], name
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in out], schema)
        if out := found(held):
            yield pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in out], schema)

    schema = pa.schema([(c, pa.binary() if kind == "binary" else pa.int64()) for c in "uv"])
    return rows.select("tile", "side", "node", "root", "set").mapInArrow(run, f"u {kind}, v {kind}")


def linked_to_hubs(pairs: DataFrame, sets: DataFrame, percent: int, share: int = 2048) -> DataFrame:
    """The pairs (node, hub) whose sets link, as (u, v).  A row carries one set; a hub stands before up to ``share`` nodes at a time."""
    kind = docs_type(pairs)
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
    hubs = counts.join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("node"), "set")
    others = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("part"), F.lit(1).alias("side"), "node").join(sets, "node")
    rows = hubs.unionByName(others).repartition(parts_of(pairs.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "side")

    def run(batches):
        hub = None
        for batch in batches:
            linked = []
            for side, data in zip(batch.column("side").to_pylist(), batch.column("set").to_pylist()):
                mine = np.frombuffer(data, np.uint64)
                if side == 0:
                    hub = mine
                    linked.append(False)
                    continue
                least, most = sorted((len(mine), len(hub)))
                shared = 0
                if 100 * least >= percent * most:
                    at = np.searchsorted(hub, mine)
                    shared = int((hub[np.minimum(at, len(hub) - 1)] == mine).sum())
                linked.append(shared > 0 and 100 * shared >= percent * (least + most - shared))
            keep = batch.filter(pa.array(linked))
            yield pa.RecordBatch.from_arrays([keep.column("node"), keep.column("hub")], ["u", "v"])

    return rows.select("hub", "part", "side", "node", "set").mapInArrow(run, f"u {kind}, v {kind}")
