"""The metric-space join against all pairs."""

import random

import numpy as np
import pytest

from filinglens.llm import near, regions, tiles
from test_dedup import shingles

SCHEMA = "doc_id long, text string, region string, node string, root string, window string"


def components_of(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = set()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                pair = ids[b], ids[a]
                if pair not in seen and find(pair[0]) != find(pair[1]):
                    seen.add(pair)
                    x, y = sets[pair[0]], sets[pair[1]]
                    if 100 * len(x & y) >= percent * len(x | y):
                        root[find(pair[0])] = find(pair[1])
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(str((doc, len(sets[i]), least.get(find(i)))) for i, (doc, _) in enumerate(rows))


def family(seed, size, words, changes):
    """Variants of one text with up to ``changes`` words exchanged."""
    r = random.Random(seed)
    base = [f"b{seed}x{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(words)] = f"n{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def corpus():
    r = random.Random(3)
    texts = family(1, 60, 120, 2) + family(2, 60, 90, 8) + family(3, 40, 40, 1) + family(4, 30, 300, 12)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"o{r.randrange(10**7)}" for _ in range(r.choice([2, 3, 5, 60]))) for _ in range(50)]
    texts += ["a b", "A b", "a", "", None, "a b c", "a  b\tc", " ", texts[0], texts[0].upper()]
    rows = list(enumerate(texts))
    return rows + rows[:5] + [(None, texts[1]), (None, "only here without id"), (None, None)]


def got(out):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in out.collect())


@pytest.mark.parametrize("tile", [512, 20])
def test_equals_all_pairs(spark, odd, none, tile, monkeypatch):
    monkeypatch.setattr(regions, "PIVOTS", 6)
    rows = corpus()
    docs = spark.createDataFrame([(*x, "", "", "", "") for x in rows], SCHEMA)
    out = regions.joined(docs, tile=tile)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and got(out) == components_of(rows, 3, 90)
    if tile == 20:
        rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
        assert got(regions.joined(odd, tile=tile)) == components_of(rows, 3, 90)
        assert regions.joined(none).collect() == []


def some_sets(seed, n, items, changes):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 10**9, items)
    out = []
    for _ in range(n):
        s = base.copy()
        s[rng.integers(0, items, rng.integers(0, changes + 1))] = rng.integers(0, 10**9, 1)
        out.append(np.unique(s).astype(np.uint64))
    return out


def groups(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        root[find(i)] = find(j)
    return [frozenset(j for j in range(n) if find(j) == find(i)) for i in range(n)]


@pytest.mark.parametrize("percent", [75, 90])
@pytest.mark.parametrize("changes", [1, 6, 30])
def test_tiles_and_pivots_join_the_same(percent, changes):
    sets = some_sets(changes, 150, 80, changes) + some_sets(99, 100, 60, 3)
    n = len(sets)
    every = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
    whole = tiles.tile_edges(sets, np.arange(n), n, percent)
    assert groups(n, whole) == groups(n, every) and len(whole) < 4 * n and set(map(frozenset, whole)) <= set(map(frozenset, every))
    assert groups(n, regions.voronoi_edges(sets, np.arange(n), n, percent, leaf=20)) == groups(n, every)
    cut = 70
    across = [(i, j) for i, j in every if (i < cut) != (j < cut)]
    assert groups(n, tiles.tile_edges(sets, np.arange(n), cut, percent)) == groups(n, across)
    roots = np.arange(n) // 3
    known = [(i, i - 1) for i in range(n) if i % 3]
    assert groups(n, tiles.tile_edges(sets, roots, n, percent) + known) == groups(n, every + known)


def test_windows_hold_every_linked_pair():
    """Linked sets meet in the home region of each of them, whatever the pivots."""
    sets = some_sets(5, 200, 60, 12)
    sizes = np.array([len(s) for s in sets])
    rows = np.arange(len(sets))
    shared = tiles.common(sets, rows, rows)
    distance = 1 - shared / (sizes[:, None] + sizes[None, :] - shared)
    pivots = rows[::17]
    inside, home = regions.reached(distance[:, pivots], 90), distance[:, pivots].argmin(1)
    for x, y in zip(*np.nonzero(distance <= 0.1)):
        assert inside[y, home[x]] and inside[x, home[x]]
    assert inside.sum() < inside.size


def test_tiles_of_two_sides_and_many_parts(spark):
    """A region far above the tile size, cut into parts, loses no link, and edges stay few."""
    texts = family(8, 300, 100, 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near.signed(docs).filter("node is not null").dropDuplicates(["node"]).cache()
    sets = tiles.sets_of(docs, rows.select("node", "k1", "k2"), 5)
    from pyspark.sql import functions as F

    members = rows.select(F.lit(1).cast("long").alias("region"), "node", F.col("node").alias("root"), F.col("n_shingles").alias("n"))
    laid = tiles.tiles_of(tiles.regions_of(members), tile=40)
    assert laid.groupBy("tile").count().agg(F.max("count")).first()[0] < 140
    edges = [(r.u, r.v) for r in tiles.edges_in(laid, sets, 75).collect()]
    name = {r.node: r.doc_id for r in rows.collect()}
    held = [(i, texts[i]) for i in sorted(name.values())]
    root = {i: i for i, _ in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = sorted((find(name[u]), find(name[v])))
        root[b] = a
    assert sorted(str((i, len(shingles(t, 5)), find(i))) for i, t in held) == components_of(held, 5, 75)


def test_folded_counts_rule_out_no_link(spark):
    """Nodes that go have no linked partner in the region; far ones do go."""
    from pyspark.sql import functions as F

    texts = family(21, 30, 200, 6) + family(22, 3, 4000, 30) + [" ".join(f"f{i}x{k}" for k in range(150)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = regions.signed(docs, np.zeros(regions.SLOTS, np.int32)).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "folded").cache()
    stay = {r.node for r in regions.within_reach(nodes.withColumn("region", F.lit(1).cast("long")), nodes).collect()}
    sets = [shingles(t, 3) for t in texts]
    linked = {i for i in range(len(texts)) if any(i != j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) for j in range(len(texts)))}
    assert linked <= stay and not stay & set(range(33, 53))


def test_overlapping_regions_become_one(spark):
    """Regions of one family with different members are put together, a chain of pairs is not; every pair keeps a common region."""
    rng = random.Random(6)
    rows = [(r, f"f{n}", f"f{n}", 10) for r in range(30) for n in rng.sample(range(20), 15)] + [(100 + i, f"c{k}", f"c{k}", 10) for i in range(40) for k in (i, i + 1)]
    members = spark.createDataFrame(rows, "region long, node string, root string, n long")
    before = tiles.regions_of(members)
    assert tiles.merged(before).count() == before.count()
    after = tiles.merged(before, tile=10, worth_items=0).collect()
    held = {}
    for r in after:
        held.setdefault(r.region, set()).add(r.node)
    assert sum(n[0] == "f" for nodes in held.values() for n in nodes) == 20 and len(held) == 41
    pairs = {(x, y) for r, x, *_ in rows for q, y, *_ in rows if r == q}
    assert all(any({x, y} <= nodes for nodes in held.values()) for x, y in pairs)
