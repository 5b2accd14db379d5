import collections
import hashlib
import itertools
import random
import re

import pytest

from filinglens.llm import exact, links, near

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((str(i), str(top[t or ""]), len(groups[t or ""]), i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows))


@pytest.mark.parametrize("limit", [64 << 20, 3000])
def test_exact_groups(spark, odd, none, limit):
    """A table that holds everything, and one that spills again and again."""
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(odd, table_bytes=limit, fanout=3).collect())
    assert got == brute_groups(rows)
    assert exact.exact_duplicates(none).collect() == []


def test_equal_hashes_of_different_contents():
    table = exact.ContentTable(1 << 20)
    for content, keep in ((b"a", 1), (b"b", 9), (b"a", 4), (b"b", None)):
        assert table.add(7, content, keep, 1, 1)
    assert dict(zip(table.contents, table.folded)) == {b"a": [4, 1, 2], b"b": [9, 1, 2]}
    full = exact.ContentTable(1)
    assert full.add(1, b"x", 1, 1, 1) and not full.add(2, b"y", 1, 1, 1) and full.add(1, b"x", 2, 1, 1)


def test_exact_stage_keeps_one_row_of_each_text(odd, none):
    kept = exact.without_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in odd.collect()}
    assert 7 in {r.doc_id for r in kept.collect()} and exact.without_duplicates(none).count() == 0


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_near(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = min((x for x in first[find(k)] if x is not None), default=None)
        out.append((str(i), len(sets[k]), str(c), i == c))
    return sorted(out)


def variants(seed, groups, size, words):
    draw, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{draw.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + words // 30)):
                copy[draw.randrange(len(copy))] = f"v{draw.randrange(4000)}"
            rows.append((len(rows) * 7 % 9973, " ".join(copy)))
    return rows


def test_near_components_equal_brute_force(spark, odd, none):
    rows = variants(3, 12, 9, 90) + variants(4, 1, 150, 120) + [(20_000, None), (20_001, ""), (20_002, "two words"), (20_003, "Two  Words"), (20_003, "Two  Words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near.near_duplicates(docs).collect()) == brute_near(rows)
    mine = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near.near_duplicates(odd).collect()) == brute_near(mine)
    assert near.near_duplicates(none).collect() == []


def test_dense_regions_lose_no_component(spark):
    """Regions far above the size of a tile, with strays that are linked by one member only."""
    rows = variants(8, 1, 200, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, roots = near.clustered(docs, tile=24)
    distinct = list({frozenset(shingles(t)): (i, t) for i, t in rows}.values())
    sizes = collections.Counter(c for _, _, c, _ in brute_near(distinct))
    assert roots.select("root").distinct().count() == sum(n > 1 for n in sizes.values()) and roots.count() == sum(n for n in sizes.values() if n > 1)


@pytest.mark.parametrize("changes", [5, 6, 7])
def test_families_around_the_limit(spark, changes):
    """A large family whose pairs lie just above, around or just below 75: nearly all components, and no pairs in the output."""
    draw, rows = random.Random(changes), []
    base = [f"w{draw.randrange(4000)}" for _ in range(120)]
    for _ in range(400):
        copy = list(base)
        for at in draw.sample(range(0, 120, 5), changes // 2 + draw.randrange(2)):
            copy[at] = f"v{draw.randrange(10**6)}"
        rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, _, c, _ in brute_near(rows)}
    got = {str(r.doc_id): str(r.component_id) for r in near.near_duplicates(docs, tile=60).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_template_family_loses_no_link(spark):
    """Thousands of nodes of one template, whose regions are dense in every order: links in pairs, just above the limit."""
    draw, rows = random.Random(12), []
    base = [f"t{i}" for i in range(100)]
    for _ in range(1000):
        own = [f"w{draw.randrange(10**6)}" for _ in range(40)]
        rows += [(len(rows), " ".join(base + own)), (len(rows) + 1, " ".join(base + own[:21] + [f"v{draw.randrange(10**6)}" for _ in range(19)]))]
    number = {}
    masks = [sum(1 << number.setdefault(s, len(number)) for s in shingles(t)) for _, t in rows]
    sizes = [m.bit_count() for m in masks]
    links = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * (n := (masks[i] & masks[j]).bit_count()) >= 75 * (sizes[i] + sizes[j] - n)}
    assert len(links) == 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
    assert sum(got[i] != got[j] for i, j in links) <= 1 and len(set(got.values())) >= 1000


def test_near_stage_keeps_one_of_each_component(odd, none):
    kept = near.without_near_duplicates(odd)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert kept.columns == odd.columns and ids == sorted((i is None, i or 0) for i in [1, 2, 3, 4, 5, 6, 9, 10, 11, 12, None, None, 13])
    assert near.without_near_duplicates(none).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 60)] + [("900", f"{i}") for i in range(901, 930)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert {got[f"{i:03d}"] for i in range(61)} == {"000"} and {got[str(i)] for i in range(900, 930)} == {"900"} and len(got) == 91
    assert links.components(spark.createDataFrame([], "u string, v string")).collect() == []
    stars = spark.createDataFrame([("a", "b"), ("c", "a"), ("x", "y"), ("b", "a")], "u string, v string")
    assert {r.node: r.root for r in links.components(stars).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
