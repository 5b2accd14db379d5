"""Exact top-k from the inverted-file index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filinglens.operators import vector_index as VI

SCHEMA = "id long, company string, kind string, embedding array<float>"


def clustered(seed, n, dims, clusters=12, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return np.float32(centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims)))


def corpus_of(spark, x):
    rows = [(i, None if i % 50 == 49 else "ab"[i % 2] if i % 3 else "hot", None if i % 31 == 0 else f"k{i % 4}", [float(v) for v in row]) for i, row in enumerate(x)]
    return rows, spark.createDataFrame([*rows, (10**6, "hot", "k1", None)], SCHEMA)


def queries_of(spark, q):
    rows = [(f"q{i}", [float(v) for v in row], None if i % 13 == 12 else f"k{i % 5}") for i, row in enumerate(q)]
    return rows, spark.createDataFrame([*rows, ("none", None, "k1")], "query_id string, embedding array<float>, wanted string")


def plain(rows, queries, k, filters=False, groups=False):
    x = np.array([r[3] for r in rows], np.float64)
    out = []
    for name, q, wanted in queries:
        s = np.round(x @ np.array(q), 6)
        for g in {r[1] for r in rows} if groups else {None}:
            ids = [i for i, r in enumerate(rows) if (not groups or r[1] == g) and (not filters or (wanted is not None and r[2] == wanted))]
            for rank, i in enumerate(sorted(ids, key=lambda i: (-s[i], rows[i][0]))[:k], 1):
                out.append((*([str(g)] if groups else []), name, rows[i][0], float(s[i]), rank))
    return sorted(out)


@pytest.mark.parametrize("filters", [False, True])
@pytest.mark.parametrize("groups", [False, True])
def test_equals_brute_force(spark, filters, groups):
    x, q = clustered(1, 900, 8), clustered(2, 37, 8)
    x[100:120] = x[100]  # ties
    rows, corpus = corpus_of(spark, x)
    asked, queries = queries_of(spark, q)
    index = VI.build(corpus, "id", ["kind"] if filters else [], ["company"] if groups else [], block=40, cells=9)
    out = VI.search(index, queries, 6, {"kind": "wanted"} if filters else None, lane=10)
    assert out.columns == [*(["company"] if groups else []), "query_id", "id", "score", "rank"]
    got = sorted((*([str(r.company)] if groups else []), r.query_id, r.id, r.score, r["rank"]) for r in out.collect())
    assert got == plain(rows, asked, 6, filters, groups)


def test_a_stored_index_answers_again(spark, tmp_path):
    x, q = clustered(3, 300, 5), clustered(4, 6, 5)
    rows, corpus = corpus_of(spark, x)
    VI.build(corpus, "id", ["kind"], path=f"{tmp_path}/index", block=30)
    asked, queries = queries_of(spark, q)
    index = VI.load(spark, f"{tmp_path}/index", "id", ["kind"])
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in VI.search(index, queries, 3).collect()) == plain(rows, asked, 3)
    assert VI.search(index, queries.limit(0), 3).count() == 0
    assert VI.search(VI.build(corpus.limit(0), "id"), queries, 3).count() == 0


def test_bounds_hold_and_most_blocks_stay_unread(spark):
    """Scores never pass the bound of their block, and far blocks need no reading once a query has k near rows."""
    x, q = clustered(5, 4000, 16, clusters=20, spread=0.05), clustered(5, 20, 16, clusters=20, spread=0.01)
    _, corpus = corpus_of(spark, x)
    blocks = VI.build(corpus, "id", block=50, cells=40).blocks.collect()
    asked = VI.Asked([{"query_id": i, "embedding": v, "filters": None, "least": None} for i, v in enumerate(q.astype(float))], 5, "id", {}, 6)
    every = x.astype(float) @ q.astype(float).T
    asked.least = np.sort(every, axis=0)[-5]
    read = 0
    for b in blocks:
        bound = asked.bounds(b.m, b.r, b.norm)
        mine = np.frombuffer(b.x).reshape(len(b.rows), -1) @ q.astype(float).T
        assert (mine.max(0) <= bound).all()
        read += (bound >= asked.least).sum()
    assert read < 0.35 * len(blocks) * len(q)


def test_lanes_hold_whatever_the_tables_hold(spark):
    """One hot group is spread over the parts, and a task sees one lane at a time."""
    x, q = clustered(6, 500, 4), clustered(7, 3, 4)
    rows = [(i, "hot", "k", [float(v) for v in row]) for i, row in enumerate(x)]
    asked, queries = queries_of(spark, q)
    index = VI.build(spark.createDataFrame(rows, SCHEMA), "id", [], ["company"], block=25)
    assert index.blocks.count() >= 20 and index.blocks.agg(F.max(F.size("rows"))).first()[0] == 25
    got = sorted((r.company, r.query_id, r.id, r.score, r["rank"]) for r in VI.search(index, queries, 4).collect())
    assert got == plain(rows, asked, 4, groups=True)


@pytest.mark.parametrize("filters", [False, True])
def test_a_corpus_asked_once_is_read_once(spark, filters):
    """Every encoded row costs model time, so ``top_k`` reads the corpus in one pass and stores none of it."""
    from filinglens.operators import retrieval as OR

    x, q = clustered(8, 700, 6), clustered(9, 23, 6)
    x[50:90] = x[50]  # ties
    rows, corpus = corpus_of(spark, x)
    asked, queries = queries_of(spark, q)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    hits = OR.top_k(queries, corpus.repartition(3).mapInArrow(counted, corpus.schema), 6, "id", {"kind": "wanted"} if filters else None, query_block=10)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in hits.collect()) == plain(rows, asked, 6, filters)
    assert read.value == len(rows) + 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
    try:
        more = OR.top_k(queries, corpus, 6, "id", {"kind": "wanted"} if filters else None, query_block=10)
        assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in more.collect()) == plain(rows, asked, 6, filters)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_encoded_together_equal_each_alone():
    from filinglens.operators import retrieval as OR

    encode = OR.hashing_encoder(64)()
    texts = ["", "a", "The same. The same.", "é中\U0001f600 x", "line\nline"] * 70
    together = encode(texts)
    assert (together == np.concatenate([encode([t]) for t in texts])).all() and not encode([]).size
    c = [ord(x) for x in " a "]
    h = (((c[0] * 73856093 ^ c[1] * 19349663 ^ c[2] * 83492791) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 7
    assert together[1, (h >> 1) % 64] == (1 if h & 1 else -1) and np.abs(together[1]).sum() == 1
