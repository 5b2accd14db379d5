import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.operators import chunks as OC
from filinglens.operators import evidence as OE
from filinglens.operators import graph as OG
from filinglens.operators import neardup as ON
from filinglens.operators import responses as ORS
from filinglens.operators import retrieval as OR
from filinglens.operators import signals as OS
from filinglens.operators.ordering import number_rows
from filinglens.session import expand_over


# --- near duplicates -------------------------------------------------------------------------

def mutated(rng, text, n):
    t = list(text)
    for _ in range(n):
        t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
    return "".join(t)


@pytest.mark.parametrize("sweeps", [1, 3])
def test_near_duplicates_equal_the_sequential_rule(spark, sweeps):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(rng.randint(30, 120))) for _ in range(12)]
    rows = []
    for i in range(160):
        company = "hot" if i % 3 else f"c{i % 5}"
        rows.append((company, i, mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4, 6]))))
    kept, seen = set(), {}
    for c, i, t in rows:
        if not any(SequenceMatcher(None, t, e).ratio() >= 0.93 for e in seen.setdefault(c, [])):
            seen[c].append(t)
            kept.add((c, i))
    d = spark.createDataFrame(rows, "company string, pos int, text string")
    got = {(r.company, r.pos) for r in ON.drop_near_duplicates(d, "company", ["pos"], "text", 0.93, sweeps=sweeps).collect()}
    assert got == kept and len(kept) < len(rows)


# --- numbering and core selection ------------------------------------------------------------------

def test_numbering_restarts_per_group_and_knows_totals(spark):
    d = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"))
    rows = number_rows(d, [F.desc("id")], "n", ["g"], total="t").collect()
    for g in {r.g for r in rows}:
        mine = sorted((r for r in rows if r.g == g), key=lambda r: -r.id)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1)) and {r.t for r in mine} == {len(mine)}
    assert sorted(r.n for r in number_rows(d, [F.asc("id")], "n").collect()) == list(range(1, 1001))


def sequential_core(items, categories, per, most):
    ranked = sorted(items, key=lambda x: -x[1])
    chosen = []
    for c in categories:
        added = 0
        for x in ranked:
            if c in x[2] and x not in chosen:
                chosen.append(x)
                added += 1
                if added == per:
                    break
    for x in ranked:
        if len(chosen) >= most:
            break
        if x not in chosen:
            chosen.append(x)
    return [x[0] for x in sorted(chosen, key=lambda x: -x[1])[:most]]


def test_core_selection_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    data = [(c, i, rng.randint(1, 6), rng.sample(L.PROFILE_CATEGORIES, rng.randint(1, 3))) for c, n in (("a", 120), ("b", 9), ("c", 45)) for i in range(n)]
    d = spark.createDataFrame(data, "company string, pos int, relevance_score int, categories array<string>")
    got = {}
    for r in OE.core_evidence(d, "company", ["pos"]).orderBy("company", "core_rank").collect():
        got.setdefault(r.company, []).append(r.pos)
    for c in "abc":
        assert got[c] == sequential_core([(i, s, k) for x, i, s, k in data if x == c], L.PROFILE_CATEGORIES, 5, 40)


# --- retrieval ---------------------------------------------------------------------------------------

def frame(spark, m, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)], f"{name} long, embedding array<float>, kind long")


def test_top_k_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    c, q = np.round(rng.normal(size=(300, 8)), 1), np.round(rng.normal(size=(11, 8)), 1)
    corpus, queries = frame(spark, c).repartition(5), frame(spark, q, "query_id")
    for block in (2048, 4):
        for filters in (None, {"kind": "kind"}):
            got = {}
            for r in OR.top_k(queries, corpus, 4, "id", filters, query_block=block).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            s = np.round(np.float32(c).astype(float) @ np.float32(q).astype(float).T, 6)
            for j in range(len(q)):
                ids = [i for i in range(len(c)) if filters is None or i % 3 == j % 3]
                assert got[j] == sorted(ids, key=lambda i: (-s[i, j], i))[:4]


def test_top_k_within_groups(spark):
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(120, 6)), rng.normal(size=(5, 6))
    corpus = frame(spark, c).withColumn("company", F.when(F.col("id") < 80, "hot").otherwise("cold"))
    got = {}
    for r in OR.top_k_within(frame(spark, q, "query_id"), corpus, ["company"], 3, "id").orderBy("rank").collect():
        got.setdefault((r.company, r.query_id), []).append(r.id)
    s = np.round(np.float32(c).astype(float) @ np.float32(q).astype(float).T, 6)
    for j in range(5):
        assert got[("hot", j)] == sorted(range(80), key=lambda i: (-s[i, j], i))[:3]
        assert got[("cold", j)] == sorted(range(80, 120), key=lambda i: (-s[i, j], i))[:3]


def test_fusion_bonus(spark):
    hits = spark.createDataFrame([("f", "q1", "a", "x", 0.5), ("f", "q2", "a", "x", 0.4), ("f", "q1", "b", "x", 0.5), ("f", "q1", "a", "y", 0.53)],
                                 "field string, query string, category string, chunk_id string, score double")
    got = [(r.chunk_id, r.fused_score, r.evidence_id) for r in OR.fuse(hits).orderBy("evidence_rank").collect()]
    assert got == [("x", 0.54, "E1"), ("y", 0.53, "E2")]


def test_zero_mean_gives_no_vector(spark):
    d = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [-1.0, 0.0]), ("b", [3.0, 4.0])], "company string, embedding array<float>")
    got = {r.company: r.vector for r in OR.mean_vectors(d, "company").collect()}
    assert got["a"] is None and got["b"] == pytest.approx([0.6, 0.8])


def test_phrase_picks_are_relevant_then_different():
    relevance = np.array([0.9, 0.89, 0.5])
    among = np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]])
    assert OR.diverse_order(relevance, among, 2, 0.5) == [0, 2]
    assert OR.diverse_order(relevance, among, 9, 0.0) == [0, 1, 2]


# --- graphs ----------------------------------------------------------------------------------------------

def test_greedy_by_rounds_equals_greedy_by_order(spark):
    rng = random.Random(5)
    rows = [(g, t, c, rng.choice([0.7, 0.8, 0.8, 0.9])) for g in range(6) for t in range(7) for c in range(6) if rng.random() < 0.6]
    d = spark.createDataFrame(rows, "g int, t int, c int, similarity double")
    got = {(r.g, r.t, r.c) for r in OG.mutual_best(d, ["g"]).collect()}
    want = set()
    for g in range(6):
        m = np.zeros((7, 6))
        for x, t, c, s in rows:
            if x == g:
                m[t, c] = s
        want |= {(g, t, c) for t, c, _ in OG.greedy_pairs(m, 0.5)}
    assert got == want


def test_edge_similarity_takes_the_better_direction():
    n = np.array([[0.1, 0.9], [0.8, 0.2]])
    assert OG.greedy_edges(n, np.array([[0, 1]]), np.array([[0, 1]]), 0.5) == [(0, 0, 0.8)]
    assert OG.greedy_edges(n, np.array([[0, 1]]), np.array([[0, 1]]), 0.85) == []


@pytest.mark.parametrize("floor", [0.3, 0.7, 0.95])
def test_edge_candidates_are_all_pairs_above_the_floor(floor):
    rng = np.random.default_rng(int(floor * 100))
    nodes = np.round(rng.random((14, 11)), 2)
    te, ce = (np.array([(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]) for n in nodes.shape)
    want = {(i, j, max(min(nodes[a, c], nodes[b, d]), min(nodes[a, d], nodes[b, c]))) for i, (a, b) in enumerate(te) for j, (c, d) in enumerate(ce)}
    got = set(zip(*(x.tolist() for x in OG.edge_candidates(nodes, te, ce, floor))))
    assert got == {w for w in want if w[2] >= floor}


def test_one_job_gives_the_scores_of_the_steps(spark):
    """All scores of a pair in one row equal alignment, Jaccards, relabelling and cosine as tables, noise kept or dropped."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["noise a", "noise b", "12 3"]
    nodes, edges = [], []
    for c in ("T", "U", "V", "W"):
        mine = rng.sample(words, 14)
        nodes += [(c, w, i + 1, [rng.random() for _ in range(5)]) for i, w in enumerate(mine)]
        edges += [(c, *sorted((a, b)), rng.randrange(1, 9)) for a, b in {tuple(sorted(rng.sample(mine, 2))) for _ in range(20)}]
    nodes.append(("lone", "w1", 1, [1.0] * 5))
    unit = [(c, w, i, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for c, w, i, v in nodes]
    n = spark.createDataFrame(unit, "company string, keyword string, node_pos long, vector array<double>")
    e = spark.createDataFrame(edges, "company string, a string, b string, weight long")
    pairs = spark.createDataFrame([("T", x) for x in ("U", "V", "W", "lone", "T")] + [("U", "V")], "target string, candidate string")
    for drop in (True, False):
        got = {(r.target, r.candidate): tuple(r)[2:] for r in OG.network_similarity(pairs, n, e, ["noise"], drop, 0.8, 0.75).collect()}
        a = OG.align(pairs, n, e, 0.8, 0.75)
        rn, re_ = OG.relabelled(pairs, n, e, OG.node_mapping(a))
        tn, te = OG.without_noise(n, e, ["noise"]) if drop else (n, e)
        cosine = OG.centrality_cosine(OG.weighted_degree(tn, te), OG.pair_degrees(rn, re_, ["noise"], drop), pairs)
        want = {(r.target, r.candidate): tuple(r)[2:] for r in OG.jaccard_scores(a).join(cosine, ["target", "candidate"]).collect()}
        assert got == want and len(got) == 6


def test_graph_measures(spark):
    k = spark.createDataFrame([("A", s, w, 0.5) for s, ws in enumerate(["ab", "abc", "ab", "cd", "e"]) for w in ws], "company string, sentence_pos int, keyword string, score double")
    nodes, edges = OG.keyword_nodes(k), OG.cooccurrence_edges(k, OG.keyword_nodes(k))
    assert {(r.a, r.b): r.weight for r in edges.collect()} == {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 1, ("c", "d"): 1}
    s = OG.graph_summary(nodes, edges).collect()[0]
    g = (1 * (1 / 3) * (1 / 3)) ** (1 / 3)
    assert (s.node_count, s.edge_count, s.density) == (5, 4, 0.4)
    assert s.average_clustering == pytest.approx((g + g + g / 3) / 5, abs=1e-6)
    d = {r.keyword: r.centrality for r in OG.weighted_degree(nodes, edges).collect()}
    assert d == {"a": 1.0, "b": 1.0, "c": 0.75, "d": 0.25, "e": 0.0}
    left, _ = OG.without_noise(nodes, edges, ["d"])
    assert {r.keyword for r in left.collect()} == {"a", "b", "c"}


def test_network_scores_of_a_twin_are_one(spark):
    words = ["화장품", "브랜드", "수출", "제품"]
    n = spark.createDataFrame([(c, w, i + 1, [1.0 if j == i else 0.0 for j in range(4)]) for c in ("T", "twin") for i, w in enumerate(words)] + [("other", "건설", 1, [0.5] * 4)],
                              "company string, keyword string, node_pos long, vector array<double>")
    e = spark.createDataFrame([(c, "브랜드", "화장품", 2) for c in ("T", "twin")] + [(c, "수출", "제품", 1) for c in ("T", "twin")], "company string, a string, b string, weight long")
    pairs = spark.createDataFrame([("T", "twin"), ("T", "other")], "target string, candidate string")
    got = {r.candidate: r for r in OG.network_similarity(pairs, n, e).collect()}
    assert (got["twin"].keyword_score, got["twin"].edge_score, got["twin"].centrality_score) == (1.0, 1.0, 1.0)
    assert (got["other"].keyword_score, got["other"].edge_score, got["other"].centrality_score) == (0.0, 0.0, 0.0)


# --- signals ------------------------------------------------------------------------------------------------

def test_signal_table(spark):
    v = spark.createDataFrame([("1", "가", 0.9), ("2", "나", 0.8), ("3", "다", 0.7), ("9", "x", 1.0)], "stock_code string, company_name string, vector_score double")
    n = spark.createDataFrame([("1", 0.1, 0.1, 0.1, 1, 1), ("2", 0.2, 0.1, 0.3, 1, 1), ("3", 0.3, 0.1, 0.2, 1, 1)],
                              "stock_code string, keyword_score double, edge_score double, centrality_score double, node_match_count int, edge_match_count int")
    got = {r.stock_code: r for r in OS.compare(v, n).collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].vector_rank, got["1"].keyword_rank, got["1"].edge_rank, got["1"].centrality_rank) == (1, 3, 1, 3)
    assert got["1"].vector_percentile == 1.0 and got["1"].keyword_percentile == 0.0 and got["1"].mean_percentile == 0.5
    assert got["1"].rank_spread == 2 and got["1"].top5_agreement == 4 and got["1"].vector_network_gap == pytest.approx(1 - 7 / 3)
    ranks = [F.lit(None).cast("int"), F.lit(3), F.lit(12), F.lit(5)]
    row = spark.range(1).select(OS.rank_spread(ranks).alias("s"), OS.agreement(ranks, 10).alias("a"), OS.mean_present(ranks).alias("m")).collect()[0]
    assert (row.s, row.a, row.m) == (9, 2, pytest.approx(20 / 3))


# --- chunks, prompts, responses ----------------------------------------------------------------------------------

def test_chunk_ids_and_dedup(spark):
    text, other = "이 문장은 충분히 길고 의미가 있는 근거 문장입니다. " * 3, "전혀 다른 내용의 긴 문장이 여기에 이어집니다. " * 4
    rows = [(0, "business", "annual", "text", text, None), (1, "growth", "annual", "text", text + "\n", None), (2, "growth", "annual", "text", other, None),
            (3, "risk", "annual", "table", "x", "| a |\n| --- |"), (4, "risk", "annual", "text", "짧다", None)]
    d = spark.createDataFrame(rows, "ev int, category string, report_type string, source_type string, content string, markdown string")
    cut = OC.chunk_rows(d, ["ev", "category", "report_type", "source_type"])
    got = OC.number_chunks(OC.first_occurrences(cut, ["ev", "piece_index"]), ["ev", "piece_index"])
    assert sorted((r.chunk_id, r.ev) for r in got.collect()) == [("business_annual_text_0001", 0), ("growth_annual_text_0001", 2), ("risk_annual_table_0001", 3)]
    stats = {(r.dimension, r.value): r.n_chunks for r in OC.chunk_statistics(got).collect()}
    assert stats[("total", "all")] == 3 and stats[("source_type", "table")] == 1


def test_responses(spark):
    ok = '{"value": "v", "status": "확인", "company_claim": null, "interpretation": null, "reason": "r", "evidence_ids": ["E2", "E7"]}'
    rows = [(1, ok), (2, f"```JSON\n{ok}\n```"), (3, f"설명 {ok} 끝"), (4, ok.replace("확인", "좋음")), (5, "없음"), (6, ok)]
    known = spark.createDataFrame([(i, e) for i in range(1, 6) for e in ("E1", "E2")], "k int, evidence_id string")
    got = {r.k: r for r in ORS.parse_responses(spark.createDataFrame(rows, "k int, raw string"), known, ["k"]).collect()}
    assert [(got[i].status, got[i].evidence_ids, got[i].problem) for i in (1, 2, 3)] == [("확인", ["E2"], None)] * 3
    assert (got[4].problem, got[5].problem) == ("bad_status", "not_json")
    assert (got[6].status, got[6].value, got[6].evidence_ids, got[6].problem) == ("미공시", None, [], None)


def test_fields_and_prompts(spark):
    f = ORS.profile_fields(spark)
    assert f.count() == 18 and f.filter("category = 'risk'").count() == 8
    every = expand_over(spark.createDataFrame([("A",), ("B",)], "company string"), f)
    assert every.count() == 36
    ev = spark.createDataFrame([("A", "products_services", 2, "E2", "c2", "annual", "", "둘"), ("A", "products_services", 1, "E1", "c1", "annual", "", "하나")],
                               "company string, field string, evidence_rank int, evidence_id string, chunk_id string, report_type string, section string, content string")
    p = {(r.company, r.field): r for r in ORS.prompts(every, ev, ["company", "field"]).collect()}
    text = p[("A", "products_services")].prompt
    assert text.index("[E1]") < text.index("[E2]") and "B1" in text
    assert p[("B", "products_services")].prompt is None and p[("B", "products_services")].n_evidence == 0
    plain = sorted((r.company, r.field) for r in every.collect())
    cut = expand_over(spark.createDataFrame([("A",), ("B",)], "company string"), f, block=3)
    assert sorted((r.company, r.field) for r in cut.collect()) == plain and sorted(cut.columns) == sorted(every.columns)


def test_many_queries_meet_the_corpus_in_lanes(spark):
    draw = np.random.default_rng(12)
    rows = [("AB"[i % 2], i, i % 3, [float(x) for x in draw.normal(size=4)]) for i in range(200)]
    corpus = spark.createDataFrame(rows, "company string, id int, kind int, embedding array<double>")
    asked = spark.createDataFrame([(q, q % 3, [float(x) for x in draw.normal(size=4)]) for q in range(37)], "query_id int, kind_wanted int, embedding array<double>")
    whole = sorted(tuple(r) for r in OR.top_k(asked, corpus, 4, "id", {"kind": "kind_wanted"}).collect())
    assert sorted(tuple(r) for r in OR.top_k(asked, corpus, 4, "id", {"kind": "kind_wanted"}, query_block=5).collect()) == whole and len(whole) == 148
    within = sorted(tuple(r) for r in OR.top_k_within(asked, corpus, ["company"], 2, "id").collect())
    assert sorted(tuple(r) for r in OR.top_k_within(asked, corpus, ["company"], 2, "id", query_block=5).collect()) == within and len(within) == 148


@pytest.mark.parametrize("fill", [True, False])
def test_sentence_pairs_of_large_companies(spark, monkeypatch, fill):
    draw = np.random.default_rng(13)
    monkeypatch.setattr(OR, "PAIR_TILE", 7)
    items = {c: np.round(draw.integers(-2, 3, size=(n, 3)) + 0.1, 1) for c, n in (("A", 30), ("B", 25), ("C", 2))}
    df = spark.createDataFrame([(c, i, [float(x) for x in v]) for c, m in items.items() for i, v in enumerate(m)], "company string, pos int, embedding array<double>")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "target string, candidate string")
    got = sorted((r.candidate, r.pair_rank, r.target_pos, r.candidate_pos, r.one_to_one) for r in OR.best_sentence_pairs(pairs, df, 6, fill).collect())
    want = []
    for c in "BC":
        t, m = items["A"], items[c]
        sim = np.round((t / np.linalg.norm(t, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T, 6)
        order = sorted((-sim[i, j], i, j) for i in range(len(t)) for j in range(len(m)))
        first, rest = [], []
        for _, i, j in order:
            if len(first) < 6 and i not in {x for x, _ in first} and j not in {y for _, y in first}:
                first.append((i, j))
            else:
                rest.append((i, j))
        chosen = [(*p, True) for p in first] + ([(*p, False) for p in rest[: 6 - len(first)]] if fill else [])
        want += [(c, n + 1, *p) for n, p in enumerate(chosen)]
    assert got == sorted(want)


@pytest.mark.parametrize("kind", ["drawn", "equal", "few values"])
def test_a_lane_keeps_few_pairs_and_all_that_count(kind):
    """A million pairs leave a bounded rest that holds every greedy pick and the best of all, ties included."""
    draw = np.random.default_rng(5)
    k, n, m = 3, 900, 1200
    sim = {"drawn": draw.normal(size=(n, m)) / 4, "equal": np.ones((n, m)), "few values": draw.integers(0, 4, size=(n, m)) / 4}[kind]
    tp, cp = np.arange(n) * 3, np.arange(m) * 2
    found = OR.ClosePairs(k, 2 * k * k + k)
    found.room = 5_000
    for i in draw.permutation(3):
        for j in draw.permutation(4):
            found.add(tp[i::3], cp[j::4], sim[i::3, j::4])
            assert found.held <= found.room
    t, c, s, close = found.kept()
    assert len(t) <= 2 * k * k + 3 * k and close.sum() <= 2 * k * k + k
    whole = np.round(sim, 6)
    order = np.lexsort((np.tile(cp, n), np.repeat(tp, m), -whole.ravel()))
    every = [(int(tp[o // m]), int(cp[o % m]), float(whole.ravel()[o])) for o in order[: 20_000]]
    kept = list(zip(t.tolist(), c.tolist(), s.tolist()))
    assert kept[: 2 * k] == every[: 2 * k]

    def greedy(pairs):
        out = []
        for p in pairs:
            if len(out) < k and p[0] not in {x[0] for x in out} and p[1] not in {x[1] for x in out}:
                out.append(p)
        return out

    assert greedy([p for p, x in zip(kept, close) if x]) == greedy(every)
