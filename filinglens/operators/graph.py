"""Keyword graphs per company and their comparison with a target's graph.

Tables: ``nodes`` (company, keyword, node_pos, frequency, …), ``edges`` (company, a, b, weight) with
a < b.  A company has at most sixty nodes, so everything after the node cut is
bounded per company.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import text as X
from filinglens.operators.ordering import top_per_group
from filinglens.session import attach, join_to_few, materialise, once

COMPANY = "company"


# --- building -----------------------------------------------------------------------------

def clean_keywords(raw: DataFrame, stopwords=None, phrases=None, floor: float = L.MIN_KEYWORD_SCORE) -> DataFrame:
    """Normalised keywords without noise, one row per sentence and keyword.

    ``raw``: company, sentence_pos, phrase, score; the best score of a phrase stays.
    """
    named = once(raw.filter(F.col("score") >= floor), keyword=X.normalise_keyword(F.col("phrase"), stopwords))
    kept = named.filter(~X.is_noisy_keyword(F.col("keyword"), F.col("score"), floor, phrases))
    return kept.groupBy(COMPANY, "sentence_pos", "keyword").agg(F.max("score").alias("score"))


def keyword_nodes(keywords: DataFrame, limit: int = L.MAX_GRAPH_NODES) -> DataFrame:
    """Top keywords of each company by frequency times mean score."""
    counted = keywords.groupBy(COMPANY, "keyword").agg(F.count("*").alias("frequency"), F.avg("score").alias("mean_score"))
    scored = counted.withColumns({"mean_score": F.round("mean_score", 6),
                                  "importance": F.round(F.col("frequency") * F.col("mean_score"), 6)})
    return top_per_group(scored, [COMPANY], [F.desc("importance"), F.desc("frequency"), F.desc("mean_score"), F.asc("keyword")], limit, "node_pos")


def cooccurrence_edges(keywords: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keyword pairs of one sentence, weighted by the number of sentences.

    A sentence carries a handful of keywords, so pairs are formed inside its row; the
    few nodes go to the keywords.
    """
    selected = attach(keywords, nodes.select(COMPANY, "keyword"), [COMPANY, "keyword"])
    per_sentence = selected.groupBy(COMPANY, "sentence_pos").agg(F.array_sort(F.collect_set("keyword")).alias("k"))
    pairs = F.flatten(F.transform("k", lambda a, i: F.transform(
        F.slice(F.col("k"), i + 2, F.size("k")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return (per_sentence.select(COMPANY, F.explode(pairs).alias("p"))
            .groupBy(COMPANY, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("weight")))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(COMPANY, F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("o")),
                                                   F.struct(F.col("b").alias("k"), F.col("a").alias("o")))).alias("e"), "weight").select(
        COMPANY, F.col("e.k").alias("keyword"), F.col("e.o").alias("other"), "weight")


def without_noise(nodes: DataFrame, edges: DataFrame, phrases=None) -> tuple[DataFrame, DataFrame]:
    """Graph for centrality: noise keywords and then isolated ones removed."""
    clean = nodes.filter(~X.is_centrality_noise(F.col("keyword"), phrases))
    keys = clean.select(COMPANY, "keyword")
    left = edges.join(keys.withColumnRenamed("keyword", "a"), [COMPANY, "a"], "left_semi").join(
        keys.withColumnRenamed("keyword", "b"), [COMPANY, "b"], "left_semi").select(COMPANY, "a", "b", "weight")
    return clean.join(_ends(left).select(COMPANY, "keyword"), [COMPANY, "keyword"], "left_semi"), left


def weighted_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted degree of every node and its centrality, degree / (n − 1)."""
    size = nodes.groupBy(COMPANY).agg(F.count("*").alias("_n"))
    degree = _ends(edges).groupBy(COMPANY, "keyword").agg(F.sum("weight").alias("degree"), F.count("*").alias("neighbours"))
    return (nodes.select(COMPANY, "keyword").join(degree, [COMPANY, "keyword"], "left").join(size, COMPANY)
            .select(COMPANY, "keyword", F.coalesce("degree", F.lit(0)).alias("degree"),
                    F.coalesce("neighbours", F.lit(0)).alias("neighbours"),
                    F.when(F.col("_n") > 1, F.coalesce("degree", F.lit(0)) / (F.col("_n") - 1)).otherwise(0.0).alias("centrality")))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean weighted clustering per company.

    Clustering of a node is the mean, over its neighbour pairs, of the geometric
    mean of the three edge weights relative to the graph's largest weight.
    """
    top = edges.groupBy(COMPANY).agg(F.max("weight").alias("_w"), F.count("*").alias("edge_count"))
    scaled = edges.join(top.select(COMPANY, "_w"), COMPANY).select(COMPANY, "a", "b", (F.col("weight") / F.col("_w")).alias("w"))
    e1 = scaled.select(COMPANY, F.col("a").alias("x"), F.col("b").alias("y"), F.col("w").alias("w1"))
    e2 = scaled.select(COMPANY, F.col("a").alias("y"), F.col("b").alias("z"), F.col("w").alias("w2"))
    e3 = scaled.select(COMPANY, F.col("a").alias("x"), F.col("b").alias("z"), F.col("w").alias("w3"))
    triangles = e1.join(e2, [COMPANY, "y"]).join(e3, [COMPANY, "x", "z"]).select(
        COMPANY, F.explode(F.array("x", "y", "z")).alias("keyword"), F.pow(F.col("w1") * F.col("w2") * F.col("w3"), F.lit(1 / 3)).alias("g"))
    corner = triangles.groupBy(COMPANY, "keyword").agg(F.sum("g").alias("g"))
    degrees = weighted_degree(nodes, edges)
    local = degrees.join(corner, [COMPANY, "keyword"], "left").withColumn(
        "c", F.when(F.col("neighbours") >= 2, 2 * F.coalesce("g", F.lit(0.0)) / (F.col("neighbours") * (F.col("neighbours") - 1))).otherwise(0.0))
    sized = local.groupBy(COMPANY).agg(F.count("*").alias("node_count"), F.avg("c").alias("_c"))
    n, m = F.col("node_count"), F.coalesce("edge_count", F.lit(0))
    return sized.join(top.select(COMPANY, "edge_count"), COMPANY, "left").select(
        COMPANY, "node_count", m.alias("edge_count"),
        F.round(F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0), 6).alias("density"),
        F.round(F.when(n > 1, F.col("_c")).otherwise(0.0), 6).alias("average_clustering"))


def central_keywords(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    return top_per_group(weighted_degree(nodes, edges), [COMPANY], [F.desc("degree"), F.asc("keyword")], k, "central_rank").select(
        COMPANY, "central_rank", "keyword", "degree")


# --- matching ----------------------------------------------------------------------------------------

def greedy_pairs(similarity: np.ndarray, floor: float) -> list[tuple[int, int, float]]:
    """One-to-one pairs at or above ``floor``, best similarity first, ties by position."""
    ti, ci = np.nonzero(similarity >= floor)
    return _greedy(ti, ci, similarity[ti, ci])


def edge_candidates(nodes: np.ndarray, target_edges: np.ndarray, candidate_edges: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge pairs (target, candidate, similarity) at or above ``floor``.

    The similarity of two edges is the better of the two end pairings, each as weak as its weaker end; so both ends of
    a pair must be node pairs at or above the floor, and only edges between such node pairs are looked at.
    """
    t, c = np.nonzero(nodes >= floor)
    none = np.zeros(0, np.int64)
    if not len(t) or not len(target_edges) or not len(candidate_edges):
        return none, none, np.zeros(0)

    def numbered(edges, n):
        out = np.full((n, n), -1, np.int64)
        out[edges[:, 0], edges[:, 1]] = np.arange(len(edges))
        return out

    te, ce = numbered(target_edges, nodes.shape[0]), numbered(candidate_edges, nodes.shape[1])
    ce = np.maximum(ce, ce.T)
    x, y = np.nonzero((te[np.ix_(t, t)] >= 0) & (ce[np.ix_(c, c)] >= 0))
    edge, other = te[t[x], t[y]], ce[c[x], c[y]]
    weak = np.minimum(nodes[t[x], c[x]], nodes[t[y], c[y]])
    pair = edge * len(candidate_edges) + other
    found, at = np.unique(pair, return_inverse=True)
    best = np.full(len(found), -np.inf)
    np.maximum.at(best, at, weak)
    return found // len(candidate_edges), found % len(candidate_edges), best


def greedy_edges(nodes: np.ndarray, target_edges: np.ndarray, candidate_edges: np.ndarray, floor: float) -> list[tuple[int, int, float]]:
    """One-to-one edge pairs at or above ``floor``, best similarity first, ties by position."""
    return _greedy(*edge_candidates(nodes, target_edges, candidate_edges, floor))


def _greedy(ti: np.ndarray, ci: np.ndarray, values: np.ndarray) -> list[tuple[int, int, float]]:
    used_t, used_c, out = set(), set(), []
    for o in np.lexsort((ci, ti, -values)):
        a, b = int(ti[o]), int(ci[o])
        if a not in used_t and b not in used_c:
            used_t.add(a), used_c.add(b), out.append((a, b, float(values[o])))
    return out


def mutual_best(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy one-to-one matching by shuffles only.

    ``pairs``: keys, t, c, similarity.  Rounds accept the pairs that are first for
    both ends and drop everything touching them; under a strict order this equals
    taking pairs greedily from the best one down.
    """
    rank = F.struct((-F.col("similarity")).alias("s"), "t", "c")
    open_pairs, done = materialise(pairs), None
    while not open_pairs.isEmpty():
        ranked = open_pairs.withColumn("_r", rank)
        bt = ranked.groupBy(*keys, "t").agg(F.min("_r").alias("_bt"))
        bc = ranked.groupBy(*keys, "c").agg(F.min("_r").alias("_bc"))
        won = materialise(ranked.join(bt, [*keys, "t"]).join(bc, [*keys, "c"])
                          .filter("_r = _bt and _r = _bc").select(*keys, "t", "c", "similarity"))
        done = won if done is None else done.unionByName(won)
        open_pairs = materialise(open_pairs.join(won.select(*keys, "t"), [*keys, "t"], "left_anti")
                                 .join(won.select(*keys, "c"), [*keys, "c"], "left_anti").select(*keys, "t", "c", "similarity"))
    return done if done is not None else pairs.limit(0)


def _packed(nodes: DataFrame, edges: DataFrame, who: str, p: str) -> DataFrame:
    """One row per company: ordered keywords, their vectors, edges as node positions."""
    flag = F.col("noisy") if "noisy" in nodes.columns else F.lit(False)
    n = nodes.groupBy(COMPANY).agg(F.array_sort(F.collect_list(F.struct("node_pos", "keyword", "vector", flag.alias("noisy")))).alias("n"))
    pos = nodes.select(COMPANY, "keyword", (F.col("node_pos") - 1).cast("int").alias("i"))
    placed = (edges.join(pos.select(COMPANY, F.col("keyword").alias("a"), F.col("i").alias("ia")), [COMPANY, "a"])
              .join(pos.select(COMPANY, F.col("keyword").alias("b"), F.col("i").alias("ib")), [COMPANY, "b"]))
    e = placed.groupBy(COMPANY).agg(F.array_sort(F.collect_list(F.struct("ia", "ib", F.col("weight").cast("double").alias("w")))).alias("e"))
    return n.join(e, COMPANY, "left").select(
        F.col(COMPANY).alias(who), F.transform("n", lambda x: x["keyword"]).alias(f"{p}k"), F.transform("n", lambda x: x["vector"]).alias(f"{p}v"),
        F.transform("n", lambda x: x["noisy"]).alias(f"{p}x"),
        F.transform("e", lambda x: x["ia"]).alias(f"{p}a"), F.transform("e", lambda x: x["ib"]).alias(f"{p}b"),
        F.transform("e", lambda x: x["w"]).alias(f"{p}w"))


def _edge_array(a, b) -> np.ndarray:
    return np.array(list(zip(a, b)), dtype=int).reshape(-1, 2) if a is not None else np.zeros((0, 2), dtype=int)


_MATCHES = ("node_matches array<struct<target:string,candidate:string,similarity:double>>, "
            "edge_matches array<struct<ta:string,tb:string,ca:string,cb:string,similarity:double,target_weight:double,candidate_weight:double,mass:double>>, "
            "target_weight double, candidate_weight double, target_nodes bigint, candidate_nodes bigint")


def align(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, node_floor: float = L.NODE_MATCH_THRESHOLD,
          edge_floor: float = L.EDGE_MATCH_THRESHOLD, digits: int = 6) -> DataFrame:
    """Node and edge matches of every (target, candidate) pair.

    ``nodes`` carries a unit ``vector``.  Both graphs of a pair sit in one row of at
    most sixty nodes; the batch job works row by row without grouping.
    """
    asked = pairs.select(F.col("target").alias(COMPANY)).distinct()
    targets = _packed(nodes.join(asked, COMPANY, "left_semi"), edges.join(asked, COMPANY, "left_semi"), "target", "t")
    both = pairs.select("target", "candidate").join(targets, "target").join(_packed(nodes, edges, "candidate", "c"), "candidate")
    kind = pairs.schema["target"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                tv = np.array([np.asarray(v, dtype=np.float64) for v in r.tv])
                cv = np.array([np.asarray(v, dtype=np.float64) for v in r.cv])
                sim = np.round(tv @ cv.T, digits)
                te, ce = _edge_array(r.ta, r.tb), _edge_array(r.ca, r.cb)
                tw, cw = ([] if w is None else list(w) for w in (r.tw, r.cw))
                node = [{"target": r.tk[a], "candidate": r.ck[b], "similarity": s} for a, b, s in greedy_pairs(sim, node_floor)]
                edge = []
                for a, b, s in greedy_edges(sim, te, ce, edge_floor):
                    edge.append({"ta": r.tk[te[a][0]], "tb": r.tk[te[a][1]], "ca": r.ck[ce[b][0]], "cb": r.ck[ce[b][1]],
                                 "similarity": s, "target_weight": tw[a], "candidate_weight": cw[b], "mass": min(tw[a], cw[b]) * s})
                out.append((r.target, r.candidate, node, edge, float(sum(tw)), float(sum(cw)), len(r.tk), len(r.ck)))
            yield pd.DataFrame(out, columns=["target", "candidate", "node_matches", "edge_matches", "target_weight", "candidate_weight",
                                             "target_nodes", "candidate_nodes"], dtype=object)

    return both.mapInPandas(run, f"target {kind}, candidate {kind}, {_MATCHES}")


def jaccard_scores(aligned: DataFrame) -> DataFrame:
    """Semantic keyword Jaccard and soft weighted edge Jaccard of every pair."""
    m = F.size("node_matches")
    union = F.col("target_nodes") + F.col("candidate_nodes") - m
    mass = F.aggregate("edge_matches", F.lit(0.0), lambda s, x: s + x["mass"])
    rest = F.col("target_weight") + F.col("candidate_weight") - mass
    has_edges = (F.col("target_weight") > 0) & (F.col("candidate_weight") > 0) & (rest > 0)
    return aligned.select(
        "target", "candidate", m.cast("bigint").alias("node_match_count"), F.size("edge_matches").cast("bigint").alias("edge_match_count"),
        F.round(F.when(union > 0, m / union).otherwise(0.0), 6).alias("keyword_score"),
        F.round(F.when(has_edges, mass / rest).otherwise(0.0), 6).alias("edge_score"))


def node_mapping(aligned: DataFrame) -> DataFrame:
    return aligned.select("target", "candidate", F.explode("node_matches").alias("m")).select(
        "target", "candidate", F.col("m.candidate").alias("keyword"), F.col("m.target").alias("mapped"))


def relabelled(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate graphs in the target's naming; unmatched nodes get a prefix, loops go, equal edges merge."""
    def named(column: str) -> Column:
        return F.coalesce(F.col(f"_m_{column}"), F.concat(F.lit(L.UNMATCHED_PREFIX), F.col(column)))

    def mapped(df: DataFrame, column: str) -> DataFrame:
        return df.join(mapping.select("target", "candidate", F.col("keyword").alias(column), F.col("mapped").alias(f"_m_{column}")),
                       ["target", "candidate", column], "left")

    who = pairs.select("target", "candidate")
    n = mapped(who.join(nodes.select(F.col(COMPANY).alias("candidate"), "keyword"), "candidate"), "keyword")
    e = mapped(mapped(who.join(edges.withColumnRenamed(COMPANY, "candidate"), "candidate"), "a"), "b")
    ends = e.select("target", "candidate", named("a").alias("x"), named("b").alias("y"), "weight").filter("x <> y")
    merged = ends.groupBy("target", "candidate", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight"))
    return n.select("target", "candidate", named("keyword").alias("keyword")).distinct(), merged


def centrality_cosine(target_degrees: DataFrame, candidate_degrees: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of centrality vectors over the union of node names.

    ``target_degrees``: company, keyword, centrality.  ``candidate_degrees``: target,
    candidate, keyword, centrality.
    """
    t = pairs.select("target", "candidate").join(
        target_degrees.select(F.col(COMPANY).alias("target"), "keyword", F.col("centrality").alias("x")), "target")
    c = candidate_degrees.select("target", "candidate", "keyword", F.col("centrality").alias("y"))
    union = t.join(c, ["target", "candidate", "keyword"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    sums = union.groupBy("target", "candidate").agg(F.sum(x * y).alias("d"), F.sum(x * x).alias("p"), F.sum(y * y).alias("q"))
    found = sums.select("target", "candidate", F.round(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("d") / F.sqrt(F.col("p") * F.col("q"))).otherwise(0.0), 6).alias("centrality_score"))
    return pairs.select("target", "candidate").join(found, ["target", "candidate"], "left").fillna(0.0, ["centrality_score"])


def pair_degrees(nodes: DataFrame, edges: DataFrame, phrases=None, drop_noise: bool = True) -> DataFrame:
    """Centralities of relabelled candidate graphs, noise nodes and isolates left out on request."""
    pair = F.struct("target", "candidate")
    n, e = nodes.withColumn(COMPANY, pair).drop("target", "candidate"), edges.withColumn(COMPANY, pair).drop("target", "candidate")
    if drop_noise:
        bare = F.when(F.col("keyword").startswith(L.UNMATCHED_PREFIX), F.substring("keyword", len(L.UNMATCHED_PREFIX) + 1, 1 << 20)).otherwise(F.col("keyword"))
        flagged = n.filter(~X.is_centrality_noise(bare, phrases))
        n, e = without_noise(flagged, e, phrases=[])
    d = weighted_degree(n, e)
    return d.select(f"{COMPANY}.target", f"{COMPANY}.candidate", "keyword", "centrality")


def centralities(names: list[str], edges: dict[tuple[str, str], float], noisy: set[str] | None) -> dict[str, float]:
    """Weighted degree of each name over (n - 1); with ``noisy`` given, these names and then isolated ones left out."""
    kept = set(names)
    if noisy is not None:
        kept -= noisy
        edges = {e: w for e, w in edges.items() if e[0] in kept and e[1] in kept}
        kept &= {x for e in edges for x in e}
    degree = dict.fromkeys(kept, 0.0)
    for (a, b), w in edges.items():
        degree[a] += w
        degree[b] += w
    return {k: d / (len(kept) - 1) if len(kept) > 1 else 0.0 for k, d in degree.items()}


def cosine(x: dict[str, float], y: dict[str, float]) -> float:
    p, q = sum(v * v for v in x.values()), sum(v * v for v in y.values())
    return sum(v * y[k] for k, v in x.items() if k in y) / (p * q) ** 0.5 if p > 0 and q > 0 else 0.0


def network_similarity(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, phrases=None, drop_noise: bool = True,
                       node_floor: float = L.NODE_MATCH_THRESHOLD, edge_floor: float = L.EDGE_MATCH_THRESHOLD, digits: int = 6) -> DataFrame:
    """Keyword, edge and centrality similarity of every pair, in one batch job.

    Both graphs of a pair sit in one row of at most sixty nodes, so alignment, both Jaccards, relabelling and the
    centrality cosine are all computed there.  ``drop_noise=False`` gives the earlier variant without centrality
    filtering.  The steps as tables: ``align``, ``jaccard_scores``, ``relabelled``, ``centrality_cosine``.
    """
    # stored, because a constant target would turn the joins on it into products
    pairs = materialise(pairs.select("target", "candidate"))
    flagged = nodes.withColumn("noisy", X.is_centrality_noise(F.col("keyword"), phrases))
    asked = pairs.select(F.col("target").alias(COMPANY)).distinct()
    targets = _packed(flagged.join(asked, COMPANY, "left_semi"), edges.join(asked, COMPANY, "left_semi"), "target", "t")
    both = join_to_few(pairs.join(_packed(flagged, edges, "candidate", "c"), "candidate"), targets, ["target"])
    kind, prefix = pairs.schema["target"].dataType.simpleString(), L.UNMATCHED_PREFIX

    def scores(r):
        tv, cv = (np.array([np.asarray(v, dtype=np.float64) for v in m]) for m in (r.tv, r.cv))
        sim = np.round(tv @ cv.T, digits)
        te, ce = _edge_array(r.ta, r.tb), _edge_array(r.ca, r.cb)
        tw, cw = ([] if w is None else [float(v) for v in w] for w in (r.tw, r.cw))
        matched = greedy_pairs(sim, node_floor)
        mass, n_edges = 0.0, 0
        for a, b, s in greedy_edges(sim, te, ce, edge_floor):
            mass, n_edges = mass + min(tw[a], cw[b]) * s, n_edges + 1
        union, rest = len(r.tk) + len(r.ck) - len(matched), sum(tw) + sum(cw) - mass
        to = {b: a for a, b, _ in matched}
        names = [r.tk[to[j]] if j in to else prefix + k for j, k in enumerate(r.ck)]
        noise = {n for j, n in enumerate(names) if (r.tx[to[j]] if j in to else r.cx[j])}
        renamed: dict[tuple[str, str], float] = {}
        for (i, j), w in zip(ce.tolist(), cw):
            if names[i] != names[j]:
                key = (min(names[i], names[j]), max(names[i], names[j]))
                renamed[key] = renamed.get(key, 0.0) + w
        own = {(r.tk[i], r.tk[j]): w for (i, j), w in zip(te.tolist(), tw)}
        x = centralities(list(r.tk), own, {k for k, f in zip(r.tk, r.tx) if f} if drop_noise else None)
        y = centralities(names, renamed, noise if drop_noise else None)
        return (r.target, r.candidate, len(matched), n_edges, len(matched) / union if union > 0 else 0.0,
                mass / rest if sum(tw) > 0 and sum(cw) > 0 and rest > 0 else 0.0, cosine(x, y))

    columns = ["target", "candidate", "node_match_count", "edge_match_count", "keyword_score", "edge_score", "centrality_score"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([scores(r) for r in pdf.itertuples(index=False)], columns=columns)

    out = both.mapInPandas(run, f"target {kind}, candidate {kind}, node_match_count bigint, edge_match_count bigint, keyword_score double, edge_score double, centrality_score double")
    return out.select(*columns[:4], *[F.round(c, 6).alias(c) for c in columns[4:]])
