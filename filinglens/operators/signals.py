"""Comparison of similarity signals: ranks, percentiles, agreement, fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens.operators.ordering import number_rows
from filinglens.session import materialise

SIGNALS = ["vector", "keyword", "edge", "centrality"]


def ranked(rows: DataFrame, metric: str, name: str, tie: str) -> DataFrame:
    """Unique ranks 1..n by ``metric`` descending, ties by ``tie``."""
    return number_rows(rows, [F.desc_nulls_last(metric), F.asc(tie)], name)


def percentile(rank: Column, total: Column) -> Column:
    return F.when(rank.isNull() | (total <= 1), 0.0).otherwise((total - rank) / (total - 1))


def _present(ranks: list[Column]) -> Column:
    return F.array_compact(F.array(*ranks))


def rank_spread(ranks: list[Column]) -> Column:
    a = _present(ranks)
    return F.when(F.size(a) > 0, F.array_max(a) - F.array_min(a)).otherwise(0)


def agreement(ranks: list[Column], n: int) -> Column:
    return reduce(lambda x, y: x + y, [F.coalesce((r <= n).cast("int"), F.lit(0)) for r in ranks])


def mean_present(ranks: list[Column]) -> Column:
    a = _present(ranks)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a))


def compare(vector_scores: DataFrame, network_scores: DataFrame, key: str = "stock_code") -> DataFrame:
    """One row per company present in both inputs.

    ``vector_scores``: key, company_name, vector_score.  ``network_scores``: key,
    keyword_score, edge_score, centrality_score, node_match_count, edge_match_count.
    Ranks and percentiles are taken inside the intersection; all ranks come out of one range sort.
    """
    rows = materialise(vector_scores.join(network_scores, key)).withColumn("_row", F.monotonically_increasing_id())
    # One narrow row for each metric, one range sort for all ranks.
    long = rows.select("_row", key, F.posexplode(F.array(*[F.col(f"{s}_score").cast("double") for s in SIGNALS])).alias("_metric", "_score"))
    placed = number_rows(long, [F.desc_nulls_last("_score"), F.asc(key)], "_rank", ["_metric"], total="_total")
    wide = placed.groupBy("_row").agg(F.max("_total").alias("_total"), *[F.max(F.when(F.col("_metric") == i, F.col("_rank"))).alias(f"{s}_rank") for i, s in enumerate(SIGNALS)])
    rows = rows.join(wide, "_row").drop("_row")
    ranks = [F.col(f"{s}_rank") for s in SIGNALS]
    rows = rows.withColumns({f"{s}_percentile": percentile(F.col(f"{s}_rank"), F.col("_total")) for s in SIGNALS})
    network_mean = mean_present(ranks[1:])
    return rows.drop("_total").withColumns({
        "mean_percentile": reduce(lambda a, b: a + b, [F.col(f"{s}_percentile") for s in SIGNALS]) / len(SIGNALS),
        "rank_spread": rank_spread(ranks), "top5_agreement": agreement(ranks, 5), "top10_agreement": agreement(ranks, 10),
        "network_rank_mean": network_mean, "vector_network_gap": F.col("vector_rank") - network_mean})


def consensus(signals: DataFrame, n: int, key: str = "stock_code") -> DataFrame:
    return signals.orderBy(F.desc("top10_agreement"), F.desc("top5_agreement"), F.desc("mean_percentile"), F.asc(key)).limit(n)


def disagreement(signals: DataFrame, n: int = 15, key: str = "stock_code") -> DataFrame:
    return signals.orderBy(F.desc("rank_spread"), F.asc(key)).limit(n)


def late_fusion(signals: DataFrame, weights: dict[str, float] | None = None, top: int = 5, key: str = "stock_code") -> DataFrame:
    """Peers by weighted sum of percentiles; equal weights unless given."""
    weights = weights or {s: 1 / len(SIGNALS) for s in SIGNALS}
    fused = F.round(reduce(lambda a, b: a + b, [F.col(f"{s}_percentile") * w for s, w in weights.items()]), 6)
    return signals.withColumn("fused_score", fused).orderBy(F.desc("fused_score"), F.asc(key)).limit(top)


def drill_down(signals: DataFrame, aligned: DataFrame, pairs: DataFrame, chosen: DataFrame, key: str = "stock_code",
               nodes: int = 5, edges: int = 5) -> DataFrame:
    """Signals of chosen companies with their best node, edge and sentence matches.

    ``aligned`` and ``pairs`` name the company ``candidate``.
    """
    by = lambda c, n: F.slice(F.array_sort(F.transform(c, lambda x: F.struct((-x["similarity"]).alias("s"), x.alias("m")))), 1, n)
    detail = aligned.select(F.col("candidate").alias(key), F.transform(by("node_matches", nodes), lambda x: x["m"]).alias("top_nodes"),
                            F.transform(by("edge_matches", edges), lambda x: x["m"]).alias("top_edges"))
    sentences = pairs.groupBy(F.col("candidate").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("pair_rank", "target_pos", "candidate_pos", "similarity"))).alias("top_sentences"))
    return signals.join(chosen.select(key), key, "left_semi").join(detail, key, "left").join(sentences, key, "left")
