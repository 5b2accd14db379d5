"""Sentence evidence: filters, scoring, disposition, core selection, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import text as X
from filinglens.operators.neardup import drop_near_duplicates
from filinglens.operators.ordering import top_per_group
from filinglens.session import join_safe, materialise, once


class Vocabulary:
    """Terms the sentence filters use; Korean disclosure terms unless given."""

    def __init__(self, keywords=None, noise=None, correction=None, peer=None, other=None, industry=None, anchors=None,
                 prefixes=None, self_weights=None, pairs=None):
        pick = lambda given, default: default if given is None else given
        self.keywords = pick(keywords, {c: list(dict.fromkeys(L.PROFILE_KEYWORDS_COMMON[c] + L.PROFILE_KEYWORDS_BEAUTY[c]))
                                        for c in L.PROFILE_CATEGORIES})
        self.noise = pick(noise, L.NOISE_TERMS)
        self.correction = pick(correction, L.CORRECTION_NOTES)
        self.peer = pick(peer, L.PEER_TERMS)
        self.other = pick(other, L.OTHER_COMPANY_WORD)
        self.industry = pick(industry, L.INDUSTRY_TERMS)
        self.anchors = pick(anchors, L.SELF_ANCHORS)
        self.prefixes = pick(prefixes, L.NAME_PREFIXES)
        self.self_weights = pick(self_weights, L.SELF_WEIGHTS)
        self.pairs = pick(pairs, L.CATEGORY_PAIR_BONUS)

    # predicates over a sentence column and a company-name column

    def is_noise(self, s: Column) -> Column:
        return X.any_term(s, self.noise) | (X.any_term(s, self.correction) & (F.length(s) < L.CORRECTION_NOTE_CHARS))

    def is_anchored(self, s: Column, name: Column) -> Column:
        return X.any_term(s, self.anchors) | ((name != "") & F.contains(s, name))

    def is_peer(self, s: Column, name: Column) -> Column:
        return X.any_term(s, self.peer) | (s.contains(self.other) & ~self.is_anchored(s, name))

    def is_industry(self, s: Column, name: Column) -> Column:
        return ~self.is_anchored(s, name) & X.any_term(s, self.industry)

    def target_score(self, s: Column, name: Column) -> Column:
        named = [F.when(F.contains(s, n), L.NAME_WEIGHT).otherwise(0)
                 for n in [name, *[F.concat(F.lit(p), name) for p in self.prefixes]]]
        worded = [F.when(s.contains(w), v).otherwise(0) for w, v in self.self_weights]
        return reduce(lambda a, b: a + b, named + worded)

    def categories(self, s: Column) -> Column:
        return X.dictionary_tags(s, self.keywords)

    def relevance(self, s: Column, categories: Column, name: Column) -> Column:
        hits = reduce(lambda a, b: a + b, [X.hit_count(s, t) for t in self.keywords.values()])
        bonus = reduce(lambda a, b: a + b, [
            F.when(F.array_contains(categories, a) & F.array_contains(categories, b), v).otherwise(0) for a, b, v in self.pairs])
        return F.size(categories) * 2 + hits + self.target_score(s, name) + bonus


DISPOSITIONS = ["noise", "peer", "no_category", "industry", "no_anchor", "company"]


def sentence_table(texts: DataFrame, keys: list[str], column: str = "text", low: int = L.SENTENCE_MIN_CHARS,
                   high: int = L.SENTENCE_MAX_CHARS) -> DataFrame:
    """One row per sentence with its position in the text.

    Spark filters what goes into an inner explode by its size, which would split every text twice.
    """
    return texts.select(*keys, F.posexplode_outer(X.sentences(F.col(column), low, high)).alias("sentence_pos", "sentence")).filter("sentence_pos IS NOT NULL")


def judged(sentences: DataFrame, vocabulary: Vocabulary | None = None, name: str = "company_name") -> DataFrame:
    """Each sentence with categories, score and the one filter that decided it.

    Duplicates are settled afterwards, within the ``industry`` and ``company`` rows.
    """
    v = vocabulary or Vocabulary()
    s, n = F.col("sentence"), F.coalesce(F.col(name), F.lit(""))
    tagged = once(sentences, categories=v.categories(s))
    decided = once(tagged, disposition=F.when(v.is_noise(s), "noise").when(v.is_peer(s, n), "peer")
                   .when(F.size("categories") == 0, "no_category").when(v.is_industry(s, n), "industry")
                   .when(~v.is_anchored(s, n), "no_anchor").otherwise("company"))
    return decided.withColumn("relevance_score", v.relevance(s, F.col("categories"), n))


def extraction_counts(judged_rows: DataFrame, groups: list[str]) -> DataFrame:
    return judged_rows.groupBy(*groups).agg(
        F.count("*").alias("total_sentences"),
        *[F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS])


def extraction_outcomes(judged_rows: DataFrame, company: str, order: list[str], threshold: float = L.NEAR_DUPLICATE_RATIO, ratio: str = "sequence") -> DataFrame:
    """Eight disjoint outcomes per company that add up to its sentences: the dispositions, and duplicates of company and industry rows."""
    kinds = ("company", "industry")
    text = F.when(F.col("disposition").isin(*kinds), F.col("sentence")).alias("sentence")
    judged_rows = materialise(judged_rows.select(company, *order, "disposition", text))  # read twice, judged once
    kept = kept_evidence(judged_rows, company, order, threshold, ratio, kinds)
    counts = kept.groupBy(company).agg(*[F.count_if(F.col("disposition") == d).alias(f"_{d}") for d in kinds])
    out = join_safe(extraction_counts(judged_rows, [company]), counts, [company], "left")
    for d in kinds:
        n = F.coalesce(f"_{d}", F.lit(0).cast("long"))
        out = out.withColumn(f"{d}_duplicate", F.col(d) - n).withColumn(d, n)
    return out.drop(*[f"_{d}" for d in kinds])


def kept_evidence(judged_rows: DataFrame, company: str, order: list[str], threshold: float = L.NEAR_DUPLICATE_RATIO, ratio: str = "sequence",
                  kinds: tuple[str, ...] = ("company", "industry")) -> DataFrame:
    """Evidence of several dispositions, each without near duplicates of its own earlier sentences, settled together."""
    mine = judged_rows.filter(F.col("disposition").isin(*kinds)).withColumn("_who", F.to_json(F.struct(company, "disposition")))
    return drop_near_duplicates(mine, "_who", order, "sentence", threshold, ratio).drop("_who")


def company_evidence(judged_rows: DataFrame, company: str, order: list[str], threshold: float = L.NEAR_DUPLICATE_RATIO,
                     disposition: str = "company", ratio: str = "sequence") -> DataFrame:
    """Evidence sentences with near duplicates of earlier ones removed."""
    return drop_near_duplicates(judged_rows.filter(F.col("disposition") == disposition), company, order, "sentence", threshold, ratio)


def category_counts(evidence: DataFrame, groups: list[str]) -> DataFrame:
    """Rows per category; a row counts once for each category it has."""
    return evidence.select(*groups, F.explode("categories").alias("category")).groupBy(*groups, "category").agg(F.count("*").alias("n"))


def core_evidence(evidence: DataFrame, company: str, order: list[str], categories=None, per_category: int = L.CORE_PER_CATEGORY,
                  max_items: int = L.CORE_MAX_ITEMS, score: str = "relevance_score") -> DataFrame:
    """Core sentences: some for each category in turn, then the best of the rest.

    A row taken for one category is out of the next category's pass, so the k-th
    category can need rows up to place ``per_category * k`` of its own ranking.
    The small top lists are cut out first, in one shuffle; the sequential passes
    and the fill then run on bounded rows only.
    """
    categories = categories or L.PROFILE_CATEGORIES
    by = [F.desc(score), *[F.asc(c) for c in order]]
    keep = [company, *order, score]
    reach = max(per_category * len(categories), max_items)
    tagged = evidence.select(*keep, "categories")
    lists = F.array_union(F.array(F.lit("*")), F.array_intersect("categories", F.array(*[F.lit(c) for c in categories])))
    tops = top_per_group(tagged.select(*keep, "categories", F.explode(lists).alias("_list")), [company, "_list"], by, reach, "_r")
    item = F.struct((-F.col(score)).alias("neg"), *order, "categories")
    pools = tops.groupBy(company).agg(F.array_sort(F.collect_set(item)).alias("pool"))
    taken = F.array().cast(pools.schema["pool"].dataType)
    for c in categories:
        fresh = F.filter(F.col("pool"), lambda x: F.array_contains(x["categories"], c) & ~F.array_contains(taken, x))
        pools = pools.withColumn(f"_t_{c}", F.concat(taken, F.slice(fresh, 1, per_category)))
        taken = F.col(f"_t_{c}")
    rest = F.array_except(F.col("pool"), taken)
    room = F.greatest(F.lit(max_items) - F.size(taken), F.lit(0))
    selected = F.concat(taken, F.slice(rest, 1, room))
    placed = F.array_sort(F.transform(selected, lambda x, i: F.struct(x["neg"].alias("neg"), i.alias("at"), *[x[c].alias(c) for c in order])))
    picked = pools.select(company, F.posexplode(F.slice(placed, 1, max_items)).alias("_at", "x")).select(
        company, (F.col("_at") + 1).cast("bigint").alias("core_rank"), *[F.col(f"x.{c}").alias(c) for c in order])
    return join_safe(evidence, picked, [company, *order])


def profile_text(core: DataFrame, company: str, column: str = "sentence") -> DataFrame:
    """Core sentences of each company joined by newline in core order."""
    ordered = F.array_sort(F.collect_list(F.struct("core_rank", F.col(column).alias("t"))))
    return core.groupBy(company).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("profile_text"),
                                     F.count("*").alias("core_count"))


def profile_records(core: DataFrame, company: str, counts: DataFrame | None = None, category_counts_table: DataFrame | None = None,
                    column: str = "sentence") -> DataFrame:
    """One nested record per company: core evidence in order, text, counters.

    Only the core sentences (at most forty) are nested; the full evidence stays a
    table of its own.
    """
    item = F.struct("core_rank", F.col(column).alias("text"), "categories", "relevance_score")
    out = core.groupBy(company).agg(F.array_sort(F.collect_list(item)).alias("core_evidence")).withColumns({
        "profile_text": F.array_join(F.transform("core_evidence", lambda x: x["text"]), "\n"), "core_evidence_count": F.size("core_evidence")})
    if category_counts_table is not None:
        maps = category_counts_table.groupBy(company).agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("category_counts"))
        out = out.join(maps, company, "left")
    return out.join(counts, company, "left") if counts is not None else out


def flatten_core(records: DataFrame, company: str) -> DataFrame:
    """Non-empty core sentences of nested records with categories and score."""
    rows = records.select(company, F.posexplode("core_evidence").alias("sentence_pos", "e"))
    return rows.select(company, "sentence_pos", F.trim("e.text").alias("text"), "e.categories", "e.relevance_score").filter("text <> ''")
