"""Business sections, concept groups and the candidate pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import text as X


def _found(c: Column, heading: str, start=None) -> Column:
    """1-based position of ``heading``, null when absent."""
    at = F.call_function("locate", F.lit(heading), c, start) if start is not None else F.instr(c, heading)
    return F.when(at > 0, at)


def section_slice(c: Column, starts=None, ends=None, fallback: int = L.SLICE_FALLBACK_CHARS) -> Column:
    """From the earliest start heading to the earliest end heading behind it."""
    starts, ends = starts or L.SLICE_STARTS, ends or L.SLICE_ENDS
    begin = F.array_min(F.array(*[_found(c, h) for h in starts]))
    end = F.array_min(F.array(*[_found(c, h, begin + 1) for h in ends]))
    length = F.coalesce(end - begin, F.lit(fallback))
    return F.coalesce(X.clean_search(F.substring(c, begin, length)), F.lit(""))


def regions(c: Column, starts=None, ends=None, fallback: int = L.REGION_FALLBACK_CHARS, minimum: int = L.REGION_MIN_CHARS) -> Column:
    """Every start heading to the next end heading: ``array<struct<pos,heading,text>>``."""
    starts, ends = starts or L.REGION_STARTS, ends or L.REGION_ENDS
    opened = F.flatten(F.array(*[
        F.transform(X.occurrences(c, h), lambda p: F.struct(p.alias("pos"), F.lit(h).alias("heading"))) for h in starts]))

    def cut(o):
        after = o["pos"] + F.length(o["heading"]) + 1
        end = F.array_min(F.array(*[_found(c, h, after) for h in ends]))
        body = X.strip(F.substring(c, o["pos"] + 1, F.coalesce(end - 1 - o["pos"], F.lit(fallback))))
        return F.struct(o["pos"].alias("pos"), o["heading"].alias("heading"), body.alias("text"))

    return F.filter(F.transform(F.array_sort(opened), cut), lambda r: F.length(r["text"]) >= minimum)


def group_matches(c: Column, groups: dict[str, list[str]]) -> Column:
    """Map from concept group to its sorted terms found in the text."""
    entries = F.array(*[
        F.struct(F.lit(g).alias("key"), F.array_sort(F.array_distinct(X.term_hits_nocase(c, terms))).alias("value"))
        for g, terms in groups.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def with_concepts(texts: DataFrame, column: str = "business_text", industry=None, business=None) -> DataFrame:
    """Concept groups of each text and its prefilter score."""
    c = F.col(column)
    out = texts.withColumns({"industry_groups": group_matches(c, industry or L.INDUSTRY_GROUPS),
                             "business_groups": group_matches(c, business or L.BUSINESS_GROUPS)})
    n_i, n_b = F.size("industry_groups"), F.size("business_groups")
    return out.withColumns({"n_industry": n_i, "n_business": n_b,
                            "prefilter_score": n_i * L.INDUSTRY_GROUP_WEIGHT + n_b * L.BUSINESS_GROUP_WEIGHT})


def pool_outcome(candidates: DataFrame, min_industry: int = L.MIN_INDUSTRY_GROUPS, min_business: int = L.MIN_BUSINESS_GROUPS) -> DataFrame:
    """Name the one step of the funnel each company ends at."""
    blank = F.trim(F.coalesce("business_text", F.lit(""))) == ""
    return candidates.withColumn(
        "outcome",
        F.when(F.col("rcept_no").isNull(), "no_filing").when(blank, "no_text")
        .when(F.col("n_industry") < min_industry, "industry_failed")
        .when(F.col("n_business") < min_business, "business_failed").otherwise("passed"))


OUTCOMES = ["no_filing", "no_text", "industry_failed", "business_failed", "passed"]


def funnel(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count("*").alias("checked"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def best_candidates(outcomes: DataFrame, limit: int = L.MAX_CANDIDATES, tie: str = "corp_code") -> DataFrame:
    return (outcomes.filter(F.col("outcome") == "passed")
            .orderBy(F.desc("prefilter_score"), F.desc("n_industry"), F.desc("n_business"), F.asc(tie)).limit(limit))


def keyword_presence(texts: DataFrame, keys: list[str], column: str = "text", keywords=None) -> DataFrame:
    """One row per text: its keywords found, those missing and the count."""
    keywords = keywords or L.PRESENCE_KEYWORDS
    found = X.term_hits(F.col(column), keywords)
    return texts.select(*keys, found.alias("found"), *[F.col(column).contains(k).alias(f"has_{i + 1:02d}") for i, k in enumerate(keywords)]).withColumns(
        {"missing": F.array_except(F.array(*[F.lit(k) for k in keywords]), F.col("found")), "n_found": F.size("found")})


def merged_dictionary(common: DataFrame, domain: DataFrame) -> DataFrame:
    """Ordered unique keywords per category, common ones first.

    Both inputs: category, pos, keyword.  A keyword listed twice keeps its first
    place.
    """
    both = common.withColumn("src", F.lit(0)).unionByName(domain.withColumn("src", F.lit(1)))
    first = both.groupBy("category", "keyword").agg(F.min(F.struct("src", "pos")).alias("at"))
    return first.select("category", "keyword", F.col("at.src").alias("src"), F.col("at.pos").alias("pos"))
