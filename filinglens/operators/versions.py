"""Fields resolved over filing versions, and valuation figures.

Texts: company, rcept_dt, rcept_no, text — one row per filing version.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import amounts as A
from filinglens.functions import text as X

BEFORE, AFTER = 500, 1500


def contexts(c: Column, keywords: list[str], before: int, after: int) -> Column:
    """Every hit of every keyword, keyword order first: ``array<struct<k,keyword,pos,snippet>>``."""
    return F.flatten(F.array(*[
        F.transform(X.occurrences(c, w), lambda p: F.struct(
            F.lit(i).alias("k"), F.lit(w).alias("keyword"), p.alias("pos"), X.context(c, p, F.lit(len(w)), before, after).alias("snippet")))
        for i, w in enumerate(keywords)]))


def first_contexts(texts: DataFrame, keys: list[str], keywords: list[str], column: str = "text", before: int = 300, after: int = 500,
                   per_keyword: int = 3) -> DataFrame:
    """First hits of each keyword in each text with their surroundings."""
    c = F.col(column)
    hits = F.flatten(F.array(*[
        F.transform(F.slice(X.occurrences(c, w), 1, per_keyword), lambda p, n: F.struct(
            F.lit(w).alias("keyword"), (n + 1).alias("hit"), p.alias("pos"), X.context(c, p, F.lit(len(w)), before, after).alias("snippet")))
        for w in keywords]))
    return texts.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.keyword", "h.hit", "h.pos", "h.snippet")


# --- validators ------------------------------------------------------------------------------

def is_peer_selection(s: Column, terms=None, at_least: int = 2) -> Column:
    return X.hit_count(s, terms or L.PEER_SELECTION_TERMS) >= at_least


def is_valuation_method(s: Column, methods=None, terms=None) -> Column:
    return X.any_term(s, methods or L.PER_TERMS) & X.any_term(s, terms or L.VALUATION_TERMS)


def final_price(s: Column, pattern: str = L.FINAL_PRICE_PATTERN, future=None, confirmed=None) -> Column:
    """The price text when a number is there and the wording is not only about the future."""
    number = F.regexp_extract(s, pattern, 1)
    only_future = X.any_term(s, future or L.FUTURE_TERMS) & ~X.any_term(s, confirmed or L.CONFIRMED_TERMS)
    return F.when((number != "") & ~only_future, number)


VALIDATORS = {
    "peer_selection": lambda s: (is_peer_selection(s), F.lit(None).cast("string")),
    "per_method": lambda s: (is_valuation_method(s), F.lit("PER")),
    "final_offer_price": lambda s: (final_price(s).isNotNull(), final_price(s)),
}


def resolve_field(texts: DataFrame, field: str, keywords: list[str], validator=None, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Newest filing of each company with a snippet that passes the validator.

    The versions looked at are those from the newest down to the one used (all of
    them when none passes); ``checked_versions`` lists the count and
    :func:`checked_versions` the rows.
    """
    validate = validator or VALIDATORS[field]
    hits = F.transform(contexts(F.col("text"), keywords, before, after), lambda h: F.struct(
        h["k"].alias("k"), h["pos"].alias("pos"), h["keyword"].alias("keyword"), h["snippet"].alias("snippet"),
        validate(h["snippet"])[0].alias("ok"), validate(h["snippet"])[1].alias("value")))
    best = F.try_element_at(F.filter(hits, lambda h: h["ok"]), F.lit(1))
    judged = texts.select("company", "rcept_dt", "rcept_no", best.alias("hit"))
    row = F.struct("rcept_dt", "rcept_no", "hit.keyword", "hit.value", "hit.snippet")
    found = judged.groupBy("company").agg(F.max(F.when(F.col("hit").isNotNull(), row)).alias("f"))
    at = F.struct("rcept_dt", "rcept_no")
    looked = (texts.select("company", "rcept_dt", "rcept_no").join(found, "company")
              .filter(F.col("f").isNull() | (at >= F.struct("f.rcept_dt", "f.rcept_no"))).groupBy("company").agg(F.count("*").alias("checked_versions")))
    return found.join(looked, "company").select(
        "company", F.lit(field).alias("field"), F.when(F.col("f").isNull(), "not_found").otherwise("found").alias("status"),
        F.col("f.value").alias("value"), F.col("f.keyword").alias("matched_keyword"), F.col("f.snippet").alias("snippet"),
        F.col("f.rcept_no").alias("rcept_no"), F.col("f.rcept_dt").alias("rcept_dt"), "checked_versions")


def checked_versions(texts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Versions looked at for each company: newest down to the one used."""
    r = resolved.select("company", "field", F.col("rcept_dt").alias("_d"), F.col("rcept_no").alias("_n"))
    at = F.struct("rcept_dt", "rcept_no")
    return texts.select("company", "rcept_dt", "rcept_no").join(r, "company").filter(
        F.col("_n").isNull() | (at >= F.struct(F.col("_d").alias("rcept_dt"), F.col("_n").alias("rcept_no")))).drop("_d", "_n")


# --- figures -----------------------------------------------------------------------------------------

def current_matches(c: Column, patterns: list[str], superseded: str = L.SUPERSEDED_MARK, current: str = L.CURRENT_MARK,
                    window: int = L.SUPERSEDED_WINDOW) -> Column:
    """Matches in pattern order then text order, those in a superseded passage left out."""
    every = F.flatten(F.array(*[
        F.transform(X.match_spans(c, p), lambda m: F.struct(F.lit(i).alias("pattern"), m["pos"].alias("pos"), m["text"].alias("text")))
        for i, p in enumerate(patterns)]))

    def lead(m):
        start = F.greatest(m["pos"] - window, F.lit(0))
        return F.substring(c, start + 1, m["pos"] - start)

    return F.filter(every, lambda m: ~(lead(m).contains(superseded) & ~lead(m).contains(current)))


def _groups(pattern: str) -> int:
    """Capturing groups of a pattern, named ones included."""
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups


def extract_figure(texts: DataFrame, patterns: list[str], superseded: str = L.SUPERSEDED_MARK, current: str = L.CURRENT_MARK,
                   window: int = L.SUPERSEDED_WINDOW, before: int = 300, after: int = 500) -> DataFrame:
    """First valid match of the newest filing that has one, with groups, source and evidence."""
    c = F.col("text")
    first = F.try_element_at(current_matches(c, patterns, superseded, current, window), F.lit(1))
    start = F.greatest(F.col("m.pos") - before, F.lit(0))
    evidence = F.substring(c, start + 1, F.col("m.pos") + F.length("m.text") + after - start)
    per_filing = texts.withColumn("m", first).filter("m is not null").select(
        "company", "rcept_dt", "rcept_no", F.col("m.pattern").alias("pattern"), F.col("m.text").alias("match"), evidence.alias("evidence"))
    newest = per_filing.groupBy("company").agg(F.max(F.struct("rcept_dt", "rcept_no", "pattern", "match", "evidence")).alias("f"))
    out = newest.select("company", "f.*")
    for g in (1, 2):
        value = F.lit(None).cast("string")
        for i, p in enumerate(patterns):
            if _groups(p) >= g:
                value = F.when(F.col("pattern") == i, F.regexp_extract("match", p, g)).otherwise(value)
        out = out.withColumn(f"group{g}", value)
    return out


def valuation_table(texts: DataFrame, patterns=None) -> DataFrame:
    """Price, discount range and price band of each company."""
    patterns = patterns or L.VALUATION_PATTERNS
    price = extract_figure(texts, patterns["valuation_price"]).select(
        "company", A.parse_int(F.col("group1")).alias("valuation_price"), F.col("rcept_no").alias("price_source"))
    rate = extract_figure(texts, patterns["discount_rate"]).select(
        "company", A.parse_float(F.col("group1")).alias("lower_price_discount"), A.parse_float(F.col("group2")).alias("upper_price_discount"),
        F.col("rcept_no").alias("discount_source"))
    band = extract_figure(texts, patterns["offer_price_band"]).select(
        "company", A.parse_int(F.col("group1")).alias("band_low"), A.parse_int(F.col("group2")).alias("band_high"), F.col("rcept_no").alias("band_source"))
    return (texts.select("company").distinct().join(price, "company", "left").join(rate, "company", "left").join(band, "company", "left"))


def resolved_details(resolved: DataFrame) -> DataFrame:
    """Criteria, method and final price read from resolved fields."""
    s, f = F.coalesce("snippet", F.lit("")), F.col("field")
    method = F.when((F.col("value") == "PER") | X.any_term(s, L.PER_TERMS), "PER")
    return resolved.groupBy("company").agg(
        F.max(F.when(f == "peer_selection", F.array_join(X.term_hits(s, L.PEER_CRITERIA), "|"))).alias("criteria"),
        F.max(F.when(f == "per_method", method)).alias("method"),
        F.max(F.when(f == "final_offer_price", A.parse_int(F.col("value")))).alias("final_price")).withColumn(
        "valuation_type", F.when(F.col("method").isNotNull(), "relative_valuation"))


def valuation_fields(texts: DataFrame, fields=None, patterns=None) -> DataFrame:
    """All valuation facts of each company: criteria, method, final price, price, discounts, band."""
    parts = [resolve_field(texts, f, words) for f, words in (fields or L.VERSION_FIELDS).items()]
    resolved = parts[0]
    for p in parts[1:]:
        resolved = resolved.unionByName(p)
    return valuation_table(texts, patterns).join(resolved_details(resolved), "company", "left")
