"""Filing lists: dates, versions, first and latest events, report counts.

Expected columns: corp_code, corp_name, rcept_no, rcept_dt (date), report_nm.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import ident
from filinglens.functions.text import all_terms, any_term
from filinglens.operators.ordering import latest_per_group

FILING_ORDER = ["rcept_dt", "rcept_no"]


def as_of(filings: DataFrame, day: str | Column) -> DataFrame:
    return filings.filter(F.col("rcept_dt") <= _day(day))


def before(filings: DataFrame, day: str | Column) -> DataFrame:
    return filings.filter(F.col("rcept_dt") < _day(day))


def within_lookback(filings: DataFrame, day: str | Column, days: int = L.LOOKBACK_DAYS) -> DataFrame:
    end = _day(day)
    return filings.filter(F.col("rcept_dt").between(F.date_sub(end, days), end))


def _day(day: str | Column) -> Column:
    return F.lit(day).cast("date") if isinstance(day, str) else day


def named_all(filings: DataFrame, terms: list[str]) -> DataFrame:
    return filings.filter(all_terms(F.col("report_nm"), terms))


def named_any(filings: DataFrame, terms: list[str]) -> DataFrame:
    return filings.filter(any_term(F.col("report_nm"), terms))


def named_exactly(filings: DataFrame, name: str) -> DataFrame:
    return filings.filter(F.col("report_nm") == name)


def classify(filings: DataFrame) -> DataFrame:
    kind = ident.report_type(F.col("report_nm"))
    return filings.withColumns({
        "report_type": kind,
        "form_code": ident.form_code(F.coalesce(kind, F.when(F.col("report_nm").contains("증권신고서"), F.lit("securities")))),
        "report_period": ident.report_period(F.col("report_nm")),
        "source_url": ident.viewer_url(F.col("rcept_no")),
    })


def validity(filings: DataFrame) -> DataFrame:
    """Add ``problem``: null for a usable row, else what is wrong with its identifiers."""
    day = F.to_date(F.col("rcept_dt"))
    return filings.withColumn(
        "problem",
        F.when(~F.coalesce(F.col("corp_code"), F.lit("")).rlike(r"^\d{8}$"), "corp_code")
        .when(~F.coalesce(F.col("rcept_no"), F.lit("")).rlike(r"^\d{14}$"), "rcept_no")
        .when(day.isNull(), "rcept_dt"))


def quarantine(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validity(filings)
    return checked.filter("problem is null").drop("problem"), checked.filter("problem is not null")


def upsert(filings: DataFrame, version: list[str]) -> DataFrame:
    """One row per rcept_no; the row latest by ``version`` wins."""
    return latest_per_group(filings, ["rcept_no"], version, filings.columns).select(*filings.columns)


def periodic_list(filings: DataFrame, start: str, end: str, version: list[str] | None = None) -> DataFrame:
    if dt.date.fromisoformat(start) > dt.date.fromisoformat(end):
        raise ValueError("start is later than end")
    listed = classify(filings.filter(F.col("rcept_dt").between(_day(start), _day(end)))).filter("report_type is not null")
    return upsert(listed, version or ["rcept_dt"])


def latest_per_type(filings: DataFrame) -> DataFrame:
    listed = classify(filings).filter("report_type is not null")
    return latest_per_group(listed, ["corp_code", "report_type"], FILING_ORDER, ["report_nm"])


def latest_periodic_as_of(companies: DataFrame, filings: DataFrame, day: str, days: int = L.LOOKBACK_DAYS) -> DataFrame:
    """Each company with its newest periodic filing in the lookback, null if none."""
    window = named_any(within_lookback(filings, day, days), list(L.REPORT_TYPES))
    newest = latest_per_group(window, ["corp_code"], FILING_ORDER, ["report_nm"])
    return companies.join(newest, "corp_code", "left")


def first_original(filings: DataFrame, name: str = L.SECURITIES_REPORT) -> DataFrame:
    """Earliest exactly-named filing per company after rcept_no dedup."""
    exact = named_exactly(filings, name).dropDuplicates(["rcept_no"])
    return latest_per_group(exact, ["corp_code"], FILING_ORDER, ["report_nm"], earliest=True)


def recent_issuers(filings: DataFrame, start: str, end: str, term: str = L.SECURITIES_REPORT) -> DataFrame:
    """Companies filing in [start, end] with their first ever and newest recent filing.

    One pass: both ends come out of a single aggregate per company.
    """
    named = filings.filter(F.col("report_nm").contains(term) & (F.col("rcept_dt") <= _day(end)))
    row = F.struct("rcept_dt", "rcept_no", "report_nm")
    both = named.groupBy("corp_code").agg(
        F.min(row).alias("f"), F.max(F.when(F.col("rcept_dt") >= _day(start), row)).alias("r"))
    return both.filter("r is not null").select(
        "corp_code",
        F.col("f.rcept_dt").alias("first_rcept_dt"), F.col("f.rcept_no").alias("first_rcept_no"),
        F.col("f.report_nm").alias("first_report_nm"),
        F.col("r.rcept_dt").alias("recent_rcept_dt"), F.col("r.rcept_no").alias("recent_rcept_no"),
        F.col("r.report_nm").alias("recent_report_nm"))


def pre_event_reports(events: DataFrame, filings: DataFrame) -> DataFrame:
    """Every periodic report filed before the company's event day.

    ``events``: one row per company, corp_code and event_dt.
    """
    reports = classify(filings).filter("report_type is not null")
    return reports.join(events.select("corp_code", "event_dt"), "corp_code").filter(
        F.col("rcept_dt") <= F.date_sub("event_dt", 1))


def pre_event_counts(events: DataFrame, filings: DataFrame) -> DataFrame:
    """Per company: reports per type, total, newest report, whether any exists."""
    found = pre_event_reports(events, filings)
    kinds = ["annual", "semiannual", "quarterly"]
    row = F.struct("rcept_dt", "rcept_no", "report_type", "report_nm")
    counted = found.groupBy("corp_code").agg(
        *[F.count_if(F.col("report_type") == k).alias(f"{k}_count") for k in kinds],
        F.count("*").alias("total_count"), F.max(row).alias("newest"))
    return (events.select("corp_code", "event_dt").join(counted, "corp_code", "left")
            .fillna(0, [f"{k}_count" for k in kinds] + ["total_count"])
            .select("corp_code", "event_dt", *[f"{k}_count" for k in kinds], "total_count",
                    (F.col("total_count") > 0).alias("has_report"),
                    F.col("newest.report_type").alias("latest_type"),
                    F.col("newest.rcept_dt").alias("latest_dt"),
                    F.col("newest.rcept_no").alias("latest_no")))


def reports_before_first_event(filings: DataFrame, event_term: str = L.SECURITIES_REPORT) -> DataFrame:
    """Companies with an annual or quarterly report before their own first event.

    The first event is an aggregate joined back, so no company's rows have to
    sit in one task.
    """
    first = (filings.filter(F.col("report_nm").contains(event_term)).groupBy("corp_code")
             .agg(F.min(F.struct("rcept_dt", "rcept_no")).alias("e"))
             .select("corp_code", F.col("e.rcept_dt").alias("event_dt"), F.col("e.rcept_no").alias("event_no")))
    earlier = (classify(filings).filter(F.col("report_type").isin("annual", "quarterly"))
               .join(first, "corp_code").filter(F.col("rcept_dt") < F.col("event_dt")))
    return earlier.groupBy("corp_code", "event_dt", "event_no").agg(
        F.count_if(F.col("report_type") == "annual").alias("annual_count"),
        F.count_if(F.col("report_type") == "quarterly").alias("quarterly_count"))


def report_counts(filings: DataFrame) -> DataFrame:
    return (classify(filings).groupBy("corp_code").pivot("report_type", ["annual", "semiannual", "quarterly"])
            .agg(F.count(F.lit(1))).fillna(0, ["annual", "semiannual", "quarterly"]))


def still_to_collect(filings: DataFrame, log: DataFrame) -> DataFrame:
    """Filings without an ``ok`` entry in the collection log."""
    done = log.filter(F.col("download_status") == "ok").select("rcept_no")
    return filings.join(done, "rcept_no", "left_anti")


def date_slices(ranges: DataFrame, months: int = 3) -> DataFrame:
    """Consecutive slices of [start, end] of ``months`` months, the last one clipped."""
    step = F.expr(f"interval {int(months)} months")
    starts = F.sequence(F.col("start").cast("date"), F.col("end").cast("date"), step)
    return (ranges.select("*", F.posexplode(starts).alias("slice", "slice_start"))
            .withColumn("slice_end", F.least(F.date_sub(F.add_months("slice_start", months), 1), F.col("end").cast("date"))))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def collection_manifest(filings: DataFrame, log: DataFrame) -> DataFrame:
    """Filings with their collection status; a filing never tried is ``pending``."""
    return (filings.join(log.select("rcept_no", "download_status", "error"), "rcept_no", "left")
            .withColumn("download_status", F.coalesce("download_status", F.lit("pending"))))
