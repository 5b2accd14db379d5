"""Readers with fixed schemas for registries, caches, statements and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY_COLUMNS = ["corp_code", "corp_name", "corp_eng_name", "stock_code", "modify_date"]
STATEMENT_COLUMNS = ["sj_div", "sj_nm", "account_id", "account_nm", "account_detail", "thstrm_amount", "thstrm_add_amount",
                     "frmtrm_amount", "frmtrm_add_amount", "thstrm_nm", "frmtrm_nm", "currency"]


def _texts(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CACHE_SCHEMA = T.StructType([
    T.StructField("analysis_as_of", T.StringType()),
    T.StructField("company", _texts(["corp_code", "stock_code", "company_name", "krx_company_name", "market", "listing_date", "listed_shares"])),
    T.StructField("filing", _texts(["rcept_no", "rcept_dt", "report_nm"])),
    T.StructField("business_text", T.StringType()),
])
STATEMENT_SCHEMA = T.StructType([
    T.StructField("company", T.StringType()), T.StructField("business_year", T.IntegerType()),
    T.StructField("dart_report_type", T.StringType()), T.StructField("fs_div", T.StringType()),
    T.StructField("statements", T.ArrayType(_texts(STATEMENT_COLUMNS))),
    T.StructField("_corrupt_record", T.StringType()),
])


def registry(spark: SparkSession, path: str, stock_code: str = "keep") -> DataFrame:
    """Company registry from XML ``<list>`` records, values trimmed.

    ``stock_code``: ``keep`` leaves blanks, ``null`` turns them to null, ``require``
    drops the rows.
    """
    raw = spark.read.format("xml").option("rowTag", "list").schema(_texts(REGISTRY_COLUMNS)).load(path)
    rows = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in REGISTRY_COLUMNS])
    if stock_code == "null":
        return rows.withColumn("stock_code", F.when(F.col("stock_code") != "", F.col("stock_code")))
    return rows.filter("stock_code <> ''") if stock_code == "require" else rows


def candidate_cache(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Cached candidates, nested objects flattened."""
    rows = spark.read.schema(CACHE_SCHEMA).option("multiLine", multi_line).json(path)
    return rows.select("analysis_as_of", "company.*", "filing.rcept_no", "filing.rcept_dt", "filing.report_nm", "business_text")


def statements(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Statement rows in file order, and the files that could not be read."""
    raw = (spark.read.schema(STATEMENT_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("path", F.input_file_name()))
    bad = F.col("_corrupt_record").isNotNull() | F.col("business_year").isNull() | F.col("dart_report_type").isNull()
    rows = raw.filter(~bad).select("company", "business_year", "dart_report_type", "fs_div", F.posexplode("statements").alias("line_no", "s"))
    return rows.select("company", "business_year", "dart_report_type", "fs_div", "line_no", "s.*"), raw.filter(bad).select("path", "_corrupt_record")


def listing(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column text so codes keep their zeros."""
    return spark.read.schema(_texts(columns)).option("header", True).csv(path)


def archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def _keyed_lists(spark: SparkSession, path: str) -> DataFrame:
    """Category, its place in the file and terms of a JSON object of lists, read whole."""
    lists = F.from_json("value", "map<string,array<string>>")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(lists)).alias("at", "e")).select("at", F.col("e.key").alias("category"), F.coalesce("e.value", F.array().cast("array<string>")).alias("terms"))


def dictionary_files(spark: SparkSession, common: str, domain: str | None = None) -> DataFrame:
    """As :func:`dictionary`, from a file of common terms and one of the domain's (JSON: category to list)."""
    base = _keyed_lists(spark, common)
    terms = F.col("terms")
    if domain is not None:
        base = base.join(_keyed_lists(spark, domain).select("category", F.col("terms").alias("more")), "category", "left")
        terms = F.concat(terms, F.coalesce("more", F.array().cast("array<string>")))
    return base.select("category", F.posexplode(F.array_distinct(terms)).alias("pos", "keyword"))


def field_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Search queries and judging rules of profile fields from a file (JSON: field to {queries, rules})."""
    kind = "map<string,struct<queries:array<string>,rules:array<string>>>"
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("field", "d")).select("field", "d.queries", "d.rules")


def dictionary(spark: SparkSession, common: dict[str, list[str]], domain: dict[str, list[str]]) -> DataFrame:
    """Keyword dictionary rows: common terms first, repeated terms once."""
    rows = [(c, p, w) for c in common for p, w in enumerate(dict.fromkeys([*common[c], *domain.get(c, [])]))]
    return spark.createDataFrame(rows, "category string, pos int, keyword string")
