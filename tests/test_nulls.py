"""Rows with null keys stay; stored data survives fresh checkpoints."""

import datetime

from pyspark.sql import functions as F

from filinglens.operators import chunks, finance, ordering, versions
from filinglens.streaming.ingest import ingest


def test_numbering_keeps_null_groups(spark):
    rows = spark.createDataFrame([(g, i) for i, g in enumerate(["a", None, "a", None, None, "b", "a", None, "b"])], "g string, i int")
    got = ordering.number_rows(rows, [F.asc("i")], "n", ["g"], "total").collect()
    assert sorted(((r.g or "-"), r.i, r.n, r.total) for r in got) == [
        ("-", 1, 1, 4), ("-", 3, 2, 4), ("-", 4, 3, 4), ("-", 7, 4, 4), ("a", 0, 1, 3), ("a", 2, 2, 3), ("a", 6, 3, 3), ("b", 5, 1, 2), ("b", 8, 2, 2)]
    c = spark.createDataFrame([("risk", None, "text", 1)], "category string, report_type string, source_type string, o int")
    assert [r.chunk_id for r in chunks.number_chunks(c, ["o"]).collect()] == ["risk__text_0001"]


def test_basis_and_first_occurrence_keep_nulls(spark):
    s = spark.createDataFrame([("A", None, "annual", "CFS"), ("A", None, "annual", "OFS"), ("B", 2020, None, "OFS")], "company string, business_year int, dart_report_type string, fs_div string")
    assert sorted((r.company, r.fs_div) for r in finance.prefer_consolidated(s).collect()) == [("A", "CFS"), ("B", "OFS")]
    f = spark.createDataFrame([(None, None, "x"), (None, 2, "x"), ("c", 1, "y")], "company string, at int, fingerprint string")
    assert sorted((r.fingerprint, str(r.at)) for r in chunks.first_occurrences(f, ["at"], ["company"]).collect()) == [("x", "None"), ("y", "1")]


def test_groups_of_a_pattern():
    assert [versions._groups(p) for p in (r"a[(]b", r"\((x)", r"(?<n>x)(y)", r"(?:a)(?<=b)")] == [0, 1, 2, 0]


def test_a_second_checkpoint_adds_to_the_sink(spark, tmp_path):
    def put(folder, rows):
        spark.createDataFrame(rows, "rcept_no string, rcept_dt date, v int").write.mode("append").parquet(f"{tmp_path}/{folder}")

    day = datetime.date(2024, 1, 1)
    schema = "rcept_no string, rcept_dt date, v int"
    put("one", [("1", day, 1), ("2", day, 1), ("2", day, 5)])
    put("two", [("2", day, 9), ("3", day, 1)])
    kind = spark.createDataFrame([], schema).schema
    for source in ("one", "two"):
        ingest(spark, f"{tmp_path}/{source}", f"{tmp_path}/out", f"{tmp_path}/state-{source}", kind, version="v").awaitTermination()
    got = sorted((r.rcept_no, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("1", 1), ("2", 5), ("3", 1)]
    ingest(spark, f"{tmp_path}/one", f"{tmp_path}/out", f"{tmp_path}/fresh", kind, version="v").awaitTermination()  # everything again
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_a_hot_cluster_of_variants_stays_linear(spark):
    from filinglens.operators import neardup

    base = "이 회사는 화장품 원료를 제조하여 국내외 고객사에 공급하는 사업을 영위하고 있으며 주요 제품은 기능성 소재이다"
    rows = [("A", i, base + f" {i:04d}") for i in range(1500)] + [("A", 5000 + i, f"{i * 7919 % 1000:03d}" + "".join(chr(0xAC00 + (i * 131 + j * j * 37) % 9000) for j in range(60))) for i in range(50)]
    df = spark.createDataFrame(rows, "company string, at int, sentence string")
    firsts = df.select("company", F.lpad(F.col("at").cast("string"), 20, "0").alias("ord"), F.col("sentence").alias("text"))
    assert neardup.behind_first(firsts, "company", 0.93).count() <= 4 * len(rows)
    got = sorted(r.at for r in neardup.drop_near_duplicates(df, "company", ["at"], "sentence").collect())
    assert got == [0] + list(range(5000, 5050))


def test_outcomes_add_up(spark):
    from filinglens.operators import evidence

    rows = [("A", i, d, s) for i, (d, s) in enumerate([("company", "우리 회사는 화장품을 제조하여 판매하고 있습니다"), ("company", "우리 회사는 화장품을 제조하여 판매하고 있습니다."), ("noise", "x"), ("industry", "산업"), ("industry", "산업"), ("peer", "y")])]
    rows += [(None, 9, "company", "이름 없는 회사")]
    got = {r.source: r.asDict() for r in evidence.extraction_outcomes(spark.createDataFrame(rows, "source string, at int, disposition string, sentence string"), "source", ["at"]).collect()}
    a = got["A"]
    assert (a["company"], a["company_duplicate"], a["industry"], a["industry_duplicate"], a["noise"], a["peer"]) == (1, 1, 1, 1, 1, 1)
    for r in got.values():
        assert r["total_sentences"] == sum(r[k] for k in [*evidence.DISPOSITIONS, "company_duplicate", "industry_duplicate"])


def test_definitions_from_files(spark, tmp_path):
    import json

    from filinglens.operators import responses
    from filinglens.sources import readers

    (tmp_path / "c.json").write_text(json.dumps({"a": ["x", "y", "x"], "b": ["z"]}, indent=1))
    (tmp_path / "d.json").write_text(json.dumps({"a": ["y", "w"], "q": ["v"]}))
    got = sorted((r.category, r.pos, r.keyword) for r in readers.dictionary_files(spark, str(tmp_path / "c.json"), str(tmp_path / "d.json")).collect())
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "w"), ("b", 0, "z")]
    assert readers.dictionary_files(spark, str(tmp_path / "c.json")).count() == 3
    (tmp_path / "f.json").write_text(json.dumps({"products_services": {"queries": ["q1", "q2"], "rules": ["r"]}}))
    fields = responses.profile_fields(spark)
    new = {r.field: (r.queries, r.rules) for r in responses.defined_fields(fields, readers.field_definitions(spark, str(tmp_path / "f.json"))).collect()}
    assert new["products_services"] == (["q1", "q2"], ["r"]) and len(new) == 18 and sum(len(q) for q, _ in new.values()) == 19


def test_scratch_is_removed(spark):
    import os

    from filinglens import session

    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    session.clear_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
