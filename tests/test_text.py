import re

from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions import text as X
from filinglens.operators import audit as OA
from filinglens.operators import evidence as OE
from filinglens.operators import sections as OS
from filinglens.operators import versions as OV


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).collect()[0].x


def test_cleaning(spark):
    t = " a​\t b﻿  c \n\n\n\n d　"
    assert one(spark, X.clean_inline, t) == "a b c d"
    assert one(spark, X.clean_chunk, t) == "a b c \n\n d"
    assert one(spark, X.clean_document, " a \r\n\r\n\r\n b \n c ") == "a\n\nb\nc"
    assert one(spark, X.clean_search, " a\t\tb\n\n\nc ") == "a b\nc"


def test_sentences_keep_their_bounds(spark):
    a, b = "가" * 40 + ".", "나" * 29
    assert one(spark, X.sentences, f"{a} {b}.\n{b}\n\n{'다' * 1201}") == [a, b + "."]


def test_korean_evidence_dispositions(spark):
    v = OE.Vocabulary()
    pad = " 이 문장은 충분히 긴 설명을 담고 있으며 길이를 채운다"
    s = ["당사의 주요 제품은 화장품과 디바이스입니다" + pad, "수요예측 결과 당사의 제품" + pad, "비교기업의 제품과 당사" + pad, "동사의 제품은 화장품" + pad,
         "아무 관련이 없는 문장입니다" + pad, "화장품 시장 전망은 밝다" + pad, "화장품 제품을 판매한다" + pad, "정정 전 제품은 당사" + pad, "㈜에이피알의 브랜드는 메디큐브" + pad]
    d = spark.createDataFrame([(i, t, "에이피알") for i, t in enumerate(s)], "i int, sentence string, company_name string")
    got = {r.i: (r.disposition, r.relevance_score, r.categories) for r in OE.judged(d, v).collect()}
    assert [got[i][0] for i in range(9)] == ["company", "noise", "peer", "peer", "no_category", "industry", "no_anchor", "noise", "company"]
    assert got[0][2] == ["product"] and got[0][1] == 2 + 4 + 4  # one category, 주요 제품·제품·화장품·디바이스, 당사
    assert got[8][1] == 2 + 2 + 8  # brand, 브랜드·메디큐브, plain and prefixed name


def test_slice_takes_the_first_heading_and_regions_take_all(spark):
    body = "본문 " * 300
    t = "목차 사업의 내용 재무에 관한 사항 본문 II. 사업의 내용\n" + body + "III. 재무에 관한 사항 끝"
    assert one(spark, OS.section_slice, t) == "사업의 내용"
    r = one(spark, OS.regions, t)
    assert [x.heading for x in r] == ["II. 사업의 내용", "사업의 내용"] and all(len(x.text) >= 500 for x in r)
    assert one(spark, OS.section_slice, "없음") == "" and one(spark, OS.regions, "없음") == []


def test_concept_groups_and_funnel(spark):
    rows = [("1", "r", "화장품과 뷰티 디바이스 브랜드 수출"), ("2", None, ""), ("3", "r", " "), ("4", "r", "브랜드 수출"), ("5", "r", "화장품")]
    d = spark.createDataFrame(rows, "corp_code string, rcept_no string, business_text string")
    out = OS.pool_outcome(OS.with_concepts(d))
    got = {r.corp_code: (r.outcome, r.prefilter_score) for r in out.collect()}
    assert got == {"1": ("passed", 11), "2": ("no_filing", 0), "3": ("no_text", 0), "4": ("industry_failed", 2), "5": ("business_failed", 3)}
    assert out.filter("corp_code = '1'").collect()[0].industry_groups == {"cosmetics": ["화장품"], "beauty_device": ["뷰티 디바이스"], "beauty_general": ["뷰티"]}
    assert tuple(OS.funnel(out).collect()[0]) == (5, 1, 1, 1, 1, 1)


def test_occurrences_and_matches(spark):
    for term, text in (("aa", "aaaaa"), ("a.", "a.a.b"), ("\\E", "x\\Ey\\E")):
        assert one(spark, lambda c: X.occurrences(c, term), text) == [m.start() for m in re.finditer(re.escape(term), text)]
    text = "x 12원 12원, 12원"
    assert [(m.pos, m.text) for m in one(spark, lambda c: X.match_spans(c, r"\d+원"), text)] == [(m.start(), m.group()) for m in re.finditer(r"\d+원", text)]


def test_headings_and_lengths(spark):
    t = "머리말\n1. 사업 개요\n" + "가나다 라마바. " * 200 + "\n(2) 제품\n짧음\n원재료\n4. 힣" + "힣" * 1996
    blocks = one(spark, X.heading_blocks, t)
    assert [b.split("\n")[0][:6] for b in blocks] == ["머리말", "1. 사업 ", "(2) 제품", "원재료", "4. 힣힣힣"]
    pieces = one(spark, X.text_pieces, t)
    assert all(L.CHUNK_MIN_CHARS <= len(p) <= L.CHUNK_MAX_CHARS for p in pieces)
    assert [len(p) for p in pieces if p.endswith("힣")] == [900, 900, 397]  # the part behind "4. ": 0-900, 800-1700, 1600-1997
    table = "<!-- table_0001 -->\n" + "| a | b |\n" * 300
    assert len(one(spark, X.length_pieces, table.strip())) == 1


def test_keyword_rules(spark):
    assert one(spark, X.normalise_keyword, " 당사 화장품!! 2023 Beauty-Tech ") == "화장품 beauty-tech"
    noisy = lambda k, s: one(spark, lambda c: X.is_noisy_keyword(c, F.lit(s)), k)
    assert [noisy("화장품", 0.5), noisy("화장품", 0.3), noisy("증가할 수 있다", 0.9), noisy("2023년 12월", 0.9), noisy("12.5 %", 0.9), noisy("a", 0.9)] == [False, True, True, True, True, True]
    central = lambda k: one(spark, X.is_centrality_noise, k)
    assert [central("주 3"), central("화장품법 개정"), central("1,234 (5)"), central("화장품")] == [True, True, True, False]


def test_version_fields(spark):
    old = "확정공모가액은 250,000원으로 확정되었습니다. 사업 유사성 및 재무 유사성 기준으로 선정"
    new = "확정공모가액은 향후 결정할 예정입니다. 유사회사의 PER"
    d = spark.createDataFrame([("A", "2024-01-01", "1", old), ("A", "2024-02-01", "2", new)], "company string, rcept_dt string, rcept_no string, text string")
    price = OV.resolve_field(d, "final_offer_price", L.VERSION_FIELDS["final_offer_price"]).collect()[0]
    assert (price.status, price.value, price.rcept_no, price.checked_versions) == ("found", "250,000", "1", 2)
    per = OV.resolve_field(d, "per_method", L.VERSION_FIELDS["per_method"]).collect()[0]
    assert (per.value, per.rcept_no, per.checked_versions) == ("PER", "2", 1)
    peer = OV.resolve_field(d, "peer_selection", L.VERSION_FIELDS["peer_selection"]).collect()[0]
    assert (peer.matched_keyword, peer.rcept_no) == ("사업 유사성", "1")
    both = [OV.resolve_field(d, f, w) for f, w in L.VERSION_FIELDS.items()]
    detail = OV.resolved_details(both[0].unionByName(both[1]).unionByName(both[2])).collect()[0]
    assert (detail.criteria, detail.method, detail.final_price) == ("사업 유사성|재무 유사성", "PER", 250000)


def test_valuation_figures_skip_superseded(spark):
    t = "정정 전 주당 평가가액 10,000원 " + "가" * 250 + " 주당 평가가액은 20,000 원이며 평가액 대비 할인율 25.5% ~ 13% 희망공모가액 밴드 147,000원 ~ 200,000원"
    d = spark.createDataFrame([("A", "2024-01-01", "1", t), ("A", "2024-02-01", "2", "없음")], "company string, rcept_dt string, rcept_no string, text string")
    r = OV.valuation_table(d).collect()[0]
    assert (r.valuation_price, r.lower_price_discount, r.upper_price_discount, r.band_low, r.band_high, r.price_source) == (20000, 25.5, 13.0, 147000, 200000, "1")


def test_audit_diagnosis(spark):
    docs = spark.createDataFrame([("A", "규제와 인허가"), ("B", "무관"), ("C", "의존도")], "c string, text string")
    chunks = spark.createDataFrame([("A", "1", "규제"), ("B", "2", "무관")], "c string, chunk_id string, content string")
    got = {(r.c, r.field): r.diagnosis for r in OA.recall_audit(docs, chunks, "c").collect()}
    assert got[("A", "R5_regulatory_risk")] == "retrieval_or_query"
    assert got[("B", "R5_regulatory_risk")] == "absent_everywhere"
    assert got[("C", "R2_customer_concentration")] == "lost_before_chunking"


def test_plain_words_skip_the_cleaning_and_come_out_alike(spark):
    """Plain words take no regular expression but the first; a blank around them sends the same word down the long way."""
    words = ["the", "word", "a", "éß", "자사", "주식회사", "ab\n", "Ab", "a-b", "x1", "ŉa", "ªº", "tokens here", "idiotic"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    shaped = lambda c: X.normalise_keyword(c, ["the", "자사"])
    noisy = lambda c, score: X.is_noisy_keyword(c, F.lit(score), phrases=["idiot"])
    padded = F.concat(F.lit(" "), "w", F.lit(" "))
    got = rows.select("w", shaped(F.col("w")).alias("k"), shaped(padded).alias("long_k"), *[noisy(c, s).alias(f"{n}{s}") for n, c in (("n", F.col("w")), ("long_n", padded)) for s in (0.2, 0.9)]).collect()
    assert all(r.k == r.long_k and r["n0.9"] == r["long_n0.9"] and r["n0.2"] == r["long_n0.2"] for r in got)
    assert {r.w: r.k for r in got} == {"the": "", "word": "word", "a": "", "éß": "éß", "자사": "", "주식회사": "주식회사", "ab\n": "ab", "Ab": "ab", "a-b": "a-b", "x1": "x1",
                                       "ŉa": "ŉa", "ªº": "ªº", "tokens here": "tokens here", "idiotic": "idiotic"}


def test_sentences_of_plain_and_odd_texts_are_the_squashed_parts(spark):
    """texts without odd blanks skip the pattern for each sentence; the result is that of the pattern."""
    import random

    from pyspark.sql import functions as F

    from filinglens.functions import text as X

    rng = random.Random(3)
    plain, odd = list(" \n\n ab.!é"), list("  \t\n\r\f\x0b\x1c\x85\xa0　ab.!é")
    rows = [("".join(rng.choice(pool) for _ in range(rng.randrange(30))),) for pool in (plain, odd) for _ in range(1500)] + [(None,)]
    parts = F.transform(F.split(F.regexp_replace("t", r"[ \t]+", " "), X.SENTENCE_BREAK), X.squash)
    want = F.filter(parts, lambda s: F.length(s).between(1, 20))
    assert spark.createDataFrame(rows, "t string").filter(~X.sentences(F.col("t"), 1, 20).eqNullSafe(want)).isEmpty()


def test_a_text_is_split_once(spark):
    """an inner explode has Spark filter by the size of the sentences, so every text was split once more."""
    from filinglens.operators import evidence as E

    rows = spark.createDataFrame([(1, "One long first sentence. " * 3), (2, ""), (3, None)], "doc_id int, text string")
    table = E.sentence_table(rows, ["doc_id"], low=1)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("size(") == 0
    assert [(r.doc_id, r.sentence_pos) for r in table.orderBy("sentence_pos").collect()] == [(1, 0), (1, 1), (1, 2)]


def test_outcomes_judge_once(spark):
    """the judging, which costs most, ran for the counts and once more for the duplicates."""
    from pyspark.sql import functions as F

    from filinglens.operators import evidence as E

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked_at(s):
        seen.add(1)
        return s

    rows = spark.createDataFrame([("a", i, "company", f"sentence number {i} of this company") for i in range(20)], "source string, at int, disposition string, sentence string")
    out = E.extraction_outcomes(rows.withColumn("disposition", looked_at.asNondeterministic()("disposition")), "source", ["at"]).collect()
    assert [r.company + r.company_duplicate for r in out] == [20] and seen.value == 20
