"""Near-duplicate removal: bounds, ratios, the sequential rule on large and awkward inputs."""

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filinglens.operators import neardup as N

TEXT = st.text(alphabet="abcdeñ 가나", max_size=40)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_bit_parallel_counts(a, b):
    places = N.places_of(a)
    assert N.levenshtein(places, a, b) == edits(a, b)
    assert N.common_subsequence(places, a, b) == subsequence(a, b)
    assert N.common_subsequence(places, a, b) >= sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def mutated(rng, text, n):
    t = list(text)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(t))
        if kind == 0:
            t[at] = rng.choice("abcdefgh ")
        elif kind == 1:
            t.insert(at, rng.choice("abcdefgh "))
        elif len(t) > 5:
            del t[at]
    return "".join(t)


def ratio(a, b, kind):
    return SequenceMatcher(None, a, b).ratio() if kind == "sequence" else 1 - edits(a, b) / max(len(a), len(b), 1)


def sequential(rows, threshold, kind):
    kept, seen = set(), {}
    for company, i, text in rows:
        if text is None or not any(ratio(e, text, kind) >= threshold - 1e-9 for e in seen.setdefault(company, [])):
            if text is not None:
                seen[company].append(text)
            kept.add((company, i))
    return kept


@pytest.mark.parametrize("kind,threshold", [("sequence", 0.93), ("edit", 0.93), ("edit", 0.8), ("sequence", 0.7)])
def test_equals_the_sequential_rule(spark, kind, threshold):
    """Also for thresholds with narrower grams, short texts, null companies and texts, and surrogate-free odd letters."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij klmnoñ가") for _ in range(n)) for n in (3, 5, 9, 14, 20, 30, 45, 80, 130)]
    rows = [(rng.choice(["a", "b", None]), i, mutated(rng, rng.choice(base), rng.choice([0, 1, 2, 3, 5, 8]))) for i in range(220)]
    rows += [("a", 300, None), (None, 301, None), ("a", 302, ""), ("a", 303, ""), ("b", 304, "x")]
    d = spark.createDataFrame(rows, "company string, pos int, text string")
    got = {(r.company, r.pos) for r in N.drop_near_duplicates(d, "company", ["pos"], "text", threshold, kind).collect()}
    assert got == sequential(rows, threshold, kind) and len(got) < len(rows)


@pytest.mark.parametrize("threshold", [0.93, 0.85])
def test_candidates_hold_every_similar_pair(spark, threshold):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(n)) for n in (12, 31, 60, 110)]
    texts = sorted({mutated(rng, rng.choice(base), rng.randrange(12)) for _ in range(250)})
    rows = spark.createDataFrame([("c", f"{i:05d}", t) for i, t in enumerate(texts)], "company string, ord string, text string")
    got = {(int(r.a), int(r.b)) for r in N.candidates(rows, "company", threshold).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if 2 * subsequence(texts[i], texts[j]) >= threshold * (len(texts[i]) + len(texts[j]))}
    assert want and want <= got and len(got) < len(texts) * (len(texts) - 1) / 2


def test_five_thousand_variants_of_one_company(spark):
    """One cluster whose members are similar to its first sentence: one stays, in a time that grows with the rows."""
    rng = random.Random(2)
    words = [f"wort{rng.randrange(900)}" for _ in range(18)]
    took = []
    for n in (1250, 5000):
        rows = []
        for i in range(n):
            w = list(words)
            if i:
                w[rng.randrange(18)] = f"neu{rng.randrange(10000)}"
            rows.append(("hot", i, " ".join(w)))
        d = spark.createDataFrame(rows, "company string, pos int, text string")
        t = time.time()
        assert [r.pos for r in N.drop_near_duplicates(d, "company", ["pos"], "text").collect()] == [0]
        took.append(time.time() - t)
    assert took[1] < 60 and took[1] < 4 * took[0] + 5


def test_different_sentences_of_one_company_do_not_meet(spark):
    """Sentences that share a few words only: far fewer candidates than pairs."""
    rng = random.Random(9)
    rows = spark.createDataFrame([("c", f"{i:05d}", "the company is " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for i in range(2000)], "company string, ord string, text string")
    assert N.candidates(rows, "company", 0.93).count() < 20_000
    assert N.similar_pairs(rows, "company", 0.93).count() == 0


def test_sentences_of_one_language_leave_few_candidates(spark):
    """unrelated sentences out of the same syllables share most short grams, yet hardly any pair is looked at."""
    rng = random.Random(4)
    parts = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve".split()
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(26)) for _ in range(1500)]
    rows = spark.createDataFrame([("c", f"{i:05d}", t) for i, t in enumerate(texts)], "company string, ord string, text string")
    assert N.candidates(rows, "company", 0.93).count() < 100


def test_many_small_blocks_and_released_sentences(spark, monkeypatch):
    """tiles of many blocks, with sentences released from behind dropped ones, give the sequential rule."""
    monkeypatch.setattr(N, "BLOCK", 12)
    rng = random.Random(3)
    rows, text = [], "".join(rng.choice("abcdefghij klmno") for _ in range(45))
    for i in range(70):
        text = mutated(rng, text, 2) if i % 25 else "".join(rng.choice("abcdefghij klmno") for _ in range(rng.randrange(35, 50)))
        rows.append((rng.choice(["a", None]), i, text))
    d = spark.createDataFrame(rows, "company string, pos int, text string")
    got = {(r.company, r.pos) for r in N.drop_near_duplicates(d, "company", ["pos"], "text", 0.93, "edit").collect()}
    assert got == sequential(rows, 0.93, "edit") and len(got) < len(rows)


@pytest.mark.parametrize("share", [0, 200_000])
def test_a_chain_of_pairs_is_settled_also_for_a_null_company(spark, monkeypatch, share):
    """pairs of a null company were never settled, as its keys met nothing in the rounds."""
    monkeypatch.setattr(N, "SHARE", share, raising=False)
    pairs = spark.createDataFrame([(c, f"{i:03d}", f"{i + 1:03d}") for c in ("a", None) for i in range(6)], "company string, a string, b string")
    assert sorted((str(r.company), r.k) for r in N.dropped_by_rounds(pairs, "company").collect()) == [(c, f"{i:03d}") for c in ("None", "a") for i in (1, 3, 5)]


def test_a_long_chain_takes_few_jobs(spark):
    """every round of a chain took several jobs."""
    pairs = spark.createDataFrame([("a", f"{i:03d}", f"{i + 1:03d}") for i in range(40)], "company string, a string, b string")
    spark.sparkContext.setJobGroup("chain", "chain")
    assert N.dropped_by_rounds(pairs, "company").count() == 20
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 30


def test_held_back_sentences_are_released_and_settled_by_rounds(spark, monkeypatch):
    """sentences behind a head that has few, too, so that some are released, and companies of many pairs."""
    monkeypatch.setattr(N, "FEW", 0, raising=False)
    monkeypatch.setattr(N, "SHARE", 0, raising=False)
    rng = random.Random(6)
    rows, text = [], "".join(rng.choice("abcdefghij klmno") for _ in range(60))
    for i in range(24):
        text = mutated(rng, text, 2)
        rows.append(("a" if i % 3 else None, i, text))
    d = spark.createDataFrame(rows, "company string, pos int, text string")
    got = {(r.company, r.pos) for r in N.drop_near_duplicates(d, "company", ["pos"], "text", 0.93).collect()}
    assert got == sequential(rows, 0.93, "sequence") and len(got) < len(rows)


def spoken(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_bands_strips_and_words_lose_no_pair(monkeypatch):
    """two languages, short and very long sentences, variants of them; strips of odd sizes and one or two sides."""
    monkeypatch.setattr(N, "STRIP", 7, raising=False)
    monkeypatch.setattr(N, "SPAN", 16, raising=False)
    rng = random.Random(8)
    tongues = ["th er on an re he in ed nd ha at en es or".split(), "ción que ñ ez ll ó í mente ado".split()]
    base = [spoken(rng, t, n) for t in tongues for n in (3, 8, 20, 20, 60, 200) for _ in range(12)]
    texts = base + [mutated(rng, t, max(1, int(len(t) * share))) for t in base for share in (0.01, 0.03, 0.06)]
    rng.shuffle(texts)
    for left in (len(texts), 100):
        i, j = N.close_pairs(texts, left, 0.93)
        got = {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
        assert len(got) == len(i)
        for x in range(left):
            for y in range(x + 1 if left == len(texts) else left, len(texts)):
                a, b = texts[x], texts[y]
                if 0.869 <= len(a) / len(b) <= 1.151 and (x, y) not in got:
                    assert 2 * N.common_subsequence(N.places_of(a), a, b) < 0.93 * (len(a) + len(b))
        assert 0 < len(got) < 10_000


def test_unrelated_sentences_take_few_nanoseconds_a_pair():
    """a pair of one length took 36 ns, so the square of a company's sentences took most of the time."""
    rng = random.Random(1)
    parts = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve".split()
    texts = [spoken(rng, parts, 30)[:110] for _ in range(20_000)]
    N.close_pairs(texts[:500], 500, 0.93)
    began = time.process_time()
    i, _ = N.close_pairs(texts, len(texts), 0.93)
    assert len(i) < 1000 and time.process_time() - began < 20e-9 * len(texts) ** 2 / 2
