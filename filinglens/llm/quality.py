"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words, word pairs and byte triples are hashed into ``buckets``.  Two multinomials are estimated with additive
smoothing: one over all trusted documents (those labelled with quality 1, however many), one over all documents.  A
document's score is the sum of the log ratios of its n-grams divided by their number.  The threshold is the cut
between the good and bad documents of all labelled rows with the best balanced accuracy, the lowest of equals; every
document is decided by that one number, whatever its neighbours.

What travels: one row per bucket and task while counting, then a vector of ``buckets`` floats to the tasks; for the
threshold one row per distinct score of labelled documents, in a range sort.

A null or empty text has no words, score 0 and fails the base rules.  Repeated rows are scored each on their
own.  Without labels of both kinds the threshold is minus infinity, so the base rules alone decide; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, labels, stored, whole_text
from filinglens.llm.kernel import NOT_SPACE, U, Hashes, grams, mix, table_of, words

BUCKETS = 1 << 16
BROADCAST_LABELS = 1 << 20
FEWEST_WORDS = 50
_SYMBOLS = table_of(b"#*$%&|<>")


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and the text it stands in."""
    s, e, first = words(buf, offsets, NOT_SPACE)
    h = Hashes(buf).span(s, e)
    pair, at = grams(h, first, (1,))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    wide = buf.astype(np.uint32)
    triple = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16 if len(buf) > 2 else np.zeros(0, np.uint32)
    place = np.searchsorted(offsets, np.arange(len(triple)), "right") - 1
    inside = np.arange(len(triple)) + 3 <= offsets[place + 1]
    triple, place = triple[inside], place[inside]
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    low = [(x >> U(64 - int(buckets).bit_length() + 1)).astype(np.int64) for x in (h, pair)]
    return np.concatenate([*low, ((triple * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)]), np.concatenate([owner, owner[at], place])


def base_rules(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The countable rules for each text of a block."""
    n = len(offsets) - 1
    s, e, first = words(buf, offsets, NOT_SPACE)

    def per_text(mask):
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    hashes = Hashes(buf)
    visible = NOT_SPACE[buf]
    # Lines: from a text's start or a line feed to the next; those with a word, less the distinct ones.
    begin = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(buf == 10) + 1)))
    begin = begin[begin < len(buf)] if len(buf) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(buf)), offsets[text + 1]) if len(begin) else begin
    feed = (end > begin) & (buf[end - 1] == 10) if len(begin) else np.zeros(0, bool)
    end = end - feed
    seen = np.concatenate(([0], np.cumsum(visible)))
    full = seen[end] > seen[begin]
    begin, end, text = begin[full], end[full], text[full]
    line = mix(hashes.span(begin, end) + mix(text.astype(U) + U(1)))
    _, one = np.unique(line, return_index=True)
    dup_lines = np.bincount(text, minlength=n) - np.bincount(text[one], minlength=n)
    # Words inside three-word windows that occur at least twice in their text.
    g, at = grams(hashes.span(s, e), first, (1, 2))
    owner = np.repeat(np.arange(n), np.diff(first))
    _, inverse, count = np.unique(mix(g + mix(owner[at].astype(U) + U(1))), return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1] if len(at) else at
    covered = np.zeros(len(s), bool)
    for k in range(3):
        covered[again + k] = True
    return {"n_words": np.diff(first), "word_chars": per_text(visible & ((buf & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOLS[buf]),
            "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(owner[covered], minlength=n)}


def one_label(labels_: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of all labelled ids; contradictory labels of one id count as the larger."""
    return labels_.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))


def sample_of(labels_: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by hash."""
    return one_label(labels_, column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of each bucket: documents with label 1 in ``trusted`` (doc_id, label) against all documents.

    Up to ``BROADCAST_LABELS`` counted labels go to the documents (16 MB); more meet them by an ordinary join.
    """
    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                f, owner = features(buf, offsets, buckets)
                raw += np.bincount(f, minlength=buckets)
                target += np.bincount(f[trusted[lo:hi][owner]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], ["bucket", "raw", "target"])

    good = stored(trusted.filter("label = 1").select("doc_id", "label"), "trusted")
    if good.count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(good, "doc_id", "left")
    counted = (marked.select("text", F.coalesce(F.col("label") == 1, F.lit(False)).alias("trusted")).mapInArrow(count, "bucket long, raw long, target long")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counted["bucket"]], target[counted["bucket"]] = counted["raw"], counted["target"]
    share = [np.log(x + smoothing) - np.log(x.sum() + smoothing * buckets) for x in (target, raw)]
    return (share[0] - share[1]).astype(np.float32)


def scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, the base rules and llr, the length-normalised log-likelihood ratio."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in [*names, "llr"]}
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                for k, v in base_rules(buf, offsets).items():
                    out[k].append(v)
                f, owner = features(buf, offsets, len(ratio))
                total, n = np.bincount(owner, ratio[f].astype(np.float64), hi - lo), np.bincount(owner, minlength=hi - lo)
                out["llr"].append(total / np.maximum(n, 1))
            columns = [pa.array(np.concatenate(out[k]).astype(np.float64 if k == "llr" else np.int64)) for k in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", llr double")


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The lowest cut with the best balanced accuracy; documents at or above it are good."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    caught = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    apart = np.concatenate(([True], s[1:] > s[:-1], [True]))
    gain = np.where(apart, caught - lost, -np.inf)
    k = int(np.argmax(gain))
    if k == 0:
        return -np.inf
    return float((s[k - 1] + s[k]) / 2) if k < len(s) else np.inf


def best_cut_of(rows: DataFrame) -> float:
    """``best_cut`` of any number of rows (llr, label): counts per partition of a range sort, windows inside each."""
    counted = rows.groupBy("llr").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") != 1).alias("bad"))
    placed = stored(counted.orderBy("llr").withColumn("part", F.spark_partition_id()), "scores")
    totals = sorted(placed.groupBy("part").agg(F.min("llr").alias("low"), F.max("llr").alias("high"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: r.low)
    good, bad = sum(r.good for r in totals), sum(r.bad for r in totals)
    if not good or not bad:
        return -np.inf
    before, so_far, last = [], [0, 0], None
    for r in totals:
        before.append((r.part, so_far[0], so_far[1], last))
        so_far, last = [so_far[0] + r.good, so_far[1] + r.bad], r.high
    side = placed.sparkSession.createDataFrame(before, "part int, lost long, caught long, last double")
    by = Window.partitionBy("part").orderBy("llr")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    run = placed.join(F.broadcast(side), "part").select(
        "llr", F.coalesce(F.lag("llr").over(by), "last").alias("under"),
        (F.col("caught") + F.coalesce(F.sum("bad").over(upto), F.lit(0))).alias("caught"), (F.col("lost") + F.coalesce(F.sum("good").over(upto), F.lit(0))).alias("lost"))
    best = run.withColumn("gain", F.col("caught") / F.lit(bad) - F.col("lost") / F.lit(good)).orderBy(F.desc("gain"), "llr").first()
    return -np.inf if best.under is None else float((best.under + best.llr) / 2)


def judged(docs: DataFrame, labels_: DataFrame, buckets: int = BUCKETS, labelled_rows: int | None = None, fewest_words: int = FEWEST_WORDS) -> DataFrame:
    """One row per document: the base rules, base_failed, kept, llr.

    ``labelled_rows``: labels the threshold is taken from, chosen by hash; all unless given.
    """
    bounded_batches(docs.sparkSession)
    marks = stored(one_label(labels_, "quality"), "marks")
    ratio = ratios(docs, marks, buckets)
    asked = marks if labelled_rows is None else stored(sample_of(labels_, "quality", labelled_rows), "asked")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_LABELS else asked
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id", "left_semi")
    cut = best_cut_of(scored(drawn, ratio).select("doc_id", "llr").join(side, "doc_id").select("llr", "label"))
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    s = scored(docs, ratio).withColumn("base_failed", failed)
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("llr") >= F.lit(cut))).alias("kept"), "llr")


def op5_ngram_ratio(spark, sf_dir):
    return judged(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {"op5_ngram_ratio": op5_ngram_ratio}
SQL = {}
