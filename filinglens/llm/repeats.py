"""Removal of repeated passages by common-prefix interval trees over a sampled, enhanced suffix array.

A byte goes if a ``length``-byte string that covers it also starts anywhere else.

1. Anchors.  Of every window of ``length`` bytes the ``GRAM``-byte string with the smallest hash is an anchor,
   the leftmost of equal ones.  Equal windows have their anchor at the same offset, so every repeated window is
   seen at an anchor whose hash occurs twice.  About one byte in 170 starts an anchor.
2. An anchor's context are the bytes around it that a window with that anchor can reach.  Occurrences with equal
   contexts (equal hashes) are repeats over the whole context; one of each kind stands for all.
3. Of anchors with several contexts the bytes are fetched and sorted: the suffix array of the anchor's suffixes,
   enhanced with the lengths of common prefixes.  A stack scan gives the tree of common-prefix intervals; inside
   an interval the left contexts are sorted and scanned likewise.  Where the left extensions differ and the
   suffixes do not all continue alike, left and right extension together are a maximal repeat, with all its
   occurrences.
4. A group of more than ``most`` contexts is split by halving the range of window offsets: windows of one half
   share a longer string around the anchor, which is the new group key; contexts that agree in all a half needs count
   as one.  At one offset the key is the window itself and a count is enough.  So no task holds more than ``most``
   contexts of one group, whatever share of all rows has the passage.

5. ``passage``, a shorter length, is judged in the same scan: anchors are then those of passages, of which every
   ``length``-byte string has one at the same place, and an interval counts for each length that it reaches.

Null and empty texts, and those shorter than ``length``, lose nothing.  Repeated rows are repeats of each other.
An empty table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, parts_of, row_key, stored, whole_text
from filinglens.llm.kernel import U, Hashes, mix

LENGTH = 400
GRAM = 64
PASSAGE = 256  # about 51 words of four letters and a blank
MOST = 20_000
STEP = 1 << 19


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by running minima of blocks."""
    n = len(a)
    padded = np.full(-(-n // width) * width, np.iinfo(a.dtype).max, a.dtype)
    padded[:n] = a
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, 1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: np.ndarray, length: int, gram: int, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, context hash and room of each anchor of one text; memory is bounded by the step, not by the text."""
    n, reach = len(buf), passage - gram
    found = []
    for at in range(0, n - passage + 1, STEP):
        lo, hi = max(0, at - reach), min(n, at + STEP + 2 * length)
        hashes = Hashes(buf[lo:hi])
        s = np.arange(at - lo, min(n - gram + 1, at + STEP + reach) - lo)
        g = hashes.span(s, s + gram)
        low = sliding_min((g & ~U((1 << 20) - 1)) | np.arange(len(g), dtype=U), reach + 1) & U((1 << 20) - 1)
        p = np.unique(low.astype(np.int64))
        spot = s[p]
        left, right = np.minimum(reach, spot + lo), np.minimum(length, n - lo - spot)
        found.append((spot + lo, g[p], mix(hashes.span(spot - left, spot + right) + left.astype(U)), left + right))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    pos, gram_hash, context, room = (np.concatenate(x) for x in zip(*found))
    _, one = np.unique(pos, return_index=True)
    return pos[one], gram_hash[one], context[one], room[one]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), whole_text().alias("text"))


def places(docs: DataFrame, length: int, gram: int, passage: int) -> DataFrame:
    """(anchor, context, k1, k2, pos, full) of every anchor; ``full`` where its context has room for a window."""
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in blocks(batch.column("text")):
                got = [anchors(buf[offsets[i] : offsets[i + 1]], length, gram, passage) for i in range(hi - lo)]
                sizes = [len(g[0]) for g in got]
                if sum(sizes):
                    owner = pa.array(np.repeat(np.arange(lo, hi), sizes))
                    pos, anchor, context, room = (np.concatenate(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), batch.column("k1").take(owner), batch.column("k2").take(owner), pa.array(pos), pa.array(room >= length)],
                                                     ["anchor", "context", "k1", "k2", "pos", "full"])

    return keyed(docs).mapInArrow(run, "anchor long, context long, k1 long, k2 long, pos long, full boolean")


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(x), len(y))
    if x[:hi] == y[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of a sorted list with ``lcp[i]`` between items i and i + 1; children first."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left extension, right extension, occurrences) of the maximal repeats of at least ``length`` bytes.

    ``rights`` are sorted suffixes, ``lefts`` the bytes before them, nearest first.
    """
    lcp = [common(a, b) for a, b in zip(rights, rights[1:])]
    order = {leaf: k for k, leaf in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    for depth, first, last in intervals(lcp):
        leaves = sorted(range(first, last + 1), key=order.__getitem__)
        back = [common(lefts[a], lefts[b]) for a, b in zip(leaves, leaves[1:])]
        for extent, a, b in intervals(back):
            if extent + depth < length:
                continue
            members = leaves[a : b + 1]
            if min(lcp[min(members) : max(members)]) == depth:  # else they all continue alike, and a deeper interval has them
                yield extent, depth, members


def farthest(rights: list[bytes], lefts: list[bytes], sizes: tuple[int, ...]) -> np.ndarray:
    """By size and item: how far left and right it is repeated, over the maximal repeats of at least that size.

    Inside an interval an item shares most with its neighbours in the order of the left contexts.  That order is
    made once; what neighbours share is a range minimum, from a table of runs of 2, 4, 8 ... items.
    """
    n = len(rights)
    lcp = [common(a, b) for a, b in zip(rights, rights[1:])]
    order = np.array(sorted(range(n), key=lefts.__getitem__))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    back = np.array([common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])])
    runs, top = [back], int(back.max())
    while 1 << len(runs) < n:
        half = 1 << len(runs) - 1
        runs.append(np.minimum(runs[-1], np.append(runs[-1][half:], np.full(half, top))))
    table = np.stack(runs)
    best = np.zeros((len(sizes), n, 2), np.int64)
    for depth, first, last in intervals(lcp):
        if depth + top < min(sizes):
            continue
        at = np.sort(rank[first : last + 1])
        a, b = at[:-1], at[1:]
        run = np.frexp(b - a)[1] - 1
        shared = np.minimum(table[run, a], table[run, b - (1 << run)])
        near = np.zeros(len(at), np.int64)
        near[1:] = shared
        near[:-1] = np.maximum(near[:-1], shared)
        for k, size in enumerate(sizes):
            wide = near + depth >= size
            leaf = order[at[wide]]
            best[k, leaf, 0] = np.maximum(best[k, leaf, 0], near[wide])
            best[k, leaf, 1] = np.maximum(best[k, leaf, 1], depth)
    return best


def _trees(sizes: tuple[int, ...], groups: bool):
    """Per group key: the extents of each context by size, or the maximal repeats themselves."""
    def settle(rows):
        rights, lefts = [r[3] for r in rows], [r[4] for r in rows]
        if not groups:
            best = farthest(rights, lefts, sizes)
            return [(rows[m][1], rows[m][2], *best[k, m].tolist(), None, sizes[k]) for k, m in zip(*(x.tolist() for x in best[:, :, 1].nonzero()))]
        out = []
        for left, right, members in maximal_repeats(rights, lefts, sizes[0]):
            text = lefts[members[0]][:left][::-1] + rights[members[0]][:right]
            name = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)
            out += [(rows[m][1], rows[m][2], left, right, name, sizes[0]) for m in members]
        return out

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], ["anchor", "context", "left", "right", "name", "size"])

    def run(batches):
        rows, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "anchor", "context", "suffix", "prefix"))):
                if rows and rows[0][0] != row[0]:
                    if len(rows) > 1:
                        out += settle(rows)
                    rows = []
                    if len(out) >= 2000:
                        yield batch_of(out)
                        out = []
                rows.append(row)
        if len(rows) > 1:
            out += settle(rows)
        if out:
            yield batch_of(out)

    return run


EXTENT = "anchor long, context long, left int, right int, name long, size int"


def trees(items: DataFrame, sizes: tuple[int, ...], groups: bool = False) -> DataFrame:
    """Sort the suffixes of each group and scan them; items: group, anchor, context, suffix, prefix."""
    laid = items.repartition(parts_of(items.sparkSession), "group").sortWithinPartitions("group", "suffix", "prefix", "context")
    return laid.select("group", "anchor", "context", "suffix", "prefix").mapInArrow(_trees(sizes, groups), EXTENT)


def halved(items: DataFrame, length: int, reach: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Split groups of more than ``most`` contexts: (items of groups that are small enough, extents found by counting).

    A block of window offsets low..high needs the bytes from ``high`` before the anchor to ``length - low`` after its
    start.  Contexts that agree in all of them are repeated over the whole block; one of them goes on as a partner for
    the others.
    """
    rest = items.withColumn("low", F.lit(0)).withColumn("high", F.lit(reach))
    small = counted = None
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))).alias("half")
        cut = rest.select("*", halves).withColumn("low", F.col("half.a")).withColumn("high", F.col("half.b")).drop("half").filter("low <= high")
        cut = cut.filter((F.octet_length("prefix") >= F.col("low")) & (F.octet_length("suffix") >= length - F.col("high")))
        cut = cut.withColumn("prefix", F.substring(F.col("prefix"), F.lit(1), F.col("high"))).withColumn("suffix", F.substring(F.col("suffix"), F.lit(1), length - F.col("low")))
        shared = F.xxhash64("group", "low", "high", F.substring(F.col("prefix"), F.lit(1), F.col("low")), F.substring(F.col("suffix"), F.lit(1), length - F.col("high")))
        cut = stored(cut.withColumn("group", shared).withColumn("same", F.xxhash64(F.lit(1), "prefix", F.lit(2), "suffix")), "halves")
        alike = cut.groupBy("group", "same").agg(F.count("*").alias("n"), F.min(F.struct("anchor", "context")).alias("one"))
        extents = cut.join(alike.filter("n > 1").select("group", "same"), ["group", "same"], "left_semi").select(
            "anchor", "context", F.octet_length("prefix").alias("left"), F.octet_length("suffix").alias("right"), F.lit(None).cast("long").alias("name"), F.lit(length).alias("size"))
        counted = extents if counted is None else counted.unionByName(extents)
        sizes = alike.groupBy("group").agg(F.count("*").alias("m")).filter("m > 1")
        firsts = alike.join(sizes, "group").select("group", "same", "one.anchor", "one.context", "m")
        kept = stored(cut.join(firsts, ["group", "same", "anchor", "context"]).drop("same"), "distinct")
        fits = kept.filter(F.col("m") <= most).select(*items.columns)
        small = fits if small is None else small.unionByName(fits)
        rest = kept.filter((F.col("m") > most) & (F.col("low") < F.col("high"))).drop("m")
        if rest.isEmpty():
            return small, counted


def _fetch(length: int, reach: int):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            out = []
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                data = text[i].as_buffer()
                for w in wanted:
                    p = w["pos"]
                    out.append((w["anchor"], w["anchor"], w["context"], data[p : p + length].to_pybytes(), data[max(0, p - reach) : p].to_pybytes()[::-1]))
                if len(out) >= 2000 or out and i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["group", "anchor", "context", "suffix", "prefix"])
                    out = []
    return run


def repeat_extents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, groups: bool = False, passage: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Occurrences of anchors that occur twice, and how far each (anchor, context) is repeated to the left and right.

    With ``passage``, a shorter length, also by the repeats of at least that many bytes; ``size`` tells which.
    """
    bounded_batches(docs.sparkSession)
    least = passage or length
    reach, sizes = least - gram, (length, passage) if passage else (length,)
    every = places(docs, length, gram, least)
    alike = Window.partitionBy("anchor")
    counted = every.select("*", F.count("*").over(alike).alias("n"), (F.min("context").over(alike) != F.max("context").over(alike)).alias("mixed"))
    shared = stored(counted.filter("n > 1").drop("n"), "shared")
    contexts = stored(shared.groupBy("anchor", "context", "mixed", "full").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at")), "contexts")
    whole = contexts.filter("n > 1").select("anchor", "context", F.lit(reach).alias("left"), F.lit(length).alias("right"), F.lit(None).cast("long").alias("name"), F.when(F.col("full"), length).otherwise(least).alias("size"))
    mixed = contexts.filter("mixed")
    hot = stored(mixed.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > most), "hot")

    def items(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("anchor", "context", "at.pos")).alias("wanted"))
        return keyed(docs).join(wanted, ["k1", "k2"]).select("wanted", F.col("text").cast("binary").alias("text")).mapInArrow(
            _fetch(length, reach), "group long, anchor long, context long, suffix binary, prefix binary")

    if hot.isEmpty():
        return shared, whole.unionByName(trees(items(mixed), sizes, groups))
    extents = whole.unionByName(trees(items(mixed.join(hot, "anchor", "left_anti")), sizes, groups))
    crowded = stored(items(mixed.join(hot, "anchor", "left_semi")), "hot-items")
    for size in sizes:
        small, counted = halved(crowded, size, reach, most)
        extents = extents.unionByName(trees(small, (size,), groups)).unionByName(counted)
    return shared, extents


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """All occurrences of the maximal repeats found at anchors: name (hash of the string), doc_id, start, end.

    A repeat is reported up to the reach of its anchors' contexts; a longer passage appears as several that overlap.
    """
    shared, extents = repeat_extents(docs, length, gram, most, groups=True)
    named = extents.withColumn("name", F.coalesce("name", F.xxhash64("anchor", "context"))).drop("size")
    ids = keyed(docs).select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("size"))
    found = shared.select("anchor", "context", "k1", "k2", "pos").distinct().join(named, ["anchor", "context"]).join(ids, ["k1", "k2"])
    return found.select("name", "doc_id", F.greatest(F.lit(0), F.col("pos") - F.col("left")).alias("start"), F.least("size", F.col("pos") + F.col("right")).alias("end")).distinct()


def merged(found: list[tuple[int, int]], n: int) -> list[list[int]]:
    """Maximal runs of the union of spans, cut to 0..n."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a), min(n, b)) for a, b in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end of the maximal removed runs), kept (remaining bytes), n_passage.

    n_passage counts the bytes covered by a ``passage``-byte string that also starts anywhere else; without
    ``passage`` it equals n_removed.
    """
    shared, extents = repeat_extents(docs, length, gram, most, passage=passage)
    long = F.col("size") == length
    far = extents.groupBy("anchor", "context").agg(*(F.max(x).alias(f"far_{x}") for x in ("left", "right")), *(F.max(F.when(long, F.col(x))).alias(x) for x in ("left", "right")))
    spans = shared.select("anchor", "context", "k1", "k2", "pos").join(far, ["anchor", "context"]).groupBy("k1", "k2").agg(
        F.collect_set(F.struct(*((F.col("pos") + s * F.col(x)).alias(n) for n, s, x in (("a", -1, "left"), ("b", 1, "right"), ("c", -1, "far_left"), ("d", 1, "far_right"))))).alias("spans"))

    def run(batches):
        for batch in batches:
            text, kept, runs, wide = batch.column("text"), [], [], []
            for i, found in enumerate(batch.column("spans").to_pylist()):
                data = text[i].as_py().encode("utf-8")
                gone = merged([(x["a"], x["b"]) for x in found or () if x["a"] is not None], len(data))
                wide.append(sum(b - a for a, b in merged([(x["c"], x["d"]) for x in found or ()], len(data))))
                ends = [0, *(x for m in gone for x in m), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
                runs.append([{"a": a, "b": b} for a, b in gone])
                if len(kept) == 200 or i == batch.num_rows - 1:
                    part = batch.slice(i + 1 - len(kept), len(kept))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(k) for k in kept], pa.int64()), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(wide, pa.int64())],
                                                     ["doc_id", "n_kept", "spans", "kept", "n_passage"])
                    kept, runs, wide = [], [], []

    left = keyed(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_kept long, spans array<struct<a: long, b: long>>, kept binary, n_passage long")
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return left.select("doc_id", (F.col("n_kept") + lost).alias("n_bytes"), lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept", "n_passage")


def digested(docs: DataFrame, passage: int | None = None, **options) -> DataFrame:
    """The removal by document; with ``passage`` also n_passage."""
    more = ["n_passage"] if passage else []
    return removed(docs, passage=passage, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more)


def op1_interval_tree(spark, sf_dir):
    return digested(documents(spark, sf_dir), passage=PASSAGE)


QUERIES = {"op1_interval_tree": op1_interval_tree}
SQL = {}
