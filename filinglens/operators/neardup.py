"""Order-dependent near-duplicate removal within a company.

A sentence goes when its ratio to an earlier *kept* sentence of the same company reaches the threshold.  Two ratios
are known: ``sequence`` (twice the characters in matching blocks over both lengths) and ``edit`` (one minus the
Levenshtein distance over the greater length).  For both, similar sentences of a and b characters have a common
subsequence of at least t (a + b) / 2, so one becomes the other by at most D = (1 - t) (a + b) insertions and
deletions, which gives four bounds that lose nothing:

* lengths: min/max >= t / (2 - t);
* letters: the counts of the letters differ by at most D in all;
* grams: an insertion touches 2q - 1 q-grams, so their counts differ by at most (2q - 1) D, folded or not;
* the common subsequence itself, counted in a bit-parallel way before any ratio.

Plan.  Identical sentences collapse first.  Then variants go behind their first sentence: each sentence is compared
with the earliest sentence of a few buckets (opening, ending, ``SEEDS`` runs of ``WIDE`` MinHash values of its grams),
in order, until one is similar; so a cluster of m variants costs a few times m comparisons, and only its first sentence
goes on; variants of a first sentence that has no more than ``FEW`` go on as well.  What is left is laid by length into
blocks of ``BLOCK`` sentences and more, and blocks of one company whose lengths fit meet in tiles: letter counts as bits
(one exclusive or and one bit count per 64 of them) leave few pairs for the gram counts and fewer for the ratio.  Neither
pairs nor grams are shuffled, only sentences, once for each block they meet.  Which sentences stay is settled company by
company over the similar pairs, by rounds where there are more than ``SHARE``.

A sentence put behind another one is rightly dropped if that one is kept.  Where it is not, the sentence is released
and takes part in its own right; this repeats until nothing is released, so the result is that of the sequential rule.
Nulls: a null company is a company, a null text is no sentence and stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglens.session import join_safe, materialise, scratch_path

EDGE, SEEDS, WIDE, GRAM = 20, 6, 4, 6
BLOCK, LETTERS, BUCKETS = 16384, 32, 512
WORDS, STRIP, SPAN, PIECE = 8, 128, 4096, 4096
FEW, SHARE = 32, 200_000


def common_subsequence(places: dict[str, int], first: str, second: str) -> int:
    """Length of the longest common subsequence, one step per character of ``second``; ``places``: bits where a character stands in ``first``."""
    full = (1 << len(first)) - 1
    row = full
    for c in second:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(first) - row.bit_count()


def places_of(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Ratio:
    """Whether two sentences are similar; keeps what it knows of the last earlier sentence."""

    def __init__(self, threshold: float, kind: str):
        if kind not in ("sequence", "edit"):
            raise ValueError(f"no ratio {kind!r}")
        self.threshold, self.kind, self.text = threshold, kind, None

    def similar(self, earlier: str, later: str) -> bool:
        if earlier == later:
            return True
        if self.text != earlier:
            self.text, self.places, self.letters = earlier, places_of(earlier), Counter(earlier)
        a, b = len(earlier), len(later)
        need = self.threshold * (a + b) / 2 - 1e-9
        if min(a, b) < need or (self.letters & Counter(later)).total() < need:
            return False
        shared = common_subsequence(self.places, earlier, later)
        if shared < need:
            return False
        if self.kind == "sequence":
            return SequenceMatcher(None, earlier, later).ratio() >= self.threshold
        return levenshtein(self.places, earlier, later) <= (1 - self.threshold) * max(a, b) + 1e-9


def levenshtein(places: dict[str, int], first: str, second: str) -> int:
    """Edit distance, one step of whole-word bit operations per character of ``second``."""
    n = len(first)
    if not n:
        return len(second)
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, distance = full, 0, n
    for c in second:
        met = places.get(c, 0)
        across = (((met & up) + up) ^ up) | met
        plus, minus = down | ~(across | up) & full, up & across
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        met |= down
        up, down = minus | ~(met | plus) & full, plus & met
    return distance


def gram_codes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all q-grams of all texts, and where each text's ones begin; a text shorter than q has none."""
    lengths = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    counts = np.maximum(lengths - q + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(ends - lengths, counts)
    code = np.zeros(len(at), np.uint64)
    for k in range(q):
        code = code * np.uint64(0x9E3779B97F4A7C15) + letters[at + k]
    return code, starts


def _mixed(code: np.ndarray, seed: int) -> np.ndarray:
    h = (code ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def stored(rows: DataFrame) -> DataFrame:
    """Written once, so that Spark knows its bytes and broadcasts it where it is small, which leaves the sentences in place."""
    path = scratch_path(rows.sparkSession, "near")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def behind_first(rows: DataFrame, company: str, threshold: float, ratio: str = "sequence", salt: int = 0) -> DataFrame:
    """Pairs (company, first, k): k is similar to an earlier sentence ``first`` that is behind no other one."""
    kind = rows.schema[company].dataType.simpleString()

    def keyed(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = np.zeros((len(texts), SEEDS + 2 * (salt == 0)), np.uint64)
            for k in range(0, len(texts), PIECE):
                part = texts[k : k + PIECE]
                code, starts = gram_codes([t if len(t) >= GRAM else t.ljust(GRAM) for t in part], GRAM)
                # Odd factors deal 32 mixed bits out anew; the buckets only choose what is compared.
                code = (_mixed(code, 1) >> np.uint64(32)).astype(np.uint32)
                for s in range(SEEDS):
                    for w in range(WIDE):
                        factor = np.uint32(((salt * SEEDS + s) * WIDE + w + 1) * 0x9E3779B1 & 0xFFFFFFFF | 1)
                        keys[k : k + PIECE, s] = keys[k : k + PIECE, s] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(code * factor, starts[:-1])
                if salt == 0:
                    keys[k : k + PIECE, SEEDS:] = [[hash_of(t[:EDGE]), hash_of(t[-EDGE:])] for t in part]
            keys = _mixed(keys, 1) + np.arange(keys.shape[1], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("company"), batch.column("ord"), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], ["company", "ord", "keys"])

    texts = rows.select(F.col(company).alias("company"), "ord", "text")
    keys = materialise(texts.mapInArrow(keyed, f"company {kind}, ord string, keys array<long>"))
    dealt = keys.select("company", "ord", F.explode("keys").alias("bucket")).withColumn("bucket", F.xxhash64("company", "bucket"))
    # Nearly all buckets hold one sentence; counting numbers alone tells which do not.
    shared = stored(dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    dealt = stored(dealt.join(shared, "bucket", "left_semi"))
    heads = dealt.groupBy("company", "bucket").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = stored(join_safe(dealt, heads, ["company", "bucket"]).filter("first <> ord").select("company", "ord", "first").distinct())
    met = join_safe(texts.withColumnRenamed("ord", "first").withColumnRenamed("text", "a"), met, ["company", "first"])
    met = stored(met.groupBy("company", "ord").agg(F.sort_array(F.collect_list(F.struct("first", "a"))).alias("heads")))
    met = join_safe(texts, met, ["company", "ord"]).select("company", "ord", "text", "heads")

    def compare(batches):
        tester = Ratio(threshold, ratio)
        for batch in batches:
            out = []
            for k, text, heads in zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist(), batch.column("heads").to_pylist()):
                out.append(next((h["first"] for h in heads if tester.similar(h["a"], text)), None))
            yield pa.RecordBatch.from_arrays([batch.column("company"), pa.array(out, pa.string()), batch.column("ord")], ["company", "first", "k"])

    near = materialise(met.mapInArrow(compare, f"company {kind}, first string, k string").filter("first IS NOT NULL").withColumnRenamed("company", company))
    return materialise(join_safe(near, near.select(company, F.col("k").alias("first")).distinct(), [company, "first"], "left_anti"))


def hash_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _counted(owner: np.ndarray, bucket: np.ndarray, rows: int, buckets: int) -> np.ndarray:
    return np.minimum(np.bincount(owner * buckets + bucket, minlength=rows * buckets), 255).astype(np.uint8).reshape(rows, buckets)


def letter_counts(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """How often each text has each of the most frequent letters; the last column has all others."""
    pieces = [np.frombuffer("".join(texts[k : k + PIECE]).encode("utf-32-le", "surrogatepass"), np.uint32) for k in range(0, len(texts), PIECE)]
    often = np.zeros(0x110000, np.int64)
    for p in pieces:
        seen = np.bincount(p)
        often[: len(seen)] += seen
    place = np.full(len(often), LETTERS - 1, np.int64)
    place[np.argsort(-often, kind="stable")[: LETTERS - 1]] = np.arange(LETTERS - 1)
    out = np.zeros((len(texts), LETTERS), np.uint8)
    for k, p in zip(range(0, len(texts), PIECE), pieces):
        n = sizes[k : k + PIECE]
        out[k : k + PIECE] = _counted(np.repeat(np.arange(len(n)), n), place[p], len(n), LETTERS)
    return out


class Grams:
    """Folded counts of the q-grams of those texts that are asked for."""

    def __init__(self, texts: list[str], q: int):
        self.texts, self.q, self.known, self.counts = texts, q, np.zeros(len(texts), bool), None

    def of(self, rows: np.ndarray) -> np.ndarray:
        if self.counts is None:
            self.counts = np.empty((len(self.texts), BUCKETS), np.uint8)
        new = np.unique(rows[~self.known[rows]])
        for k in range(0, len(new), PIECE):
            part = new[k : k + PIECE]
            code, starts = gram_codes([self.texts[i] for i in part.tolist()], self.q)
            self.counts[part] = _counted(np.repeat(np.arange(len(part)), np.diff(starts)), (_mixed(code, self.q) % np.uint64(BUCKETS)).astype(np.int64), len(part), BUCKETS)
        self.known[new] = True
        return self.counts[rows].astype(np.int16)


def bands(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The rows by length, cut where lengths have grown by a twelfth, not below 256 rows; one length is never cut."""
    rows = rows[np.argsort(sizes[rows], kind="stable")]
    n, out, k = sizes[rows], [], 0
    while k < len(rows):
        end = max(int(np.searchsorted(n, n[k] * 13 / 12 + 1, "right")), min(k + 256, len(rows)))
        end = int(np.searchsorted(n, n[end - 1], "right"))
        out.append(rows[k:end])
        k = end
    return out


def close_pairs(texts: list[str], n_left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the first ``n_left`` texts with the others, or among all if there are no others, that all count bounds let through."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts, grams = letter_counts(texts, sizes), [Grams(texts, q) for q in (2, 4)]
    left = bands(np.arange(n_left), sizes)
    alone = n_left == len(texts)
    right = left if alone else bands(np.arange(n_left, len(texts)), sizes)
    fit, out = threshold / (2 - threshold), []
    for k, mine in enumerate(left):
        for other in right[k:] if alone else right:
            if sizes[other[0]] * fit > sizes[mine[-1]] + 1e-6 or sizes[mine[0]] * fit > sizes[other[-1]] + 1e-6:
                continue
            for i, j in meet(mine, other, sizes, counts, threshold):
                room = (1 - threshold) * (sizes[i] + sizes[j]) + 1e-6
                good = np.abs(counts[i].astype(np.int16) - counts[j]).sum(1) <= room
                i, j, room = i[good], j[good], room[good]
                for g in grams:
                    good = np.zeros(len(i), bool)
                    for c in range(0, len(i), 2 * PIECE):
                        part = slice(c, c + 2 * PIECE)
                        good[part] = np.abs(g.of(i[part]) - g.of(j[part])).sum(1) <= (2 * g.q - 1) * room[part]
                    i, j, room = i[good], j[good], room[good]
                out.append((i, j))
    i, j = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1)]
    return i, j


def meet(mine: np.ndarray, other: np.ndarray, sizes: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows of two bands, or of one band with itself, whose letters differ little enough, some at a time.

    Rows lie along the direction in which letter counts spread most, with signs only: along it two rows are at most as
    far apart as their counts are, so a strip of rows meets a stretch of the others (sentences of another language are
    far away).  Counts are bits (count > level), those that tell most first; all pairs look at one word of 64 bits, or at
    more while too many are left, and what is left looks at the other words.
    """
    same = other is mine
    spread = np.linalg.eigh(np.cov(counts[mine].T.astype(np.float64)))[1][:, -1] if len(mine) > 1 else np.ones(LETTERS)
    signs = np.where(spread < 0, -1, 1)

    def laid(rows):
        along = counts[rows] @ signs
        at = np.argsort(along, kind="stable")
        return rows[at], along[at]

    x, near = laid(mine)
    y, far = (x, near) if same else laid(other)
    mine_counts = counts[x]
    above = [(np.count_nonzero(mine_counts[:, c] > v) / len(x), c, v) for c in range(LETTERS) for v in range(int(mine_counts[:, c].min()), int(mine_counts[:, c].max()))]
    above = sorted(above, key=lambda a: abs(a[0] - 0.5))[: 64 * WORDS]
    letter, level = np.array([a[1] for a in above], np.int64), np.array([a[2] for a in above], np.uint8)
    width = max(-(-len(above) // 64), 1)

    def coded(rows):
        out = np.zeros((width, len(rows)), np.uint64)
        for k in range(0, len(rows), PIECE):
            bits = counts[rows[k : k + PIECE]][:, letter] > level
            out[:, k : k + PIECE] = np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, width * 64 - len(above)))), axis=1)).view(np.uint64).T
        return out

    left, right = coded(x), coded(y)
    room = np.minimum((1 - threshold) * (sizes[x] + sizes[y].max()) + 1e-6, 64 * WORDS).astype(np.uint16)
    # Three words fit eight bits; long sentences may need more of them.
    wide = room.max() >= 64
    differ, count, first, mask = [np.zeros(STRIP * SPAN, t) for t in (np.uint64, np.uint8, np.uint16 if wide else np.uint8, bool)]
    used, usable, hold, held = 1, width if wide else min(width, 3), [], 0
    for k in range(0, len(x), STRIP):
        e = min(k + STRIP, len(x))
        most = int(room[k:e].max())
        lo, hi = np.searchsorted(far, near[k] - most), np.searchsorted(far, near[e - 1] + most, "right")
        for c in range(max(lo, k) if same else lo, hi, SPAN):
            d = min(c + SPAN, hi)
            shape, n = (e - k, d - c), (e - k) * (d - c)
            bits, some, apart = differ[:n].reshape(shape), count[:n].reshape(shape), first[:n].reshape(shape)
            apart[:] = 0
            for w in range(used):
                np.bitwise_xor(left[w, k:e, None], right[w, None, c:d], out=bits)
                apart += np.bitwise_count(bits, out=some)
            np.less_equal(apart, room[k:e, None].astype(apart.dtype), out=mask[:n].reshape(shape))
            mask[n : n + -n % 8] = False
            # Eight pairs at once, as hardly any is left.
            eights = np.flatnonzero(mask[: n + -n % 8].view(np.uint64))
            at, place = np.nonzero(mask[: n + -n % 8].reshape(-1, 8)[eights])
            at = eights[at] * 8 + place
            i, j, sums = at // shape[1] + k, at % shape[1] + c, first[at].astype(np.uint16)
            seen = used
            if len(at) * 128 > n and used < usable:
                used += 1
            elif len(at) * 4096 < n and used > 1:
                used -= 1
            if same:
                after = i < j
                i, j, sums = i[after], j[after], sums[after]
            for w in range(seen, width):
                sums += np.bitwise_count(left[w, i] ^ right[w, j])
                good = sums <= room[i]
                i, j, sums = i[good], j[good], sums[good]
            hold.append((x[i], y[j]))
            held += len(i)
            if held > 1 << 16:
                yield tuple(np.concatenate([h[v] for h in hold]) for v in (0, 1))
                hold, held = [], 0
    if held:
        yield tuple(np.concatenate([h[v] for h in hold]) for v in (0, 1))


def tiles(rows: DataFrame, threshold: float, fresh: bool) -> DataFrame:
    """Rows (company, ord, text, fresh) copied to the tiles (company, i, j) their block takes part in; side 0 is block i, 1 block j.

    A block holds sentences of neighbouring lengths; where one stretch of lengths has too many, they are dealt by hash.
    """
    sized = rows.withColumn("n", F.length("text"))
    lengths = sized.groupBy("company", "fresh", "n").agg(F.count("*").alias("m"))
    before = Window.partitionBy("company", "fresh").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # A larger company has larger blocks, so that its sentences are not copied to ever more tiles.
    block = F.least(F.greatest(F.lit(BLOCK), F.ceil(F.sum("m").over(Window.partitionBy("company", "fresh")) / 20)), F.lit(4 * BLOCK))
    lengths = lengths.withColumn("block", block).withColumn("band", F.floor(F.coalesce(F.sum("m").over(before), F.lit(0)) / F.col("block")).cast("long"))
    lengths = stored(lengths)
    bands = stored(lengths.groupBy("company", "fresh", "band").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.ceil(F.sum("m") / F.max("block")).cast("int").alias("parts")))
    lengths = lengths.drop("block")
    name = lambda band, part: F.concat_ws("-", F.col("fresh").cast("string"), band, part)
    blocks = bands.select("company", "fresh", "low", "high", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "band")
    blocks = blocks.select("company", "low", "high", "fresh", name("band", "part").alias("block"))
    other = blocks.select("company", F.col("low").alias("low_"), F.col("high").alias("high_"), F.col("fresh").alias("fresh_"), F.col("block").alias("block_"))
    fit = threshold / (2 - threshold)
    # Lengths are whole numbers: half a letter of room is below the next one and covers rounding.
    fits = (F.col("block") <= F.col("block_")) & (F.col("low_") * F.lit(fit) <= F.col("high") + 0.5) & (F.col("low") * F.lit(fit) <= F.col("high_") + 0.5)
    met = join_safe(blocks, other, ["company"]).filter(fits & (F.col("fresh") | F.col("fresh_") if fresh else F.lit(True)))
    met = met.select("company", F.col("block").alias("i"), F.col("block_").alias("j"))
    sides = met.select("company", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(met.filter("i <> j").select("company", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    sides = stored(sides.groupBy("company", "block").agg(F.collect_list(F.struct("i", "j", "side")).alias("at")))
    placed = join_safe(sized, lengths.drop("m"), ["company", "fresh", "n"])
    placed = join_safe(placed, bands.select("company", "fresh", "band", "parts"), ["company", "fresh", "band"])
    placed = placed.withColumn("block", name(F.col("band"), F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int")))
    return join_safe(placed, sides, ["company", "block"]).select("company", "ord", "text", F.explode("at").alias("at")).select("company", "at.i", "at.j", "at.side", "ord", "text")


def _pairs(rows: DataFrame, company: str, threshold: float, ratio: str | None, fresh: str | None = None) -> DataFrame:
    kind = rows.schema[company].dataType.simpleString()
    rows = rows.select(F.col(company).alias("company"), "ord", "text", (F.col(fresh) if fresh else F.lit(True)).alias("fresh"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        names, texts = table.column("ord").to_pylist(), table.column("text").to_pylist()
        i, j = close_pairs(texts, int((table.column("side").to_numpy() == 0).sum()), threshold)
        tester, found = Ratio(threshold, ratio or "sequence"), []
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = (x, y) if names[x] < names[y] else (y, x)
            if ratio is None or tester.similar(texts[a], texts[b]):
                found.append((a, b))
        pick = [pa.array([names[f[k]] for f in found], pa.string()) for k in (0, 1)]
        return pa.table([table.column("company").slice(0, 1).take(pa.array([0] * len(found), pa.int64())), *pick], names=["company", "a", "b"])

    # Tiles cost time rather than bytes, so they are dealt to a fixed number of tasks, some for each core as tiles differ.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    dealt = tiles(rows, threshold, fresh is not None).repartition(tasks, "company", "i", "j")
    met = dealt.groupBy("company", "i", "j").applyInArrow(meet, f"company {kind}, a string, b string")
    return met.select(F.col("company").alias(company), "a", "b")


def candidates(rows: DataFrame, company: str, threshold: float) -> DataFrame:
    """Pairs (company, a, b), a before b, that the count bounds let through; every similar pair is among them.

    ``rows``: company, ord (sortable text key), text.
    """
    return _pairs(rows, company, threshold, None)


def similar_pairs(rows: DataFrame, company: str, threshold: float, ratio: str = "sequence", fresh: str | None = None) -> DataFrame:
    """Pairs (company, a, b) of order keys with a before b whose ratio reaches the threshold; with ``fresh`` (a boolean column) those that hold a fresh row."""
    return _pairs(rows, company, threshold, ratio, fresh)


def dropped_at_once(pairs: DataFrame, company: str) -> DataFrame:
    """Order keys that lose to an earlier kept key, each company's pairs walked through in one group."""
    def walk(table: pa.Table) -> pa.Table:
        gone: set[str] = set()
        for a, b in sorted(zip(table.column("a").to_pylist(), table.column("b").to_pylist()), key=lambda p: p[1]):
            if a not in gone:
                gone.add(b)
        return pa.table([table.column("company").slice(0, 1).take(pa.array([0] * len(gone), pa.int64())), pa.array(sorted(gone), pa.string())], names=["company", "k"])

    kind = pairs.schema[company].dataType.simpleString()
    met = pairs.select(F.col(company).alias("company"), "a", "b").groupBy("company").applyInArrow(walk, f"company {kind}, k string")
    return met.select(F.col("company").alias(company), "k")


def dropped_by_rounds(pairs: DataFrame, company: str) -> DataFrame:
    """Order keys that lose to an earlier kept key.

    Companies of up to ``SHARE`` pairs are walked through at once.  For the others, each round keeps the keys without an
    undecided earlier partner and drops their later partners, until no pair is left; the pair list shrinks every round.
    """
    open_pairs = materialise(pairs.select(company, "a", "b").distinct())
    many = [r[0] for r in open_pairs.groupBy(company).agg(F.count("*").alias("n")).filter(F.col("n") > SHARE).select(company).collect()]
    if not many:
        return dropped_at_once(open_pairs, company)
    large = reduce(lambda x, y: x | y, [F.col(company).eqNullSafe(F.lit(c)) for c in many])
    dropped = dropped_at_once(open_pairs.filter(~large), company)
    open_pairs = open_pairs.filter(large)
    while not open_pairs.isEmpty():
        later = open_pairs.select(company, F.col("b").alias("k")).distinct()
        kept = join_safe(open_pairs.select(company, F.col("a").alias("k")).distinct(), later, [company, "k"], "left_anti")
        gone = materialise(join_safe(open_pairs, kept.withColumnRenamed("k", "a"), [company, "a"], "left_semi")
                           .select(company, F.col("b").alias("k")).distinct())
        dropped = dropped.unionByName(gone)
        left = join_safe(open_pairs, gone.withColumnRenamed("k", "a"), [company, "a"], "left_anti")
        left = join_safe(left, gone.withColumnRenamed("k", "b"), [company, "b"], "left_anti")
        open_pairs = materialise(join_safe(left, kept.withColumnRenamed("k", "a"), [company, "a"], "left_anti"))
    return dropped


def drop_near_duplicates(rows: DataFrame, company: str, order: list[str], text: str, threshold: float = 0.93, ratio: str = "sequence", sweeps: int = 2) -> DataFrame:
    """Rows of each company that are no near duplicate of an earlier kept row.

    ``order``: non-negative whole-number or text columns giving a strict order.  ``sweeps``: how often what is left is
    put behind its first sentences anew before the exact join; it changes the work, not the result.
    """
    parts = [F.lpad(F.col(c).cast("string"), 20, "0") if rows.schema[c].dataType.typeName() in ("integer", "long", "short")
             else F.col(c).cast("string") for c in order]
    keyed = materialise(rows.withColumn("_ord", F.concat_ws("~", *parts)))
    firsts = materialise(keyed.filter(F.col(text).isNotNull()).groupBy(company, F.col(text).alias("text")).agg(F.min("_ord").alias("ord")))
    behind, left = None, firsts
    for salt in range(sweeps):
        found = behind_first(left, company, threshold, ratio, salt)
        behind = found if behind is None else behind.unionByName(found)
        if found.isEmpty():
            break
        left = materialise(join_safe(left, found.select(company, F.col("k").alias("ord")), [company, "ord"], "left_anti"))
    # A first sentence that went behind another one in a later sweep holds nothing any more.
    behind = materialise(join_safe(behind, behind.select(company, F.col("k").alias("first")).distinct(), [company, "first"], "left_anti"))
    # Only the square of many variants is worth holding back; a few meet all others at once.
    many = behind.groupBy(company, "first").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).drop("n")
    behind = materialise(join_safe(behind, many, [company, "first"], "left_semi"))
    pairs, fresh = None, None
    while True:
        waiting = behind.select(company, F.col("k").alias("ord")).distinct()
        heads = join_safe(firsts, waiting, [company, "ord"], "left_anti")
        if fresh is None:
            pairs = materialise(similar_pairs(heads, company, threshold, ratio))
        else:
            heads = join_safe(heads, fresh.withColumn("fresh", F.lit(True)), [company, "ord"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
            pairs = materialise(pairs.unionByName(similar_pairs(heads, company, threshold, ratio, "fresh")))
        lost = materialise(dropped_by_rounds(pairs, company))
        held = join_safe(behind, lost.withColumnRenamed("k", "first"), [company, "first"], "left_anti")
        fresh = materialise(join_safe(waiting, held.select(company, F.col("k").alias("ord")).distinct(), [company, "ord"], "left_anti"))
        if fresh.isEmpty():
            break
        behind = materialise(held)
    gone = lost.withColumnRenamed("k", "ord").unionByName(waiting)
    again = join_safe(firsts, gone, [company, "ord"], "left_anti").select(company, F.col("ord").alias("_ord"))
    return join_safe(keyed.filter(F.col(text).isNotNull()), again, [company, "_ord"], "left_semi").unionByName(keyed.filter(F.col(text).isNull())).drop("_ord")
