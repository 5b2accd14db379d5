"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their scores come from a public model file whose path is a parameter.  Blanks become the marker
``▁`` and a text gets one in front.  Among all ways to cut the marked text into pieces the one with the highest
sum of scores wins; a character that starts no piece becomes its UTF-8 bytes as byte pieces, at a score below
every piece.  Decoding joins the pieces, turns byte pieces back into bytes, markers into blanks and drops the
one in front, so a text comes back whole whatever characters it has but one: a literal ``▁`` comes back as a blank, as
the piece format has no other sign for it.

No piece has a marker after another character, so a best cut is the best cut of each stretch of markers with
the visible characters after it; equal stretches are cut once per Python worker, the new ones of a batch side by
side.  The pieces must be checked for that, and are: a model that breaks the rule has its texts cut as one stretch.

Null and empty texts have no ids.  Repeated rows are encoded each on its own; an empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import blocks, bounded_batches, documents, kept_in_process, whole_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MOST_STRETCHES = 300_000
SIDE_BY_SIDE = 48
BELOW = 10.0


class DoubleArray:
    """Trie of byte strings in two arrays: the child of s by byte b is t = base[s] + b + 1 if check[t] = s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [-1], [-1]
        begin, pending = 1, [(0, sorted(keys.items()), 0)]
        while pending:
            state, items, depth = pending.pop()
            if items and len(items[0][0]) == depth:
                self.value[state] = items[0][1]
                items = items[1:]
            groups: dict[int, list] = {}
            for item in items:
                groups.setdefault(item[0][depth], []).append(item)
            if not groups:
                continue
            labels = list(groups)
            at, taken, check = max(begin, labels[0] + 1), 0, self.check
            first = at
            while True:  # at: where the first child would go
                if at >= len(check):
                    break
                if check[at] >= 0:
                    taken += 1
                elif all((t := at + b - labels[0]) >= len(check) or check[t] < 0 for b in labels):
                    break
                at += 1
            if taken >= 0.95 * (at - first + 1):  # next to no room was left before
                begin = max(begin, at)
            base = at - labels[0] - 1
            more = base + labels[-1] + 2 - len(check)
            if more > 0:
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            self.base[state] = base
            for b in labels:
                self.check[base + b + 1] = state
            pending += [(base + b + 1, part, depth + 1) for b, part in groups.items()]


class Unigram:
    """Encoder and decoder over scored pieces."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: text, score and kind (piece, byte, unknown or other), by id."""
        self.scores = [s for _, s, _ in pieces]
        usable = {p.encode("utf-8"): k for k, (p, _, kind) in enumerate(pieces) if kind == "piece" and p}
        self.trie = DoubleArray(usable)
        self.byte = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((k for k, (_, _, kind) in enumerate(pieces) if kind == "unknown"), None)
        self.floor = min((self.scores[k] for k in usable.values()), default=0.0) - BELOW
        self.texts = [p.encode("utf-8") if kind == "piece" else bytes([int(p[3:5], 16)]) if kind == "byte" else b"" for p, _, kind in pieces]
        self.bytes = frozenset(self.byte.values())
        whole = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == "piece")
        self.stretch = re.compile(r".+", re.S) if whole else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.is_byte = np.array([k in self.bytes for k in range(len(pieces))])

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best cut; of equal scores the first found, shortest last piece first."""
        data = text.encode("utf-8")
        n = len(data)
        best, back = [-np.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, top = self.trie.base, self.trie.check, self.trie.value, self.scores, len(self.trie.check)
        for i in range(n):
            here = best[i]
            if here == -np.inf:
                continue
            lead = data[i]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single, state, at = False, 0, i
            while at < n:
                t = base[state] + data[at] + 1
                if t >= top or check[t] != state:
                    break
                state, at = t, at + 1
                if (k := value[state]) >= 0:
                    single = single or at == i + size
                    if (score := here + scores[k]) > best[at]:
                        best[at], back[at] = score, (i, k)
            if not single and here + self.floor > best[i + size]:
                best[i + size], back[i + size] = here + self.floor, (i, -1)
        ids: list[int] = []
        while n:
            i, k = back[n]
            ids += [k] if k >= 0 else self.unknown_ids(data[i:n])
            n = i
        return ids[::-1]

    def viterbi_many(self, texts: list[str]) -> list[list[int]]:
        """As ``viterbi``, for many short texts at once: every step is taken for all of them."""
        rows = [t.encode("utf-8") for t in texts]
        size = np.array([len(r) for r in rows])
        m, longest = len(rows), int(size.max())
        data = np.zeros((m, longest), np.int64)
        data[np.arange(longest) < size[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
        base, check, value = (np.array(x) for x in (self.trie.base, self.trie.check, self.trie.value))
        scores = np.array(self.scores)
        best, start, piece = np.full((m, longest + 1), -np.inf), np.zeros((m, longest + 1), np.int64), np.full((m, longest + 1), -1)
        best[:, 0] = 0.0
        for i in range(longest):
            here = np.flatnonzero((best[:, i] > -np.inf) & (i < size))
            lead = data[here, i]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single, place = np.zeros(len(here), bool), np.arange(len(here))
            alive, state = here, np.zeros(len(here), np.int64)
            for at in range(i, longest):
                t = base[state] + data[alive, at] + 1
                ok = (at < size[alive]) & (t < len(check))
                ok[ok] = check[t[ok]] == state[ok]
                alive, state, place = alive[ok], t[ok], place[ok]
                if not len(alive):
                    break
                k = value[state]
                hit = k >= 0
                single[place[hit & (at + 1 == i + char[place])]] = True
                score = best[alive, i] + scores[k]
                hit &= score > best[alive, at + 1]
                best[alive[hit], at + 1], start[alive[hit], at + 1], piece[alive[hit], at + 1] = score[hit], i, k[hit]
            rest, end = here[~single], i + char[~single]
            better = best[rest, i] + self.floor > best[rest, end]
            rest, end = rest[better], end[better]
            best[rest, end], start[rest, end], piece[rest, end] = best[rest, i] + self.floor, i, -1
        out = []
        for row, n, begun, pieces in zip(rows, size.tolist(), start.tolist(), piece.tolist()):
            ids: list[int] = []
            while n:
                i, k = begun[n], pieces[n]
                ids += [k] if k >= 0 else self.unknown_ids(row[i:n])
                n = i
            out.append(ids[::-1])
        return out

    def unknown_ids(self, char: bytes) -> list[int]:
        """Ids of a character without a piece, last first."""
        return [self.byte.get(b, self.unknown) for b in reversed(char)] if self.byte else [self.unknown]

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """For each text its ids as little-endian unsigned 32-bit numbers, and how many are byte pieces."""
        cut = [self.stretch.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > MOST_STRETCHES:
            self.known.clear()
        known = self.known
        new = list(set().union(*cut) - known.keys())
        short = [x for x in new if 4 * len(x) <= SIDE_BY_SIDE or len(x.encode("utf-8")) <= SIDE_BY_SIDE]
        for lo in range(0, len(short), 20_000):
            part = short[lo : lo + 20_000]
            known.update((x, np.array(ids, "<u4").tobytes()) for x, ids in zip(part, self.viterbi_many(part)))
        long = {x: np.array(self.viterbi(x), "<u4").tobytes() for x in set(new) - set(short)}
        out = []
        for stretches in cut:
            ids = b"".join([known[x] if x in known else long[x] for x in stretches] if long else map(known.__getitem__, stretches))
            out.append((ids, int(self.is_byte[np.frombuffer(ids, "<u4")].sum())))
        return out

    def encode(self, text: str) -> tuple[bytes, int]:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        joined = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = joined.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def pieces_of(path: str) -> list[tuple[str, float, str]]:
    """Pieces of a model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [(model.is_unknown, "unknown"), (model.is_control, "other"), (model.is_unused, "other"), (model.is_byte, "byte")]
    return [(model.id_to_piece(k), model.get_score(k), next((name for test, name in kinds if test(k)), "piece")) for k in range(model.get_piece_size())]


def _public(model: str):
    def make():
        import public_tokenizers

        return Unigram(pieces_of(public_tokenizers.path(model)))
    return make


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_byte_ids (byte pieces among them), decoded (text from the ids)."""
    def run(batches):
        unigram = kept_in_process(f"unigram_{model}", _public(model))
        for batch in batches:
            for lo, hi, _, _ in blocks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                got = unigram.encode_many(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64()),
                                                  pa.array([unigram.decode(g[0]) for g in got], pa.string())], ["doc_id", "ids", "n_byte_ids", "decoded"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, ids binary, n_byte_ids long, decoded string")


def digested(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_ids, n_byte_ids, ids_crc32 and the SHA-256 of the decoded text."""
    e = encoded(docs, model)
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "n_byte_ids", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_unigram_pieces(spark, sf_dir):
    return digested(documents(spark, sf_dir))


QUERIES = {"op10_unigram_pieces": op10_unigram_pieces}
SQL = {}
