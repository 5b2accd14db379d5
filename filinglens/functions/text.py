"""Column expressions over text; all stay on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from filinglens import lexicon as L

# Unicode blanks that a text run may hold.
BLANK = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Blanks besides the space and the line feed, one by one: looking for each costs less than a pattern of all.
ODD_BLANKS = [chr(i) for i in (9, *range(11, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
SENTENCE_BREAK = r"(?<=[.!?。])\s+|\n+"
# One word of small or caseless letters: it is its own normal form and holds neither digits nor blanks.
PLAIN_WORD = r"^[\p{Ll}\p{Lo}]{2,}\z"
_MARK = "\u0001"
PIECE_BREAK = r"(?<=[.!?다요])\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squash(c: Column) -> Column:
    """Every blank run becomes one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", " "))


def _drop_marks(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "\u00a0\t\u200b\ufeff", "  ")


def clean_inline(c: Column) -> Column:
    return squash(_drop_marks(c))


def clean_chunk(c: Column) -> Column:
    c = F.regexp_replace(_drop_marks(c), " {2,}", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_document(c: Column) -> Column:
    """Lines trimmed, blank lines collapsed to one."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\u00a0]*\n[ \t\u00a0]*", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_search(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n+", "\n"))


def fingerprint(c: Column) -> Column:
    return F.sha1(F.regexp_replace(F.lower(clean_chunk(c)), f"{BLANK}+", " "))


def short_id(c: Column) -> Column:
    return F.substring(F.sha1(squash(c)), 1, 16)


# --- term matching -------------------------------------------------------------------

def _terms_or_false(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def any_term(c: Column, terms: list[str]) -> Column:
    return _terms_or_false([c.contains(t) for t in terms])


def all_terms(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [c.contains(t) for t in terms])


def term_hits(c: Column, terms: list[str]) -> Column:
    """Terms found in ``c``, in list order, case as given."""
    return F.array_compact(F.array(*[F.when(c.contains(t), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def term_hits_nocase(c: Column, terms: list[str]) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]))


def hit_count(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(t).cast("int") for t in terms]) if terms else F.lit(0)


def dictionary_tags(c: Column, dictionary: dict[str, list[str]]) -> Column:
    """Dictionary keys with at least one term in ``c``, in dictionary order."""
    return F.array_compact(F.array(*[F.when(any_term(c, terms), F.lit(k)) for k, terms in dictionary.items()]))


# --- sentences and blocks --------------------------------------------------------------------

def sentences(c: Column, low: int = L.SENTENCE_MIN_CHARS, high: int = L.SENTENCE_MAX_CHARS) -> Column:
    """Most texts hold no blank but single spaces and line feeds, so that only the ends of their parts are to be trimmed."""
    runs = c.contains("  ") | c.contains("\t")
    parts = F.split(F.when(runs, F.regexp_replace(c, r"[ \t]+", " ")).otherwise(c), SENTENCE_BREAK)
    parts = F.when(any_term(c, ODD_BLANKS), F.transform(parts, squash)).otherwise(F.transform(parts, lambda s: F.trim(s)))
    return F.filter(parts, lambda s: F.length(s).between(low, high))


def is_table_block(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), F.trim), lambda l: l != "")
    pipes = F.size(F.filter(lines, lambda l: l.contains("|")))
    floor_half = F.floor(F.size(lines) / 2)
    return c.contains("<!-- table_") | ((F.size(lines) > 0) & (pipes >= F.greatest(F.lit(2).cast("bigint"), floor_half)))


def is_heading(line: Column, patterns=None, keywords=None) -> Column:
    patterns = L.HEADING_PATTERNS if patterns is None else patterns
    keywords = L.HEADING_KEYWORDS if keywords is None else keywords
    by_shape = _terms_or_false([line.rlike(p) for p in patterns])
    return by_shape | ((F.length(line) <= L.HEADING_KEYWORD_CHARS) & any_term(line, keywords))


def pack_paragraphs(c: Column, limit: int = L.BLOCK_MAX_CHARS) -> Column:
    """Paragraphs joined up to ``limit`` characters; a pipe table stands alone."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), squash), lambda p: p != "")

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & ~p.startswith("|") & ~last.startswith("|") & (F.length(last) + 1 + F.length(p) <= limit)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), p)))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), step)


def heading_blocks(c: Column, patterns=None, keywords=None) -> Column:
    """Lines grouped under the heading that opens them."""
    lines = F.filter(F.transform(F.split(clean_chunk(F.translate(c, _MARK, "")), r"\r?\n"), strip), lambda l: l != "")
    marked = F.transform(lines, lambda l: F.when(is_heading(l, patterns, keywords), F.concat(F.lit(_MARK), l)).otherwise(l))
    return F.filter(F.split(F.array_join(marked, "\n"), f"\n?{_MARK}"), lambda b: b != "")


def length_pieces(c: Column, limit: int = L.CHUNK_MAX_CHARS, overlap: int = L.CHUNK_OVERLAP_CHARS) -> Column:
    """Pieces of at most ``limit`` characters of a cleaned text, cut at sentence ends where possible."""
    body = c
    pieces = F.filter(F.transform(F.split(body, PIECE_BREAK), strip), lambda s: s != "")
    step_len = limit - overlap

    def cuts(s):
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(s) - overlap) / step_len) - 1, F.lit(0)).cast("int"))
        return F.transform(starts, lambda i: F.struct(strip(F.substring(s, i * step_len + 1, F.lit(limit))).alias("t"), F.lit(False).alias("open")))

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(last["open"], F.lit(False)) & (F.length(last["t"]) + 1 + F.length(s) <= limit)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                         F.array(F.struct(F.concat(last["t"], F.lit(" "), s).alias("t"), F.lit(True).alias("open"))))
        alone = F.when(F.length(s) > limit, cuts(s)).otherwise(F.array(F.struct(s.alias("t"), F.lit(True).alias("open"))))
        return F.when(joins, grown).otherwise(F.concat(acc, alone))

    folded = F.aggregate(pieces, F.array().cast("array<struct<t:string,open:boolean>>"), step,
                         lambda acc: F.transform(acc, lambda x: x["t"]))
    return F.when((F.length(body) <= limit) | is_table_block(body), F.array(body)).otherwise(folded)


def text_pieces(c: Column, low: int = L.CHUNK_MIN_CHARS, limit: int = L.CHUNK_MAX_CHARS,
                overlap: int = L.CHUNK_OVERLAP_CHARS, patterns=None, keywords=None) -> Column:
    """Heading blocks cut to length; short leftovers dropped."""
    pieces = F.flatten(F.transform(heading_blocks(c, patterns, keywords), lambda b: length_pieces(b, limit, overlap)))
    return F.filter(pieces, lambda p: F.length(p) >= low)


# --- positions ------------------------------------------------------------------------------------

def quote(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _walk(parts: Column, widths) -> Column:
    """Positions of the gaps between ``parts``; ``widths`` is the gap length."""
    return F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + widths, F.lit(0)) + F.length(p))))


def occurrences(c: Column, term: str) -> Column:
    """0-based positions of every non-overlapping ``term``."""
    parts = F.split(c, quote(term), -1)
    return F.when(c.contains(term), _walk(parts, F.lit(len(term)))).otherwise(F.array().cast("array<int>"))


def match_spans(c: Column, pattern: str) -> Column:
    """``array<struct<pos,text>>`` for each match of ``pattern``, left to right."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def step(acc, m):
        last = F.try_element_at(acc, F.lit(-1))
        start = F.coalesce(last["pos"] + F.length(last["text"]), F.lit(0)) + 1
        here = F.call_function("locate", m, c, start) - 1
        return F.concat(acc, F.array(F.struct(here.alias("pos"), m.alias("text"))))

    return F.aggregate(found, F.array().cast("array<struct<pos:int,text:string>>"), step)


def context(c: Column, pos: Column, width, before: int, after: int) -> Column:
    """Text from ``before`` characters left of ``pos`` to ``after`` right of the hit."""
    left = F.greatest(pos - before, F.lit(0))
    return strip(F.substring(c, left + 1, pos + width + after - left))


# --- keywords ----------------------------------------------------------------------------------------

def normalise_keyword(c: Column, stopwords=None) -> Column:
    stopwords = L.KEYWORD_STOPWORDS if stopwords is None else stopwords
    plain = c.rlike(PLAIN_WORD)
    bare = squash(F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_\s\-]", " "))
    tokens = F.filter(F.split(bare, " "), lambda t: (t != "") & ~t.isin(*stopwords) & ~t.rlike(r"^\d+(\.\d+)?$"))
    joined = F.array_join(tokens, " ")
    cleaned = F.when(F.length(joined) >= 2, joined).otherwise(F.lit(""))
    return F.when(plain & ~c.isin(*stopwords), c).when(plain, "").otherwise(cleaned)


def is_noisy_keyword(keyword: Column, score: Column, floor: float = L.MIN_KEYWORD_SCORE, phrases=None) -> Column:
    phrases = L.KEYWORD_NOISE_PHRASES if phrases is None else phrases
    k = F.lower(strip(keyword))
    dated = k.rlike(r"\d{4}년|\d+월|\d+일") & (F.size(F.split(k, r"\s+")) <= 2)
    plain = F.when(keyword.rlike(PLAIN_WORD), (score < floor) | any_term(keyword, phrases))
    return plain.otherwise((k == "") | (score < floor) | any_term(k, phrases) | k.rlike(r"^[\d\s.%]+$") | dated
            | (F.length(F.replace(k, F.lit(" "), F.lit(""))) < 2))


def is_centrality_noise(keyword: Column, phrases=None) -> Column:
    phrases = L.CENTRALITY_NOISE_PHRASES if phrases is None else phrases
    k = F.lower(strip(keyword))
    return (k == "") | any_term(k, [p.lower() for p in phrases]) | k.rlike(r"^주\s*\d+$") | k.rlike(r"^[\d\s.,%()\-]+$")
