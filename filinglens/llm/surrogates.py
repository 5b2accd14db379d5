"""PII: detected entities are replaced by keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity's own format: a Feistel network over the mixed-radix number that
its characters spell, each within its class (digits, letters of one script and case).  A permutation maps
different entities of one format to different surrogates and the same entity to the same one in every document
and run, without a table of entities; only what the check below moves is settled per document.  Types with an
inner rule stay within it by walking the permutation on until the rule holds (or fails) as before: dialling
codes and area codes, private and public addresses, check digits of cards and account numbers.  A given name
from the lists is replaced by the next one in a keyed order of its list, of the same script and gender and never
itself; other names keep vowels, consonants and case.

Within a document a check compares all surrogates with each other and with the originals; a surrogate that is
taken, or equal to an original, moves on until it is free.  Names are settled word by word for the whole document and
then put together, so a person keeps one given and one family name in full names and single mentions alike: a given
name moves to the next one of its list and, when the list is used up, to other letters before its ending.  Other
values move on under another tweak, with one more letter from time to time where the format has no fixed length.  An
entity so moved has in that document another surrogate than elsewhere: it can't have the same one everywhere and
never a name that the text holds.  Letters outside the listed classes are permuted among the letters of their Unicode
block with the same script and case; what has no such letters is replaced by drawn ones.

A null text stays null, an empty one empty.  Repeated rows give repeated results; an empty table an empty result.
Texts without entities are unchanged.  Ties between detectors go to the one listed first.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglens.llm.common import bounded_batches, documents, kept_in_process

KEY = "filinglens surrogate key; give your own"

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Camille Carmen Charlotte Claire Elena Emily Emma Hannah Ingrid Isabel Julia Karin Laura Lucia Marie Monika Sophie Susan".split(),
    ("latin", "m"): "Andrew Antoine Carlos Daniel David Diego Felix Hans Henri James Javier John Klaus Louis Michael Pablo Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
}
# Forms of address by gender ("" where they leave it open).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f"}

# Character classes; a character is replaced by one of its own class.
_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ",
            "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
            *("".join(map(chr, range(a, b))) for a, b in ((0x3B1, 0x3C2), (0x391, 0x3A2), (0x5D0, 0x5EB), (0x3042, 0x3094), (0x30A2, 0x30F4), (0xAC00, 0xD7A4), (0x4E00, 0x9FA6)))]
# Turns of the collision check after which a surrogate without a fixed length grows by a letter.
LONGER = 50
_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = "0123456789abcdef"


class Permutation:
    """Keyed permutations of numbers below a product of radices, and of strings within their classes."""

    ROUNDS = 8

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        # For each character the mark of its class in a shape, its place in the class and the members.
        self.classes = {c: (chr(65 + k), i, members) for k, members in enumerate(_CLASSES) for i, c in enumerate(members)}
        self.listed = frozenset(self.classes)

    def class_of(self, c: str) -> tuple[str, int, str] | None:
        """The class of a character; letters and digits that no list names form classes by block, script and case."""
        if c not in self.classes:
            def kind(x):
                return unicodedata.category(x), unicodedata.name(x, "").split(" ")[0]

            block = ord(c) & ~0x7F
            members = "".join(x for x in map(chr, range(block, block + 0x80)) if x not in self.listed and kind(x) == kind(c)) if c.isalnum() else ""
            self.classes[c] = (members[0], members.index(c), members) if len(members) > 1 else None
        return self.classes[c]

    def _draw(self, tweak: str, turn: int, value: int, limit: int) -> int:
        said = f"{tweak}\x00{turn}\x00{value}\x00{limit}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=max(16, (limit.bit_length() + 71) // 8)).digest() if limit.bit_length() < 400 else
                              b"".join(hashlib.blake2b(said + bytes([k % 256, k // 256]), key=self.key).digest() for k in range(limit.bit_length() // 512 + 2)), "big") % limit

    def number(self, x: int, left: int, right: int, tweak: str, back: bool = False) -> int:
        """Permute x < left * right."""
        a, b = divmod(x, right)
        sign = -1 if back else 1
        for turn in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            if turn % 2:
                b = (b + sign * self._draw(tweak, turn, a, right)) % right
            else:
                a = (a + sign * self._draw(tweak, turn, b, left)) % left
        return a * right + b

    def digits(self, values: list[int], radices: list[int], tweak: str, back: bool = False) -> list[int]:
        half = len(values) // 2
        size = [1, 1]
        x = 0
        for i, (v, r) in enumerate(zip(values, radices)):
            x = x * r + v
            size[i >= half] *= r
        x = self.number(x, size[0], size[1], tweak, back)
        out = []
        for r in reversed(radices):
            x, v = divmod(x, r)
            out.append(v)
        return out[::-1]

    def text(self, s: str, tweak: str, back: bool = False, alphabet: str | None = None) -> str:
        """Permute the characters of ``s`` that belong to a class (or to ``alphabet``); the others stay."""
        if alphabet:
            spots = [(i, alphabet.index(c), alphabet) for i, c in enumerate(s) if c in alphabet]
        else:
            spots = [(i, at[1], at[2]) for i, c in enumerate(s) if (at := self.class_of(c))]
        if not spots:
            return s
        shape = tweak + "".join(("#" if c in alphabet else ".") if alphabet else at[0] if (at := self.class_of(c)) else "." for c in s)
        new = self.digits([v for _, v, _ in spots], [len(m) for _, _, m in spots], shape, back)
        out = list(s)
        for (i, _, members), v in zip(spots, new):
            out[i] = members[v]
        return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    return -sum((2 * int(c) - 9 * (c > "4")) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits))) % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


_CAPITALS = "".join(c for a, b in ((0xC0, 0x250), (0x400, 0x530)) for c in map(chr, range(a, b)) if c.isupper())
_LAST = rf"[A-Z{_CAPITALS}][\w'’-]+"
_GIVEN_WORDS = "|".join(n for names in GIVEN.values() for n in names)
DETECTORS = [
    ("email", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "@"),
    ("access_key", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), "IA"),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?(?P<value>[\w+/.-]{6,})"), None),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"), None),
    ("ipv4", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"), "."),
    ("card", re.compile(r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"), None),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"), None),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "-"),
]
_DIGIT = re.compile(r"\d")
_SECRET = re.compile(r"(?i)password|passwd|secret|token|api[_-]?key")
NAME = re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES)})\.?\s+(?P<after>(?:{_LAST})(?:\s+(?:{_LAST}))?)|(?P<given>{_GIVEN_WORDS})(?:\s+(?P<family>{_LAST}))?)(?!\w)")


NAME_WORD = re.compile(r"[\w'’-]+")


class Surrogates:
    """Detects entities of one text and replaces them."""

    def __init__(self, key: str = KEY):
        self.permute = Permutation(key)
        self.cycles: dict[tuple[str, str], dict[str, list[str]]] = {}
        self.given = {name: (kind, i) for kind, names in GIVEN.items() for i, name in enumerate(names)}

    def walk(self, step, value: str, rule) -> str:
        """Go on permuting until ``rule`` says of the result what it says of ``value``: a permutation of either side."""
        wanted, out = rule(value), step(value)
        while rule(out) != wanted:
            out = step(out)
        return out

    def cycle(self, kind: tuple[str, str]) -> dict[str, list[str]]:
        """For each given name the others of its list, in the keyed order of the list that starts behind it."""
        if kind not in self.cycles:
            names = sorted(GIVEN[kind], key=lambda n: self.permute._draw(f"given{kind}", 0, GIVEN[kind].index(n), 1 << 64))
            self.cycles[kind] = {n: names[i + 1 :] + names[:i] for i, n in enumerate(names)}
        return self.cycles[kind]

    def name_word(self, word: str, turn: int) -> str:
        if not any(self.permute.class_of(c) for c in word):
            return "".join(chr(97 + self.permute._draw(f"{turn}/drawn{word}", 0, i, 26)) for i in range(len(word)))
        tweak, more = f"{turn}/" if turn else "", "ea"[turn // LONGER % 2] * (turn // LONGER)
        if (known := self.given.get(word)) is not None:
            others = self.cycle(known[0])[word]
            if turn < len(others):
                return others[turn]
            # The list is used up: other letters, with the ending that marks the gender.
            new = self.permute.text(word[:-1] + more, tweak + "name") + word[-1]
            return self.name_word(word, turn + 1) if new in self.given or new in TITLES else new
        return self.walk(lambda w: self.permute.text(w, tweak + "name"), word + more, lambda w: w in self.given or w in TITLES)

    def surrogate(self, kind: str, value: str, turn: int = 0) -> str:
        """The surrogate, or the ``turn``-th one in its place; names, addresses and secrets grow by a letter every ``LONGER`` turns."""
        tweak, more = f"{turn}/" if turn else "", "e" * (turn // LONGER)
        p = self.permute
        if kind == "name":
            return NAME_WORD.sub(lambda m: self.name_word(m[0], turn), value)
        if kind == "email":
            name, _, top = (more + value).rpartition(".")
            return f"{p.text(name, tweak + 'email')}.{top}"
        if kind == "access_key":
            return value[:4] + p.text(value[4:], tweak + "key", alphabet=_BASE36)
        if kind == "secret":
            value += more
            return p.text(value, tweak + "secret", alphabet=_HEX if all(c in _HEX for c in value) else None)
        if kind == "iban":
            rest = p.text(value[4:], tweak + "iban" + value[:2])
            return value[:2] + (iban_check(value[:2], rest) if iban_check(value[:2], value[4:]) == value[2:4] else value[2:4]) + rest
        if kind == "ipv4":
            def step(x):
                return str(ipaddress.IPv4Address(p.number(int(ipaddress.IPv4Address(x)), 1 << 16, 1 << 16, tweak + "ipv4")))
            plain = ".".join(str(int(o)) for o in value.split("."))
            return self.walk(step, plain, lambda x: ipaddress.IPv4Address(x).is_global)
        if kind == "card":
            bare = re.sub(r"\D", "", value)
            valid = luhn(bare[:-1]) == int(bare[-1])
            if valid:
                new = bare[0] + p.text(bare[1:-1], tweak + "card" + bare[0])
                new += str(luhn(new))
            else:
                new = self.walk(lambda x: bare[0] + p.text(x[1:], tweak + "card" + bare[0]), bare, lambda x: luhn(x[:-1]) == int(x[-1]))
            fresh = iter(new)
            return "".join(next(fresh) if c.isdigit() else c for c in value)
        if kind == "phone":
            lead = m[0] if (m := re.match(r"\+\d{1,3}(?=[ .(-])", value)) else ""
            return lead + self.walk(lambda x: p.text(x, tweak + "phone" + lead), value[len(lead):], lambda x: next((c for c in x if c.isdigit()), "") in "01")
        return p.text(value, tweak + kind)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and kind of each entity, in order, without overlaps."""
        spans: list[tuple[int, int, str]] = []
        numeric, worded = _DIGIT.search(text) is not None, _SECRET.search(text) is not None

        def admit(a, b, kind):
            if all(b <= x or y <= a for x, y, _ in spans):
                spans.append((a, b, kind))

        rest = text  # without what has been found, so that an entity doesn't run into its neighbour
        for kind, pattern, needs in DETECTORS:
            if needs and needs not in text or kind == "secret" and not worded or kind not in ("email", "secret", "access_key") and not numeric:
                continue
            found = [m.span("value") if kind == "secret" else m.span() for m in pattern.finditer(rest)]
            for a, b in found:
                admit(a, b, kind)
                rest = rest[:a] + "\x00" * (b - a) + rest[b:]
        words: set[str] = set()
        for m in NAME.finditer(text):
            for part in ("after", "given", "family"):
                if m[part]:
                    admit(*m.span(part), "name")
                    words |= set(m[part].split()) - (set() if part != "given" else {m[part]})
        later = words - {w for w in words if len(w) < 3}
        if later:  # the same person again, by one of the words of the name
            for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(later, key=len, reverse=True))) + r")(?!\w)", text):
                admit(*m.span(), "name")
        return sorted(spans)

    def settled(self, words: set[str]) -> dict[str, str]:
        """For each word of the names of a text its surrogate: all different, none of them a word of these names."""
        out: dict[str, str] = {}
        taken: set[str] = set()
        for word in sorted(words):
            turn = 0
            while (new := self.name_word(word, turn)) in taken or new in words:
                turn += 1
            out[word] = new
            taken.add(new)
        return out

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]], dict[tuple[str, str], str]]:
        """The new text, the entities found in the old one, and their surrogates."""
        spans = self.find(text)
        if not spans:
            return text, [], {}
        originals = {(kind, text[a:b]) for a, b, kind in spans}
        words = self.settled({w for kind, value in originals if kind == "name" for w in NAME_WORD.findall(value)})
        values = {v for _, v in originals}
        chosen: dict[tuple[str, str], str] = {}
        taken: set[str] = set()
        for kind, value in sorted(originals):
            if kind == "name":
                chosen[kind, value] = NAME_WORD.sub(lambda m: words[m[0]], value)
                taken.add(chosen[kind, value])
        for kind, value in sorted(o for o in originals if o[0] != "name"):
            new, turn = self.surrogate(kind, value), 0
            while new in taken or new in values:
                turn += 1
                new = self.surrogate(kind, value, turn)
            chosen[kind, value] = new
            taken.add(new)
        out, at = [], 0
        for a, b, kind in spans:
            out += [text[at:a], chosen[kind, text[a:b]]]
            at = b
        return "".join(out) + text[at:], spans, chosen


RESULT = "struct<text: string, n_entities: bigint, n_distinct: bigint, kinds: string>"


def replaced(key: str = KEY):
    """A column function: text with surrogates, entities, distinct entities and their kinds."""
    kind = pa.struct([("text", pa.string()), ("n_entities", pa.int64()), ("n_distinct", pa.int64()), ("kinds", pa.string())])

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        worker = kept_in_process("surrogates_" + hashlib.sha256(key.encode()).hexdigest()[:16], lambda: Surrogates(key))
        out = []
        for text in column.to_pylist():
            new, spans, chosen = worker.replace(text) if text else (text, [], {})
            out.append({"text": new, "n_entities": len(spans), "n_distinct": len(chosen), "kinds": ",".join(sorted({k for _, _, k in spans}))})
        return pa.array(out, kind)

    return run


def anonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, n_distinct, kinds, text with surrogates."""
    bounded_batches(docs.sparkSession)
    made = docs.select("doc_id", replaced(key)(F.col("text")).alias("made"))
    return made.select("doc_id", "made.n_entities", "made.n_distinct", "made.kinds", "made.text")


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, all columns; n_chars, where there is one, follows the text."""
    bounded_batches(docs.sparkSession)
    out = docs.withColumn("text", replaced(key)(F.col("text"))["text"])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_keyed_surrogates(spark, sf_dir):
    return anonymised(documents(spark, sf_dir))


QUERIES = {"op8_keyed_surrogates": op8_keyed_surrogates}
SQL = {}
