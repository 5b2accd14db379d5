"""Rows that every operator must take."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named as the operators name their own ones.
CLASHES = "kept string, row string, k1 string, node string, label string, hash string, score string, n string"


def prose(seed: int, words: int, stems=("the", "of", "river", "stone", "walk", "light", "hand", "over", "under", "winter", "house", "seven")) -> str:
    out, x = [], seed * 2654435761 % 4294967296
    for _ in range(words):
        x = (x * 1103515245 + 12345) % 4294967296
        out.append(stems[x >> 16 & 0xFFFF and (x >> 16) % len(stems)] + (str(x >> 20 & 63) if x & 1024 else ""))
    return " ".join(out)


ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", None, "a", 6), (4, "word", "en", None, 4), (5, "1234 5678 !!", None, "b", 12),
    (6, prose(1, 120), "en", "a", 1), (7, prose(1, 120), "en", "a", 1), (8, prose(1, 119) + " changed", "en", "b", 1), (9, prose(2, 30000), "en", "a", 1),
    (10, "Ünïcödé 日本語 🎉 naïve " * 5, "fr", "c", 1), (11, prose(3, 60) + "\n" + prose(3, 60), "en", "a", 1), (12, prose(4, 80), "en", "a", 1), (12, prose(4, 80), "en", "a", 1),
    (None, prose(5, 70), "en", "a", 1), (None, None, None, None, None), (13, "a\x00b\x1f\x7f    x", None, None, 3), (14, prose(1, 120).upper(), "en", "a", 1),
]
