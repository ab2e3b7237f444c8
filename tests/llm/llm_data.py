"""Made-up rows for these tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, lang: str = "en") -> str:
    """Made-up words in the manner of a language, in sentences and lines."""
    rng = random.Random(f"{lang}{seed}")
    common = {"en": "the of and to in that it is was for", "fr": "le la de et les des un une que pour"}[lang].split()
    parts = {"en": "th er on an re he in ed nd ha at en es or ti".split(), "fr": "eau ai oi ou ch é è ai eux ment tion que elle".split()}[lang]
    words = [rng.choice(common) if rng.random() < 0.45 else "".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append(w.capitalize() if i % 12 == 0 else w)
        out.append(".\n" if i % 36 == 35 else ". " if i % 12 == 11 else " ")
    return "".join(out).strip()


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    texts = [
        None, "", "   \n\t ", "a", "one two three", prose(1, 80), prose(1, 80), prose(2, 60000), "x" * 200_000,
        "the the the the the the the the the the the the", "é" * 30 + " ß   x y 日本語 😀", "a\n\nb\na\n", "\x00\x0b\x0c\x1c",
        "<|endoftext|> it's can't 'S", prose(3, 90, "fr"),
    ]
    rows = [(i, t, "fr" if i == 14 else "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(4, 70), "en", None, None), (None, None, None, None, None), (20, prose(5, 50), None, None, 0)]
    return rows
