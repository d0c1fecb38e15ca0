"""A small corpus with the cases that operators must bear, and word helpers for brute-force versions."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["an", "ber", "cio", "dor", "el", "fa", "gun", "hi", "jo", "ka", "lum", "mi", "no", "pra", "que", "ré", "sch", "tü", "ña", "ves"]


def words_of(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def prose(rng: random.Random, words: int) -> str:
    out = []
    for _ in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(rng.choice([w, w, w, w.capitalize(), w + ",", w + ".", w + ".\n"]))
    return " ".join(out)


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, shared passages, a long text, repetition within a text, nulls, empties, equal rows."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    passage = prose(rng, 70)
    for i in range(n):
        kind, text = i % 10, prose(rng, rng.randint(1, 150))
        if kind == 3 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 5:
            parts = (rng.choice(rows)[1] or "").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif kind == 7:
            text = f"{text} {passage} {prose(rng, 20)}"
        elif kind == 9:
            text = text + " " + text
        rows.append((i, text, rng.choice(["aa", "bb", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(text)))
    long = prose(rng, 6000)
    rows += [(n, long, "aa", "s0", len(long)), (n + 1, None, None, None, None), (n + 2, "", "aa", "s1", 0), (n + 3, "  \n\t ", "bb", "s1", 4), (n + 4, "ha " * 500, "aa", "s0", 1500), (n + 5, "!!! ...", "aa", "s2", 7)]
    rows += [rows[0], rows[0], (None, "a null id, with text", "aa", "s0", 20), (None, None, None, None, None)]
    return rows


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
