"""Small texts and plain-Python counterparts of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(n=60, seed=5, vocabulary=400):
    """Random texts with copies, near copies, shared passages, empty and null
    texts, a long text, odd white space and a repeated row."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["ka", "lo", "Ti", "né", "ß", "ra", "on"]) for _ in range(rng.randint(1, 4)))
             for _ in range(vocabulary)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(70)
    rows = []
    for i in range(n):
        t = text(rng.choice([3, 12, 60, 150]))
        if i % 5 == 1:
            t = t + "\n" + passage + " \t " + text(20)
        if i % 7 == 3 and i > 10:
            t = rows[i - 7][1] or t
        if i % 11 == 4 and i > 10 and rows[i - 3][1]:
            w = words(rows[i - 3][1])
            if w:
                w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i * 3, t, "en", f"s{i % 4}", len(t)))
    rows[2] = (rows[2][0], None, None, None, None)
    rows[8] = (rows[8][0], "", "en", "s1", 0)
    rows[9] = (rows[9][0], " \n\t ", "en", None, 4)
    rows.append((n * 3, text(4000), "en", "s0", 0))
    rows.append(rows[12])                                    # a repeated row
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
