"""Spelling variants against all pairs of a small vocabulary."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crease.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(words, min_chars=6, min_count=5, ratio=5):
    n = {w: c for w, c in collections.Counter(words).items() if w and len(w) >= min_chars and c >= min_count}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def random_words(seed, letters="aeioxé", n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)]
    out = []
    for i, w in enumerate(base):
        out += [w] * rng.choice([1, 5, 6, 30, 200])
        for _ in range(4):
            at = rng.randrange(len(w))
            v = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])
            out += [v] * rng.choice([4, 5, 7, 40])
    return out


def frame(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


@pytest.mark.parametrize("bucket", [64, 2, 0])
def test_equals_all_pairs(spark, bucket):
    words = random_words(bucket) + [None, "", "abc"] * 6
    assert result(sp.group_variants(frame(spark, words), bucket=bucket)) == brute(words)


def test_one_reduced_word_holds_a_third_of_the_vocabulary(spark):
    # letters 7 apart are one symbol: every word over a, h, o, v has the same reduced word
    words = random_words(4, letters="ahov", n=60) * 1 + random_words(5, letters="bcdefg", n=60)
    reduced = collections.Counter(tuple(ord(c) % 7 for c in w) for w in set(words))
    assert max(reduced.values()) > 30
    assert result(sp.group_variants(frame(spark, words), bucket=8)) == brute(words)


def test_ties_take_the_smallest_form_and_chains_have_one_root(spark):
    words = ["wordab"] * 5 + ["wordac"] * 30 + ["wordad"] * 30 + ["wordadd"] * 150 + ["wordaddd"] * 1000 + ["Zordac"] * 30
    got = {r[0]: r for r in result(sp.group_variants(frame(spark, words)))}
    assert got["wordab"][1] == "wordac" and got["wordad"][1:3] == ("wordadd", "wordaddd")
    assert got["wordadd"][2] == "wordaddd" and result(sp.group_variants(frame(spark, words))) == brute(words)


def test_very_long_words_and_other_letters(spark):
    long = "ab" * 15_000
    words = [long] * 25 + [long[:700] + long[701:]] * 5 + ["日本語日本語"] * 30 + ["日本語日本𝄞"] * 6 + ["straße"] * 5 + ["strasse"] * 5
    assert result(sp.group_variants(frame(spark, words))) == brute(words)


def test_empty_table_and_clashing_names(spark):
    assert result(sp.group_variants(frame(spark, []))) == []
    more = frame(spark, ["vision"] * 5).withColumn("n", F.lit("x")).withColumn("code", F.lit(1)).withColumn("near", F.lit(2))
    assert result(sp.group_variants(more)) == [("vision", None, "vision", 5, 0, None)]
    with pytest.raises(ValueError):
        sp.group_variants(frame(spark, []), ratio=1)


@pytest.mark.parametrize("symbols", [7, None])
def test_neighbourhood_is_every_one_edit_word_once(symbols):
    texts = ["aab", "bba", "abc", "c", "aaaa"]
    alphabet = [1, 2, 3] if symbols else [97, 98, 99]
    got = collections.defaultdict(list)
    for w, h in sp._Rolling([t.translate({97: 0, 98: 1, 99: 2}) if symbols else t for t in texts], symbols).edits(np.array(alphabet, np.uint64)):
        for i, x in zip(w.tolist(), h.tolist()):
            got[i].append(x)
    for i, t in enumerate(texts):
        edits = {t[:p] + t[p + 1:] for p in range(len(t))} | {t[:p] + c + t[p:] for p in range(len(t) + 1) for c in "abc"}
        edits |= {t[:p] + c + t[p + 1:] for p in range(len(t)) for c in "abc"} - {t}
        plain = [e.translate({97: 0, 98: 1, 99: 2}) if symbols else e for e in sorted(edits)]
        assert sorted(got[i]) == sorted(sp._Rolling(plain, symbols).whole().tolist())


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(sp, "BATCH_ROWS", 50)
    assert max(len(w) for w, _ in sp._Rolling(["abcdefgh" * 40], 7).edits(np.arange(1, 8, dtype=np.uint64))) <= 50


def test_registered_query_on_the_whole_table(spark):
    folder, words = "/root/testdata/sf0.001", []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for run in RUN.findall((r.text or "").translate(LOWER)):
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            words.append(run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run)
    got = result(sp.query(spark, folder))
    assert got == brute(words) and any(r[1] for r in got)


def test_damage_of_null_ids_and_texts(spark):
    docs = spark.createDataFrame([(None, "Vision Vision"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.word for r in sp.damaged_words(docs).collect()] == ["vision", "vision"]
