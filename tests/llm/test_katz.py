"""Katz backoff against a plain implementation; probabilities add up to 1."""

import collections
import math
import zlib

import numpy as np
import pytest

from crease.llm import katz as z

from .helpers import SCHEMA, corpus, frame, words

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Plain:
    def __init__(self, rows, folds):
        self.tokens = [[*words((r[1] or "").translate(_LOW)), None] for r in rows]
        self.held = [r[0] is None or zlib.crc32(str(r[0]).encode()) % folds == 0 for r in rows]
        self.one, two = collections.Counter(), collections.Counter()
        for t, h in zip(self.tokens, self.held):
            if not h:
                self.one.update(t)
                two.update(zip(["<begin>", *t[:-1]], t))
        self.after = collections.defaultdict(dict)
        for (a, b), n in two.items():
            self.after[a][b] = n
        self.n, self.v = sum(self.one.values()), len(self.one)
        of = collections.Counter(two.values())
        self.d = dict(enumerate(z.discounts([of[r] for r in range(1, z.K + 2)]), 1))

    def low(self, w):
        return (self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, a, w):
        seen = self.after.get(a)
        if not seen:
            return self.low(w)
        total = sum(seen.values())
        star = lambda n: (self.d[n] * n if n <= z.K else n - z.TAIL) / total
        if w in seen:
            return star(seen[w])
        return (1 - sum(map(star, seen.values()))) / (1 - sum(map(self.low, seen))) * self.low(w)


@pytest.mark.parametrize("block_bytes", [1 << 12, 8 << 20])
def test_scores_equal_the_plain_model(spark, block_bytes):
    rows = corpus(n=80, vocabulary=60)
    model = Plain(rows, 10)
    got = z.score(frame(spark, rows), block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    want = collections.defaultdict(list)
    for r, t, h in zip(rows, model.tokens, model.held):
        want[r[0]].append((h, len(t), sum(model.one[w] > 0 for w in t), model.n, sum(math.log10(model.low(w)) for w in t),
                           sum(math.log10(model.p(a, w)) for a, w in zip(["<begin>", *t[:-1]], t))))
    for r in got:
        w = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
    for a in list(model.after)[:20]:
        known = sum(model.p(a, w) for w in model.one)
        assert known + model.p(a, "never seen") == pytest.approx(1, abs=1e-9)


def test_discounts():
    n = [1000, 300, 150, 90, 60, 45]
    d = z.discounts(n)
    common = 6 * 45 / 1000
    assert d[0] == pytest.approx((2 * 300 / 1000 - common) / (1 - common))
    assert ((d > 0) & (d < 1)).all()
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 9], [10, 100, 1, 0, 3, 0]):
        d = z.discounts(odd)
        assert ((d > 0) & (d < 1)).all()


def test_edge_cases(spark):
    rows = [(None, "a b", None, None, 0), (1, None, None, None, 0), (1, "", None, None, 0), (2, "A é", None, None, 0)]
    got = z.score(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 1), (1, 1), (2, 3)]
    assert all(r.score <= 0 and np.isfinite(r.score) for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]
    assert z.score(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = z.score(frame(spark, [(None, "a b", None, None, 0)])).collect()
    assert [(r.train_tokens, r.base_score, r.score) for r in alone] == [(0, 0.0, 0.0)]
