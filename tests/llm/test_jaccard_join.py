"""Near-duplicate classes and link counts against all pairs by brute force."""

import itertools
import random

import numpy as np
import pytest

from crease.llm import jaccard_join as j
from crease.llm.components import components

from .helpers import SCHEMA, corpus, frame, words


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], low[find(i)], links[i]) for i, r in enumerate(rows))


def family(n, seed, words_n=120):
    rng = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(words_n)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(words_n)] = f"v{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [7, 1024])
def test_equals_brute_force(spark, chunk):
    rows = corpus()
    for s in (1, 2):
        rows += [(1000 * s + i, t, "en", "s", 0) for i, t in enumerate(family(25, s))]
    got = j.near_duplicates(frame(spark, rows), chunk=chunk)
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute(rows)


def test_nulls_and_empty_table(spark):
    rows = [(None, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0), (2, "a b c d e f", None, None, 0),
            (3, None, None, None, 0), (4, "", None, None, 0), (5, "x", None, None, 0), (6, " x ", None, None, 0)]
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in j.near_duplicates(frame(spark, rows)).collect()}
    assert got == {None: (None, 1, 0), 1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 0), 4: (4, 1, 0), 5: (5, 2, 1), 6: (5, 2, 1)}
    assert j.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minhash_agrees_with_similarity():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64) * np.uint64(2), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sig = j.minhashes(np.concatenate([shared, own[:100], shared, own[100:]]), np.array([0, 900, 1800]))
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12


def test_posterior_bound_is_the_binomial_tail():
    import math

    for n in (32, 160):
        m = j.least_matches(n, 0.8, 1e-6)
        tail = lambda m: sum(math.comb(n + 1, k) * .8 ** k * .2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(m) >= 1e-6 > tail(m - 1)


def test_both_ways_to_intersect_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 150).astype(np.uint64)) for _ in range(40)]
    left, right = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right)]
    assert j._common(sets, left, right).tolist() == want
    assert j._common(sets, left[:3], right[:3]).tolist() == want[:3]


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 150, 150: 150}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def template(n, seed=4):
    """Texts of which half the words come from one template: many shared bands, few links."""
    rng = np.random.default_rng(seed)
    page = [f"t{k}" for k in range(40)]
    out = []
    for i in range(n):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
        out.append(" ".join((page + own) if i % 9 else page + own[:3]))
    return out


def test_each_pair_that_shares_a_band_is_compared_once():
    import itertools

    from crease.llm.textops import split
    import pyarrow as pa

    _, values, offsets = j.grams(split(pa.array(template(300))))
    keys = j.band_keys(j.minhashes(values, offsets))
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if (keys[a] == keys[b]).any()}
    assert set(zip(*(x.tolist() for x in j.candidates(keys, keys, True, -1)))) == want
    met = []
    for band in range(j.BANDS):
        for key in np.unique(keys[:, band]):
            rows = np.flatnonzero(keys[:, band] == key)
            left, right = j.candidates(keys[rows], keys[rows], True, band)
            met += zip(rows[left].tolist(), rows[right].tolist())
    assert len(met) == len(set(met)) and set(met) == want
    assert len(want) < 300 * 299 / 4                     # the component has nearly all pairs


@pytest.mark.parametrize("chunk", [16, 1024])
def test_templates_equal_brute_force(spark, chunk):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(template(150) + family(30, 5))]
    rows += rows[3:6] + [(9, "another text under a known id", "en", "s", 0)]
    got = j.near_duplicates(frame(spark, rows), chunk=chunk)
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute(rows)
