"""Packing: whole pieces, full windows, target proportions at every window."""

import itertools
import zlib

import numpy as np
import pytest

from crease.llm import packing as p
from crease.llm.sources import tokenizer_path

from .helpers import SCHEMA, corpus, frame

PATH = tokenizer_path("byte_bpe_50k.json")


def true_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]


@pytest.mark.parametrize("targets, length", [(None, 2048), (None, 64), ({"s0": 3.0, "s1": 1.0}, 128)])
def test_every_id_is_in_one_piece(spark, targets, length):
    rows = corpus()[:-1]
    got = p.pack(frame(spark, rows).repartition(3), PATH, targets=targets, length=length).collect()
    want = dict(true_ids(rows))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = np.array(want[i][r.start:r.start + r.length], "<u4")
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want[i])
    total = sum(map(len, want.values()))
    assert sorted(by_seq) == list(range(-(-total // length)))
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or s == max(by_seq)


@pytest.mark.parametrize("quantum", [1, 40])
def test_each_window_meets_the_target_within_a_quantum(spark, quantum):
    rows = corpus()[:-1]
    got = p.pack(frame(spark, rows), PATH, length=256, quantum=quantum).collect()
    total = sum(r.length for r in got)
    share = {}
    for r in got:
        share[r.source] = share.get(r.source, 0) + r.length / total
    for last in range(1, max(r.sequence_id for r in got)):
        for source, part in share.items():
            served = sum(r.length for r in got if r.sequence_id < last and r.source == source)
            assert abs(served - part * 256 * last) <= quantum * (1 + len(share) * part)


def test_served_counts_and_ranks_agree_with_a_simulation():
    totals = np.array([50, 7, 7, 120, 1])
    for rates, quantum in itertools.product((totals.astype(float), totals ** 0.7, np.array([1.0, 1.0, 2.0, 3.0, 0.5])),
                                            (1, 3, 7, 64)):
        order = sorted((min((k // quantum + 1) * quantum, totals[q]) / rates[q], q, k)
                       for q in range(5) for k in range(totals[q]))
        want = np.zeros((len(order) + 1, 5), int)
        for n, (_, q, _) in enumerate(order):
            want[n + 1] = want[n]
            want[n + 1, q] += 1
        assert (p.served(np.arange(len(order) + 1), totals, rates, quantum) == want).all()
        for q in range(5):
            ranks = [n for n, x in enumerate(order) if x[1] == q]
            assert p.rank_of(q, np.arange(totals[q]), totals, rates, quantum).tolist() == ranks


def round_robin(totals, shares, quantum):
    """Deficit round robin, quantum by quantum: the queue that is owed most first."""
    left, spent = list(totals), [0] * len(totals)
    while any(left):
        q = min((q for q in range(len(totals)) if left[q]),
                key=lambda q: (min(spent[q] + quantum, totals[q]) / shares[q], q))
        step = min(quantum, left[q])
        left[q], spent[q] = left[q] - step, spent[q] + step
        yield q, step


def test_the_query_is_the_plain_round_robin_with_its_own_mixture(spark):
    """The registered query on sf0.001, against tokenising and serving everything here."""
    d = "/root/testdata/sf0.001"
    got = p.query(spark, d).collect()
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    ids, source = dict(true_ids(rows)), {r[0]: r[2] for r in rows}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(ids)
    for i, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and zlib.crc32(np.array(ids[i][at:at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i]) == mine[0].doc_tokens
    names = sorted(set(source.values()))
    totals = [sum(len(ids[i]) for i in ids if source[i] == s) for s in names]
    want, at = {}, 0
    for q, step in round_robin(totals, [t ** p.TEMPER for t in totals], p.QUANTUM):
        while step:
            here = min(step, p.LENGTH - at % p.LENGTH)
            want[at // p.LENGTH, names[q]] = want.get((at // p.LENGTH, names[q]), 0) + here
            at, step = at + here, step - here
    served = {}
    for r in got:
        key = r.sequence_id, source[r.doc_id]
        served[key] = served.get(key, 0) + r.length
    assert served == want
    assert np.median([r.length for r in got if r.doc_tokens >= 2 * p.QUANTUM]) >= p.QUANTUM / 2


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b", None, None, 0), (1, "a b", None, "x", 0), (1, "a b", None, "x", 0), (2, None, None, "y", 0)]
    got = p.pack(frame(spark, rows), PATH, length=4).collect()
    assert sum(r.length for r in got) == 3 * 3 + 1
    assert p.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_more_sources_than_queues_pool_the_rest(spark, monkeypatch):
    monkeypatch.setattr(p, "MAX_QUEUES", 2)
    rows = corpus()[:-1]
    got = p.pack(frame(spark, rows), PATH, length=128).collect()
    assert sum(r.length for r in got) == sum(len(i) for _, i in true_ids(rows))


@pytest.mark.parametrize("weight", [0, 0.0, -1.0, float("nan"), float("inf")])
def test_weights_that_would_lose_documents_are_refused_by_name(spark, weight):
    with pytest.raises(ValueError, match="s1"):
        p.pack(frame(spark), PATH, targets={"s0": 1.0, "s1": weight})


@pytest.mark.parametrize("targets", [{}, {"nowhere": 2.0}, {"s0": 1e-6, "nowhere": 5.0}, {"s0": 1e6}])
def test_absent_empty_and_extreme_targets_lose_no_id(spark, targets):
    rows = corpus()[:-1]
    got = p.pack(frame(spark, rows), PATH, targets=targets, length=128).collect()
    assert sum(r.length for r in got) == sum(len(i) for _, i in true_ids(rows))
    assert len({(r.doc_id, r.start) for r in got}) == len(got)
