"""Conversation repair against every sequence of edits, and against plain Python on whole tables."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crease.llm import conversation_repair as cr

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """blank / duplicate / truncated / '' of sorted (role, text) rows."""
    seen, out = set(), []
    for role, text in rows:
        said = NOT_SPACE.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by trying every sequence of edits in the order of cost, then letters."""
    fault = faults(rows)

    @functools.cache
    def solve(i, emitted, began):        # began: '' nothing, else the initial of the last emitted
        options = []
        if i == len(rows):
            if began in ("", "a"):
                options.append((0, "", ()))
        if emitted < 2 * len(rows) + 4:
            for new, role in (("u", "user"), ("a", "assistant")):
                if began + new in ("u", "su", "ua", "au"):
                    cost, audit, lines = solve(i, emitted + 1, new)
                    options.append((cost + 3, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            (role, text), more = rows[i], 3 * (fault[i] == "truncated")
            cost, audit, lines = solve(i + 1, emitted, began)
            options.append((cost + 4, "D" + audit, lines))
            if fault[i] not in ("blank", "duplicate"):
                for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    new = name[:1]
                    if new and began + new in ("s", "u", "su", "ua", "au"):
                        cost, audit, lines = solve(i + 1, emitted + 1, new)
                        options.append((cost + price + more, letter + audit, (f"{name}:{text}", *lines)))
        return min(options, default=(10 ** 9, "", ()), key=lambda o: o[:2])

    return solve(0, 0, "")


def expected(rows):
    """Digest columns of one conversation of (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, *_ in rows if t is not None}
    plain = [r[1:] for r in rows]
    count = Counter(faults(plain))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
    cost, audit, lines = cheapest(tuple(plain))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(spark, rows):
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(frame(spark, rows)).collect()}
    assert got == {conv: expected(own) for conv, own in by_conversation(rows).items()}


def random_rows(seed, n=150):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "agent"]
    texts = ["Hello.", "Why?", "no stop", "", " \n", None, "Yes!  ", "é", "Hello.", "Go.", "a.\t"]
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            t = turn if rng.random() < 0.8 else rng.choice([None, 2, 30])
            rows += [(conv if conv % 40 else None, t, role, rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_every_sequence_of_edits(spark, seed):
    check(spark, random_rows(seed))


def test_state_crosses_arrow_batches(spark):
    rows = [(r[0] % 3 if r[0] else None, *r[1:]) for r in random_rows(7, 40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_giant_conversation_spills_and_equals_the_same_in_memory(monkeypatch):
    rng = random.Random(1)
    rows = [(str(t), rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "and", "", f"line {t}."])) for t in range(3000)]

    def run(limit):
        monkeypatch.setattr(cr, "BLOCK_BYTES", limit)
        talk, seen = cr.Conversation("1"), set()
        again = []
        for r in rows:
            again.append(r[1:] in seen)
            seen.add(r[1:])
        for (turn, role, text), repeated in zip(reversed(rows), reversed(again)):
            talk.add(turn, role, text, repeated)
        talk.close()
        return talk, talk.summary()

    talk, spilled = run(2_000)
    assert len(talk.blocks) > 50 and talk.file is not None
    kept, whole = run(1 << 30)
    assert not kept.blocks and spilled == whole
    letters = Counter(whole[7])
    assert letters["K"] + letters["D"] + letters["R"] == len(rows)


def test_edge_conversations(spark):
    long = "word " * 200_000 + "end."
    check(spark, [
        (1, 0, "user", ""), (1, 1, "assistant", " "),                               # all blank: nothing stays
        (2, 0, "system", "Be kind."),                                               # system alone is not legal
        (3, None, None, None), (3, None, "user", "Hi."), (3, 5, "assistant", "Yo."),
        (4, 0, "user", long), (4, 1, "assistant", long), (4, 1, "assistant", long), (4, 7, "user", long),
        (5, -3, "assistant", "x"), (5, 9, "system", "y."),
        (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, 9, "user", "Hi."),
    ])


def test_a_third_of_all_rows_are_one_row(spark):
    rows = [(0, t, "user", "Same.") for t in range(120)] + [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(1, 40) for t in range(6)]
    check(spark, rows)


def test_empty_table_clashing_names_and_repaired_rows(spark):
    assert cr.repair(frame(spark, [])).collect() == []
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", ""), (1, 2, "user", "Why")]
    more = frame(spark, rows)
    for name in ("conv", "at", "digest", "repeated", "c", "r", "d", "n", "first", "audit", "cost", "place", "edit"):
        more = more.withColumn(name, F.lit(1))
    assert [tuple(r)[1:] for r in cr.repair(more).collect()] == [expected([r[1:] for r in rows])]
    edits = cr.repaired_rows(more).collect()
    assert "".join(r.edit for r in edits) == expected([r[1:] for r in rows])[6]
    assert [(r.place, r.role, r.text) for r in edits if r.edit != "D"] == [
        (i + 1, *line.split(":", 1)) for i, line in enumerate(cheapest(tuple(r[2:] for r in rows))[2])]


def test_registered_query_on_the_whole_table(spark):
    folder, kept, convs = "/root/testdata/sf0.001", [], set()
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        convs.add(r.conv_id)
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = r.role if kind != 4 else "user", r.text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(r.conv_id, r.turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {c: expected(by_conversation(kept).get(c, [])) for c in convs}
    assert {r.conv_id: tuple(r)[1:] for r in cr.query(spark, folder).collect()} == want


def test_damage_reads_nulls_as_spaces_and_keeps_emptied_conversations(spark, tmp_path):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None), (gone, 0, "user", "Hi.")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in cr.query(spark, str(tmp_path)).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert zlib.crc32(b" : ") % 20 not in (0, 3, 4) and got[None] == expected([(None, None, " ")])
