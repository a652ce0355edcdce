"""Conversation structure repair: the cheapest edits that give a legal order of turns.

A repaired conversation is empty, or an optional system turn followed by one or
more pairs of a user and an assistant turn (role initials ``(s?(ua)+)?``).  Edits
of a row: keep it (0), rerole it to user or assistant (3), delete it (4; the only
edit of a blank or repeated row); a user or assistant turn without text may be
inserted anywhere (3); a truncated row that stays costs 3 more.  Of equally cheap
edits, those whose letters (D, I, K, R) come first in order are taken.

Method.  Rows are repartitioned by conversation and sorted by turn inside the
partition (a secondary sort, which spills), last turn first; ``mapInPandas`` then
reads each conversation as a stream that crosses Arrow batches.  What is carried
from row to row is the cost to finish from each of four states (nothing yet,
after s, after u, after a).  Each row leaves one byte of backpointers: the best
edit in each state, two bits a state.  Since costs run backwards, walking the
bytes forwards takes the least letter at every step, which is the least of all
cheapest edits.  Bytes and rows wait in blocks, which go to an unnamed temporary
file of the task once they exceed ``BLOCK_BYTES``, and come back in reverse; so a
conversation of any length takes a few blocks of memory.

Conversations differ in length, and one is read by one task, as its digest must
be; only the time of that task grows with the largest conversation.  Repeated
rows are found before, by Spark: first turns of the (conversation, role, text)
that occur more than once, aggregated on a 128-bit digest of the text.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import table

RETAG, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3          # costs
BLOCK_BYTES = 4 << 20
SPACE = " \t\n\x0b\x0c\r"

START, S, U, A = range(4)
FITS = {"s": ((START, S),), "u": ((START, U), (S, U), (A, U)), "a": ((U, A),)}     # kept rows: state before, after
NEXT = (U, U, A, U)                                    # state after a user or assistant turn of our choice
ROLE = {U: "user", A: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)                    # cost to finish without any row
LETTERS = "DIKR"

SUMMARY = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
ROWS = "conv string, place long, edit string, role string, text string"


@functools.cache
def step(go: tuple[int, ...], initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, ...], int, int]:
    """One row further to the front: (costs to finish by state, less their least;
    that least; backpointers).  ``go`` holds the costs behind the row."""
    stays = TRUNCATED * truncated
    keep = dict(FITS.get(initial, ()))
    best, letter = [], []
    for state in range(4):
        options = [(DELETE + go[state], "D")]
        if not must_go:
            if state in keep:
                options.append((stays + go[keep[state]], "K"))
            options.append((RETAG + stays + go[NEXT[state]], "R"))
        cost, edit = min(options)
        best.append(cost)
        letter.append(edit)
    for _ in range(3):                                 # inserting before the row
        for state in range(4):
            by_insert = (INSERT + best[NEXT[state]], "I")
            best[state], letter[state] = min((best[state], letter[state]), by_insert)
    least = min(best)
    return tuple(b - least for b in best), least, sum(LETTERS.index(x) << 2 * i for i, x in enumerate(letter))


class Conversation:
    """One conversation, read from its last row to its first."""

    def __init__(self, conv: str | None):
        self.conv = conv
        self.go, self.cost = AT_END, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.least = self.most = self.turn = None
        self.turns = 0
        self.ahead = None                              # initial of the row that follows
        self.pending = None                            # the latest row, until the one before it is known
        self.pointers, self.rows, self.size = bytearray(), [], 0
        self.file, self.blocks = None, []

    def add(self, turn: str | None, role: str, text: str, repeated: bool) -> None:
        """``repeated``: the same role and text stand in an earlier turn."""
        row = (turn, role, text)
        if self.pending is not None:
            self._take(*self.pending, again=self.pending[:3] == row)
        self.pending = (*row, repeated)

    def _take(self, turn, role, text, repeated, again) -> None:
        if turn is not None and turn != self.turn:     # turns come sorted
            value = int(turn)
            self.most = value if self.most is None else self.most
            self.turn, self.least, self.turns = turn, value, self.turns + 1
        said = text.rstrip(SPACE)
        blank, repeated = not said, repeated or again
        truncated = not blank and not repeated and said[-1] not in ".!?"
        for name, found in (("blank", blank), ("duplicate", repeated and not blank), ("truncated", truncated)):
            self.counts[name] += found
        initial = role[:1]
        if self.ahead is not None and initial + self.ahead not in ("su", "ua", "au"):
            self.illegal += 1
        self.ahead = initial
        self.go, least, pointer = step(self.go, initial if initial in FITS else "", blank or repeated, truncated)
        self.cost += least
        self.pointers.append(pointer)
        self.rows.append((role, text))
        self.size += len(role) + len(text) + 64
        if self.size > BLOCK_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.blocks.append(self.file.tell())
            pickle.dump((self.pointers, self.rows), self.file, protocol=5)
            self.pointers, self.rows, self.size = bytearray(), [], 0

    def close(self) -> None:
        """Call after the first row."""
        if self.pending is not None:
            self._take(*self.pending, again=False)
            self.pending = None

    def edits(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(letter, role, text) from the first row on; a deleted row has neither."""
        state = START
        blocks = [*self.blocks, None]
        while blocks:
            at = blocks.pop()
            if at is None:
                pointers, rows = self.pointers, self.rows
            else:
                self.file.seek(at)
                pointers, rows = pickle.load(self.file)
            for pointer, (role, text) in zip(reversed(pointers), reversed(rows)):
                while (letter := LETTERS[pointer >> 2 * state & 3]) == "I":
                    state = NEXT[state]
                    yield "I", ROLE[state], ""
                if letter == "D":
                    yield "D", None, None
                    continue
                if letter == "K":
                    state = dict(FITS[role[:1]])[state]
                else:
                    state = NEXT[state]
                    role = ROLE[state]
                yield letter, role, text
        while state in (S, U):
            state = NEXT[state]
            yield "I", ROLE[state], ""

    def summary(self) -> tuple:
        audit, digest, rest = [], hashlib.sha256(), b""
        for letter, role, text in self.edits():
            audit.append(letter)
            if letter != "D":
                digest.update(rest + f"{role}:{text}".encode())
                rest = b"\n"
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost + self.go[START], "".join(audit),
                digest.hexdigest())

    def repaired(self) -> Iterator[tuple]:
        place = 0
        for letter, role, text in self.edits():
            place += letter != "D"
            yield self.conv, place if letter != "D" else None, letter, role, text


def conversations(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Conversations of sorted rows, each as soon as its last row is read."""
    talk = None
    for batch in batches:
        for conv, turn, role, text, repeated in zip(*(batch[c] for c in ("conv", "turn", "role", "text", "repeated"))):
            if talk is None or conv != talk.conv:
                if talk is not None:
                    talk.close()
                    yield talk
                talk = Conversation(conv)
            talk.add(turn, role, text, repeated)
    if talk is not None:
        talk.close()
        yield talk


def _streamed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows under fixed names, repeated ones marked, each conversation in one
    partition and in reverse order.  Ids and turns travel as text (null stays
    null), as pandas has no integers beside nulls."""
    blank = F.lit(" ")
    plain = rows.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("at"),
                        F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))
    plain = plain.withColumn("digest", F.md5("text"))
    several = (plain.groupBy("conv", "role", "digest")
               .agg(F.count(F.lit(1)).alias("n"), F.count("at").alias("known"), F.min("at").alias("first"), F.max("at").alias("last"))
               .where((F.col("known") > 0) & ((F.col("known") < F.col("n")) | (F.col("first") < F.col("last"))))
               .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                       F.when(F.col("known") == F.col("n"), F.col("first")).alias("first")))
    same = (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("d").isNotNull() & F.col("at").isNotNull() & (F.col("first").isNull() | (F.col("at") > F.col("first")))
    marked = plain.join(several, same, "left").select("conv", "at", F.col("at").cast("string").alias("turn"), "role", "text",
                                                      F.coalesce(later, F.lit(False)).alias("repeated"))
    return (marked.repartition("conv")
            .sortWithinPartitions("conv", F.desc_nulls_last("at"), F.desc("role"), F.desc("text"))
            .select("conv", "turn", "role", "text", "repeated"))


def _in_frames(rows: Iterator[tuple], columns: list[str], limit: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > limit:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation of ``rows``: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first; rows of one turn by role, then
    text.  A null role or text counts as one space.  Rows with a null
    conversation id form one conversation.  Each row's first fault counts: blank
    (only white space), duplicate (role and text seen earlier in the
    conversation), truncated (the last character but white space is none of
    ``.!?``).  ``gaps`` are the numbers missing among the turns (nulls ignored),
    ``illegal`` the neighbouring rows whose role initials are not su, ua or au,
    ``cost`` and ``audit`` the cheapest edits (module docstring), and the digest
    is that of the repaired ``role:text`` lines.  No rows give no conversations.
    Other columns are not read.
    """
    def summaries(batches):
        yield from _in_frames((talk.summary() for talk in conversations(batches)), _columns(SUMMARY))

    done = _streamed(rows, conv_col, turn_col, role_col, text_col).mapInPandas(summaries, SUMMARY)
    return done.select(F.col("conv").cast(rows.schema[conv_col].dataType).alias("conv_id"), *_columns(SUMMARY)[1:])


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """The repaired conversations themselves: ``conv_id, place, edit, role,
    text``, one row per edit; deleted rows have an ``edit`` only.  Rows as in
    ``repair``."""
    def edited(batches):
        yield from _in_frames((row for talk in conversations(batches) for row in talk.repaired()), _columns(ROWS))

    done = _streamed(rows, conv_col, turn_col, role_col, text_col).mapInPandas(edited, ROWS)
    return done.select(F.col("conv").cast(rows.schema[conv_col].dataType).alias("conv_id"), *_columns(ROWS)[1:])


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows with planted faults, by crc32 of ``conv_id:turn``
    modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3
    repeats it, 4 makes it a user's.  Nulls read as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    kind = F.col("kind")
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
            .where(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every conversation, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations")
    done = repair(damaged(rows)).withColumnRenamed("conv_id", "found")
    every = rows.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("found")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql_min(*options: str) -> str:
    return f"least({', '.join(options)})"


def _sql_add(cost: int | str, letter: str, then: str) -> str:
    """A cost of eight digits and the letters behind it, so that texts compare as (cost, letters)."""
    return f"(printf('%08d', CAST(left({then}, 8) AS INT) + {cost}) || '{letter}' || substr({then}, 9))"


def _sql_consume(state: str, after: str, keeps: str) -> str:
    """The best of deleting, keeping and reroling row x in a state; ``keeps`` maps initials to later states."""
    kept = " ".join(f"WHEN '{i}' THEN {_sql_add('x.stays', 'K', f'c.{to}')}" for i, to in
                    (pair.split(">") for pair in keeps.split()))
    delete = _sql_add(DELETE, "D", f"c.{state}")
    retag = _sql_add(f"{RETAG} + x.stays", "R", f"c.{after}")
    return (f"CASE WHEN x.must_go THEN {delete} ELSE "
            + _sql_min(delete, retag, f"coalesce(CASE x.initial {kept} END, {retag})") + " END")


ORACLE_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT b, list_reduce(list_concat([b], CAST(range(8) AS BIGINT[])), lambda x, i:
           CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT key, 0 AS p, CAST(4294967295 AS BIGINT) AS x FROM keys
  UNION ALL
  SELECT key, p + 1, xor(x >> 8, v) FROM crc JOIN crc_table ON b = xor(x & 255, ascii(substr(key, p + 1, 1))) WHERE p < length(key)),
kinds AS (SELECT key, xor(x, 4294967295) % 20 AS kind FROM crc WHERE p = length(key)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
              ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations JOIN kinds
    ON key = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')
  WHERE kind <> 0),
convs AS (SELECT row_number() OVER () AS conv, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (
  SELECT c.conv, d.turn, d.role, d.text, row_number() OVER (PARTITION BY c.conv ORDER BY d.turn NULLS FIRST, d.role, d.text) AS i
  FROM damaged d JOIN convs c ON c.conv_id IS NOT DISTINCT FROM d.conv_id),
said AS (
  SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before
  FROM numbered),
judged AS (
  SELECT *, last_char = '' AS is_blank, last_char <> '' AND seen AS is_dup,
         last_char <> '' AND NOT seen AND last_char NOT IN ('.', '!', '?') AS is_trunc
  FROM said),
ready AS (SELECT *, is_blank OR is_dup AS must_go, CASE WHEN is_trunc THEN {TRUNCATED} ELSE 0 END AS stays FROM judged),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(is_blank) AS blank,
         count_if(is_dup) AS duplicate, count_if(is_trunc) AS truncated,
         count_if(i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM ready GROUP BY conv),
costs AS (
  SELECT conv, n AS i, '00000000' AS e, '00000006II' AS s, '00000003I' AS u, '00000000' AS a FROM counts
  UNION ALL
  SELECT conv, i, {_sql_min('e', _sql_add(INSERT, 'I', 'u1'))}, {_sql_min('s', _sql_add(INSERT, 'I', 'u1'))}, u1,
         {_sql_min('a', _sql_add(INSERT, 'I', 'u'))}
  FROM (
    SELECT *, {_sql_min('u', _sql_add(INSERT, 'I', 'a'))} AS u1
    FROM (
      SELECT c.conv, c.i - 1 AS i, {_sql_consume('e', 'u', 's>s u>u')} AS e, {_sql_consume('s', 'u', 'u>u')} AS s,
             {_sql_consume('u', 'a', 'a>a')} AS u, {_sql_consume('a', 'u', 'u>u')} AS a
      FROM costs c JOIN ready x ON x.conv = c.conv AND x.i = c.i))),
solved AS (SELECT conv, CAST(left(e, 8) AS BIGINT) AS cost, substr(e, 9) AS audit FROM costs WHERE i = 0),
letters AS (SELECT conv, audit, p, substr(audit, p, 1) AS letter FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS p FROM solved)),
placed AS (
  SELECT *, count_if(letter <> 'I') OVER (PARTITION BY conv ORDER BY p) AS i,
         count_if(letter <> 'D') OVER (PARTITION BY conv ORDER BY p) AS m, count_if(letter <> 'D') OVER (PARTITION BY conv) AS total
  FROM letters),
lines AS (
  SELECT l.conv, l.p, CASE WHEN letter = 'K' THEN x.role WHEN (m + total) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN letter = 'I' THEN '' ELSE x.text END AS line
  FROM placed l LEFT JOIN ready x ON x.conv = l.conv AND x.i = l.i WHERE letter <> 'D'),
texts AS (SELECT conv, string_agg(line, chr(10) ORDER BY p) AS repaired FROM lines GROUP BY conv)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM convs v LEFT JOIN counts USING (conv) LEFT JOIN solved USING (conv) LEFT JOIN texts USING (conv)
"""
