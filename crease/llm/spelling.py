"""Spelling variant grouping: words one edit apart, by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols (code point modulo 7).  One edit of a
word is one edit of its reduced word, or none, so the near words of a word are
among the words whose reduced word lies in the full one-edit neighbourhood
(itself, every deletion, replacement and insertion) of its own.  With few
symbols that neighbourhood is small (about 120 reduced words at 8 letters,
against 1,500 words over 90 letters).  Neighbourhoods are generated once for
each *reduced* word, joined to the reduced vocabulary, and the original words
behind each met pair are compared (``levenshtein``).

Reduced words and their edits are rolling 64-bit hashes: from the prefix sums
of a word every edit takes a few operations, whatever the word's length, and
edits leave a task in batches of bounded size, so a word of a million letters
needs no more memory than many short ones.  Equal hashes of different reduced
words only add pairs to compare.

A reduced word that more than ``BUCKET`` words share would make many pairs.
Its words take another way, of bounded work for each word: their neighbourhood
over the letters themselves is joined to the vocabulary.  Both ways are exact,
together they find every pair, and none compares all pairs of a group beyond
``BUCKET`` words.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lower_ascii
from .sources import stored, table
from .textops import mix

SYMBOLS = 7
BUCKET = 64             # words of one reduced word that are compared with each other
MIN_CHARS = 6
MIN_COUNT = 5
FORM_RATIO = 5          # a form is so many times as frequent as its variant
DAMAGE = 199            # one run in so many loses a letter in op11

RUN = "[a-zÀ-ÿ]+"     # of a text whose A-Z are lower-cased
BATCH_LETTERS = 20_000
BATCH_ROWS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def letter_runs(text: Column) -> Column:
    """Maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(RUN), F.lit(0))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of a column ``word``: words of ``min_chars`` code points and
    ``min_count`` occurrences at least.  Null words do not count."""
    return (words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


# ---- reduced words and their edits, as hashes --------------------------------------------------

def _slices(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of ``BATCH_LETTERS`` letters (one word at least)."""
    ends = np.cumsum([len(w) for w in words])
    lo = 0
    while lo < len(words):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BATCH_LETTERS, "right")))
        yield lo, hi
        lo = hi


class _Rolling:
    """Prefix sums of some words' symbols; the words lie one after the other."""

    def __init__(self, words: list[str], symbols: int | None):
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.symbol = points % np.uint64(symbols) + np.uint64(1) if symbols else points
        size = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        n = len(points)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, _BASE)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(self.symbol * self.power[:n], dtype=np.uint64)])
        self.shift = back[self.start]                       # brings a word's first letter to power 0
        self.last = np.ones(n, bool)                        # the next letter is another symbol or word
        self.last[:-1] = self.symbol[:-1] != self.symbol[1:]
        self.last[self.end[size > 0] - 1] = True

    def whole(self) -> np.ndarray:
        return mix((self.total[self.end] - self.total[self.start]) * self.shift)

    def edits(self, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, hash) of every word that is one edit away, each once, in batches."""
        n, step = len(self.symbol), max(1, BATCH_ROWS // (2 * len(alphabet) + 1))
        owner = np.repeat(np.arange(len(self.start)), self.end - self.start)
        for lo in range(0, n, step):
            at = np.arange(lo, min(n, lo + step))
            w = owner[at]
            head, tail = self.total[at] - self.total[self.start[w]], self.total[self.end[w]] - self.total[at + 1]
            here = self.symbol[at] * self.power[at]
            cut = self.last[at]                             # deleting any letter of a run is the same
            words, hashes = [w[cut]], [(head + tail * _INVERSE)[cut] * self.shift[w[cut]]]
            for c in alphabet:
                other = self.symbol[at] != c                # before an equal letter, inserting is the same as after it
                v = w[other]
                put = c * self.power[at[other]]
                words += [v, v]
                hashes += [(head + tail)[other] * self.shift[v] + put * self.shift[v],
                           (head[other] + put + (here + tail)[other] * _BASE) * self.shift[v]]
            yield np.concatenate(words), mix(np.concatenate(hashes))
        whole = self.total[self.end] - self.total[self.start]
        step = max(1, BATCH_ROWS // len(alphabet))
        for lo in range(0, len(whole), step):               # insertions at the end
            w = np.arange(lo, min(len(whole), lo + step))
            for c in alphabet:
                yield w, mix((whole[w] + c * self.power[self.end[w]]) * self.shift[w])


def _longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _coded(vocab: DataFrame, symbols: int) -> DataFrame:
    """``vocab`` with ``reduced`` and ``code``: hashes of the reduced word and of the word."""
    def add(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            parts = [[_Rolling(words[lo:hi], s).whole() for lo, hi in _slices(words)] for s in (symbols, None)]
            reduced, code = (np.concatenate([np.zeros(0, np.uint64), *p]) for p in parts)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), _longs(reduced), _longs(code)],
                                             names=["word", "n", "reduced", "code"])

    return vocab.mapInArrow(add, "word string, n long, reduced long, code long")


def _neighbourhood(words: DataFrame, alphabet: list[int], symbols: int | None, itself: bool) -> DataFrame:
    """``source, code``: for each ``word`` with its ``source``, the hashes of its one-edit neighbourhood."""
    letters = np.array(alphabet, np.uint64)

    def generate(batches):
        for batch in batches:
            texts, source = batch.column("word").to_pylist(), batch.column("source").to_numpy()
            for lo, hi in _slices(texts):
                rolling, own = _Rolling(texts[lo:hi], symbols), source[lo:hi]
                more = [(np.arange(hi - lo), rolling.whole())] if itself else []
                for w, h in itertools.chain(more, rolling.edits(letters)):
                    yield pa.RecordBatch.from_arrays([pa.array(own[w], pa.int64()), _longs(h)], names=["source", "code"])

    return words.select("word", "source").mapInArrow(generate, "source long, code long")


# ---- the operator -------------------------------------------------------------------------------

def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words of ``vocab`` (``word``
    unique, ``n``) that differ by exactly one inserted, deleted or replaced code
    point.  No pair is left out, however many words share a reduced word."""
    coded = stored(_coded(vocab, symbols), "coded_words")
    sizes = stored(coded.groupBy("reduced").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("word")), "reduced_words")
    few, many = sizes.where(F.col("size") <= bucket), sizes.where(F.col("size") > bucket)

    # few words behind both reduced words: reduced neighbourhoods, joined to the reduced vocabulary
    edges = _neighbourhood(few.withColumnRenamed("reduced", "source"), list(range(1, symbols + 1)), symbols, itself=True)
    met = edges.join(few.select(F.col("reduced").alias("code")), "code")
    left = coded.select(F.col("reduced").alias("source"), F.col("word").alias("word"))
    right = coded.select(F.col("reduced").alias("code"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = F.levenshtein("word", "near", 1) == 1
    pairs = met.join(left, "source").join(right, "code").where(one_edit).select("word", "near", "near_n")

    # a hot reduced word: its words' neighbourhoods over the letters, joined to the vocabulary
    letters = [ord(r[0]) for r in coded.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]]
    hot = coded.join(many.select("reduced"), "reduced", "left_semi")
    around = _neighbourhood(hot.withColumnRenamed("code", "source"), letters or [1], None, itself=False)
    hot_words = hot.select(F.col("code").alias("source"), F.col("word").alias("word"), F.col("n").alias("n"))
    all_words = coded.select("code", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("reduced").alias("near_reduced"))
    far = around.join(all_words, "code").join(hot_words, "source").where(one_edit)
    back = (far.join(many.select(F.col("reduced").alias("near_reduced")), "near_reduced", "left_anti")
            .select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.unionByName(far.select("word", "near", "near_n")).unionByName(back).distinct()


def follow(links: DataFrame, depth: int) -> DataFrame:
    """``word, root`` of ``word, root`` links without cycles, of chains of at
    most ``depth`` links: each round doubles the length of the followed chains."""
    links = stored(links, "links")
    for _ in range(max(0, math.ceil(math.log2(max(1, depth))))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return links


def group_variants(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO,
                   symbols: int = SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """Groups of spelling variants among the values of a column ``word``.

    One row per word of the vocabulary: ``word, form, root, n, n_near, form_n``.
    Its form is its near word (one edit away) with the largest ``n`` (of equals,
    the smallest in code-point order), if that is ``ratio`` times its own ``n``
    at least, else null; its root is the last form of its chain of forms (the
    word itself if it has none).  Rows of equal root are one group.  Counts rise
    by ``ratio`` along a chain, so chains are short and have no cycles; ``ratio``
    is 2 at least.  Null words do not count; no words give no rows.
    """
    if ratio < 2:
        raise ValueError(f"ratio is 2 or more, not {ratio}")
    vocab = stored(vocabulary(words, min_chars, min_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(vocab, symbols, bucket).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    formed = stored(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n")), "forms")
    most, least = vocab.agg(F.max("n"), F.min("n")).first()
    depth = int(math.log(most / least, ratio) + 1e-9) if most else 0
    roots = follow(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), depth)
    return (formed.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = DAMAGE) -> DataFrame:
    """``word``: the letter runs of ``docs``, of which one in ``one_in`` (by the
    crc32 h of ``<id>:<run>``) loses its letter ``h % length``.  A null id
    damages nothing; null texts have no runs.  Runs too short to count are left
    out early."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(letter_runs(F.col(text_col))).alias("run"))
    runs = runs.where(F.char_length("run") >= MIN_CHARS)
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return (runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
            .select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every frequent word, with its form and the root of its group."""
    return group_variants(damaged_words(table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
keyed AS (SELECT CAST(doc_id AS VARCHAR) || ':' || run AS key, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
crc_table AS (
  SELECT b, list_reduce(list_concat([b], CAST(range(8) AS BIGINT[])), lambda x, i:
           CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS b)),
bytes AS (
  SELECT key, run, c, list_reduce(list_concat([[]], list_transform(string_split(key, ''), lambda ch:
           CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) - 64 AS BIGINT)] END)),
           lambda x, y: list_concat(x, y)) AS bs
  FROM (SELECT DISTINCT key, run, c FROM keyed WHERE key IS NOT NULL)),
crc AS (
  SELECT key, run, c, bs, 0 AS p, CAST(4294967295 AS BIGINT) AS x FROM bytes
  UNION ALL
  SELECT key, run, c, bs, p + 1, xor(x >> 8, v) FROM crc JOIN crc_table ON b = xor(x & 255, bs[p + 1]) WHERE p < len(bs)),
hashed AS (SELECT run, c, xor(x, 4294967295) AS h FROM crc WHERE p = len(bs)
           UNION ALL SELECT run, c, 1 FROM keyed WHERE key IS NULL),
damaged AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
              ELSE run END AS word, c FROM hashed),
vocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM gaps),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN vocab b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN vocab b ON a.cut = b.word),
near AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM pairs GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(x.n_near, 0) AS n_near,
         (SELECT min(p.near) FROM pairs p WHERE p.word = v.word AND p.near_n = x.best_n AND x.best_n >= 5 * v.n) AS form,
         CASE WHEN x.best_n >= 5 * v.n THEN x.best_n END AS form_n
  FROM vocab v LEFT JOIN near x USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
