"""N-gram Jaccard self-join with Bayesian candidate pruning (BayesLSH).

Texts are sets of word 5-grams (a text of 1-4 words is one gram; an empty text
has none and links to nothing).  Links: Jaccard similarity >= ``threshold``.

1. One narrow pass makes each text's key (hash of its word sequence) and the
   keys of ``BANDS`` bands of ``ROWS`` MinHash values.  Copies fold into one
   text class, named by its smallest document id.
2. Classes that share a band are candidates (two texts at 0.8 share none with
   probability (1 - 0.8**ROWS)**BANDS = 3e-6); no other pair is compared.  Each
   class is tied to the smallest class of its bands; components of these ties
   of at most ``CHUNK`` texts meet in one task, texts and all.
3. The texts of larger components (site templates tie millions together) meet
   by band instead: a band's texts are a bucket, a bucket of more than ``CHUNK``
   texts is cut into chunks, and every pair of chunks is a task.  A pair belongs
   to the first band it shares, so it is compared once.  Signatures travel
   first; texts follow only where one has a candidate left.
4. A task compares MinHash values ``STEP`` at a time and drops a pair as soon as
   P(similarity >= threshold | matches), under a uniform prior, falls below
   ``TOLERANCE``; the rest is verified on the exact gram sets.  A task returns
   link counts and a spanning forest -- one row per text, never the pairs.
5. Components of the verified forest are the near-duplicate classes.

Texts and grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .sources import stored
from .textops import Split, _power_tables, mix, row_slices, split, windows

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-6
CHUNK = 1024
PACK = 512              # texts of small groups that share a task's group

_rng = np.random.default_rng(20240501)
_MUL = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def sequence_keys(s: Split) -> np.ndarray:
    """Hash of each text's whole word sequence (0 words: a fixed value)."""
    power, inverse = _power_tables(len(s.hash) + 1)
    total = np.zeros(len(s.hash) + 1, np.uint64)
    np.cumsum(s.hash * power[: len(s.hash)], out=total[1:])
    lo, hi = s.offsets[:-1], s.offsets[1:]
    return mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def grams(s: Split, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, gram hashes, offsets) of the texts; grams may repeat."""
    keys = sequence_keys(s)
    at, h = windows(s.hash, s.offsets, width)
    n = np.diff(s.offsets)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.uint64)
    long = np.repeat(n >= width, counts)
    out[long] = h
    out[~long] = keys[(n > 0) & (n < width)]
    return keys, out, offsets


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, HASHES) MinHash values; texts without grams get the largest value."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.full((HASHES, len(offsets) - 1), 0xFFFFFFFF, np.uint32)
    if len(full):
        x = (values >> np.uint64(32)).astype(np.uint32)
        starts = offsets[:-1][full]
        for k in range(HASHES):
            out[k, full] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts)
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys; a key includes its band's number."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k].astype(np.uint64))
        out[:, b] = key
    return out


@functools.cache
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest matches of ``compared`` that keep a pair: with a uniform prior
    P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    p, n = 0.0, compared + 1
    for m in range(n + 1):
        p += math.comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if p >= tolerance:
            return m
    return n


def _sketch(batches):
    for b in batches:
        texts = b.column(1)
        for lo, hi in row_slices(texts):
            s = split(texts.slice(lo, hi - lo))
            keys, values, offsets = grams(s)
            bands = band_keys(minhashes(values, offsets)).view(np.int64).ravel()
            empty = np.diff(s.offsets) == 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(keys.view(np.int64), mask=empty),
                 pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands))],
                ["id", "key", "bands"])


def candidates(a: np.ndarray, b: np.ndarray, same: bool, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) of texts, given by their band keys, that
    share a band; for a bucket of band ``band`` (not -1) those that share it and
    none before it.  ``same``: a and b are the same texts, each pair counts once."""
    if band >= 0:
        shares = a[:, band, None] == b[None, :, band]
        for k in range(band):
            shares &= a[:, k, None] != b[None, :, k]
    else:
        shares = np.zeros((len(a), len(b)), bool)
        for k in range(a.shape[1]):
            shares |= a[:, k, None] == b[None, :, k]
    return np.nonzero(np.triu(shares, 1) if same else shares)


def _survivors(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float):
    """The pairs (row of a, row of b) that incremental MinHash comparison keeps."""
    matches = np.zeros(len(left), np.int32)
    for k in range(0, HASHES, STEP):
        for lo in range(0, len(left), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            matches[part] += (a[left[part], k:k + STEP] == b[right[part], k:k + STEP]).sum(1)
        keep = matches >= least_matches(k + STEP, threshold, tolerance)
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def _meetings(table: pa.Table):
    """(first row, end, chunk a, chunk b, band) of each pair of chunks of a sorted table."""
    group, i, j, band = (table[c].to_numpy() for c in ("group", "i", "j", "band"))
    if not len(group):
        return
    new = (group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (band[1:] != band[:-1])
    head = np.flatnonzero(np.concatenate([[True], new]))
    for lo, hi in zip(head, [*head[1:], len(group)]):
        yield lo, hi, i[lo], j[lo], int(band[lo])


def _pairs(rows: np.ndarray, chunk: np.ndarray, i, j, band: int, sigs: np.ndarray, threshold: float, tolerance: float):
    """Surviving pairs (places in ``rows``) of a meeting of the texts ``rows``."""
    same = i == j
    a = rows if same else rows[chunk[rows] == i]
    b = rows if same else rows[chunk[rows] == j]
    keys = band_keys(sigs[a])
    left, right = candidates(keys, keys if same else band_keys(sigs[b]), same, band)
    left, right = _survivors(sigs[a], sigs[b], left, right, threshold, tolerance)
    return np.searchsorted(rows, a[left]), np.searchsorted(rows, b[right])


_SORT = [(c, "ascending") for c in ("group", "band", "i", "j", "node")]


def _signatures(batches):
    """(node, sig, bands) of the rows whose text is its class's."""
    for b in batches:
        texts, node = b.column(1), b.column(0).to_numpy()
        for lo, hi in row_slices(texts):
            keys, values, offsets = grams(split(texts.slice(lo, hi - lo)))
            at = np.flatnonzero(keys.view(np.int64) == node[lo:hi])
            sigs = minhashes(values, offsets)[at]
            bands = band_keys(sigs).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[lo:hi][at]), pa.array([x.astype("<u4").tobytes() for x in sigs], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(bands))],
                ["node", "sig", "bands"])


def _promising(threshold: float, tolerance: float):
    """The texts of each meeting that keep a pair, by their signatures."""
    def survive(key, table):
        table = table.sort_by(_SORT)
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(-1, HASHES)
        chunk, kept = table["chunk"].to_numpy(), [np.zeros(0, np.int64)]
        for lo, hi, i, j, band in _meetings(table):
            rows = np.arange(lo, hi)
            kept.append(rows[np.unique(np.concatenate(_pairs(rows, chunk, i, j, band, sigs, threshold, tolerance)))])
        return table.drop_columns(["sig"]).take(pa.array(np.concatenate(kept)))

    return survive


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    size = np.array([len(x) for x in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), size)
    shared = np.flatnonzero(counts > 1)
    one_by_one = 3e-8 * (size[left] + size[right]).sum() + 1e-5 * len(left)
    if len(sets) < 8 or one_by_one < 2e-10 * len(sets) ** 2 * len(shared):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], int)
    place = np.full(len(counts), -1)
    place[shared] = np.arange(len(shared))
    col = place[inverse]
    rows, col = rows[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = 2048
    for lo in range(0, len(shared), step):
        a, b = np.searchsorted(col, [lo, lo + step])
        has = np.zeros((len(sets), step), np.float32)
        has[rows[a:b], col[a:b] - lo] = 1
        both += has @ has.T
    return both[left, right].astype(int)


def _verified(threshold: float, tolerance: float):
    def verify(key, table):
        table = table.sort_by(_SORT)
        chunk, node, copies = (table[c].to_numpy() for c in ("chunk", "node", "copies"))
        texts = table["text"].combine_chunks()
        keys, sigs, sets = [], [], []
        for lo, hi in row_slices(texts):
            k, values, offsets = grams(split(texts.slice(lo, hi - lo)))
            keys.append(k.view(np.int64))
            sigs.append(minhashes(values, offsets))
            sets += [np.unique(values[x:y]) for x, y in zip(offsets[:-1], offsets[1:])]
        keys, sigs = np.concatenate(keys), np.concatenate(sigs)
        out = {"node": [], "texts": [], "docs": [], "parent": []}
        for lo, hi, i, j, band in _meetings(table):
            rows = np.arange(lo, hi)
            rows = rows[keys[lo:hi] == node[lo:hi]]            # rows that share an id with the class's document
            rows = rows[np.concatenate([[True], node[rows][1:] != node[rows][:-1]])] if len(rows) else rows
            left, right = _pairs(rows, chunk, i, j, band, sigs, threshold, tolerance)
            if not len(left):
                continue
            own = [sets[r] for r in rows]
            common = _common(own, left, right)
            size = np.array([len(x) for x in own])
            linked = common / (size[left] + size[right] - common) >= threshold
            left, right = left[linked], right[linked]
            name, weight = node[rows], copies[rows]
            label = np.arange(len(rows))
            while True:
                low = np.minimum(label[left], label[right])
                new = label.copy()
                np.minimum.at(new, left, low)
                np.minimum.at(new, right, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            texts_n = np.bincount(left, minlength=len(rows)) + np.bincount(right, minlength=len(rows))
            docs_n = (np.bincount(left, weight[right], len(rows)) + np.bincount(right, weight[left], len(rows)))
            hit = np.flatnonzero(texts_n)
            for c, v in (("node", name[hit]), ("texts", texts_n[hit]), ("docs", docs_n[hit]), ("parent", name[label[hit]])):
                out[c].append(v.astype(np.int64))
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return verify


_LINKS = "node long, texts long, docs long, parent long"


def _by_band(texts: DataFrame, threshold: float, tolerance: float, chunk: int) -> DataFrame:
    """Links among ``texts`` (node, copies, text) whose groups are too large for a task."""
    signed = stored(texts.select("node", "text").mapInArrow(_signatures, "node long, sig binary, bands array<long>")
                    .dropDuplicates(["node"]), "signed")
    member = signed.select("node", F.posexplode("bands").alias("band", "group"))
    buckets = stored(member.groupBy("group", "band").agg(F.count("*").alias("n")).where("n > 1")
                     .select("group", "band", "n", F.ceil(F.col("n") / chunk).cast("long").alias("chunks")), "buckets")
    packs = F.lit(max(1, (buckets.where("chunks = 1").agg(F.sum("n")).first()[0] or 0) // PACK))    # by texts
    meets = (member.join(buckets, ["group", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
             .withColumn("task", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("group"), packs))
                         .otherwise(F.xxhash64("group", "i", "j")))
             .select("task", "group", "band", "i", "j", "chunk", "node"))
    kept = stored(meets.join(signed.select("node", "sig"), "node").groupBy("task").applyInArrow(
        _promising(threshold, tolerance),
        "node long, task long, group long, band int, i long, j long, chunk long"), "promising")
    return (kept.join(texts.select("node", "copies", "text"), "node").groupBy("task")
            .applyInArrow(_verified(threshold, tolerance), _LINKS))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: the id, ``class_id`` (smallest id of its
    near-duplicate class), ``text_id`` (smallest id with the same words),
    ``n_copies`` (rows with the same words, itself included), ``n_texts``
    (different texts linked to it) and ``n_links`` (other rows linked to it,
    copies included).

    Texts with no word (null too) are classes of their own without links.  Rows
    with a null id get null classes.  Rows sharing an id are compared like any
    others.  Empty input: empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = stored(rows.mapInArrow(_sketch, rows.select("id").schema.add("key", "long").add("bands", T.ArrayType(T.LongType()))),
                    "sketch")
    named = sketch.where("id IS NOT NULL AND key IS NOT NULL")
    classes = stored(named.groupBy("key").agg(F.min("id").alias("text_id"), F.count("*").alias("n_copies")), "classes")

    # candidate groups: classes tied to the smallest class of each band they share
    banded = (named.join(classes, (named["id"] == classes["text_id"]) & (named["key"] == classes["key"]), "left_semi")
              .select("key", F.explode("bands").alias("band")))
    hubs = banded.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("top")).where("hub <> top")
    ties = banded.join(hubs, "band").where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
    group = stored(components(ties), "groups")
    sizes = stored(group.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    packs = max(1, group.count() // PACK)

    placed = (group.join(sizes, "root").join(classes, F.col("node") == F.col("key"))
              .select("root", "node", "size", F.col("n_copies").alias("copies"), "text_id"))
    texts = rows.join(placed, F.col("id") == F.col("text_id"))
    verify = _verified(threshold, tolerance)
    small = (texts.where(F.col("size") <= chunk)
             .select(F.pmod(F.xxhash64("root"), F.lit(packs)).alias("task"), F.col("root").alias("group"),
                     F.lit(-1).alias("band"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"),
                     F.lit(0).cast("long").alias("chunk"), "node", "copies", "text"))
    links = small.groupBy("task").applyInArrow(verify, _LINKS)
    if not sizes.where(F.col("size") > chunk).isEmpty():
        links = links.union(_by_band(texts.where(F.col("size") > chunk), threshold, tolerance, chunk))
    links = stored(links, "links")

    counts = links.groupBy("node").agg(F.sum("texts").alias("n_texts"), F.sum("docs").alias("docs"))
    joined = components(links.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    member = joined.join(classes, F.col("node") == F.col("key")).select("root", "node", "text_id")
    named_by = member.groupBy("root").agg(F.min("text_id").alias("class_id"))
    of_node = member.join(named_by, "root").select("node", "class_id").join(counts, "node")
    info = (classes.join(of_node, F.col("key") == F.col("node"), "left")
            .select("key", "text_id", "n_copies", F.coalesce("class_id", "text_id").alias("class_id"),
                    F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
                    (F.coalesce("docs", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")))
    info = stored(info, "info")            # a plain shuffle on either side: the skew join can split a class's copies
    out = sketch.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(info, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
                      F.coalesce("text_id", "id").alias("text_id"),
                      F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
                      F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: near-duplicate class and links of every document."""
    from .sources import table

    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, w, array_to_string(w, ' ') AS t
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents)),
classes AS (SELECT t, min(doc_id) AS text_id, count(*) AS n_copies, any_value(w) AS w FROM texts WHERE len(w) > 0 GROUP BY t),
grams AS (
  SELECT DISTINCT text_id, CASE WHEN len(w) < 5 THEN t ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT text_id, t, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM classes)),
sizes AS (SELECT text_id, count(*) AS n FROM grams GROUP BY text_id),
shared AS (
  SELECT a.text_id AS a, b.text_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.text_id <> b.text_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.text_id = a JOIN sizes y ON y.text_id = b
  WHERE CAST(c AS DOUBLE) / CAST(x.n + y.n - c AS DOUBLE) >= CAST(0.8 AS DOUBLE)),
reach AS (
  SELECT text_id AS a, text_id AS r FROM classes
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r),
groups AS (SELECT a, min(r) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_texts, sum(n_copies) AS docs FROM links JOIN classes ON text_id = b GROUP BY a)
SELECT doc_id, CAST(coalesce(class_id, doc_id) AS BIGINT) AS class_id, CAST(coalesce(c.text_id, doc_id) AS BIGINT) AS text_id,
  CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts,
  CAST(coalesce(docs, 0) + coalesce(n_copies, 1) - 1 AS BIGINT) AS n_links
FROM texts LEFT JOIN classes c ON c.t = texts.t LEFT JOIN groups g ON g.a = c.text_id LEFT JOIN counts k ON k.a = c.text_id
"""
