"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words.

Every window of every text is hashed (``textops.windows``); Spark gathers the
hashes by value, and each window whose words also start in a document with a
smaller id is marked.  Marked windows merge into maximal removal intervals.

Plan.  Documents are dealt into blocks of consecutive ids and like sizes in bytes
(an id with more text than a block, and rows without an id, are dealt into several
blocks of one rank).  A block sends its
*distinct* hashes, packed by bucket of the hash's upper bits (a hash that fills
a third of the corpus is one entry per block, not one per document).  Buckets
report to each block which of its hashes occur in a block of an earlier rank;
since ranks are ordered by id, no ids travel with the hashes.  The block then adds
the repeats inside itself and cuts the texts.  The documents are shuffled once:
both uses of the block exchange read the same shuffle.

Windows are compared by 64-bit hashes: among n windows about n*n/2**65 pairs
of different windows are taken for equal (4e-4 for 1.3e8 windows).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ordered_blocks, rank_of_block
from .columns import carried_names
from .hashes import bucket_edges, pack, unpack
from .textops import covered, owner, row_slices, split, windows

WIDTH = 50
BLOCK_BYTES = 4 << 20

_PACKED = "block long, bucket int, hashes binary"
_RESULT = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def _block_windows(table: pa.Table, text_col: str, id_col: str, width: int):
    """(row, first word, hash) of the windows of a block's rows that have an id."""
    texts, ids = table[text_col].combine_chunks(), table[id_col].combine_chunks()
    for lo, hi in row_slices(texts):
        s = split(texts.slice(lo, hi - lo))
        at, h = windows(s.hash, s.offsets, width)
        row = owner(s.offsets)[at] + lo if len(at) else at
        known = ids.is_valid().to_numpy(zero_copy_only=False)[row] if len(at) else np.zeros(0, bool)
        yield lo, hi, s, at[known], row[known], h[known]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   carry: Sequence[str] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``carry`` columns, ``n_words``,
    ``n_removed``, ``spans`` (removed word intervals, end exclusive, maximal)
    and ``kept_text`` (kept words joined by one space).

    A word goes when a window of ``width`` words that covers it also starts in
    a row with a smaller id; windows are judged on the input.  Null texts have
    no words.  Rows with a null id are neither compared nor cut.  Rows sharing
    an id never cut each other.  Texts shorter than ``width`` words have no
    window.  An empty table gives an empty result.  A carried column (or id) named
    like one of the result's comes back with ``_in`` added to its name.
    """
    out_names = carried_names([id_col, *carry], [f.name for f in T._parse_datatype_string(_RESULT)])
    cols = list(dict.fromkeys([id_col, text_col, *carry]))
    inner = {c: f"_{k}" for k, c in enumerate(cols)}         # clash with nothing
    schema = T.StructType([*(T.StructField(new, docs.schema[c].dataType) for c, new in out_names.items()),
                           *T._parse_datatype_string(_RESULT).fields])
    plain = docs.select(*[docs[c].alias(n) for c, n in inner.items()])
    id_col, text_col = inner[id_col], inner[text_col]
    dealt, blocks = ordered_blocks(plain, id_col, text_col, block_bytes)
    edges = bucket_edges(blocks)

    def send(key, table):
        found = [h for *_, h in _block_windows(table, text_col, id_col, width)]
        h = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        at = np.searchsorted(h, edges)
        parts = [(b, pack(h[lo:hi])) for b, (lo, hi) in enumerate(itertools.pairwise([*at, len(h)])) if hi > lo]
        return pa.table({"block": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                         "bucket": pa.array([b for b, _ in parts], pa.int32()),
                         "hashes": pa.array([p for _, p in parts], pa.binary())})

    def answer(key, table):
        """For each block: its hashes in this bucket that an earlier rank has too."""
        bucket = key[0].as_py()
        top = int(edges[bucket]) >> 56
        table = table.sort_by("block")
        parts = [unpack(r.as_py(), top) for r in table["hashes"]]
        blocks = np.repeat(table["block"].to_numpy(), [len(p) for p in parts])
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")           # ascending block inside a hash
        h, blocks = h[order], blocks[order]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        first = rank_of_block(blocks[head])[np.cumsum(head) - 1]
        again = rank_of_block(blocks) > first
        h, blocks = h[again], blocks[again]
        order = np.lexsort((h, blocks))
        h, blocks = h[order], blocks[order]
        names, first = np.unique(blocks, return_index=True)
        packs = [pack(h[lo:hi]) for lo, hi in itertools.pairwise([*first, len(h)])]
        return pa.table({"block": pa.array(names, pa.int64()),
                         "bucket": pa.array([bucket] * len(packs), pa.int32()),
                         "hashes": pa.array(packs, pa.binary())})

    def cut(key, table, seen):
        known = [unpack(r.as_py(), int(edges[b.as_py()]) >> 56) for b, r in zip(seen["bucket"], seen["hashes"])]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        pieces = list(_block_windows(table, text_col, id_col, width))
        h = np.concatenate([p[5] for p in pieces]) if pieces else np.zeros(0, np.uint64)
        row = np.concatenate([p[4] for p in pieces]) if pieces else np.zeros(0, np.int64)
        ids = table[id_col].combine_chunks().fill_null(0).to_numpy()[row]
        order = np.lexsort((ids, h))                   # smallest id of each hash first
        sorted_h, sorted_id = h[order], ids[order]
        head = np.ones(len(h), bool)
        head[1:] = sorted_h[1:] != sorted_h[:-1]
        smallest = sorted_id[np.flatnonzero(head)][np.cumsum(head) - 1] if len(h) else sorted_id
        gone = np.zeros(len(h), bool)
        gone[order] = sorted_id > smallest
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            gone |= known[at] == h
        rest = gone
        texts = table[text_col].combine_chunks()
        n_words, n_removed, spans, kept = [], [], [], []
        for lo, hi, s, at, _, _ in pieces:
            drop = covered(len(s.hash), at[rest[: len(at)]], width)
            rest = rest[len(at):]
            for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                a, b = s.offsets[i], s.offsets[i + 1]
                words, mask = (text or "").encode().split(), drop[a:b]
                n_words.append(len(words))
                n_removed.append(int(mask.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                kept.append(b" ".join(itertools.compress(words, ~mask) if n_removed[-1] else words).decode())
        out = {new: table[inner[c]] for c, new in out_names.items()}
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_text": pa.array(kept, pa.string())}
        return pa.table(out)

    by_block = dealt.groupBy("_block")
    sent = by_block.applyInArrow(send, _PACKED)
    seen = sent.groupBy("bucket").applyInArrow(answer, _PACKED)
    return by_block.cogroup(seen.withColumnRenamed("block", "_block").groupBy("_block")).applyInArrow(cut, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: what is left of every document."""
    from .sources import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM wins GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM wins JOIN firsts USING (key) WHERE doc_id > first_doc),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept_text
  FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM words w LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
