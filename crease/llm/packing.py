"""Packing: mixture-controlled packing by deficit round robin over source queues.

Each source is a queue of tokens, served by quanta of ``QUANTUM`` tokens.  In a
round every queue earns its share, spends whole quanta, and carries what is left
-- its deficit, less than a quantum -- to the next round; a window (a sequence of
``LENGTH`` tokens) ends where it ends, inside a quantum if need be, and the next
one goes on there.  Long quanta keep documents whole, short ones keep each window
nearer to its target.  The round robin serves quanta in the order of (tokens of
the queue up to the quantum's end / rate, queue); a drained queue's share goes to
the others.  So the state at any window follows from the queues' totals alone
(``served``): tasks start in the middle with exactly the deficits the earlier
windows left, and none waits for another.

Plan.  1. Documents are tokenised once, in scan order, into chunks (rows of a
stored table: ids packed, compressed by the writer).  2. Token counts by chunk
and queue give each chunk's place in each queue (one small row per chunk and
queue; a window function per queue over chunks, never over documents).  3. The
chunks are read back, joined with their places, and cut.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sources import stored
from .textops import row_slices
from .tokens import SLICE_BYTES, PartEncoder

LENGTH = 2048
END_ID = 1
CHUNK_TOKENS = 2_000_000
QUANTUM = 256
TEMPER = 0.7             # of the query: sources weigh tokens ** TEMPER, rare ones more than in the corpus
MAX_QUEUES = 1024        # smaller sources share one more queue; no row is left out

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, source string")


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """Chunks of documents: ``chunk``, ``doc_ids``, ``sources``, ``sizes`` and
    ``ids`` (all documents' ids with their end ids, packed)."""

    def encode(batches):
        encoder, part, seq = PartEncoder.of(path), TaskContext.get().partitionId(), 0
        docs, sources, sizes, ids, size = [], [], [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict(
                {"chunk": pa.array([part << 32 | seq], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                 "sources": pa.array([sources], pa.list_(pa.string())),
                 "sizes": pa.array([sizes], pa.list_(pa.int64())), "ids": pa.array([b"".join(x.tobytes() for x in ids)], pa.binary())})

        for b in batches:
            for lo, hi in row_slices(b.column(1), SLICE_BYTES):
                got, offsets = encoder.encode(b.column(1).slice(lo, hi - lo), END_ID)
                ids.append(got)
                sizes += np.diff(offsets).tolist()
                docs += b.column(0).slice(lo, hi - lo).to_pylist()
                sources += b.column(2).slice(lo, hi - lo).to_pylist()
                size += len(got)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    docs, sources, sizes, ids, size, seq = [], [], [], [], 0, seq + 1
        if docs:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), text_col, F.col(source_col).cast("string")).mapInArrow(
        encode, "chunk long, doc_ids array<long>, sources array<string>, sizes array<long>, ids binary")


def _until(v: np.ndarray, totals: np.ndarray, rates: np.ndarray, quantum: int) -> np.ndarray:
    """Quanta of each queue (columns) that end, at tokens / rate, by time v (rows)."""
    v, most = v[:, None], -(-totals // quantum)
    end = lambda k: np.minimum(k * quantum, totals) / rates
    k = np.minimum(np.floor(v * rates / quantum), most)
    k = np.where((k < most) & (end(k + 1) <= v), k + 1, k)
    return np.where(end(k) > v, k - 1, k).astype(np.int64)


def served(ranks: np.ndarray, totals: np.ndarray, rates: np.ndarray, quantum: int = 1) -> np.ndarray:
    """(ranks, queues): how many tokens of each queue are among the first ``rank``."""
    low = np.zeros(len(ranks))
    high = np.full(len(ranks), (totals / rates).max() * 2 + 1)
    while True:
        mid = (low + high) / 2
        open_ = (mid > low) & (mid < high)
        if not open_.any():
            break
        fits = np.minimum(_until(mid, totals, rates, quantum) * quantum, totals).sum(1) <= ranks
        low = np.where(open_ & fits, mid, low)
        high = np.where(open_ & ~fits, mid, high)
    out = np.minimum(_until(low, totals, rates, quantum) * quantum, totals)
    more = np.minimum(out + quantum, totals)
    size = np.where((more > out) & (more / rates <= high[:, None]), more - out, 0)   # the quanta that end just after
    return out + np.clip((ranks - out.sum(1))[:, None] - (np.cumsum(size, 1) - size), 0, size)


def rank_of(queue: int, place: np.ndarray, totals: np.ndarray, rates: np.ndarray, quantum: int = 1) -> np.ndarray:
    """Serving rank (from 0) of tokens at ``place`` (from 0) of a queue."""
    v = np.minimum((place // quantum + 1) * quantum, totals[queue]) / rates[queue]
    upto = _until(v, totals, rates, quantum)
    tokens = np.minimum(upto * quantum, totals)
    tied = (upto > 0) & (tokens / rates == v[:, None])
    before = np.where(tied, (upto - 1) * quantum, tokens)
    return before.sum(1) + (tokens - before)[:, :queue].sum(1) + place % quantum


def _cut_chunk(row: dict, starts: dict, queue_of, totals, rates, length: int, quantum: int, dtype):
    """Columns of the pieces of one chunk."""
    sizes = np.array(row["sizes"], np.int64)
    queue = np.array([queue_of(s) for s in row["sources"]])
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.frombuffer(row["ids"], dtype).astype("<u4")
    columns = []
    for q in np.unique(queue):
        mine = np.flatnonzero(queue == q)
        edges = starts[q] + np.concatenate([[0], np.cumsum(sizes[mine])])      # documents in the queue
        w0, w1 = rank_of(q, np.array([edges[0], edges[-1] - 1]), totals, rates, quantum) // length
        for lo in range(w0, w1 + 1, 8192):
            hi = min(lo + 8192, w1 + 1)
            counts = served(np.minimum(np.arange(lo, hi + 1) * length, totals.sum()), totals, rates, quantum)
            before = (counts[1:, :q] - counts[:-1, :q]).sum(1)                 # of the window, served by earlier queues
            a, b = max(edges[0], counts[0, q]), min(edges[-1], counts[-1, q])
            cuts = np.unique(np.concatenate([counts[:, q], edges, [a, b]]))
            cuts = cuts[(cuts >= a) & (cuts <= b)]
            at, size = cuts[:-1], np.diff(cuts)
            doc = np.searchsorted(edges, at, "right") - 1
            win = np.searchsorted(counts[:, q], at, "right") - 1
            start = at - edges[doc]
            doc = mine[doc]
            columns.append((doc, start, size, lo + win, before[win] + at - counts[win, q]))
    doc, start, size, window, offset = (np.concatenate(x) for x in zip(*columns))
    data, at = memoryview(ids.tobytes()), 4 * (first[doc] + start)
    crc = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * size).tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(size),
         pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(window), pa.array(offset),
         pa.array(row["sources"], pa.string()).take(pa.array(doc))],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])


def pack(docs: DataFrame, path: str, targets: dict[str, float] | None = None, length: int = LENGTH,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quantum: int = QUANTUM,
         temper: float = 1.0) -> DataFrame:
    """Pieces (``PIECES``) of all documents, in sequences of ``length`` tokens.

    ``targets``: weight by source, positive and finite (others are refused by
    name; leave a source out of ``docs`` to leave it out).  By default a source
    weighs its tokens to the power of ``temper``: 1 lets each window mirror the
    corpus, less gives rare sources more of each window until they are drained.
    Weights of sources that do not occur change nothing.  Sources without a weight
    share the weight 1 queue of the rest; so do null sources and, beyond
    ``MAX_QUEUES`` sources, the smallest ones.  Only the last sequence is short
    (a writer pads it).  Null and empty texts hold their end id alone.  Rows
    with null or repeated ids are packed like any others.
    """
    refused = {s: w for s, w in (targets or {}).items() if not 0 < w < math.inf}
    if refused:
        raise ValueError(f"target weights must be positive and finite: {refused}")
    chunks = stored(tokenised(docs, path, id_col, text_col, source_col), "chunks")
    sizes = (chunks.select("chunk", F.explode(F.arrays_zip("sources", "sizes")).alias("d"))
             .groupBy("chunk", F.col("d.sources").alias("source")).agg(F.sum("d.sizes").alias("n")))
    sizes = stored(sizes, "sizes")
    named = (sizes.where("source IS NOT NULL").groupBy("source").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "source"))
    if targets is not None:
        named = named.where(F.col("source").isin(*targets))
    names = sorted(r.source for r in named.limit(MAX_QUEUES).collect())
    queue = F.when(F.col("source").isin(*names), F.col("source")) if names else F.lit(None).cast("string")
    queued = sizes.groupBy("chunk", queue.alias("queue")).agg(F.sum("n").alias("n"))
    total = {r.queue: r.n for r in queued.groupBy("queue").agg(F.sum("n").alias("n")).collect()}   # MAX_QUEUES + 1 rows
    order = [*names, None] if None in total else names
    totals = np.array([total[q] for q in order], np.int64)
    weight = totals.astype(float) ** temper if targets is None else np.array([targets.get(q, 1.0) for q in order], float)
    place = {q: i for i, q in enumerate(order)}
    queue_of = functools.partial(_queue_of, place)
    w = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (queued.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
              .groupBy("chunk").agg(F.collect_list(F.struct("queue", "start")).alias("starts")))
    starts = stored(starts, "starts")

    def cut(batches):
        dtype = PartEncoder.of(path).dtype
        for b in batches:
            for row in b.to_pylist():
                at = {queue_of(s["queue"]): s["start"] for s in row["starts"]}
                yield _cut_chunk(row, at, queue_of, totals, weight, length, quantum, dtype)

    return chunks.join(starts, "chunk").mapInArrow(cut, PIECES)


def _queue_of(place: dict, source: str | None) -> int:
    return place[source] if source in place else place[None]


def query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """op3: every document's pieces; rare sources weigh more than in the corpus."""
    from .sources import table, tokenizer_path

    return pack(table(spark, sf_dir, "documents"), path or tokenizer_path("byte_bpe_50k.json"),
                temper=TEMPER).drop("source")
