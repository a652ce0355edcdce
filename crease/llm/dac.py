"""Token-ID output in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first.  Level 0 holds the first chunk
of every id; a continuation bitmap marks the ids that go on, and those ids'
next chunks form level 1, and so on.  A rank directory (set bits before every
512th bit) turns an id's place on one level into its place on the next, so any
token is reached in one step per level and no block is decoded.

File format (little endian), one file per block of documents:

    magic "DAC1" | u32 levels | u64 ids | u64 documents
    documents' first ids (u64 each; their ends are the next one's start)
    per level:  u64 entries | entries bytes of chunks
                u64 bitmap bytes | bitmap | u32 rank for every 512 bits

Files are rows of a Parquet table in the shared folder, so that any store Spark
reaches will do; ``directory`` holds every document's block and place.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, ordered_blocks
from .sources import stored
from .textops import row_slices
from .tokens import SLICE_BYTES, PartEncoder

MAGIC = b"DAC1"
RANK_BITS = 512
END_ID = 1
FILE_IDS = 4_000_000      # a block of more ids is written as several files


def encode(ids: np.ndarray, firsts: np.ndarray) -> bytes:
    """The file of ``ids``, documents beginning at ``firsts``."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little") if goes_on.any() else np.zeros(0, np.uint8)
        ones = np.concatenate([[0], np.cumsum(goes_on)])[:-1:RANK_BITS] if len(bits) else np.zeros(0)
        chunks = (rest & np.uint64(0xFF)).astype(np.uint8)
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes()
                      + struct.pack("<Q", len(bits)) + bits.tobytes() + ones.astype("<u4").tobytes())
        if not len(bits):
            break
        rest = rest[goes_on] >> np.uint64(8)
    head = MAGIC + struct.pack("<IQQ", len(levels), len(ids), len(firsts))
    return b"".join([head, firsts.astype("<u8").tobytes(), *levels])


class Reader:
    """Reads a file; the levels are views of its bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        levels, self.n, docs = struct.unpack_from("<IQQ", raw, 4)
        at = 24
        self.firsts = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.levels = []
        for _ in range(levels):
            n = struct.unpack_from("<Q", raw, at)[0]
            chunks = np.frombuffer(raw, np.uint8, n, at + 8)
            size = struct.unpack_from("<Q", raw, at + 8 + n)[0]
            bits = np.frombuffer(raw, np.uint8, size, at + 16 + n)
            ranks = np.frombuffer(raw, "<u4", -(-n // RANK_BITS) if size else 0, at + 16 + n + size)
            self.levels.append((chunks, bits, ranks))
            at += 16 + n + size + ranks.nbytes

    def all_ids(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        place, shift = np.arange(self.n), 0
        for chunks, bits, _ in self.levels:
            out[place] |= chunks.astype(np.uint32) << np.uint32(shift)
            goes_on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool) if len(bits) else []
            place, shift = place[goes_on] if len(bits) else place[:0], shift + 8
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``: bitmap, rank directory and one byte per level."""
        out, at = np.zeros(len(places), np.uint32), np.asarray(places, np.int64)
        live, shift = np.arange(len(places)), 0
        for chunks, bits, ranks in self.levels:
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            if not len(bits):
                break
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at, shift = live[on], at[on], shift + 8
            group = at // RANK_BITS
            window = group[:, None] * (RANK_BITS // 8) + np.arange(RANK_BITS // 8)
            seen = np.where(window < len(bits), bits[np.minimum(window, len(bits) - 1)], 0).astype(np.uint8)
            unpacked = np.unpackbits(seen, axis=1, bitorder="little")
            before = np.arange(RANK_BITS) < (at % RANK_BITS)[:, None]
            at = ranks[group].astype(np.int64) + (unpacked * before).sum(1, dtype=np.int64)
        return out


@dataclass(frozen=True)
class Store:
    """Tables of a written corpus: ``files`` (block, file, n_ids, ids of its
    documents, raw) and ``bases`` (block, file, ids of all files before it)."""

    files: DataFrame
    bases: DataFrame


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES) -> Store:
    """Tokenise every whole text (null: empty), end each document with id 1, and
    write all ids in ascending id order (null ids first, ties by text; the rows of
    an id with more text than a block by a hash of them first).

    Documents meet in blocks of consecutive ids and like sizes in bytes (one
    shuffle); a block's ids are written by one task, in files of at most about
    ``FILE_IDS`` ids.  Other columns are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, _ = ordered_blocks(plain, "id", "text", block_bytes)

    def save(key, table):
        encoder = PartEncoder.of(path)
        table = pa.table({"id": table["id"], "text": table["text"]})
        table = table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")],
                                                   null_placement="at_start"))
        texts, names = table["text"].combine_chunks(), table["id"].to_pylist()
        out, held, firsts, size, first = [], [], [], 0, 0
        for lo, hi in row_slices(texts, SLICE_BYTES):
            ids, offsets = encoder.encode(texts.slice(lo, hi - lo), END_ID)
            held.append(ids)
            firsts.append(size + offsets[:-1])
            size += len(ids)
            if size >= FILE_IDS or hi == len(texts):
                out.append((len(out), size, names[first:hi], encode(np.concatenate(held), np.concatenate(firsts))))
                held, firsts, size, first = [], [], 0, hi
        file, n, ids, raw = zip(*out)
        return pa.table({"block": pa.array([key[0].as_py()] * len(out), pa.int64()), "file": pa.array(file, pa.int32()),
                         "n_ids": pa.array(n, pa.int64()), "doc_ids": pa.array(ids, pa.list_(pa.int64())),
                         "raw": pa.array(raw, pa.binary())})

    files = stored(rows.groupBy("_block").applyInArrow(
        save, "block long, file int, n_ids long, doc_ids array<long>, raw binary"), "dac")
    # one small row per file: prefix sums over files, not over documents
    order = Window.orderBy("block", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("block", "file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    return Store(files, stored(bases, "bases"))


def read(store: Store, with_ids: bool = True) -> DataFrame:
    """Every document from the files: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32`` and, if asked for, ``ids``."""

    def decode(batches):
        for b in batches:
            for row in b.to_pylist():
                reader = Reader(row["raw"])
                ids = reader.all_ids()
                cuts = [*reader.firsts.tolist(), reader.n]
                data = memoryview(ids.astype("<u4").tobytes())
                for lo in range(0, len(row["doc_ids"]), 256):
                    span = list(itertools.pairwise(cuts[lo:lo + 257]))
                    a, z = span[0][0], span[-1][1]
                    out = {
                        "doc_id": pa.array(row["doc_ids"][lo:lo + 256], pa.int64()),
                        "start": pa.array([row["base"] + x for x, _ in span], pa.int64()),
                        "n_tokens": pa.array([y - x for x, y in span], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(data[4 * x:4 * y]) for x, y in span], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(
                            pa.array([x - a for x, _ in span] + [z - a], pa.int32()), pa.array(ids[a:z].astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    return store.files.join(store.bases, ["block", "file"]).select("doc_ids", "raw", "base").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokens_at(store: Store, requests: DataFrame) -> DataFrame:
    """``requests`` (doc_id, place) with ``id``: the document's token at that
    place (from 0; null outside the document).  Requests meet their file by its
    documents' ids; the file answers by rank, without decoding.  Of documents
    sharing an id the first in file order answers; null or unknown ids give no
    row."""
    directory = (store.files.select("block", "file", F.posexplode("doc_ids").alias("doc", "doc_id"))
                 .groupBy("doc_id").agg(F.min(F.struct("block", "file", "doc")).alias("at")).select("doc_id", "at.*"))
    wanted = requests.select("doc_id", F.col("place").cast("long")).join(directory, "doc_id")

    def answer(key, files, asked):
        if not files.num_rows or not asked.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "place": pa.array([], pa.int64()),
                             "id": pa.array([], pa.int64())})
        reader = Reader(files["raw"][0].as_py())
        ends = np.append(reader.firsts, reader.n)
        doc = asked["doc"].to_numpy()
        place = asked["place"].fill_null(-1).to_numpy()
        inside = (place >= 0) & (place < ends[doc + 1] - ends[doc])
        got = np.zeros(len(doc), np.int64)
        got[inside] = reader.at(ends[doc[inside]] + place[inside])
        return pa.table({"doc_id": asked["doc_id"], "place": asked["place"], "id": pa.array(got, mask=~inside)})

    return (store.files.select("block", "file", "raw").groupBy("block", "file")
            .cogroup(wanted.groupBy("block", "file")).applyInArrow(answer, "doc_id long, place long, id long"))


def query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """op5: every document, read back from the files."""
    from .sources import table, tokenizer_path

    store = write(table(spark, sf_dir, "documents"), path or tokenizer_path("word_bpe_49k.json"))
    return read(store, with_ids=False)
