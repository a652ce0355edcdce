"""SentencePiece encoding and decoding over a relational lattice.

Texts are normalised as the model says (a space in front, spaces become the
mark U+2581) and cut into units wherever no piece of the vocabulary holds the
two neighbouring characters: no piece crosses such a cut, so units are encoded
on their own, each distinct unit once.

Lattice.  Every substring of a unit of two characters up to the longest piece's
length is exploded and equi-joined to the piece table; the matching edges are
grouped by unit and folded with Spark's higher-order ``aggregate``.  The fold depends on
the kind of model.  For a unigram model it is Viterbi: the best score per
position.  A BPE model's scores are merge ranks, and the best sum of ranks is
not its encoding, so there the fold applies, step by step, the best-ranked edge
that joins exactly two current pieces (leftmost among equals), on a bit mask of
the unit's cuts.  Characters that are left get their own piece, or byte pieces.

Plan.  Documents are dealt into blocks (texts travel compressed).  A block sends
its distinct units; one shuffle by unit serves both the lattice (explode, join
to the broadcast piece table -- its size is the vocabulary file's -- and group
need no other) and the way back; encoded units return to their blocks, which
read the same document shuffle again.  Units of over ``LONG`` characters do not
fit the mask and are encoded by the same merges in the block's task.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import count_blocks, hashed_block
from .columns import carried_names
from .textops import _span_hash, distinct

SPACE = "▁"
LONG = 60
BLOCK_BYTES = 16 << 20
SLICE = 1 << 20         # characters normalised and cut at a time
BYTE_BASE = 3           # id of the piece of byte 0 in vocabularies with byte fallback


class Vocabulary:
    """Pieces of a model file; one per worker and path."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                                             or model.is_unused(i))]
        bytes_ = [i for i in range(n) if model.is_byte(i)]
        if [model.id_to_piece(i) for i in bytes_[:1]] != ["<0x00>"] or bytes_[0] != BYTE_BASE or len(bytes_) != 256:
            raise ValueError("the vocabulary needs 256 byte pieces from id 3")
        self.pieces = {model.id_to_piece(i): i for i in plain}
        order = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = {i: place[model.get_score(i)] for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.pieces))
        # characters of pieces, numbered from 1, and which pairs some piece holds
        letters = sorted({c for p in self.pieces for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.pieces:
            x = self.number[[ord(c) for c in p]]
            self.joined[x[:-1], x[1:]] = True
        self.text = [b""] * n                                # what an id decodes to
        for p, i in self.pieces.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for i in bytes_:
            self.text[i] = bytes([i - BYTE_BASE])
        size = np.array([len(x) for x in self.text])
        self.flat, self.size = np.frombuffer(b"".join(self.text), np.uint8), size
        self.first = np.concatenate([[0], np.cumsum(size)[:-1]])

    @staticmethod
    @functools.cache
    def of(path: str) -> "Vocabulary":
        return Vocabulary(path)

    def merge(self, unit: str) -> list[int]:
        """The unit's ids by its merges, best rank first, leftmost among equals."""
        part, right, left = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < len(part):
                piece = self.pieces.get(part[i] + part[j])
                if piece is not None:
                    heapq.heappush(heap, (self.rank[piece], i, part[i], part[j]))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], right[i] = a + b, "", right[j]
            if right[j] < len(part):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out: list[int] = []
        for p in filter(None, part):
            out += [self.pieces[p]] if p in self.pieces else [BYTE_BASE + b for b in p.encode()]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends of the ids' texts in them)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], ends


def cut(texts: list[str], vocabulary: Vocabulary) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised text of all, unit starts, units of each text as offsets, unit hashes)."""
    full = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    text = "".join(full)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    size = np.array([len(t) for t in full], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    number = vocabulary.number[code]
    head = np.ones(len(code), bool)
    head[1:] = ~vocabulary.joined[number[:-1], number[1:]]
    head[bounds[:-1][bounds[:-1] < len(code)]] = True
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(code)) if len(start) else start
    return text, start, np.searchsorted(start, bounds), _span_hash(code, start, end)


def _bundles(batches, id_type: pa.DataType):
    """Rows (block, ids, sizes, texts): each batch's texts of a block, compressed
    together (a bundle gets smaller than its texts one by one)."""
    codec = pa.Codec("zstd", compression_level=6)
    for b in batches:
        block = b.column(1).to_numpy()
        order = np.argsort(block, kind="stable")
        edge = np.flatnonzero(np.diff(block[order])) + 1
        out = {"block": [], "ids": [], "sizes": [], "texts": []}
        for rows in np.split(order, edge) if len(order) else []:
            part = b.take(pa.array(rows))
            raw = [(t or "").encode() for t in part.column(2).to_pylist()]
            for key, x in (("block", int(block[rows[0]])), ("ids", part.column(0).to_pylist()),
                           ("sizes", [len(t) for t in raw]), ("texts", codec.compress(b"".join(raw), asbytes=True))):
                out[key].append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["block"], pa.int32()), pa.array(out["ids"], pa.list_(id_type)),
             pa.array(out["sizes"], pa.list_(pa.int64())), pa.array(out["texts"], pa.binary())], list(out))


def _texts(table: pa.Table):
    """The texts (bytes) of a block's bundles, in order."""
    codec = pa.Codec("zstd")
    for sizes, raw in zip(table["sizes"].to_pylist(), table["texts"]):
        data, at = codec.decompress(raw.as_py(), decompressed_size=sum(sizes), asbytes=True), 0
        for n in sizes:
            yield data[at:at + n]
            at += n


def _slices(texts):
    part, n = [], 0
    for raw in texts:
        part.append(raw.decode())
        n += len(part[-1])
        if n >= SLICE:
            yield part
            part, n = [], 0
    if part:
        yield part


def _block_units(table: pa.Table, vocabulary: Vocabulary):
    """(distinct units in alphabetical order, their lengths, each occurrence's
    place among them, occurrences by text as offsets)."""
    names = np.zeros(0, np.uint64)                    # all hashes so far, sorted
    new_names, new_units, sizes, parts, counts = [], [], [], [], []
    for texts in _slices(_texts(table)):
        text, start, offsets, h = cut(texts, vocabulary)
        end = np.append(start[1:], len(text)) if len(start) else start
        seen, first, place = distinct(h)
        at = np.searchsorted(names, seen)
        fresh = np.append(names, np.uint64(0))[at] != seen
        fresh |= at == len(names)
        spans = start[first[fresh]], end[first[fresh]]
        new_units.append(pa.array([text[a:z] for a, z in zip(*(x.tolist() for x in spans))], pa.string()))
        new_names.append(seen[fresh])
        sizes.append(spans[1] - spans[0])
        names = np.insert(names, at[fresh], seen[fresh])
        parts.append((seen, place.astype(np.int32)))
        counts.append(np.diff(offsets))
    units = pa.concat_arrays(new_units) if new_units else pa.array([], pa.string())
    order = pc.sort_indices(units).to_numpy()
    rank = np.empty(len(units), np.int32)
    rank[order] = np.arange(len(units), dtype=np.int32)
    by_hash = np.empty(len(units), np.int32)
    by_hash[np.searchsorted(names, np.concatenate(new_names or [names]))] = rank
    places = [by_hash[np.searchsorted(names, seen)][place] for seen, place in parts]
    return (units.take(pa.array(order)), np.concatenate(sizes or [order])[order],
            np.concatenate(places or [rank]), np.concatenate([[0], np.cumsum(np.concatenate(counts or [order]))]))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    v = Vocabulary.of(path)
    return spark.createDataFrame([(p, i, v.rank[i], v.score[i]) for p, i in v.pieces.items()],
                                 "piece string, id int, rank int, score double")


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``units`` (unit) with ``edges``: its substrings of two or more characters
    that are pieces, each as its place in the unit's cuts, in bits: ``ends`` (its
    two ends) and ``span`` (all cuts it covers); ``order`` sorts by rank, then
    from the left.  A unit without such a piece has one edge without an id.

    Grouped by hash and unit, so that the grouping's sort compares numbers.
    """
    n, one = F.char_length("unit"), F.lit(1).cast("long")
    bit = lambda c: F.call_function("shiftleft", one, c)
    start, k = F.col("start"), F.col("k")
    starts = units.select(F.xxhash64("unit").alias("h"), "unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("h", "unit", "start", F.explode(
        F.sequence(F.lit(1), F.least(F.lit(longest), n - start))).alias("k")).where("k > 1 OR start = 0")
    edge = F.struct((F.col("rank") * (LONG + 1) + start).alias("order"), (bit(start) + bit(start + k)).alias("ends"),
                    (bit(start + k + 1) - bit(start)).alias("span"), F.col("id"), F.col("score"))
    return (spans.select("h", "unit", "start", "k", F.substring(F.col("unit"), start + 1, k).alias("piece"))
            .join(F.broadcast(pieces), "piece", "left").where("(id IS NOT NULL AND k > 1) OR (k = 1 AND start = 0)")
            .select("h", "unit", F.when(k > 1, edge).alias("edge"))
            .groupBy("h", "unit").agg(F.collect_list("edge").alias("edges")).drop("h"))


def _letters(vocabulary: Vocabulary) -> tuple[Column, Column]:
    """(all characters that are pieces, in id order; their ids)."""
    letters = sorted((i, p) for p, i in vocabulary.pieces.items() if len(p) == 1)
    return F.lit("".join(p for _, p in letters)), F.array(*[F.lit(i) for i, _ in letters])


def _ids(path: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a path of (start, id) in text order; where the id is null, that of
    the single character there, or its byte pieces."""
    letters, ids = _letters(vocabulary)

    def one(e: Column) -> Column:
        raw = F.substring(F.col("unit"), e["start"] + 1, F.lit(1))
        at = F.instr(letters, raw)
        octets = F.transform(F.sequence(F.lit(0), F.octet_length(raw) - 1), lambda i: F.conv(
            F.substring(F.hex(raw), 2 * i + 1, F.lit(2)), 16, 10).cast("int") + BYTE_BASE)
        return (F.when(e["id"].isNotNull(), F.array(e["id"])).when(at > 0, F.array(F.element_at(ids, at)))
                .otherwise(octets))

    return F.flatten(F.transform(path, one))


def merged(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``unit``, ``ids``: the lattice folded by merges.  The fold's state is the
    unit's cuts as bits; it turns negative when nothing more can be merged."""
    n = F.char_length("unit")
    here = lambda cuts, e: cuts.bitwiseAND(e["ends"]) == e["ends"]
    covered = lambda cuts, e: F.bit_count(cuts.bitwiseAND(e["span"]))  # noqa: E731  its two ends, and cuts inside

    def step(cuts: Column, _: Column) -> Column:
        best = F.try_element_at(F.filter("edges", lambda e: (covered(cuts, e) == 3) & here(cuts, e)), F.lit(1))
        return F.when(cuts < 0, cuts).otherwise(F.coalesce(
            cuts.bitwiseAND(F.bitwise_not(best["span"].bitwiseXOR(best["ends"]))), -cuts))

    start = F.call_function("shiftleft", F.lit(1).cast("long"), n + 1) - 1
    cuts = F.when(F.size("edges") > 0, F.abs(F.aggregate(F.sequence(F.lit(2), n), start, step))).otherwise(start)
    # pieces that are whole between two neighbouring cuts, and the single characters that are left
    long = F.transform(F.filter("edges", lambda e: (covered(F.col("cuts"), e) == 2) & here(F.col("cuts"), e)),
                       lambda e: F.struct((e["order"] % (LONG + 1)).alias("start"), e["id"]))
    pair = lambda p: F.call_function("shiftleft", F.lit(3).cast("long"), p)
    single = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda p: F.col("cuts").bitwiseAND(pair(p)) == pair(p)),
                         lambda p: F.struct(p.alias("start"), F.lit(None).cast("int").alias("id")))
    return (units.withColumn("edges", F.array_sort("edges")).withColumn("cuts", cuts)
            .withColumn("path", F.array_sort(F.concat(long, single)))
            .select("unit", _ids(F.col("path"), vocabulary).alias("ids")))


def best_scored(units: DataFrame, pieces: DataFrame, longest: int, unknown: float = -100.0) -> DataFrame:
    """``unit``, ``ids``: Viterbi for unigram models -- the path of the largest
    score sum, then of fewer pieces, then of the later last piece.  Characters
    without a piece score ``unknown`` and have no id."""
    edges = (lattice(units, pieces, longest)
             .select("unit", F.explode(F.filter("edges", lambda e: e["id"].isNotNull())).alias("e"))
             .select("unit", (F.col("e.order") % (LONG + 1)).alias("start"), F.bit_count(F.col("e.span")).alias("n"),
                     "e.id", "e.score"))
    n = F.char_length("unit")
    letters = (units.select("unit", F.posexplode(F.split("unit", "")).alias("start", "piece")).where("piece <> ''")
               .join(F.broadcast(pieces), "piece", "left")
               .select("unit", "start", F.lit(2).alias("n"), "id", F.coalesce("score", F.lit(unknown)).alias("score")))
    grouped = edges.unionByName(letters).groupBy("unit").agg(F.collect_list(F.struct(
        "start", (F.col("start") + F.col("n") - 1).alias("stop"), "id", "score")).alias("edges"))
    by_stop = F.transform(F.sequence(F.lit(1), n), lambda p: F.filter("edges", lambda e: e["stop"] == p))

    def step(states: Column, arriving: Column) -> Column:
        ways = F.transform(arriving, lambda e: F.struct(
            (F.element_at(states, e["start"] + 1)["score"] + e["score"]).alias("score"),
            (F.element_at(states, e["start"] + 1)["n"] - 1).alias("n"), e["start"].alias("last"),
            F.concat(F.element_at(states, e["start"] + 1)["path"], F.array(e)).alias("path")))
        rank = lambda w: F.struct(w["score"], w["n"], w["last"])
        top = F.array_max(F.transform(ways, rank))
        return F.concat(states, F.slice(F.filter(ways, lambda w: rank(w) == top), 1, 1))

    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n"), F.lit(0).alias("last"),
                             F.slice("edges", 1, 0).alias("path")))
    last = F.aggregate(by_stop, begin, step, lambda states: F.element_at(states, -1)["path"])
    return grouped.select("unit", F.transform(last, lambda e: e["id"]).alias("ids"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row's id, ``n_pieces``, ``ids_crc32`` (unsigned, ids as little-endian
    u32), ``round_trip`` (decoding gives the text back) and, if asked, ``ids``.

    Null and empty texts have no piece.  Null and repeated ids are rows like any
    others.  A text that holds U+2581 itself decodes with spaces there.
    """
    blocks = count_blocks(docs, text_col, block_bytes)
    vocabulary = Vocabulary.of(path)
    bits = len(vocabulary.text).bit_length()
    per = 62 // bits                                   # ids that travel in one long
    id_field = docs.schema[id_col]
    id_type = to_arrow_type(id_field.dataType)
    dealt = docs.select(F.col(id_col).alias("id"), hashed_block(id_col, text_col, blocks).alias("block"),
                        F.col(text_col).alias("text")).mapInArrow(
        lambda batches: _bundles(batches, id_type), T.StructType([
            T.StructField("block", T.IntegerType()), T.StructField("ids", T.ArrayType(id_field.dataType)),
            T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())]))

    def units_of(key, table):
        units, size, _, _ = _block_units(table, Vocabulary.of(path))
        place = np.flatnonzero(size <= LONG)
        return pa.table({"block": pa.array(np.full(len(place), key[0].as_py()), pa.int32()),
                         "place": pa.array(place, pa.int32()), "unit": units.take(pa.array(place))})

    def assemble(key, table, answers):
        vocabulary = Vocabulary.of(path)
        units, length, place, offsets = _block_units(table, vocabulary)
        answers = answers.sort_by("place")
        rest = answers["rest"].combine_chunks().fill_null(pa.scalar([], pa.list_(pa.int64())))
        width = 1 + pc.list_value_length(rest).to_numpy()
        head = np.zeros(width.sum(), bool)
        head[np.cumsum(width) - width] = True
        packed = np.empty(len(head), np.int64)
        packed[head] = answers["first"].to_numpy()
        packed[~head] = rest.flatten().to_numpy()
        digits = (packed[:, None] >> (bits * np.arange(per - 1, -1, -1))) & ((1 << bits) - 1)
        used = digits > 0
        size = np.zeros(len(units), np.int64)
        if len(head):
            size[answers["place"].to_numpy()] = np.add.reduceat(used.sum(1), np.flatnonzero(head))
        own = {i: vocabulary.merge(units[i].as_py()) for i in np.flatnonzero(length > LONG).tolist()}
        for i, ids in own.items():
            size[i] = len(ids)
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(first[-1], np.int32)
        answered = np.ones(len(units), bool)
        answered[list(own)] = False
        flat[np.repeat(answered, size)] = digits[used] - 1
        for i, ids in own.items():
            flat[first[i]: first[i + 1]] = ids
        out = {"n_pieces": [], "ids_crc32": [], "round_trip": [], "ids": []}
        for k, raw in enumerate(_texts(table)):
            mine = place[offsets[k]: offsets[k + 1]]
            counts = size[mine]
            ends = np.cumsum(counts)
            ids = flat[np.repeat(first[mine] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
            back, _ = vocabulary.decode(ids)
            out["n_pieces"].append(len(ids))
            out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
            out["round_trip"].append(back[1:].tobytes() == raw)
            if with_ids:
                out["ids"].append(ids)
        cols = {"id": pa.concat_arrays([x.values for x in table["ids"]]) if table.num_rows else pa.array([], id_type),
                "n_pieces": pa.array(out["n_pieces"], pa.int64()),
                "ids_crc32": pa.array(out["ids_crc32"], pa.int64()), "round_trip": pa.array(out["round_trip"], pa.bool_())}
        if with_ids:
            cols["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
        return pa.table(cols)

    by_block = dealt.groupBy("block")
    asked = by_block.applyInArrow(units_of, "block int, place int, unit string").repartition("unit")
    pieces = piece_table(docs.sparkSession, path)
    # reads all columns of ``asked``, so that both uses of it share one shuffle
    units = asked.groupBy("unit").agg(F.min("block").alias("block"), F.min("place").alias("place")).where(
        "block >= 0 AND place >= 0").select("unit")
    known = merged(lattice(units, pieces, vocabulary.longest), vocabulary)
    pack = lambda g: F.aggregate(F.slice("ids", g * per + 1, per), F.lit(0).cast("long"),
                                 lambda x, i: x * (1 << bits) + i + 1)
    more = F.transform(F.sequence(F.lit(1), F.floor((F.size("ids") - 1) / per).cast("int")), pack)
    known = known.select("unit", pack(F.lit(0)).alias("first"), F.when(F.size("ids") > per, more).alias("rest"))
    answers = asked.join(known.hint("shuffle_hash"), "unit").select("block", "place", "first", "rest")
    schema = T.StructType([T.StructField("id", id_field.dataType), *T._parse_datatype_string(
        "n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids).fields])
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(assemble, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids (null ids: null); byte
    pieces that are no UTF-8 become U+FFFD; control ids say nothing.  A column that is
    already called ``decoded`` comes back with ``_in`` added to its name."""
    names = encoded.columns
    out_names = carried_names(names, ["decoded"])

    def texts(batches):
        vocabulary = Vocabulary.of(path)
        for b in batches:
            ids = b.column(names.index(ids_col))
            back, ends = vocabulary.decode(ids.flatten().to_numpy())
            raw, ends = back.tobytes(), np.concatenate([[0], ends])
            at = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in ids.to_pylist()])])
            out = [raw[ends[x]:ends[y]].decode(errors="replace") for x, y in zip(at[:-1], at[1:])]
            out = [None if not v else t.removeprefix(" ") for t, v in zip(out, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*out_names.values(), "decoded"])

    return encoded.mapInArrow(texts, T.StructType([*(T.StructField(out_names[f.name], f.dataType) for f in encoded.schema),
                                                   T.StructField("decoded", T.StringType())]))


def query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """op7: pieces of every document."""
    from .sources import table, tokenizer_path

    return encode(table(spark, sf_dir, "documents"), path or tokenizer_path("piece_bpe_32k.model"), with_ids=False)
