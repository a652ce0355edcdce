"""Approximate nearest neighbours by cross-polytope hashing.

A fold rotates unit vectors by three rounds of random signs and a fast Hadamard
transform and names the nearest signed axis; a table joins so many folds that it
has about as many cells as there are vectors.  A query looks, in each of
``TABLES`` tables, at its ``probes`` likeliest cells (multiprobe: cells ranked by
the squared distances of their axes from the nearest ones, over all folds at
once); the candidates found there are reranked by exact inner products of the
original vectors in double precision.  Where norms differ, largest inner product
becomes nearest direction by the usual lift: x -> (x / M, sqrt(1 - |x/M|^2)),
q -> (q / |q|, 0), M being the largest norm (one aggregate).

The number of probes is fitted (``fitted_probes``): ``SAMPLE`` queries get their
exact neighbours from one pass over the table; the least number of probes that
would have met ``WANTED`` of them is used for all queries.

Plan.  Equal vectors fold into one entry named by its smallest id, with its
``k + 1`` smallest ids -- more can never be among k neighbours -- so a vector
that fills a third of the table is one entry.  Entries are dealt by (table, range
of cells), the ranges sized for ``PART`` entries; a query goes only to the ranges
that hold cells it probes, once to each.  Ranges measured to hold more than twice
``PART`` entries are split by entry, and only their queries are sent to every
part.  Each group answers a query with one packed row of its k + 1 best, and a
last grouping by query merges the answers.  A query that found fewer than k goes
against all entries, part by part.

Recall@20 measured against brute force, and the share of all pairs that were
compared, are in the README.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sources import stored

TABLES = 16
MOST_FOLDS = 8
WANTED = 0.96            # of the sample's neighbours; recall of all queries is near it
SAMPLE = 64              # queries with exact neighbours, by hash of their names
MOST_PROBES = 4096       # in a table; queries that meet too few go against all entries
DENSE = 512              # up to this length a rotation is applied as one product
ROUNDS = 3
PART = 1 << 17
K = 20
ANSWER = "query long, names binary, scores binary, compared long"
QUERY_EVERY = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of rows (length a power of two)."""
    n, h = x.shape[1], 1
    while h < n:
        pair = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    signs = np.random.default_rng([7, table, x.shape[1]]).choice([-1.0, 1.0], (ROUNDS, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


@functools.lru_cache(maxsize=256)
def _rotation(length: int, number: int) -> np.ndarray:
    return rotated(np.eye(length), number)


def turned(x: np.ndarray, number: int) -> np.ndarray:
    """``rotated``, as one product where that is quicker."""
    return x @ _rotation(x.shape[1], number) if x.shape[1] <= DENSE else rotated(x, number)


def nearest_axes(x: np.ndarray, number: int, probes: int) -> np.ndarray:
    """(rows, probes) signed axes (axis, or length + axis for its negative), nearest first."""
    r = turned(x, number)
    both = np.concatenate([r, -r], 1)
    return _largest(both, min(probes, both.shape[1]))


def _largest(x: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest of each row, largest first."""
    near = np.argpartition(-x, n - 1, 1)[:, :n] if n < x.shape[1] else np.broadcast_to(np.arange(n), x.shape)
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(x, near, 1), 1, kind="stable"), 1)


def folds(entries: int, length: int) -> int:
    """Cross-polytopes joined in a table: about as many cells as entries."""
    return min(MOST_FOLDS, max(1, round(math.log(max(2, entries)) / math.log(2 * length))))


def cells(x: np.ndarray, table: int, joined: int) -> np.ndarray:
    """The cell of each row: its nearest axis in each fold, as digits."""
    code = np.zeros(len(x), np.int64)
    for f in range(joined):
        code = code * (2 * x.shape[1]) + nearest_axes(x, table * MOST_FOLDS + f, 1)[:, 0]
    return code


def probed(x: np.ndarray, table: int, joined: int, probes: int) -> np.ndarray:
    """(rows, probes) cells, likeliest first; all of them where there are fewer."""
    out, width = [], 2 * x.shape[1]
    step = max(1, (1 << 22) // (probes * width))
    for lo in range(0, len(x), step):
        code = score = np.zeros((len(x[lo:lo + step]), 1))
        code = code.astype(np.int64)
        for f in range(joined):
            r = turned(x[lo:lo + step], table * MOST_FOLDS + f)
            both = np.concatenate([r, -r], 1)
            far = -(both.max(1, keepdims=True) - both) ** 2
            total = (score[:, :, None] + far[:, None, :]).reshape(len(r), -1)
            top = _largest(total, min(probes, total.shape[1]))
            code = np.take_along_axis(code, top // width, 1) * width + top % width
            score = np.take_along_axis(total, top, 1)
        out.append(code)
    return np.concatenate(out)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _lift(x: np.ndarray, largest: float | None, entry: bool) -> np.ndarray:
    """Unit rows padded to a power of two; ``largest`` None: all norms are equal."""
    if largest is None:
        out = np.zeros((len(x), 1 << (x.shape[1] - 1).bit_length()))
        out[:, :x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return out
    out = np.zeros((len(x), 1 << x.shape[1].bit_length()))
    if entry:
        out[:, :x.shape[1]] = y = x / largest
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
    else:
        out[:, :x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _deal(size, tables: int, ranges: int, probes: int | None):
    """Rows (dim, slot, entry, vector, codes): an entry in its range of cells of
    each table, a query (``probes`` given) in every range it probes; ``codes``
    are the cells, packed."""

    def deal(batches):
        for b in batches:
            ids, dims = b.column(0), b.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                vectors, names = b.column(1).take(pa.array(rows)), ids.take(pa.array(rows))
                lifted = _lift(_matrix(vectors), size.lift, probes is None)
                joined = folds(size.n, lifted.shape[1])
                most = (2 * lifted.shape[1]) ** joined
                for t in range(tables):
                    if probes is None:
                        code = cells(lifted, t, joined)[:, None]
                    else:
                        code = np.sort(probed(lifted, t, joined, probes), 1)
                    part = (code.astype(float) / most * ranges).astype(np.int64)     # rises with the code
                    new = np.concatenate([np.ones((len(code), 1), bool), part[:, 1:] != part[:, :-1]], 1).ravel()
                    first = np.flatnonzero(new)
                    packed = pa.Array.from_buffers(
                        pa.binary(), len(first), [None, pa.py_buffer((8 * np.append(first, len(new))).astype(np.int32)),
                                                  pa.py_buffer(code.astype("<i8").tobytes())])
                    at = pa.array(first // code.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), dim), pa.int32()), pa.array(t * ranges + part.ravel()[first], pa.int64()),
                         names.take(at), vectors.take(at), packed], ["dim", "slot", "entry", "vector", "codes"])

    return deal


def _best(k: int):
    """Each query's ``k`` best entries among those of its cells in a group, packed
    (all entries of the group for a query without cells), and their number."""

    def best(key, entries, queries):
        out = {"query": [], "names": [], "scores": [], "compared": []}
        if entries.num_rows and queries.num_rows:
            x, names = _matrix(entries["vector"]), entries["entry"].to_numpy()
            code = np.frombuffer(b"".join(c.as_py() or bytes(8) for c in entries["codes"]), "<i8")
            order = np.lexsort((names, code))
            x, names, code = x[order], names[order], code[order]
            for q, asked, looked in zip(_matrix(queries["vector"]), queries["entry"].to_pylist(), queries["codes"]):
                if looked.is_valid:
                    want = np.frombuffer(looked.as_py(), "<i8")
                    lo, hi = np.searchsorted(code, want, "left"), np.searchsorted(code, want, "right")
                    met = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())
                    if not len(met):
                        continue
                    mine, called = x[met], names[met]
                else:
                    mine, called = x, names
                rough, n = mine @ q, min(k, len(mine))
                bound = -np.partition(-rough, n - 1)[n - 1]
                near = np.flatnonzero(rough >= bound - 1e-9 * (1 + abs(bound)))
                exact = (mine[near] * q).sum(1)                # the same sum wherever the pair meets
                top = np.lexsort((called[near], -exact))[:k]
                out["query"].append(asked)
                out["names"].append(called[near[top]].astype("<i8").tobytes())
                out["scores"].append(exact[top].astype("<f8").tobytes())
                out["compared"].append(len(mine))
        return pa.table({"query": pa.array(out["query"], pa.int64()), "names": pa.array(out["names"], pa.binary()),
                         "scores": pa.array(out["scores"], pa.binary()), "compared": pa.array(out["compared"], pa.int64())})

    return best


def _merge(k: int):
    def merge(key, table):
        names = np.frombuffer(b"".join(x.as_py() for x in table["names"]), "<i8")
        scores = np.frombuffer(b"".join(x.as_py() for x in table["scores"]), "<f8")
        names, first = np.unique(names, return_index=True)
        scores = scores[first]
        top = np.lexsort((names, -scores))[:k]
        return pa.table({"query": pa.array([key[0].as_py()] * len(top), pa.int64()),
                         "entry": pa.array(names[top], pa.int64()), "score": pa.array(scores[top])})

    return merge


def _entries(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, entry; entries: entry, vector, dim, norm, ids).  A repeated
    id counts once, with the vector that sorts first."""
    usable = ("vec_id IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0) AND "
              "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    rows = (vectors.where(usable).groupBy("vec_id").agg(F.min("vector").alias("vector"))
            .withColumn("same", F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))))
    rows = stored(rows, "vectors")
    first = (rows.withColumn("n", F.row_number().over(Window.partitionBy("same").orderBy("vec_id")))
             .where(F.col("n") <= k + 1))
    entries = (first.groupBy("same").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"),
                                         F.min_by("vector", "n").alias("vector"))
               .withColumn("dim", F.size("vector"))
               .withColumn("norm", F.expr("sqrt(aggregate(vector, 0D, (s, x) -> s + double(x) * x))")))
    entries = stored(entries, "entries")
    named = rows.select("vec_id", "same").join(entries.select("same", "entry"), "same").select("vec_id", "entry")
    return named, entries


@dataclass
class _Size:
    n: int                   # entries
    lift: float | None       # largest norm, where norms differ

    @classmethod
    def of(cls, entries: DataFrame) -> "_Size":
        got = entries.agg(F.max("norm").alias("top"), F.min("norm").alias("low"), F.count("*").alias("n")).first()
        return cls(got.n, got.top if got.n and got.low < (1 - 1e-6) * got.top else None)


def fitted_probes(entries: DataFrame, queries: DataFrame, size: _Size, k: int = K, tables: int = TABLES,
                  sample: int = SAMPLE, wanted: float = WANTED) -> int:
    """Probes a table that meet ``wanted`` of the exact neighbours of ``sample``
    queries.  One pass over the entries; ``sample * (k + 1)`` rows reach the driver."""
    tried = queries.select("entry", "vector", "dim").orderBy(F.xxhash64("entry"), "entry").limit(sample).collect()
    asked = {d: np.array([r.vector for r in tried if r.dim == d], float) for d in {r.dim for r in tried}}
    names = {d: [r.entry for r in tried if r.dim == d] for d in asked}

    def nearest(batches):
        kept = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in set(dims.tolist()) & set(asked):
                rows = np.flatnonzero(dims == d)
                x, ids = _matrix(b.column(1).take(pa.array(rows))), b.column(0).to_numpy()[rows]
                for i, score in enumerate(asked[d] @ x.T):
                    score[ids == names[d][i]] = -np.inf
                    s, e, v = kept.get((d, i), (np.zeros(0), np.zeros(0, np.int64), np.zeros((0, d))))
                    s, e, v = np.concatenate([s, score]), np.concatenate([e, ids]), np.concatenate([v, x])
                    top = np.lexsort((e, -s))[:k]
                    kept[d, i] = s[top], e[top], v[top]
        for (d, i), (s, e, v) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(s), pa.int32()), pa.array([i] * len(s), pa.int32()), pa.array(s), pa.array(e, pa.int64()),
                 pa.array(list(v), pa.list_(pa.float64()))], ["dim", "i", "score", "entry", "vector"])

    order = Window.partitionBy("dim", "i").orderBy(F.desc("score"), "entry")
    true = (entries.select("entry", "vector", "dim")
            .mapInArrow(nearest, "dim int, i int, score double, entry long, vector array<double>")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .where("score > double('-infinity')").collect())
    needed = np.full(len(true), MOST_PROBES)
    for d in asked:
        mine = [j for j, r in enumerate(true) if r.dim == d]
        if not mine:
            continue
        of = np.array([true[j].i for j in mine])
        near = _lift(np.array([true[j].vector for j in mine]), size.lift, True)
        looking = _lift(asked[d], size.lift, False)
        joined = folds(size.n, near.shape[1])
        for t in range(tables):
            same = probed(looking, t, joined, MOST_PROBES)[of] == cells(near, t, joined)[:, None]
            found = np.where(same.any(1), same.argmax(1) + 1, MOST_PROBES)
            needed[mine] = np.minimum(needed[mine], found)
    return int(np.sort(needed)[math.ceil(wanted * len(needed)) - 1]) if len(needed) else 1


def answers(entries: DataFrame, queries: DataFrame, size: _Size, k: int, tables: int, probes: int, part: int) -> DataFrame:
    """(query, names, scores, compared): each group's ``k`` best for each query that looks there."""
    kind, columns = dict(entries.dtypes)["vector"], ["entry", "vector", "dim"]
    ranges = max(1, math.ceil(size.n / part))
    dealt = f"dim int, slot long, entry long, vector {kind}, codes binary"
    index = entries.select(*columns).mapInArrow(_deal(size, tables, ranges, None), dealt)
    looked = queries.select(*columns).mapInArrow(_deal(size, tables, ranges, probes), dealt)
    group = ["dim", "slot"]
    if ranges > 1:
        hot = stored(index.groupBy(*group).count().where(F.col("count") > 2 * part)
                     .select(*group, F.ceil(F.col("count") / part).alias("parts")), "hot")
        if not hot.isEmpty():
            parts = F.coalesce(F.col("parts"), F.lit(1))
            index = index.join(hot, group, "left").withColumn("part", F.pmod("entry", parts)).drop("parts")
            looked = (looked.join(hot, group, "left")
                      .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts"))
            group = [*group, "part"]
    return index.groupBy(*group).cogroup(looked.groupBy(*group)).applyInArrow(_best(k), ANSWER)


def neighbours(vectors: DataFrame, query_ids: DataFrame, k: int = K, tables: int = TABLES, probes: int | None = None,
               id_col: str = "vec_id", vector_col: str = "embedding", part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each id in
    ``query_ids`` (column ``query_id``) among all other rows, ranked by inner
    product, then by smaller id; all of them where there are fewer.  ``probes``:
    cells a table (default: fitted on a sample).

    Null ids and vectors that are null, empty, zero or hold a null or
    non-finite component take no part, as queries too.  Vectors of different
    lengths are never compared.
    """
    named, entries = _entries(vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                                             F.col(vector_col).alias("vector")), k)
    size = _Size.of(entries)
    parts = max(1, math.ceil(size.n / part))
    asked = stored(named.join(query_ids.select("query_id").distinct(), F.col("vec_id") == F.col("query_id"))
                   .select("query_id", F.col("entry").alias("query")), "queries")
    queries = entries.join(asked.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi")
    columns = ["entry", "vector", "dim"]
    if probes is None:
        probes = fitted_probes(entries, queries, size, k, tables)
    hits = answers(entries, queries, size, k + 1, tables, probes, part)
    pairs = "query long, entry long, score double"
    best = stored(hits.groupBy("query").applyInArrow(_merge(k + 1), pairs), "best")

    # queries that met too few: against every entry of their length, part by part
    met = best.join(entries.select("entry", F.size("ids").alias("n")), "entry").groupBy("query").agg(F.sum("n").alias("met"))
    there = entries.groupBy("dim").agg(F.sum(F.size("ids")).alias("there"))
    short = stored(queries.join(there, "dim").join(met, F.col("entry") == F.col("query"), "left")
                   .where(F.coalesce("met", F.lit(0)) < F.least(F.col("there"), F.lit(k + 1))).select(*columns), "short")
    if not short.isEmpty():
        spread = F.pmod(F.col("entry"), F.lit(parts))
        no_cells = F.lit(None).cast("binary").alias("codes")
        everything = entries.select("dim", spread.alias("part"), "entry", "vector", no_cells)
        again = short.select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).cast("long").alias("part"),
                             "entry", "vector", no_cells)
        hits = everything.groupBy("dim", "part").cogroup(again.groupBy("dim", "part")).applyInArrow(_best(k + 1), ANSWER)
        best = best.join(short.select(F.col("entry").alias("query")), "query", "left_anti").unionByName(
            hits.groupBy("query").applyInArrow(_merge(k + 1), pairs))

    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = (best.join(entries.select("entry", "ids"), "entry")
             .select("query", "score", F.explode("ids").alias("vec_id"))
             .withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1))
    ranked = Window.partitionBy("query_id").orderBy("n")
    return (asked.join(found, "query").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the 20 nearest of every 20th vector."""
    from .sources import table

    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id")))
