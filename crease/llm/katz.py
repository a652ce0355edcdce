"""LM scoring: a Katz backoff bigram model, trained and evaluated over blocks.

Tokens are a text's words (ASCII letters lower-cased) and one end; the first is
conditioned on a begin mark.  With c() the counts of the training texts:

    P(w | h) = d(c(hw)) c(hw) / c(h)            if c(hw) > 0
             = alpha(h) P(w)                    else, alpha = 1 for an unseen h
    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))

d is Katz's Good-Turing discount for counts up to ``K``; larger counts lose
``TAIL`` so that every context leaves some mass.  alpha(h) is the left mass over
the lower-order mass of the words not seen after h, summed exactly over h's
counted bigrams, so each context's probabilities add up to 1 over the V words,
the end included, and one unknown.

Plan (words and bigrams are 64-bit hashes; nothing corpus-sized is broadcast).
1. Documents are dealt into blocks (texts travel deflated).  A block sends its
   distinct words and bigrams with their training counts, sorted and packed by
   bucket of the hash: a word that fills the corpus is one entry per block.
2. A bucket adds up the counts and answers every block, in the order of its
   request: total count, and whether this block is the first to have trained on
   it (its owner).
3. The block, which reads the same shuffle again, now knows c(w) and c(hw) of
   all its tokens.  It writes, to a table partitioned by kind: per document the
   sums from which both scores follow; per context, from the bigrams it owns,
   the counts of counts and the lower-order mass; per document the contexts it
   backed off from; and its share of N, V and the bigram counts of counts.
4. Contexts meet in buckets, get their alpha, and answer the documents that
   backed off.  A join on the document adds it all up.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, count_blocks, hashed_block
from .hashes import bucket_edges, pack, unpack
from .sources import stored
from .textops import mix, row_slices, split

K = 5
TAIL = 0.5
ADD = 0.1
FOLDS = 10
BEGIN, END = np.uint64(0xB5297A4D3F84D5A3), np.uint64(0x68E31DA4C19B7F21)
WORD, PAIR = 0, 1

_REQUEST = "kind int, bucket int, block int, keys binary, counts binary"
_ANSWER = "kind int, bucket int, _block int, totals binary"
_FACTS = ("kind string, bucket int, keys binary, values binary, rows binary, doc long, doc_id long, held_out boolean, "
          "n_tokens long, n_known long, base double, seen double, from_begin long, by_count array<long>, "
          "n_back long, back double, n_train long, n_vocabulary long, n_texts long, of_counts array<long>")


def _squeeze(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _spread(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def _deflate(batches):
    for b in batches:
        texts = [zlib.compress((t or "").encode(), 1) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(texts, pa.binary())],
                                         ["doc_id", "held_out", "_block", "text"])


def _tokens(table: pa.Table):
    """(token, context, bigram, document, first token of each document) of a block."""
    token, size = [], []
    texts = pa.array([zlib.decompress(x) for x in table["text"].to_pylist()], pa.large_binary()).cast(pa.large_string())
    for lo, hi in row_slices(texts):
        s = split(texts.slice(lo, hi - lo), lower=True)
        token.append(np.insert(s.hash, s.offsets[1:], END))
        size.append(np.diff(s.offsets) + 1)
    token, size = np.concatenate(token), np.concatenate(size)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    context = np.concatenate([token[:1], token[:-1]])
    context[first] = BEGIN
    return token, context, mix(context * np.uint64(0xD6E8FEB86659FD93) + token), np.repeat(np.arange(len(size)), size), first


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """d(1) .. d(K) from the numbers of bigrams counted 1 .. K + 1 times; where
    Good-Turing gives none between 0 and 1, (r - TAIL) / r."""
    n = np.concatenate([[0.0], np.asarray(of_counts, float)])
    plain = np.array([(r - TAIL) / r for r in range(1, K + 1)])
    if n[1] == 0 or (K + 1) * n[K + 1] >= n[1]:
        return plain
    common = (K + 1) * n[K + 1] / n[1]
    got = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] else -1.0 for r in range(1, K + 1)]
    return np.where((np.array(got) > 0) & (np.array(got) < 1), got, plain)


def _facts(docs: DataFrame, id_col: str, text_col: str, folds: int, block_bytes: int) -> tuple[DataFrame, np.ndarray]:
    """(the written facts, the buckets' edges)."""
    blocks = count_blocks(docs, text_col, block_bytes)
    edges = bucket_edges(blocks)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         held.alias("held_out"), hashed_block(id_col, text_col, blocks).alias("_block"))
             .mapInArrow(_deflate, "doc_id long, held_out boolean, _block int, text binary"))

    def ask(key, table):
        token, _, pair, doc, _ = _tokens(table)
        train = ~table["held_out"].to_numpy()[doc]
        out = []
        for kind, keys in ((WORD, token), (PAIR, pair)):
            names, place = np.unique(keys, return_inverse=True)
            counts = np.bincount(place[train], minlength=len(names)).astype("<u4")
            at = np.searchsorted(names, edges)
            out += [(kind, b, key[0].as_py(), pack(names[lo:hi]), _squeeze(counts[lo:hi]))
                    for b, (lo, hi) in enumerate(itertools.pairwise([*at, len(names)])) if hi > lo]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["kind", "bucket", "block", "keys", "counts"])

    def total(key, table):
        top = int(edges[key[1].as_py()]) >> 56
        table = table.sort_by("block")
        keys = [unpack(x.as_py(), top) for x in table["keys"]]
        counts = np.concatenate([_spread(x.as_py(), "<u4") for x in table["counts"]]).astype(np.int64)
        ends = np.cumsum([len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")             # ascending block inside a key
        head = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        group = np.cumsum(head) - 1
        sums = np.add.reduceat(counts[order], np.flatnonzero(head))
        trained = np.flatnonzero(counts[order] > 0)
        owner = trained[np.unique(group[trained], return_index=True)[1]]
        answer = np.empty(len(keys), "<u8")
        answer[order] = sums[group] * 2
        answer[order[owner]] += 1
        return pa.table({"kind": pa.array([key[0].as_py()] * len(ends), pa.int32()),
                         "bucket": pa.array([key[1].as_py()] * len(ends), pa.int32()), "_block": table["block"],
                         "totals": pa.array([_squeeze(x) for x in np.split(answer, ends[:-1])], pa.binary())})

    def settle(key, table, answers):
        if not table.num_rows:
            return pa.Table.from_pylist([], schema=_arrow_schema())
        token, context, pair, doc, first = _tokens(table)
        held = table["held_out"].to_numpy()
        n = len(held)
        got = {}
        for kind, keys in ((WORD, token), (PAIR, pair)):
            mine = answers.filter(pc.equal(answers["kind"], kind)).sort_by("bucket")
            names, place = np.unique(keys, return_inverse=True)
            said = np.concatenate([_spread(x.as_py(), "<u8") for x in mine["totals"]])
            got[kind] = names, place, (said >> np.uint64(1)).astype(np.int64), (said & np.uint64(1)).astype(bool)
        _, word_at, word_total, word_own = got[WORD]
        pair_names, pair_at, pair_total, pair_own = got[PAIR]
        c_w, c_hw = word_total[word_at], pair_total[pair_at]
        begins = np.zeros(len(token), bool)
        begins[first] = True
        c_h = np.concatenate([[0], c_w[:-1]])
        c_h[begins] = 1                                       # its logarithm is added when it is known
        base, seen = np.log10(c_w + ADD), c_hw > 0
        likelihood = np.log10(np.where(c_hw > K, c_hw - TAIL, np.maximum(c_hw, 1)) / np.maximum(c_h, 1))
        add = lambda v: np.bincount(doc, v, n)
        whole = lambda v: add(v).astype(np.int64)
        ids = (np.int64(key[0].as_py()) << 32) + np.arange(n)
        facts = {"kind": ["doc"] * n, "doc": ids, "doc_id": table["doc_id"].to_pylist(), "held_out": held,
                 "n_tokens": whole(np.ones(len(token))), "n_known": whole(c_w > 0), "base": add(base),
                 "seen": add(np.where(seen, likelihood, 0)), "from_begin": whole(seen & begins),
                 "by_count": np.stack([whole(c_hw == r) for r in range(1, K + 1)], 1).tolist(),
                 "n_back": whole(~seen), "back": add(np.where(seen, 0, base))}
        out = [_table(facts)]

        # contexts, from the bigrams this block owns
        one = np.empty(len(pair_names), np.int64)
        one[pair_at] = np.arange(len(token))                   # any token with the bigram
        one = one[pair_own]
        count = pair_total[pair_own]
        names, place = np.unique(context[one], return_inverse=True)
        sums = [np.bincount(place, count == r, len(names)) for r in range(1, K + 1)]
        sums += [np.bincount(place, v, len(names)) for v in (count > K, np.where(count > K, count, 0), c_w[one])]
        sums = np.stack(sums).astype("<i8")
        # contexts that documents backed off from
        back = ~seen & ((c_h > 0) | begins)
        order = np.lexsort((doc[back], context[back]))
        pairs = np.stack([context[back][order], doc[back][order].astype(np.uint64)])
        head = np.flatnonzero(np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])[: len(order)])
        pairs, times = pairs[:, head], np.diff(np.append(head, len(order)))
        at, to = np.searchsorted(names, edges), np.searchsorted(pairs[0], edges)
        packed = {"kind": [], "bucket": [], "keys": [], "values": [], "rows": []}
        for b, (lo, hi) in enumerate(itertools.pairwise([*at, len(names)])):
            if hi > lo:
                for c, v in zip(packed, ("context", b, pack(names[lo:hi]), _squeeze(sums[:, lo:hi]), None)):
                    packed[c].append(v)
        for b, (lo, hi) in enumerate(itertools.pairwise([*to, len(times)])):
            if hi > lo:
                for c, v in zip(packed, ("back", b, pack(pairs[0, lo:hi]), _squeeze(times[lo:hi].astype("<i8")),
                                         _squeeze(ids[pairs[1, lo:hi].astype(np.int64)].astype("<i8")))):
                    packed[c].append(v)
        out.append(_table(packed))
        train = ~held
        out.append(_table({"kind": ["sum"], "n_train": [int(train[doc].sum())], "n_vocabulary": [int(word_own.sum())],
                           "n_texts": [int(train.sum())],
                           "of_counts": [[int((count == r).sum()) for r in range(1, K + 2)]]}))
        return pa.concat_tables(out)

    by_block = dealt.groupBy("_block")
    answers = by_block.applyInArrow(ask, _REQUEST).groupBy("kind", "bucket").applyInArrow(total, _ANSWER)
    facts = by_block.cogroup(answers.groupBy("_block")).applyInArrow(settle, _FACTS)
    return stored(facts, "katz", partition_by=["kind"]), edges


def _arrow_schema() -> pa.Schema:
    plain = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(),
             "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, plain[kind]) for name, kind in (x.split() for x in _FACTS.split(", "))])


def _table(columns: dict) -> pa.Table:
    n = len(columns["kind"])
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                     for f in _arrow_schema()], _arrow_schema())


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Train on the rows whose crc32(id as text) mod ``folds`` is not 0 and score
    every row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10).

    Null and empty texts are a single end.  Rows with a null id are held out.
    Repeated rows count, and are scored, each.  Without training texts only the
    unknown has mass: base score 0.
    """
    facts, edges = _facts(docs, id_col, text_col, folds, block_bytes)
    sums = facts.where("kind = 'sum'").agg(
        F.sum("n_train").alias("n"), F.sum("n_vocabulary").alias("v"), F.sum("n_texts").alias("texts"),
        *[F.sum(F.col("of_counts")[r]).alias(f"n{r}") for r in range(K + 1)]).first()
    n_train, n_vocabulary = sums.n or 0, sums.v or 0
    size = n_train + ADD * (n_vocabulary + 1)
    d = discounts([sums[f"n{r}"] or 0 for r in range(K + 1)])

    def back_off(key, table):
        kinds = table["kind"].to_pylist()
        top = int(edges[key[0].as_py()]) >> 56
        read = lambda kind: [i for i, k in enumerate(kinds) if k == kind]
        asked, given = read("back"), read("context")
        if not asked or not given:              # a context never trained on: alpha = 1
            return pa.table({"doc": pa.array([], pa.int64()), "alpha": pa.array([], pa.float64())})
        take = lambda column, rows: [table[column][i].as_py() for i in rows]
        names = np.concatenate([unpack(x, top) for x in take("keys", given)])
        values = np.concatenate([_spread(x, "<i8").reshape(K + 3, -1) for x in take("values", given)], 1)
        order = np.argsort(names, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
        values = np.add.reduceat(values[:, order], head, axis=1).astype(float)
        names = names[order][head]
        r = np.arange(1, K + 1)
        total = r @ values[:K] + values[K + 1]
        left = 1 - ((d * r) @ values[:K] + values[K + 1] - TAIL * values[K]) / total
        unseen = 1 - (values[K + 2] + ADD * values[: K + 1].sum(0)) / size
        alpha = np.log10(left / unseen)
        keys = np.concatenate([unpack(x, top) for x in take("keys", asked)])
        times = np.concatenate([_spread(x, "<i8") for x in take("values", asked)])
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        times = np.where(names[at] == keys, times * alpha[at], 0)
        rows, place = np.unique(np.concatenate([_spread(x, "<i8") for x in take("rows", asked)]), return_inverse=True)
        return pa.table({"doc": rows, "alpha": np.bincount(place, times, len(rows))})

    weights = (facts.where("kind IN ('context', 'back')").select("bucket", "kind", "keys", "values", "rows")
               .groupBy("bucket").applyInArrow(back_off, "doc long, alpha double")
               .groupBy("doc").agg(F.sum("alpha").alias("alpha")))
    seen = F.col("seen") - F.col("from_begin") * float(np.log10(max(sums.texts or 0, 1)))
    for r in range(K):
        seen = seen + F.col("by_count")[r] * float(np.log10(d[r]))
    back = F.col("back") - F.col("n_back") * float(np.log10(size)) + F.coalesce("alpha", F.lit(0.0))
    return (facts.where("kind = 'doc'").join(weights, "doc", "left")
            .select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known",
                    F.lit(n_train).cast("long").alias("train_tokens"),
                    (F.col("base") - F.col("n_tokens") * float(np.log10(size))).alias("base_score"),
                    (seen + back).alias("score")))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: scores of every document."""
    from .sources import table

    return score(table(spark, sf_dir, "documents"))
