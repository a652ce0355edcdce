"""Benchmark decontamination: a distributed positional inverted index.

The index is a stored table of postings, one row per word of the training
texts: the word (``term``), the row of its document and its position there,
sorted by term inside every file.  It is partitioned by document: each task
turns its own documents into postings and sorts them by the term's 64-bit code
(a radix sort), so building shuffles nothing, and the list of a word that fills
a third of the corpus is spread over all files.

A phrase (a run of words of a test item) is looked up from its rarest terms:

1. list lengths of all test terms, by one pass over the index;
2. the lists of each phrase's two shortest terms, shifted by their places in
   the phrase, are intersected on (document, place): candidates.  Phrases that
   share the two terms at the same distance share this work;
3. the candidates' other terms must stand at their places: the needed postings
   are looked up in the index by (document, position, term).

With ``slop`` the same steps give proximity matches: a term may stand up to
``slop`` words from its place, measured from the rarest term's occurrence.

Terms are compared as text; codes only sort and select.  All steps are
DataFrame operations.  Test-side tables (terms, hooks, candidates' documents)
are broadcast if they have at most ``BROADCAST_ROWS`` rows, counted on the
stored table; beyond that Spark shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import broadcast_upto, lower_ascii
from .sources import stored, table

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000       # rows of a few dozen bytes: tens of MB at most
HEADER = ""                    # the term of a document's first index row; no word is empty


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``docs``: ``code, term, row, pos, id, n_words``.

    Every row of ``docs`` gets a ``row`` number of its own, so null or repeated
    ids and repeated rows stay apart.  Its words have positions from 1; position
    0 holds its header (term ``HEADER``) with ``id`` and ``n_words``, which are
    null elsewhere.  Documents without words have a header only.  Other columns
    of ``docs`` are not read, whatever their names.
    """
    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.concat(F.array(F.lit(HEADER)), words(F.col(text_col))).alias("terms"))
    each = each.select("row", "id", F.size("terms").alias("size"), F.posexplode("terms").alias("pos", "term"))
    head = F.col("pos") == 0
    postings = each.select(F.xxhash64("term").alias("code"), "term", "row", "pos", F.when(head, F.col("id")).alias("id"),
                           F.when(head, (F.col("size") - 1).cast("long")).alias("n_words"))
    return stored(postings.sortWithinPartitions("code"), "postings")


def headers(index: DataFrame) -> DataFrame:
    """``row, id, n_words`` of every document."""
    return (index.where((F.col("code") == F.xxhash64(F.lit(HEADER))) & (F.col("pos") == 0))
            .select("row", "id", "n_words"))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``item, terms``: every run of ``width`` consecutive words of an item; an
    item of fewer words, but not none, is one run.  Null texts have no words."""
    each = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))).alias("at")
    return each.select("item", "w", at).select("item", F.slice("w", F.col("at"), F.lit(width)).alias("terms"))


def _hooks(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Of every phrase whose terms all occur: its two rarest terms with their
    places (``t1, k1, t2, k2``; the second null in a phrase of one word)."""
    place = phrases.select("phrase", F.posexplode("terms").alias("k", "term"))
    test = stored(place.select("term").distinct().withColumn("code", F.xxhash64("term")), "test_terms")
    lists = index.join(broadcast_upto(test, BROADCAST_ROWS), ["code", "term"], "left_semi").groupBy("term")
    length = lists.agg(F.count(F.lit(1)).alias("n"))
    ranked = (place.join(length, "term", "left")
              .groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "k")))
                                     .alias("by"))
              .where(F.col("by")[0]["n"] > 0))
    second = F.get("by", F.lit(1))
    return ranked.select("phrase", F.col("by")[0]["term"].alias("t1"), F.col("by")[0]["k"].alias("k1"),
                         second["term"].alias("t2"), second["k"].alias("k2"))


def find(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Matches of ``phrases`` (``phrase`` unique, ``terms`` array, not empty) in
    the index, as a stored table ``phrase, row, start``: document row and the
    position of the phrase's first term, all matches, each once.

    ``slop`` 0: exact phrases.  Otherwise a match has every term within ``slop``
    words of its place, places counted from an occurrence of the phrase's rarest
    term (shortest list; of equals, the smaller term, then the earlier place);
    ``start`` is where the first term would stand, and may be below 1.
    """
    hooked = stored(_hooks(index, phrases), "hooks")
    pair = F.struct("t1", "t2", (F.col("k2") - F.col("k1")).alias("shift"))
    hook = F.xxhash64(pair).alias("hook")
    near = F.array(*[F.lit(d) for d in range(-slop, slop + 1)])

    # each hook's two lists; two hooks under one code would only add candidates
    lists = hooked.select(hook, F.explode(F.array(
        F.struct(F.col("t1").alias("term"), F.lit(0).alias("shift"), F.lit(1).alias("list")),
        F.struct(F.col("t2").alias("term"), (F.col("k2") - F.col("k1")).alias("shift"), F.lit(2).alias("list")))).alias("x"),
        F.when(F.col("t2").isNull(), 1).otherwise(3).alias("all")).select("hook", "all", "x.*").where("term IS NOT NULL")
    lists = stored(lists.distinct().withColumn("code", F.xxhash64("term")), "hook_lists")
    shifted = index.join(broadcast_upto(lists, BROADCAST_ROWS), ["code", "term"]).select(
        "hook", "all", "row", "list", (F.col("pos") - F.col("shift")).alias("base"))
    if slop:
        shifted = shifted.withColumn("by", F.explode(F.when(F.col("list") == 1, F.array(F.lit(0))).otherwise(near)))
        shifted = shifted.withColumn("base", F.col("base") + F.col("by"))
    met = (shifted.groupBy("hook", "all", "row", "base").agg(F.bit_or("list").alias("met"))
           .where("met = all").select("hook", "row", "base"))
    met = stored(met, "candidates")

    # every other term at its place
    rows = stored(met.select("row").distinct(), "candidate_rows")
    there = index.join(broadcast_upto(rows, BROADCAST_ROWS), "row", "left_semi").select("row", "pos", "term")
    of_hook = broadcast_upto(hooked.join(phrases, "phrase").select(hook, "phrase", "k1", "terms"), BROADCAST_ROWS)
    start = (F.col("base") - F.col("k1")).alias("start")
    asked = (met.join(of_hook, "hook").select("phrase", "row", start, F.size("terms").alias("size"),
                                              F.posexplode("terms").alias("k", "term"))
             .withColumn("pos", F.col("start") + F.col("k")))
    if slop:
        asked = asked.withColumn("by", F.explode(near)).withColumn("pos", F.col("pos") + F.col("by"))
    found = (asked.join(there, ["row", "pos", "term"]).groupBy("phrase", "row", "start")
             .agg(F.count_distinct("k").alias("found"), F.max("size").alias("size")).where("found = size"))
    return stored(found.select("phrase", "row", "start"), "matches")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items,
    contaminated``.

    ``n_hit`` counts the document's words inside any occurrence of a window of
    an item (``item_windows``), ``items`` lists the ids of the items with such
    windows as sorted text (null ids as ''; an id that several items carry
    counts once).  Null texts, on either side, have no words; an empty table on
    either side gives no hits.  Repeated documents are judged one by one.
    """
    index = build_index(docs, id_col, text_col)
    windows = stored(item_windows(items, item_id_col, item_text_col, width), "item_windows")
    phrases = stored(windows.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    matches = find(index, phrases)

    of_phrase = broadcast_upto(phrases.select("phrase", F.size("terms").alias("size")), BROADCAST_ROWS)
    hit = (matches.join(of_phrase, "phrase")
           .select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
           .distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")))
    text = F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")
    owners = windows.join(phrases, "terms").select("phrase", text).distinct()
    found = (matches.select("phrase", "row").distinct().join(owners, "phrase").select("row", "item").distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    return (headers(index).join(hit, "row", "left").join(found, "row", "left")
            .select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: benchmark items found in every document."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      "contaminated")


ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_wins),
doc_wins AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT d.r, d.i, d.size, t.item_id FROM doc_wins d JOIN item_wins t USING (size, key)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       h.n_hit IS NOT NULL AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items i USING (r)
"""
