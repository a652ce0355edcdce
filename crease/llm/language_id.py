"""Language ID: Bayesian evidence fusion over web pages.

For every page and language the log posterior adds up

* text: log-likelihood of the visible text's byte trigrams (``DIM`` hashed
  buckets, counted over all labelled documents, add-``SMOOTH``), times ``TEMPER``
  as each byte is in three trigrams;
* markup: log P(declared language | language), address: log P(last host label |
  language), both from soft counts over all pages;
* host prior: the languages of the host's other pages, smoothed towards those of
  its domain (last two labels), and those towards the whole crawl's -- a
  Dirichlet of ``STRENGTH`` pseudo-pages at each level.  A page's own soft count
  is taken out of its host's and domain's sums first.

Soft counts are the pages' text-only posteriors.  Everything after the text
pass is grouped aggregation of a few numbers per page: counts are combined
before the shuffle, and joined back on the host, so a host with a third of all
pages is one small row (the skew join splits its pages).
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources import stored
from .textops import LOWER, row_slices, text_bytes

DIM = 1 << 14
SMOOTH = 0.5
TEMPER = 1 / 3
STRENGTH = 5.0
LEAST_SHARE = 0.001            # of the labelled documents, for a label to be a language: 1,000 languages at most
NONE, OTHER = "", "?"          # nothing declared; a language that no document has

_HIDING = re.compile(r"<!--|<(script|style|noscript|template)\b", re.IGNORECASE | re.ASCII)
_ENDS = {"": re.compile("-->"), **{x: re.compile(rf"</{x}\s*>", re.IGNORECASE | re.ASCII)
                                   for x in ("script", "style", "noscript", "template")}}
_TAG = re.compile(r"<[^<>]*>")
_TELLING = re.compile(r"<(html|meta)\b", re.IGNORECASE | re.ASCII)
_ATTRIBUTE = re.compile(r"(?<![\w:-])([a-z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))", re.IGNORECASE | re.ASCII)
_CODE = re.compile(r"\s*([a-z]{2,3})\b", re.IGNORECASE | re.ASCII)
_HUGE_REFERENCE = re.compile(r"&#[0-9]{1000,}+;?")        # more digits than int() takes; no character


def shown(page: str) -> str:
    """The page without comments, scripts, styles and the like; one that never
    ends hides nothing.  One forward scan: an end that is missing once is never
    looked for again."""
    kept, at, endless, pos = [], 0, set(), 0
    while m := _HIDING.search(page, pos):
        kind = (m[1] or "").lower()
        end = None if kind in endless else _ENDS[kind].search(page, m.end())
        if end is None:
            endless.add(kind)
            pos = m.end()
            continue
        kept.append(page[at:m.start()])
        at = pos = end.end()
    return " ".join([*kept, page[at:]])


def visible(page: str | None) -> str:
    return html.unescape(_HUGE_REFERENCE.sub("\ufffd", _TAG.sub(" ", shown(page or ""))))


def declared(page: str | None) -> str:
    """The language that the first ``<html ...>`` tag names, or the first
    content-language ``<meta ...>`` where that stands before it or it names none."""
    page, pos, opened = page or "", 0, False
    while m := _TELLING.search(page, pos):
        end = page.find(">", m.end())
        if end < 0:
            break
        pos, tag = end, m[1].lower()
        if tag == "html" and opened:
            continue
        opened |= tag == "html"
        given = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in reversed(list(_ATTRIBUTE.finditer(page, m.end(), end)))}
        if tag == "html":
            said = given.get("lang") or given.get("xml:lang")
        else:
            said = given.get("content") if given.get("http-equiv", "").strip().lower() == "content-language" else None
        if code := _CODE.match(said or ""):
            return code[1].lower()
    return NONE


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix), lower-cased; empty where there is none."""
    try:
        host = (urlsplit((url or "").strip()).hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    if len(labels) < 2 or labels[-1].isdigit() or ":" in host:
        return host, host, ""
    return host, ".".join(labels[-2:]), labels[-1]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every byte trigram, ASCII letters lower-cased."""
    data, bounds = text_bytes(texts)
    x = LOWER[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = of[:-2] == of[2:]
    return (key >> np.uint32(18)).astype(np.int64)[inside], of[:-2][inside]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          least_share: float = LEAST_SHARE) -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)), counted over all labelled documents.

    A language is a label's primary subtag of two or three letters, in any case
    (``de``, ``DE-at``); rows with any other label are not labelled, nor are those
    of a code that fewer than ``LEAST_SHARE`` of the labelled documents bear.  That
    bounds the model: ``DIM`` numbers for each of 1 / ``LEAST_SHARE`` codes at most.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = np.array(b.column(1).to_pylist(), object)
            for lo, hi in row_slices(b.column(0)):
                at, of = trigrams(b.column(0).slice(lo, hi - lo))
                for name in set(names[lo:hi]):
                    got = np.bincount(at[(names[lo:hi] == name)[of]], minlength=DIM)
                    sums[name] = sums.get(name, 0) + got
        for name, got in sums.items():
            seen = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()),
                                              pa.array(got[seen])], ["lang", "bucket", "n"])

    code = F.lower(F.regexp_extract(F.col(lang_col).cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*|\s*)$", 1))
    labelled = docs.select(F.col(text_col).alias("text"), code.alias("lang")).where("lang <> ''")
    bearers = labelled.groupBy("lang").count()
    labels = bearers.agg(F.sum("count")).first()[0] or 0
    common = [r.lang for r in bearers.where(F.col("count") >= least_share * labels).collect()]
    sums = (labelled.where(F.col("lang").isin(*common)).mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            .toPandas())                             # DIM rows a language at most
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((len(langs), DIM))
    counts[sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), sums["bucket"]] = sums["n"]
    return langs, np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * DIM))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """One row per page: id, host, suffix, declared, ``text_lang`` (text alone),
    ``lang`` and ``posterior`` (its probability), ``posteriors`` by language.

    Null or empty pages have no text evidence: the other evidence decides.  A
    null or unreadable address has the empty host.  Ties go to the language that
    sorts first.  Repeated rows are pages of their own.  Without a labelled
    document there are no languages: ``lang`` is null.
    """
    langs, weights = model
    n = len(langs)

    def read(batches):
        for b in batches:
            for lo, hi in row_slices(b.column(2)):
                pages = b.column(2).slice(lo, hi - lo).to_pylist()
                hosts = [address(u) for u in b.column(1).slice(lo, hi - lo).to_pylist()]
                said = [d if d in langs or d == NONE else OTHER for d in map(declared, pages)]
                at, of = trigrams(pa.array([visible(p) for p in pages], pa.large_string()))
                logs = np.stack([np.bincount(of, w[at], len(pages)) for w in weights], 1) if n else np.zeros((len(pages), 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), *[pa.array(x, pa.string()) for x in zip(*hosts)],
                     pa.array(said, pa.string()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(pages) + 1, dtype=np.int32) * n),
                                              pa.array(TEMPER * logs.ravel()))],
                    ["id", "host", "domain", "suffix", "declared", "logs"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["id"]
    seen = stored(rows.mapInArrow(read, f"id {kind}, host string, domain string, suffix string, declared string, "
                                        "logs array<double>"), "pages")
    if not n:
        return seen.select(F.col("id").alias(id_col), "host", "suffix", "declared",
                           *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")],
                           F.lit(None).cast("double").alias("posterior"), F.array().cast("array<double>").alias("posteriors"))
    seen = seen.withColumn("soft", _softmax(F.col("logs")))

    hosts = stored(seen.groupBy("host", "domain").agg(_sums("soft", n).alias("host_n")), "hosts")
    domains = hosts.groupBy("domain").agg(_sums("host_n", n).alias("domain_n"))
    total = [float(x or 0) for x in domains.select(_sums("domain_n", n).alias("t")).first()["t"]]
    base = F.array(*[F.lit((x + 1) / (sum(total) + n)) for x in total])

    def given(column: str) -> DataFrame:
        """log P(value | language) of each value of ``column``, from soft counts."""
        counts = seen.groupBy(column).agg(_sums("soft", n).alias("c"))
        logs = F.array(*[F.log((F.col("c")[i] + 1) / F.lit(total[i] + 1)) for i in range(n)])
        return counts.select(column, logs.alias(f"{column}_logs"))

    def smoothed(counts: Column, own: Column, parent: Column) -> Column:
        left = F.zip_with(counts, own, lambda c, x: F.greatest(c - x, F.lit(0.0)))
        size = F.aggregate(left, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(left, parent, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))

    fused = (seen.join(hosts.drop("domain"), "host").join(domains, "domain")
             .join(F.broadcast(given("declared")), "declared")        # a row a language, and two
             .join(given("suffix"), "suffix")
             .withColumn("domain_prior", smoothed(F.col("domain_n"), F.col("soft"), base))
             .withColumn("prior", smoothed(F.col("host_n"), F.col("soft"), F.col("domain_prior")))
             .withColumn("posteriors", _softmax(_add(F.col("logs"), F.col("declared_logs"), F.col("suffix_logs"),
                                                     F.transform("prior", lambda x: F.log(x))))))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select(F.col("id").alias(id_col), "host", "suffix", "declared", best(F.col("soft")).alias("text_lang"),
                        best(F.col("posteriors")).alias("lang"), F.array_max("posteriors").alias("posterior"),
                        "posteriors")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every page."""
    from .sources import table

    return identify(table(spark, sf_dir, "pages"), learn(table(spark, sf_dir, "documents")))
