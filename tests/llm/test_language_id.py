"""Language ID: parsing, agreement with declared pages, the fusion by hand."""

import time

import numpy as np
from pyspark.sql import functions as F

from crease.llm import language_id as g

SCHEMA = "page_id long, url string, html string"


def test_parsing():
    assert g.address("http://Blog.Example.COM:80/x") == ("blog.example.com", "example.com", "com")
    assert g.address("https://10.0.0.1/") == ("10.0.0.1", "10.0.0.1", "")
    assert g.address("http://localhost/") == ("localhost", "localhost", "")
    assert g.address(None) == g.address("http://[bad") == g.address("") == ("", "", "")
    assert g.declared('<!doctype html><HTML class=a lang="DE-at">') == "de"
    assert g.declared("<html lang=fr>") == "fr" and g.declared("<html><p lang='es'>") == "" == g.declared(None)
    assert g.declared('<meta http-equiv="content-language" content="es">') == "es"
    assert g.visible("<p>a&amp;b<script>x<y</script><!-- c --><b>d</b>").split() == ["a&b", "d"]


def test_unclosed_pages_are_read_in_linear_time():
    began = time.perf_counter()
    for unit in ("<html ", "<script ", "<!--", "<style><template>", "<meta content-language ", "<html a", "a ", '<meta a="',
                 "<meta http-equiv=content-language content=", "<", "&#", "</script ", "<html lang=  "):
        for end in ("", ">", "x</p>"):
            page = unit * ((1 << 20) // len(unit)) + end
            g.visible(page), g.declared(page)
    assert time.perf_counter() - began < 39                        # a second a page
    assert g.visible("a<script>b<!--c-->d") == "a b d" and g.visible("a<!--b<style>c</STYLE >d").split() == ["a<!--b", "d"]
    assert g.visible("&#" + "9" * 5000 + ";x") == "\ufffdx" and g.visible("&#65;") == "A"


def test_declarations():
    assert g.declared("<html><html lang=fr>") == ""                 # the first tag only
    assert g.declared('<meta content=" es-MX" http-equiv=Content-Language><html lang=fr>') == "es"
    assert g.declared("<html xml:lang='pt'>") == "pt" and g.declared("<html data-lang=de>") == ""
    assert g.declared("<html lang='english'>") == g.declared("<html lang>") == g.declared("<html lang=") == ""
    assert g.declared("<html lang=de lang=fr>") == "de"


def test_hidden_declarations_are_found_from_the_other_evidence(spark):
    """A fifth of the pages lose their declaration; the model says what it was."""
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    hidden = F.crc32(F.col("page_id").cast("string")) % 5 == 0
    bare = F.regexp_replace("html", r"(?i)\blang\s*=\s*[\"']?[a-zA-Z-]*[\"']?", "")
    model = g.learn(spark.read.parquet(f"{d}/documents.parquet"))
    got = g.identify(pages.withColumn("html", F.when(hidden, bare).otherwise(F.col("html"))), model).toPandas().set_index("page_id")
    said = {r.page_id: g.declared(r.html) for r in pages.where(hidden).collect()}
    tried = [i for i, x in said.items() if x in model[0]]
    assert len(tried) > 20 and (got.loc[tried, "declared"] == "").all()
    right = sum(got.loc[i, "lang"] == said[i] for i in tried) / len(tried)
    print("hidden declarations", len(tried), right)
    assert right >= 0.95


def test_rare_labels_are_no_languages(spark):
    rows = [("der die das", "de")] * 30 + [("the and of", "en")] * 30 + [("zz zz zz", "qq")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert g.learn(docs, least_share=0.1)[0] == ["de", "en"] and g.learn(docs)[0] == ["de", "en", "qq"]


def test_pages_of_the_test_table(spark):
    d = "/root/testdata/sf0.01"
    got = g.query(spark, d).toPandas()
    assert len(got) == spark.read.parquet(f"{d}/pages.parquet").count()
    assert (got.lang == got.declared).mean() >= 0.99 and got.posterior.between(0, 1).all()


def model():
    logs = np.full((2, g.DIM), -10.0)
    import pyarrow as pa

    for k, text in enumerate(("der und die", "the and of")):
        logs[k, g.trigrams(pa.array([text]))[0]] = -3.0
    return ["de", "en"], logs


def fused(pages, langs, logs):
    """The documented sums, by hand."""
    import pyarrow as pa

    soft, text = [], []
    for _, _, page in pages:
        at, _ = g.trigrams(pa.array([g.visible(page)]))
        text.append(g.TEMPER * logs[:, at].sum(1))
        e = np.exp(text[-1] - text[-1].max())
        soft.append(e / e.sum())
    soft = np.array(soft)
    host, domain, suffix = zip(*(g.address(u) for _, u, _ in pages))
    said = [x if x in langs or x == "" else "?" for x in (g.declared(p) for _, _, p in pages)]
    total = soft.sum(0)
    base = (total + 1) / (total.sum() + len(langs))
    out = []
    for i in range(len(pages)):
        same = lambda xs: soft[[k for k in range(len(pages)) if xs[k] == xs[i]]].sum(0)
        smooth = lambda c, p: (np.maximum(c, 0) + g.STRENGTH * p) / (np.maximum(c, 0).sum() + g.STRENGTH)
        prior = smooth(same(host) - soft[i], smooth(same(domain) - soft[i], base))
        s = text[i] + np.log((same(said) + 1) / (total + 1)) + np.log((same(suffix) + 1) / (total + 1)) + np.log(prior)
        e = np.exp(s - s.max())
        out.append(e / e.sum())
    return np.array(out)


def test_fusion_equals_the_sums_by_hand(spark):
    langs, logs = model()
    pages = [(1, "http://a.x.de/1", "<html lang=de>der und"), (2, "http://a.x.de/2", "the"), (3, "http://b.x.de", "<html lang=de>"),
             (4, "http://y.com", "<html lang=en>the and"), (5, "http://y.com", "of"), (6, None, None), (7, "http://y.com", ""),
             (7, "http://y.com", ""), (None, "http://z.org", "<html lang=sv>die")]
    got = g.identify(spark.createDataFrame(pages, SCHEMA), (langs, logs)).collect()
    key = lambda r: (r.page_id is None, r.page_id or 0)
    want = fused(pages, langs, logs)
    assert len(got) == len(pages)
    for r, w in zip(sorted(got, key=key), want):
        assert np.allclose(r.posteriors, w, atol=1e-9) and r.lang == langs[int(w.argmax())]


def test_empty_tables(spark):
    assert g.identify(spark.createDataFrame([], SCHEMA), model()).count() == 0
    docs = spark.createDataFrame([("x", None), (None, None)], "text string, lang string")
    langs, _ = learnt = g.learn(docs)
    assert langs == []
    odd = [("aber", "DE-at"), ("aber", " de "), ("hello", "en"), ("x", "english"), ("x", "1"), ("x", "")]
    assert g.learn(spark.createDataFrame(odd, "text string, lang string"))[0] == ["de", "en"]
    got = g.identify(spark.createDataFrame([(1, "http://a.de", "hallo")], SCHEMA), learnt).collect()
    assert [(r.page_id, r.lang) for r in got] == [(1, None)]
