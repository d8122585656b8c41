import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpora.functions import html, urls
from korpora.functions.text import content_terms, normalize, py_normalize, py_stem, py_tokens, stem_all, tokenize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalise_strips_accents_and_compatibility_forms(spark):
    assert one(spark, normalize(F.lit("Café ＮＡÏＶＥ é ﬁn"))) == "cafe naive e fin"
    assert one(spark, normalize(F.lit(None).cast("string"))) == ""


def test_normalise_is_nfkd_for_every_code_point(spark):
    every = [(c, chr(c)) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    forms = spark.createDataFrame(every, "c int, t string").repartition(8).select("t", normalize(F.concat(F.lit("a"), F.col("t"))).alias("n")).collect()
    want = {t: "".join(x for x in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(x) <= 0x36F) for _, t in every}
    assert [r["t"] for r in forms if r["n"] != "a" + want[r["t"]].lower() and py_normalize("a" + r["t"]) != r["n"]] == []


def test_stems():
    pairs = {"running": "run", "coding": "cod", "code": "cod", "berries": "berry", "classes": "clas", "bus": "bus", "2000": "200", "quickly": "quick", "the": "the"}
    assert {w: py_stem(w) for w in pairs} == pairs


def test_stem_columns_agree_with_the_driver(spark):
    words = [a + b for a in ("run", "cod", "glas", "bel", "tre", "x", "199") for b in ("", "s", "es", "ies", "sses", "ing", "ed", "ly", "e", "ll", "eed", "us", "is", "nning")]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stem_all(F.col("w")).alias("t")).first()["t"]
    assert got == [py_stem(w) for w in words]


@given(st.text(max_size=60))
def test_driver_tokens_are_letters_and_digits(text):
    for token, surface in py_tokens(text):
        assert surface and token and all(unicodedata.category(c)[0] in "LN" for c in surface)
        assert surface == py_normalize(surface)


def test_content_terms_keep_repeats_and_fall_back(spark):
    terms = lambda *t: F.array(*map(F.lit, t))
    assert one(spark, content_terms(terms("the", "moon", "moon"))) == ["moon", "moon"]
    assert one(spark, content_terms(terms("the", "of"))) == ["the", "of"]


def test_tokenize_whole_text(spark):
    assert one(spark, tokenize(F.lit("Tidal-range: 12 m, été!"))) == ["tidal", "range", "12", "m", "ete"]


def test_urls(spark):
    cases = {
        "https://Example.org/": "https://example.org", "https://example.org/a?utm_source=x&b=1#top": "https://example.org/a?b=1",
        "http://example.org/?ref=1": "http://example.org", "https://example.org/a?refer=1": "https://example.org/a?refer=1", "mailto:a@b.c": None, "junk": None,
        "https://example.org?x=1": "https://example.org/?x=1",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.normalize_url(F.col("u")).alias("n"))
    assert {r["u"]: r["n"] for r in df.collect()} == cases
    links = spark.createDataFrame([("../b?gclid=1", "https://a.example/x/y/z"), ("/c", "https://a.example/x"), (None, "https://a.example"), ("ftp://x", "https://a.example"), ("n?q=1", "https://a.example/x/y?z=1"), ("?p=2", "https://a.example"), ("//B.example/./c/../d#e", "http://a.example"), ("#top", "https://a.example/x"), ("../../..", "https://a.example/x/y")], "r string, b string")
    assert [r[0] for r in links.select(urls.resolve_url(F.col("r"), F.col("b"))).collect()] == ["https://a.example/x/b", "https://a.example/c", None, None, "https://a.example/x/n?q=1", "https://a.example/?p=2", "http://b.example/d", "https://a.example/x", "https://a.example"]
    assert one(spark, urls.domain(F.lit("https://A.Example:8080/x"))) == "a.example"


PAGE = """<!doctype html><html lang="en-GB"><head><title>Tides &amp; <b>moons</b></title>
<meta name="description" content="All about tides &mdash; daily"><meta property='og:description' content='second'>
<meta name="robots" content="NOINDEX, follow"><link rel="canonical" href="https://x.example/c">
<style>p{}</style></head><body><nav>menu</nav><!-- gone --><script>var x;</script><h1>Head&#108;ine</h1><p>First&nbsp;line &lt;ok&gt; &unknown; &#x1F30A;</p>
<a href="/one">1</a><a rel="nofollow" href="/two">2</a><a href='mailto:x@y.z'>m</a><a href=three>3</a><footer>foot</footer></body></html>"""


def test_extract(spark):
    x = one(spark, html.extract(F.lit(PAGE)))
    assert x["title"] == "Tides & <b>moons</b>" and x["lang"] == "en-GB"
    assert x["description"] == "All about tides — daily" and x["noindex"] and x["canonical"] == "https://x.example/c"
    assert x["links"] == ["/one", "three"]
    assert "Headline First line <ok> &unknown; 🌊" in x["text"]
    assert not any(w in x["text"] for w in ("menu", "gone", "var x", "foot"))


def test_entities_are_decoded_once(spark):
    assert one(spark, html.decode_entities(F.lit("&amp;lt; &#0; &#x110000; &AMP;"))) == "&lt;   &"
