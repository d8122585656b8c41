"""Operators on pages: language, furniture, repeated lines, truncation, forms, distinctive terms."""

import collections
import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from korpora.llm import boilerplate, distinctive, forms, language, lines, truncation
from korpora.llm.gbt import BoostedTrees

DOCS = "id bigint, url string, domain string, title string, description string, text string, len int, lang string, shard int"
SAMPLES = "sample_id int, lang string, text string"


def pages(spark, *rows):
    full = [(i + 1, r.get("url", f"https://a.example/{i}"), r.get("domain", "a.example"), r.get("title"), r.get("description"), r.get("text"), r.get("len"), r.get("lang"), r.get("shard", 0)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).selectExpr("*", "1 AS line", "2 AS key", "3 AS source", "4 AS value", "5 AS pages")


def odd(spark):
    """Null in every column, empty and very long texts, repeated rows."""
    null = spark.createDataFrame([tuple([None] * 9)], DOCS)
    some = pages(spark, {"text": ""}, {"text": None, "description": ""}, {"text": "\n\n"}, {"text": "word " * 40_000, "lang": "xx"}, {"text": "x" * 100_000}, {"text": "A line.\n" * 500}, {"domain": None, "text": "Text here."}).select(*null.columns)
    return null.unionByName(some).unionByName(some)


# p4


def brute_lines(rows, least=4, share=0.05):
    sizes, where, at = collections.Counter(), collections.defaultdict(set), []
    for i, domain, shard, text in rows:
        sizes[domain, shard] += 1
        for no, line in enumerate((text or "").split("\n"), 1):
            key = "".join(c for c in unicodedata.normalize("NFKC", line).lower() if c.isalpha())
            if key:
                where[domain, shard, key].add(i)
                at.append((i, no, (domain, shard, key)))
    return {(i, no) for i, no, k in at if len(where[k]) >= max(least, share * sizes[k[:2]])}


def test_repeated_lines_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/docs.parquet")
    rows = [tuple(r) for r in docs.select("id", "domain", "shard", "text").collect()]
    assert {tuple(r) for r in lines.repeated_lines(docs).collect()} == brute_lines(rows)


def test_lines_are_alike_by_letters(spark):
    docs = pages(spark, *[{"text": t} for t in ("Share THIS 12\nown one", "share this!", "ｓhare  this…", "Share this\nown two\n12 34", "12 34")])
    assert sorted(tuple(r) for r in lines.repeated_lines(docs).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    clean = {r["id"]: r["text"] for r in lines.without_repeated_lines(docs).collect()}
    assert clean == {1: "own one", 2: "", 3: "", 4: "own two\n12 34", 5: "12 34"}


def test_excess_against_other_sources_equals_brute_force(spark):
    """Lines that only one source repeats are called excessive, those that all sources repeat alike are not; ratios and the rule by hand."""
    random.seed(8)
    rows, at = [], 0
    for d in range(6):
        for k in range(60):
            own = [f"Own of {'abcdef'[d]}"] * (random.random() < 0.3) + ["Shared by all"] * (random.random() < 0.5) + [f"{'xyz'[k % 3] * (at % 7 + 1)} words"]
            rows.append({"domain": f"d{d}.example", "text": "\n".join(own)})
            at += 1
    got = {(r["domain"], r["key"]): r for r in lines.tested_lines(pages(spark, *rows)).collect()}
    per, size = collections.defaultdict(set), collections.Counter(r["domain"] for r in rows)
    for i, r in enumerate(rows):
        for line in r["text"].split("\n"):
            per[r["domain"], hashlib.md5("".join(c for c in line.lower() if c.isalpha()).encode()).hexdigest()].add(i)
    total, ratios = collections.Counter(), {}
    for (_, key), on in per.items():
        total[key] += len(on)
    for (d, key), on in per.items():
        k, n, out = len(on), size[d], len(rows) - size[d]
        p, p0 = k / n, (total[key] - k + 0.5) / (out + 1)
        if k >= 2:
            ratios[d, key] = 2 * (k * math.log(p / p0) + (n - k) * math.log((1 - p) / (1 - p0)) if k < n else k * math.log(p / p0)) if p > p0 else 0.0
    assert set(got) == set(ratios) and all(got[x]["ratio"] == pytest.approx(v, abs=1e-3) for x, v in ratios.items())
    ps = sorted((math.erfc(math.sqrt(math.floor(v * lines.STEPS_PER_UNIT) / lines.STEPS_PER_UNIT / 2)), x) for x, v in ratios.items())
    last = max((i for i, (p, _) in enumerate(ps, 1) if p <= lines.FALSE_RATE * i / len(ps)), default=0)
    assert {x for x, r in got.items() if r["excess"]} == {x for _, x in ps[:last]}
    name = {hashlib.md5(t.encode()).hexdigest(): t for t in ("sharedbyall", *(f"ownof{c}" for c in "abcdef"))}
    called = collections.Counter(name[key][:3] for (_, key), r in got.items() if r["excess"] and key in name)
    assert called["own"] == 6 and called["sha"] <= 1


def test_lines_of_odd_rows(spark):
    assert lines.repeated_lines(odd(spark)).count() >= 0 and lines.repeated_lines(odd(spark).limit(0)).count() == 0


# p6


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lang_samples.parquet")


def test_forms(spark, samples):
    cases = {
        "plain – “text” … é": [], "ｗide": ["compat"], "éa": ["accent"], "in​visible": ["invisible"], "a b": ["space"], "vіew оf": ["mixed"],
        "ветер λ 港": [], "": [], "line\r\nend\ttab": [], "ﬁne x²": ["compat"],
    }
    form, issues = forms.form_of(F.col("v"), forms.fit_lattice(samples))
    got = {r["v"]: (r["f"], list(r["i"])) for r in spark.createDataFrame([(c,) for c in cases], "v string").select("v", form.alias("f"), issues.alias("i")).collect()}
    assert {k: v[1] for k, v in got.items()} == cases
    assert got["vіew оf"][0] == "view of" and got["ｗide"][0] == "wide" and got["éa"][0] == "éa" and got["a b"][0] == "a b" and got["ветер λ 港"][0] == "ветер λ 港"


def test_forms_are_stable_and_undo_look_alikes(spark, samples):
    lattice = forms.fit_lattice(samples)
    random.seed(2)
    words = [w for r in samples.limit(60).collect() for w in r["text"].split() if w.isascii() and w.isalpha() and len(w) > 3][:150]
    back = 0
    for w in words:
        # Look-alikes of another script; those of Latin script are words of one script.
        options = [(i, x) for i, c in enumerate(w) for x in forms.LOOK_ALIKES.get(c, "") if forms.script(x) != "LATIN"]
        i, x = random.choice(options)
        other = w[:i] + x + w[i + 1 :]
        form, issues = forms.consistent(other, lattice)
        assert issues == ["mixed"] and forms.consistent(form, lattice)[0] == form
        back += form == w
    assert back >= 0.97 * len(words)


def test_forms_of_either_script(samples, spark):
    """Latin letters in words of another script become its own; letters with marks keep them."""
    lattice = forms.fit_lattice(samples)
    cases = {"мoсква": "москва", "кoт": "кот", "Кофе": "Кофе", "пpивeт": "привет", "λόγoς": "λόγος", "noёl": "noël", "vіеw": "view", "lighthоusе": "lighthouse", "Вrіdgе": "Bridge"}
    assert {w: forms.consistent(w, lattice)[0] for w in cases} == cases
    random.seed(6)
    words, back = "вода молоко дорога погода хорошо время человек работа сегодня завтра".split(), 0
    for w in words * 4:
        i = random.choice([i for i, c in enumerate(w) if c in forms.LATIN_OF])
        other = w[:i] + forms.LATIN_OF[w[i]] + w[i + 1 :]
        form, issues = forms.consistent(other, lattice)
        assert issues == (["mixed"] if forms.mixed(other) else []) and forms.consistent(form, lattice)[0] == form
        back += form == w
    assert back >= 0.95 * 4 * len(words)


def test_forms_of_odd_rows(spark, samples):
    terms = spark.createDataFrame([(None, None, None, None), ("t", "ｔ", 1, 0)], "term string, display string, df int, shard int")
    got = forms.consistent_forms(odd(spark), terms, samples.limit(0)).collect()
    assert len(got) == 2 * odd(spark).count() + 2
    assert all(r["form"] is not None or not r["issues"] for r in got)


def test_pairs_are_counted_in_all_samples(spark, samples):
    """Counts by hand over more rows than any sample took; a reading that only the later rows decide; the same in any order."""
    texts = [r["text"] for r in samples.collect()] * 20 + [None, "", "вода vоda b2b Ünder"]
    want = collections.Counter(p for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower()) if w.isalpha() and not forms.mixed(w) and w != "вода" for p in zip("^" + w, w + "$"))
    lattice = forms.fit_lattice(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert lattice.pairs == want | {("^", "в"): 1} and lattice.firsts["^"] == sum(n for (a, _), n in lattice.pairs.items() if a == "^")

    rows = spark.range(0, 12_000, 1, 1).selectExpr("CASE WHEN id < 6000 THEN 'sun' ELSE 'cop' END AS text", "id")
    for some in (rows, rows.repartition(3), rows.orderBy(F.desc("id"))):
        lattice = forms.fit_lattice(some)
        assert lattice.pairs["^", "s"] == lattice.pairs["^", "c"] == 6000 and forms.consistent("cор", lattice) == ("cop", ["mixed"])
    assert forms.consistent("cор", forms.fit_lattice(rows.limit(6000))) == ("сор", ["mixed"])


# p2


def test_output_codes_on_held_out_samples(samples):
    rows = [(r["lang"], r["text"]) for r in samples.orderBy("sample_id").collect()]
    train, test = rows[::2], rows[1::2]
    codes = language.OutputCodes([t for _, t in train], [lang for lang, _ in train])
    right = sum(codes.language_of(t)[0] == lang for lang, t in test)
    assert right >= 0.98 * len(test)
    assert codes.language_of("")[0] is None and codes.language_of("12 34 !?") == (None, 0.0)


def test_grams_of_words_do_not_depend_on_their_neighbours():
    words = pa.array(["été", "a", "", "straße", "été"])
    grams, starts, counts = language.word_grams(words)
    ends = [*starts[1:], len(grams)]
    each = [grams[a:b] for a, b in zip(starts, ends)]
    assert (each[0] == each[4]).all() and (language.word_grams(words.slice(3, 1))[0] == each[3]).all()
    assert [(e < language.DIMENSIONS).sum() for e in each] == counts.tolist() and counts[1] == 1 + 3 + 2 + 1


def test_code_words_differ_in_half_of_their_bits():
    for n in (2, 3, 5, 9):
        code = language.codewords(n)
        assert code.shape[0] == n and all((code[a] != code[b]).any() for a in range(n) for b in range(a))
    assert (language.codewords(5)[0] != language.codewords(5)[1]).sum() == 8


def test_labels(spark):
    df = spark.createDataFrame([("en-GB",), ("Deutsch",), ("fra",), ("fr_CA",), ("und",), ("-",), ("",), (None,), ("Unknown",)], "l string")
    assert [r[0] for r in df.select(language.named_language(F.col("l"))).collect()] == ["en", "de", "fr", "fr", None, None, None, None, None]


def judged(text, codes):
    lines_ = text.split("\n")
    return language.judge(np.zeros(len(lines_), int), np.arange(1, len(lines_) + 1), pa.array(lines_), 1, codes)[0]


def test_mixed_pages(samples):
    codes = language.OutputCodes([r["text"] for r in samples.collect()], [r["lang"] for r in samples.collect()])
    by = collections.defaultdict(list)
    for r in samples.collect():
        by[r["lang"]] += re.split(r"(?<=[.!?])\s+", r["text"])
    main, sure, segments = judged(" ".join(by["en"][:4] + by["fr"][:2]) + "\n" + " ".join(by["en"][4:8]), codes)
    assert main == "en" and 0.5 < sure <= 1 and [s[:4] for s in segments] == [("fr", 1, 1, 2)]
    main, _, segments = judged(" ".join(by["en"][:4] + by["fr"][:1] + by["en"][4:8]), codes)
    assert main == "en" and [s[:4] + s[5:] for s in segments] == [("fr", 1, 1, 1, False)]
    assert judged("", codes) == (None, 0.0, []) and judged("Yes. No.", codes)[0] is None and judged("Le soir. La mer. Un pont. Des amis. Une fleur.", codes)[0] == "fr"


def test_issues_need_a_run_of_sure_sentences(spark):
    one = lambda n, ambiguous, lang: {"lang": lang, "first_line": 1, "last_line": 1, "sentences": n, "confidence": 0.9, "ambiguous": ambiguous}
    rows = [(1, "en", "en", [one(1, False, "fr"), one(1, True, "it")]), (2, None, "en", [one(2, False, "fr"), one(3, False, "fr")]), (3, "de", "en", []), (4, None, None, [])]
    df = spark.createDataFrame(rows, "id bigint, named string, lang string, segments " + language._SEGMENTS)
    assert sorted(tuple(r) for r in language.language_issues(df).collect()) == [(2, "missing", "en"), (2, "mixed", "fr"), (3, "wrong", "en")]


def test_languages_of_odd_rows(spark, samples):
    got = language.page_languages(odd(spark), samples)
    assert language.language_issues(got).count() >= 0
    assert language.page_languages(odd(spark), samples.limit(0)).where("lang IS NOT NULL").count() == 0


# p3


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees(trees=40).fit(x[:1500], y[:1500])
    assert ((model.logits(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def site(n=40):
    random.seed(1)
    topics = "compass harbour beehive lantern orchard kettle bridge garden".split()
    for i in range(n):
        a, b = random.sample(topics, 2)
        body = [f"The {a} number {i} was repaired in spring, and the {b} stood beside it. Nobody had seen such a {a} near {b} {i * 7} before.", f"After {i} days the {b} was moved to the {a}. It stayed there for {i + 3} years, as the people of the town remember."]
        rows = ["Home | News | Log in", f"Posted by the crew, {i} comments", f"About the {a} and the {b} {i}", *body, "Related articles", f"» The {b} of old", f"» More on the {a}", "© 2024 Site. All rights reserved."]
        yield {"title": rows[2], "text": "\n".join(rows), "description": body[0] if i % 4 else "Home News Log in"}


def test_article_and_furniture(spark):
    rows = list(site())
    got = collections.defaultdict(set)
    for r in boilerplate.furniture(pages(spark, *rows)).collect():
        got[r["field"]].add((r["id"], r["line_no"]))
    want = {(i + 1, no) for i in range(len(rows)) for no in (1, 2, 6, 7, 8, 9)}
    assert len(got["text"] & want) >= 0.97 * len(want) and len(got["text"] - want) <= 0.03 * len(want)
    assert got["description"] == {(i + 1, 1) for i in range(len(rows)) if i % 4 == 0}


def test_furniture_within_descriptions(spark):
    """Notices and menus of other pages in front of, after or instead of the article's sentences; a sentence of articles is none."""
    rows = list(site())
    told = "The baker kept a tin of cookies beside the settings of the oven."
    for i, r in enumerate(rows):
        r["domain"] = f"s{i // 10}.example"
        lines = r["text"].split("\n")
        r["description"] = lines[3]
        r["text"] = "\n".join(lines[:4] + [told] * (i % 10 == 0) + lines[4:] + ["We use cookies to keep this site running. You may change your choice at any time."] * (i % 10 < 7))
    own = rows[35]["description"]
    cases = ["We use cookies to keep this site running.", f"{own} You may change your choice at any time.", f"Home News Log in {own}", f"{own} Home News Log in", told, f"Home of the compass. {own}"]
    docs = pages(spark, *rows, *[{"title": "The compass", "text": own, "domain": f"c{i}.example", "description": c} for i, c in enumerate(cases)])
    found = {r["id"] - len(rows) - 1 for r in boilerplate.furniture(docs).where("field = 'description'").collect()}
    assert found == {0, 1, 2, 3}


def test_articles_keep_blank_lines_and_indentation(spark):
    rows = list(site())
    own = rows[1]["text"].split("\n")[3]
    listing = f"{own}\n\n    if x:\n        y = 1\n\n{own}  "
    docs = pages(spark, *rows, {"text": listing, "domain": "b.example", "description": own}, {"text": None, "domain": "c.example", "description": ""})
    marked = {(r["id"], r["line_no"]) for r in boilerplate.furniture(docs).where("field = 'text'").collect()}
    got = {r["id"]: r for r in boilerplate.main_content(docs).collect()}
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        assert got[r["id"]]["text"] == "\n".join(line for no, line in enumerate(lines, 1) if (r["id"], no) not in marked)
    n = len(rows)
    assert got[n + 1]["text"] == listing and got[n + 1]["description"] == own
    assert got[n + 2]["text"] == "" and got[n + 2]["description"] is None and got[1]["description"] is None


def test_blocks_are_of_one_kind_unless_it_pays():
    logit, block = np.array([3.0, -0.1, 2.0, -4.0, 5.0]), np.array([0, 0, 0, 1, 1])
    assert boilerplate.decode(logit, block).tolist() == [True, True, True, False, True]


def test_furniture_of_odd_rows(spark):
    assert boilerplate.furniture(odd(spark)).count() >= 0 and boilerplate.furniture(odd(spark).limit(0)).count() == 0
    assert boilerplate.main_content(odd(spark)).count() == odd(spark).select("id").distinct().count()


# p5


def test_truncation(spark):
    random.seed(3)
    words = "the old lamp stood near a wide river and shone over small boats each night".split()
    full = [" ".join(random.choice(words) for _ in range(random.randint(30, 60))) + "." for _ in range(60)]
    rows = [{"description": t[:120], "text": t + "\nThe end of it.", "domain": "cut.example"} for t in full[:30]]
    rows += [{"description": t, "text": t, "domain": "whole.example"} for t in full[30:]]
    rows += [{"description": full[0][:50] + "…", "domain": "whole.example"}, {"description": full[1][:50] + " [...]", "domain": "whole.example"}, {"description": "", "title": None}]
    got = {(r["id"], r["field"]): r["why"] for r in truncation.truncated(pages(spark, *rows)).collect()}
    want = {(i + 1, "description") for i in range(30) if not full[i][:120].endswith(".")} | {(61, "description"), (62, "description")}
    assert {k for k in got if k[1] == "description"} == want and got[61, "description"] == "mark" and got[1, "description"] == "spike"
    rates = {(r["domain"], r["field"]): r["rate"] for r in truncation.truncation_rates(pages(spark, *rows)).collect()}
    assert rates["cut.example", "description"] == pytest.approx(1.0) and rates["whole.example", "text"] == 0


def test_whole_lines_are_not_shown_by_cut_ones(spark):
    """Lines within a text are whole, its last one only if it is closed; a line of few letters or without any shows nothing."""
    held = ["Contact us"] * 3 + ["-- 1"] * 5 + ["The town"] * 3 + [f"The town of {'x' * k}" for k in range(1, 200)] + ["Soon it"] * 3 + ["Soon it ends", "So", "So", "So"]
    texts = [f"{line}\n{k} closed." for k, line in enumerate(held)] + [f"{k} closed.\nRead on" for k in range(5)]
    docs = pages(spark, *[{"text": t} for t in texts])
    asked = ["Read on", "Contact us", "-- 1", "The town", "Soon it", "So"]
    forms = ["".join(c for c in t.lower() if c.isalpha()) for t in asked]
    wanted = spark.createDataFrame([(int(h), f, t) for h, f, t in zip(truncation._hashes(pa.array(forms)).view(np.int64), forms, asked)], "line bigint, form string, text string")
    got = truncation.whole_lines(docs, truncation.FIELDS, truncation.measured(docs), wanted).join(wanted, "line").select("text").collect()
    assert {r["text"] for r in got} == {"Contact us", "Soon it"}


def test_paragraphs_end_in_marks(spark):
    """A text that ends within a sentence of a paragraph was cut, whatever its last word; a repeated line of the page's furniture and a heading were not."""
    whole = [f"The mill number {k} was mended. It stands by the river.\nLike it? Pass it on\nAbout the crew\nAll rights held." for k in range(12)]
    cut = ["The mill was mended. It stands by the", "The town is old. The river", "One sentence.\nIt was mended. It stands by the ri"]
    kept = ["The lamp is lit.\nLike it? Pass it on", "The lamp is lit.\nAbout the crew"]
    rows = [{"text": t, "domain": f"d{k}.example"} for k, t in enumerate(whole + cut + kept)]
    got = {r["id"]: r["why"] for r in truncation.truncated(pages(spark, *rows)).collect()}
    assert got == {13: "open", 14: "open", 15: "open"}


def test_words_are_counted_by_their_ends(spark):
    """Keys of the last words of lines against a count by hand; equal values count once."""
    texts = ["The old lamp. The new lamp", "A lamp\nThe old lamp, 12 of them.", "A lamp\nThe old lamp, 12 of them."]
    got = {r["key"]: (r["ends"], r["goes_on"]) for r in truncation.measured(pages(spark, *[{"text": t} for t in texts])).where("NOT is_line").groupBy("key").sum("ends", "goes_on").toDF("key", "ends", "goes_on").collect()}
    keys = truncation.Words(pa.array(["old lamp", "a lamp", "them"])).keys
    assert got[keys[1, 1]] == got[keys[1, 3]] == (2, 1) and got[keys[2, 1]] == (1, 1) and got[keys[2, 3]] == (1, 0) and got[keys[1, 4]] == (1, 0)


def test_truncation_of_odd_rows(spark):
    assert truncation.truncated(odd(spark)).count() >= 0 and truncation.truncated(odd(spark).limit(0)).count() == 0


# p7

POSTINGS = "term string, doc_id bigint, w double, f0 int, f1 int, f2 int, pos array<int>, shard int"


def index_of(texts, shard=0):
    rows = []
    for doc, text in enumerate(texts, 1):
        at = collections.defaultdict(list)
        for k, w in enumerate(text.split()):
            at[w].append(k)
        rows += [(w, doc, float(len(p)), 0, 0, len(p), p, shard) for w, p in at.items()]
    return rows


def brute_degrees(rows, window):
    at = collections.defaultdict(dict)
    for term, doc, *_, pos, _ in rows:
        for p in pos or []:
            at[doc][p] = term
    near = collections.defaultdict(set)
    for doc, places in at.items():
        for p, a in places.items():
            for q in range(p + 1, p + window):
                b = places.get(q)
                if b and b != a:
                    near[doc, a].add(b)
                    near[doc, b].add(a)
    return near


def test_degrees_equal_brute_force_by_either_way(spark):
    random.seed(4)
    rows = index_of([" ".join(random.choice("abcdefghijkl") for _ in range(random.randint(1, 80))) for _ in range(25)])
    rows += rows[:10]
    near = brute_degrees(rows, 4)
    df = spark.createDataFrame(rows, POSTINGS)
    want = {(r[1], r[0]): len(near[r[1], r[0]]) for r in rows}
    for most in (10**6, 5):
        got = distinctive.term_degrees(df, 4, page_rows=most).collect()
        assert len(got) == len(want) and {(r["doc_id"], r["term"]): r["degree"] for r in got} == want


def test_scores_and_placeholders(spark):
    rows = index_of(["a b c rare", "a b c", "a b"]) + [("a", 0, 9.0, 1, 1, 1, [1], 0), ("", 1, 9.0, 1, 1, 1, [9], 0), (None, 1, 1.0, 1, 1, 1, [2], 0), ("n", None, 1.0, 1, 1, 1, None, None), ("n", 2, None, None, None, None, None, None)]
    docs = spark.createDataFrame([(1, 4), (2, None), (3, 0)], "id bigint, len int")
    got = {(r["doc_id"], r["term"]): r for r in distinctive.term_scores(spark.createDataFrame(rows, POSTINGS), docs).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "rare"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (2, "n")}
    assert got[1, "rare"]["df"] == 1 and got[1, "a"]["df_shard"] == 3 and got[2, "n"]["degree"] == 0
    assert got[1, "rare"]["score"] == pytest.approx(3 / (1 - 0.003 + 0.003 * 4 / 4) * math.log(4 / 1))
    assert distinctive.term_scores(spark.createDataFrame([], POSTINGS), docs.limit(0)).count() == 0
