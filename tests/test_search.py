"""Properties of indexing and ranking on corpora of a few pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from korpora.operators import explain, graph, query, rank
from korpora.operators.index import build_index, capped_postings, latest_by_url, limited_terms

SCHEMA = "id bigint, url string, title string, description string, text string, links array<string>, lang string, fetched_at timestamp"
NOW = "2026-08-01"
THEN = datetime.datetime(2026, 7, 1)


def corpus(spark, *pages):
    rows = [(i + 1, f"https://{p.get('host', f'h{i}.example')}/{i}", p.get("title"), p.get("description", ""), p.get("text"), p.get("links"), None, p.get("at", THEN)) for i, p in enumerate(pages)]
    return build_index(spark.createDataFrame(rows, SCHEMA))


def find(spark, index, text):
    queries = query.query_table(spark, [query.parse(text)])
    authority = graph.pagerank(index.docs, index.edges, iterations=5)
    return rank.diversify(rank.score(queries, index, authority, F.lit(NOW).cast("timestamp"))).orderBy("place").collect()


def test_title_outweighs_text(spark):
    ix = corpus(spark, {"title": "other", "text": "lantern words here"}, {"title": "lantern", "text": "words here too"}, {"title": "x", "text": "nothing"})
    assert [r["doc_id"] for r in find(spark, ix, "lantern")] == [2, 1]


def test_adjacent_words_and_phrases(spark):
    ix = corpus(spark, {"text": "tidal pools and a range"}, {"text": "the tidal range of pools"})
    hits = find(spark, ix, "tidal range")
    assert hits[0]["doc_id"] == 2 and hits[0]["proximity_factor"] == pytest.approx(1.2) and hits[0]["first_pair"] == 0
    assert [r["doc_id"] for r in find(spark, ix, '"tidal range"')] == [2]
    assert find(spark, ix, '"range tidal"') == []


def test_phrase_may_cross_fields_but_not_repeat_stopword_pages(spark):
    ix = corpus(spark, {"title": "morning", "text": "moon rises"}, {"text": "moon morning"})
    assert [r["doc_id"] for r in find(spark, ix, '"morning moon"')] == [1]
    assert find(spark, ix, "of the") == []


def test_exclusion_site_and_operator_only_queries(spark):
    ix = corpus(spark, {"text": "coffee beans", "host": "a.example"}, {"text": "coffee tea", "host": "sub.a.example"}, {"text": "coffee", "host": "ba.example"})
    assert [r["doc_id"] for r in find(spark, ix, "coffee -tea site:a.example")] == [1]
    assert {r["doc_id"] for r in find(spark, ix, "coffee site:a.example")} == {1, 2}
    assert find(spark, ix, "-tea") == [] and find(spark, ix, "") == []


def test_relaxed_pool_keeps_partial_matches(spark):
    ix = corpus(spark, {"text": "alpha only"})
    assert [r["doc_id"] for r in find(spark, ix, "alpha beta gamma")] == [1]


def test_diversity_moves_the_fourth_hit_back(spark):
    pages = [{"text": "kelp " * (9 - i) + "filler", "host": "one.example"} for i in range(5)] + [{"text": "kelp and much other text to dilute it " * 3, "host": "two.example"}]
    places = [r["domain"] for r in find(spark, corpus(spark, *pages), "kelp")]
    assert places[:4].count("one.example") == 3 and places[3] == "two.example"


def test_authority_and_freshness(spark):
    ix = corpus(spark, {"text": "same words"}, {"text": "same words", "at": None}, {"text": "links", "links": ["https://h1.example/1", "https://h1.example/1#x"]})
    hits = find(spark, ix, "same words")
    assert hits[0]["fresh_factor"] > 1 or hits[0]["doc_id"] == 2
    ranks = {r["doc_id"]: r["authority"] for r in graph.pagerank(ix.docs, ix.edges).collect()}
    assert ranks[2] == 1.0 and ranks[1] < 1
    assert [tuple(r) for r in ix.edges.collect()] == [(3, 2)]


def test_upsert_keeps_the_last_fetched(spark):
    rows = [(1, "https://a.example/x?utm_source=q", "old", "", "", None, None, THEN), (2, "https://a.example/x", "new", "", "", None, None, THEN + datetime.timedelta(1)), (3, "junk", "", "", "", None, None, THEN), (4, None, None, None, None, None, None, None)]
    assert [r["id"] for r in latest_by_url(spark.createDataFrame(rows, SCHEMA)).collect()] == [2]


def test_cap_reports_exactly_full_terms(spark):
    ix = corpus(spark, *[{"text": "word " * (i + 1)} for i in range(5)])
    assert [r["doc_id"] for r in capped_postings(ix.postings, 2).orderBy("doc_id").collect()] == [4, 5]
    assert limited_terms(ix.terms, 5).count() == 1 and limited_terms(ix.terms, 6).count() == 0


def test_words_beyond_what_is_stored_are_found(spark):
    ix = corpus(spark, {"text": "filler " * 1001 + "zebrafish", "title": "  t  "}, {"text": "other", "links": ["0", "../x?utm_source=y", "mailto:a@b.c"], "host": "h0.example"})
    assert [r["doc_id"] for r in find(spark, ix, "zebrafish")] == [1] and ix.docs.where("len = 1003 AND length(text) = 6000 AND title = 't'").count() == 1
    assert ix.docs.where("id = 2").first()["links"] == ["https://h0.example/0", "https://h0.example/x"] and [tuple(r) for r in ix.edges.collect()] == [(2, 1)]


def test_a_binding_cap_weighs_the_heaviest_pages_and_says_so(spark):
    from korpora.engine import SearchEngine

    ix = corpus(spark, *[{"text": "word " * (i + 1) + "rare" * (i == 0), "host": f"h{i}.example"} for i in range(40)])
    for cap, total, limited in ((10, 10, ["word"]), (10_000, 40, []), (1, 1, ["word"]), (40, 40, ["word"])):
        answer = SearchEngine(ix, cap).search("word", NOW, per_page=50)
        assert (answer.total, answer.limited) == (total, limited) and answer.results[0]["doc_id"] == 40
    assert SearchEngine(ix, 10).search("rare -word", NOW).total == 0  # exclusion sees the postings beyond the cap


def test_queries_of_a_table_are_read_as_on_the_driver(spark):
    texts = ['moon "exact phrase" -tide site:A.example site:b.example', '"site:x.example -y"', "-site:foo.com x", "", None, "the of", "“curled up” ＂wide＂ rest", 'a "…" b', "–dash -Élan-x\u00a0-b", 'x "one" "two three" "', "running  RUN site:no"]
    got = {r["qid"]: r for r in query.query_table_of(spark.createDataFrame(list(enumerate(texts)), "qid int, q string")).collect()}
    for i, text in enumerate(texts):
        q, r = query.parse(text), got[i]
        assert (r["terms"], r["required"], r["phrases"], r["excluded"], r["site"]) == (q.terms, q.required, [p for _, p in q.phrases], [t for _, t in q.excluded], q.site), text


def test_extra_columns_change_nothing(spark):
    ix = corpus(spark, {"text": "some page about rope"}, {"text": "rope page"})
    a = [(r["doc_id"], r["score"]) for r in find(spark, ix, "rope page")]
    ix.docs = ix.docs.withColumn("sponsored", F.lit(True)).withColumn("boost", F.lit(9.0))
    assert [(r["doc_id"], r["score"]) for r in find(spark, ix, "rope page")] == a


def test_correction(spark):
    ix = corpus(spark, {"text": "espresso lighthouse cat"}, {"text": "espresso"})
    fix = lambda q: query.correct(query.parse(q), ix.terms)
    assert fix("espreso") == "espresso" and fix("espresso") is None
    assert fix("cot") == "cat" and fix("bat") is None and fix('espreso "lighthouse"') == 'espresso "lighthouse"'
    assert fix("espreso  lighthouse") is None  # two spaces: the free text is no part of what was typed


def test_suggestions(spark):
    ix = corpus(spark, {"text": "compass compost company"}, {"text": "compass"})
    got = [r["display"] for r in query.suggest(ix.terms, "old comp").collect()]
    assert got[0] == "compass" and set(got) == {"compass", "compost", "company"}
    assert query.suggest(ix.terms, "  ").count() == 0


def test_parse():
    q = query.parse('moon "exact phrase" -tide site:A.example site:b.example')
    assert q.site == "b.example" and q.phrases == [("exact phrase", ["exact", "phras"])] and ("tide", "tid") in q.excluded
    assert query.parse('"site:x.example -y"').site is None
    assert query.parse("-site:foo.com x").excluded[0][1] == "sit"


def test_snippets(spark):
    text = "filler words " * 40 + "needle one needle two " + "tail words " * 40
    df = spark.createDataFrame([(text, ["needl"]), ("short text", ["x"]), (text, ["absent"]), (None, ["x"]), ("", [])], "s string, t array<string>")
    got = [r["snippet"] for r in explain.with_snippet(df, "s", "t").collect()]
    assert "needle one needle two" in got[0] and got[0].startswith("…") and got[0].endswith("…") and len(got[0]) <= 222
    assert got[1] == "short text" and got[2].endswith("…") and got[3] == "" and got[4] == ""


def test_list_join(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r[0] for r in df.select(explain.list_join(F.col("x"))).collect()] == ["", "a", "a and b", "a, b and c"]


def test_empty_corpus(spark):
    ix = build_index(spark.createDataFrame([], SCHEMA))
    assert ix.stats.first()["avg_len"] == 1.0 and find(spark, ix, "anything") == []


def test_engine_and_upsert(spark):
    from korpora.engine import SearchEngine
    from korpora.operators import maintenance

    ix = corpus(spark, *[{"title": f"lighthouse {i}", "text": "an old lighthouse stands here " * (i + 1), "host": f"h{i}.example"} for i in range(12)])
    engine = SearchEngine(ix, cap=12)
    answer = engine.search("lighthuose", "2026-08-01", page=2, per_page=5)
    assert answer.correction == "lighthouse" and (answer.total, answer.total_pages, len(answer.results)) == (12, 3, 5)
    assert answer.limited == ["lighthous"] and answer.operators is None and answer.results[0]["place"] == 6
    assert answer.results[0]["reasons"][0]["code"] == "matches_word" and "lighthouse" in answer.results[0]["snippet"]
    assert engine.search("lighthuose", "2026-08-01", page=2, per_page=5) is answer
    assert engine.search("lighthuose", "2026-08-01", allow_correction=False).total == 0
    assert engine.suggest("an lig") == ["lighthouse"] and engine.stats()["n_docs"] == 12
    with pytest.raises(ValueError):
        engine.search("x" * 501, "2026-08-01")
    new = spark.createDataFrame([(99, "https://h0.example/0", "replaced", "", "kelp", None, None, THEN)], SCHEMA)
    later = maintenance.upsert(ix, new)
    assert later.docs.count() == 12 and later.postings.where("doc_id = 1").count() == 0
    assert {r["term"] for r in later.postings.where("doc_id = 99").collect()} == {"replac", "kelp"}
    fewer = maintenance.remove(later, spark.createDataFrame([("https://h1.example/1#x",)], "url string"))
    assert fewer.docs.count() == 11 and fewer.terms.where("term = 'lighthous'").first()["df"] == 10
    less = maintenance.compact(fewer)
    assert less.postings.where("doc_id IN (1, 2)").count() == 0 and less.postings.count() == fewer.postings.count() and less.terms.where("term = '0'").count() == 0


def brute_hits(ix, text, first, rank_of):
    """The first hits of one query, from the collected index."""
    import math

    q = query.parse(text)
    docs, df = {r["id"]: r for r in ix.docs.collect()}, {r["term"]: r["df"] for r in ix.terms.collect()}
    posts = {(r["term"], r["doc_id"]): r for r in ix.postings.collect()}
    at = lambda t, d: set(posts[t, d]["pos"]) if (t, d) in posts else set()
    follow = lambda ts, d: any(all(p + k in at(t, d) for k, t in enumerate(ts)) for p in at(ts[0], d))
    fit = {}
    for d, doc in docs.items():
        if q.site and doc["domain"] != q.site and not doc["domain"].endswith("." + q.site) or any((t, d) in posts for _, t in q.excluded):
            continue
        if any((t, d) in posts for t in q.terms) and all(follow(p, d) for _, p in q.phrases):
            fit[d] = sum((t, d) in posts for t in q.required)
    enough = max(1, math.ceil(0.6 * len(q.required) - 1e-9))
    strict = [d for d in fit if fit[d] >= enough]
    mean, scored = sum(r["len"] for r in docs.values()) / len(docs), []
    for d in strict if len(strict) >= 5 else [d for d in fit if fit[d] >= 1]:
        bm25 = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * posts[t, d]["w"] / (posts[t, d]["w"] + 1.2 * (0.25 + 0.75 * docs[d]["len"] / mean)) for t in q.unique if (t, d) in posts)
        pairs = [follow([a, b], d) for a, b in zip(q.terms, q.terms[1:])]
        fresh = 1 + 0.05 * math.exp(-(datetime.datetime.fromisoformat(NOW) - docs[d]["fetched_at"]).total_seconds() / 86400 / 365)
        scored.append((-round(bm25 * (1 + 0.35 * rank_of.get(d, 0)) * (1 + 0.2 * sum(pairs) / max(1, len(pairs))) * fresh, 4), str(d), d))
    seen, placed = {}, []
    for s, name, d in sorted(scored):
        seen[docs[d]["domain"]] = seen.get(docs[d]["domain"], 0) + 1
        placed.append((seen[docs[d]["domain"]] > 3, s, name, d))
    return [(place, x[3], -x[1]) for place, x in enumerate(sorted(placed)[:first], 1)]


def test_every_search_of_a_log_is_answered(spark):
    """More queries than the twenty most frequent, rare and long ones and operators among them, against brute force."""
    import random

    from korpora.plans import search

    random.seed(5)
    words = "kelp rope lamp boat shore tide gull sand pier wave mast sail".split()
    ix = corpus(spark, *[{"title": random.choice(words), "text": " ".join(random.choices(words, k=14)), "host": f"h{i % 4}.example", "links": [f"https://h{(i + 1) % 4}.example/{i + 1}"]} for i in range(24)])
    texts = [" ".join(random.choices(words, k=k % 4 + 1)) for k in range(26)]
    texts += [f'"{words[0]} {words[1]}"', "kelp -rope", "lamp site:h1.example", "the unknownword tide", "unknownword", "", None, " ", "kelp", "kelp"]
    rows = [(i * 20, q) for i, q in enumerate(texts, 1)]
    log = spark.createDataFrame(rows + rows[:3] + [(None, "kelp")], "search_id bigint, q string")
    got = {}
    for r in search.answered(log, ix, graph.pagerank(ix.docs, ix.edges, iterations=5), F.lit(NOW).cast("timestamp")).orderBy("search_id", "place").collect():
        got.setdefault(r["search_id"], []).append((r["place"], r["doc_id"], r["score"]))
    rank_of = {r["doc_id"]: r["authority"] for r in graph.pagerank(ix.docs, ix.edges, iterations=5).collect()}
    want = {i: brute_hits(ix, q, 10, rank_of) for i, q in rows if q and q.strip()}
    assert got == {i: [(p, d, pytest.approx(s, abs=2e-4)) for p, d, s in hits] for i, hits in want.items() if hits}
    assert len(got) > 30 and 20 * (len(texts) - 5) not in got


def test_the_batch_weighs_postings_beyond_the_cap(spark):
    """Pages beyond the cap of one word are found by it, count with the other, and stand in the order of all."""
    from korpora.operators.index import recapped
    from korpora.plans import search

    ix = corpus(spark, *[{"text": "word " * (i % 7 + 1) + "rope " * (i % 3 == 0) + "lamp " * (i % 5 == 0), "host": f"h{i}.example"} for i in range(30)])
    texts = {20: "word", 40: "word rope", 60: "rope lamp", 80: '"word rope"', 100: "lamp -rope"}
    log = spark.createDataFrame(list(texts.items()), "search_id bigint, q string")
    none = spark.createDataFrame([], "doc_id bigint, authority double")
    got = {}
    for r in search.answered(log, recapped(ix, 2), none, F.lit(NOW).cast("timestamp")).orderBy("search_id", "place").collect():
        got.setdefault(r["search_id"], []).append((r["place"], r["doc_id"], r["score"]))
    assert got == {i: [(p, d, pytest.approx(s, abs=2e-4)) for p, d, s in brute_hits(ix, q, 10, {})] for i, q in texts.items()}
    assert "50000" not in search.SQL["batch_search_topk"].replace("_", "")


def test_the_batch_agrees_with_single_scores(spark):
    """Queries in one plan against ``batch.first_hits`` over several blocks: few and many pages of a domain, equal scores, relaxed pools, repeats and operators."""
    import random

    from korpora.operators import batch

    random.seed(11)
    words = ["kelp", "rope", "lamp", "the", "tide", *[f"name{i}" for i in range(12)]]
    odds = [30, 20, 10, 40, 5, *[1] * 12]
    ix = corpus(spark, *[{"title": random.choice(words), "text": " ".join(random.choices(words, odds, k=random.choice((3, 12)))), "host": f"h{min(i % 9, 4)}.example", "links": ["https://h1.example/2"]} for i in range(400)])
    texts = [" ".join(random.choices(words, odds, k=k % 5 + 1)) for k in range(120)] + [f"{a} {b}" for a in words[5:] for b in words[:5]]
    texts += ["kelp kelp", "the", "the the", "kelp nowhere", "name1 name2 nowhere", '"kelp rope"', '"the kelp" "rope the"', "rope -kelp", "name3 -nowhere -tide", "kelp site:h2.example", "name4 lamp site:example.org", '"kelp nowhere"', "-kelp"]
    asked = query.query_table_of(spark.createDataFrame(list(enumerate(texts)), "qid bigint, q string"))
    now, authority = F.lit(NOW).cast("timestamp"), graph.pagerank(ix.docs, ix.edges, iterations=5)
    want = rank.diversify(rank.score(asked, ix, authority, now).withColumn("score", F.round("score", 4)), 10)
    rows = lambda df: sorted(map(tuple, df.select("qid", "place", "doc_id", "score").collect()))
    assert rows(batch.first_hits(asked, ix, authority, now)) == rows(want) and want.count() > 1200


def test_a_batch_moves_no_pairs_of_query_and_page(spark):
    """240 queries by 500 pages that all share a word: what is shuffled grows with their numbers, not with their product."""
    from korpora.plans import search

    ix = corpus(spark, *[{"text": f"common word{i % 7}", "host": f"h{i}.example"} for i in range(500)])
    log = spark.createDataFrame([(i, f"common other{i}") for i in range(240)], "search_id bigint, q string")
    none = spark.createDataFrame([], "doc_id bigint, authority double")
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    last = max(stages())
    assert search.answered(log, ix, none, F.lit(NOW).cast("timestamp")).count() == 2400
    assert sum(n for k, n in stages().items() if k > last) < 240 * 500 / 3


def test_the_batch_covers_the_log(spark, sf_dir):
    from korpora import plans

    asked = spark.read.parquet(f"{sf_dir}/searches.parquet").where("search_id % 20 = 0 AND trim(q) <> ''")
    got = plans.queries()["batch_search_topk"](spark, sf_dir)
    lost = asked.join(got, "search_id", "left_anti").selectExpr("search_id AS qid", "q").distinct()
    without = rank.pool(rank.candidates(query.query_table_of(lost), plans.search.index(spark, sf_dir)))
    assert got.where("search_id % 20 <> 0").count() == 0 and asked.join(got, "search_id").count() > 0 and without.count() == 0
