"""Skewed keys, activity, robots, sources and streams."""

import collections
import json

from pyspark.sql import functions as F

from korpora.operators import activity, robots
from korpora.operators.hotkeys import chunk_parts, chunk_states, hot_keys, key_cells, key_totals
from korpora.sources.tables import read_json_corpus, write_clustered
from korpora.streaming import jobs

POSTINGS = "term string, doc_id bigint, w double, shard int"


def totals(spark, rows, **options):
    return {(r["shard"], r["key_column"], r["key_value"]): (r["n_rows"], r["pages"], r["sum_w"]) for r in key_totals(spark.createDataFrame(rows, POSTINGS), **options).collect()}


def test_key_totals_with_nulls_repeats_and_placeholders(spark):
    rows = [("a", 1, 1.0, 0), ("a", 1, 1.0, 0), ("a", 2, 2.0, 0), ("", 0, 1.0, 0), ("", 0, 1.0, 0), (None, None, None, None), ("a", None, 1.0, 0)]
    got = totals(spark, rows)
    assert got[0, "term", "a"] == (4, 2, 5.0) and got[0, "term", ""] == (2, 1, 2.0)
    assert got[0, "doc_id", "0"] == (2, 1, 2.0) and got[0, "doc_id", None] == (1, 0, 1.0)
    assert got[None, "term", None] == (1, 0, 0.0)
    assert totals(spark, []) == {}


def test_keys_over_many_chunks(spark):
    rows = [("hot" if i % 3 else f"t{i}", i % 50, 0.5, i % 2) for i in range(3000)]
    got = totals(spark, rows, chunk_rows=7)
    want = collections.Counter((r[3], "term", r[0]) for r in rows) + collections.Counter((r[3], "doc_id", str(r[1])) for r in rows)
    assert {k: v[0] for k, v in got.items()} == dict(want)


def test_chunks_hold_equal_numbers_of_rows(spark):
    rows = [("hot" if i % 3 else f"t{i}", i % 50, 0.5, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, POSTINGS).repartition(6)
    parts = chunk_parts(key_cells(df, pages=False), 64)
    sizes = [(r["bucket"], r["chunk"], r["n"]) for r in parts.groupBy("bucket", "chunk").agg(F.sum("n").alias("n")).collect()]
    last = {b: max(c for x, c, _ in sizes if x == b) for b, _, _ in sizes}
    assert all(n == 64 for b, c, n in sizes if c < last[b]) and sum(n for *_, n in sizes) == 2 * len(rows)
    held = collections.Counter(r["key_value"] for r in chunk_states(parts).where("key_column = 'term'").collect())
    assert held["hot"] >= 2000 // 64
    got = {r["key_value"]: r for r in key_totals(df, 64, pages=False).where("key_column = 'term'").collect()}
    assert got["hot"]["n_rows"] == 2000 and got["hot"]["chunks"] == held["hot"] and got["hot"]["sum_w"] == 1000.0 and got["hot"]["pages"] is None


def test_hot_keys_ignore_extra_columns(spark):
    rows = [("hot", i, 1.0, 0) for i in range(500)] + [(f"t{i}", i, 1.0, 0) for i in range(1000)]
    df = spark.createDataFrame(rows, POSTINGS).withColumn("n", F.lit(1)).withColumn("pid", F.lit(2)).withColumn("bucket", F.lit(3))
    assert [tuple(r) for r in hot_keys(key_totals(df)).collect()] == [(0, "term", "hot")]


SEARCHES = "search_id bigint, owner string, q string, searched_at timestamp_ntz, n int, total int"


def searches(spark, *rows):
    import datetime

    at = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, o, q, at + datetime.timedelta(hours=h), 1, t) for i, (o, q, h, t) in enumerate(rows)], SEARCHES)


def test_history_collapses_over_midnight(spark):
    df = searches(spark, ("a", "x", 22, 1), ("a", "x", 23, 2), ("a", "x", 25, 3), ("a", "y", 26, None), ("a", "x", 27, 4), (None, "x", 1, 1))
    got = sorted((r["q"], r["times"], r["total"]) for r in activity.collapse_history(df).collect())
    assert got == [("x", 1, 4), ("x", 3, 3), ("y", 1, None)]


def test_limits_and_cooldown(spark):
    df = searches(spark, ("a", "Q", 0, 1), ("a", "q ", 5, 1), ("b", "q", 6, 1), ("a", "q", 11, 1), ("a", "q", 12, 1), ("a", "", 0, 1))
    assert activity.fair_use_refusals(df, 4).count() == 1
    assert sorted(r["run_at"].hour for r in activity.cooldown_runs(df).collect()) == [0, 6, 12]


def test_cooldown_equals_going_through_the_log(spark):
    import datetime
    import random

    random.seed(7)
    at = datetime.datetime(2026, 1, 1)
    rows = [(i, "o", random.choice("ab "), at + datetime.timedelta(minutes=random.choice((1, 30, 360)) * random.randint(0, 200)), 1, 1) for i in range(600)]
    want, last = set(), {}
    for _, _, q, t, *_ in sorted(rows, key=lambda r: r[3]):
        if q.strip() and (q not in last or t - last[q] >= datetime.timedelta(hours=6)):
            last[q] = t
            want.add((q, t))
    got = [(r["q"], r["run_at"].replace(tzinfo=None)) for r in activity.cooldown_runs(spark.createDataFrame(rows, SEARCHES)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_the_instance_that_answered_last_is_tried_first(spark, monkeypatch):
    import random

    monkeypatch.setattr(activity, "SLICE", 7)
    random.seed(3)
    rows = [(f"r{t}", t, p, k, random.random() < 0.7, random.randint(0, 3)) for t in range(3, 80) for k, p in enumerate("xyz")]
    want, last = {}, None
    for t in range(3, 80):
        good = [p for _, at, p, _, ok, n in rows if at == t and ok and n]
        last = last if last in good else good[0] if good else last
        want[f"r{t}"] = last if good else "wide"
    got = activity.failover(spark.createDataFrame(rows, "request string, at bigint, provider string, priority int, ok boolean, n int"), "wide").collect()
    assert {r["request"]: r["provider"] for r in got} == want and len(got) == len(want) and "wide" in want.values()
    assert activity.failover(spark.createDataFrame([], "request string, at bigint, provider string, priority int, ok boolean, n int"), "wide").count() == 0


def test_crawl_order(spark):
    from korpora.operators.graph import crawl_order

    u = lambda k: f"https://{'ab'[k >= 8]}.example/{k}"
    pages = spark.createDataFrame([(u(k), "skipped" if k == 2 else "error" if k == 3 else "indexed") for k in range(10) if k != 5], "url string, outcome string")
    links = spark.createDataFrame([(u(a), u(b), i) for i, (a, b) in enumerate([(0, 2), (0, 1), (0, 8), (0, 0), (2, 4), (1, 4), (1, 5), (3, 6), (4, 7)])] + [(u(0), None, 99)], "url string, target string, at int")
    seeds = spark.createDataFrame([(u(3), 1), (u(0), 0), (u(0), 2), (None, 3)], "url string, at int")
    run = lambda **k: [(int(r["url"][-1]), r["depth"], r["outcome"]) for r in crawl_order(pages, links, seeds, **k).orderBy("nth").collect()]
    assert run() == [(0, 0, "indexed"), (3, 0, "error"), (2, 1, "skipped"), (1, 1, "indexed"), (4, 2, "indexed"), (5, 2, "error")]
    assert run(max_depth=1, same_domain=False) == [(0, 0, "indexed"), (3, 0, "error"), (2, 1, "skipped"), (1, 1, "indexed"), (8, 1, "indexed")]
    assert run(max_pages=2)[-1] == (1, 1, "indexed") and run(max_pages=1) == [(0, 0, "indexed")] and run(max_pages=0) == []


def test_settings_reject_what_they_do_not_know(spark):
    patches = spark.createDataFrame([("a", 1, "theme", "dark"), ("a", 2, "__proto__", "1"), ("a", 3, "resultsPerPage", "4")], "owner string, at int, key string, value string")
    got = {(r["key"], r["value"], r["error"]) for r in activity.effective_settings(patches).collect()}
    assert ("theme", "dark", None) in got and ("__proto__", "1", "unknown_setting") in got and ("resultsPerPage", "4", "invalid_setting_value") in got and ("resultsPerPage", "10", None) in got


def allowed(spark, text, agent, *paths):
    rules = robots.choose_group(robots.parse(spark.createDataFrame([("o", text)], "origin string, text string")), agent)
    return {r["path"]: r["allowed"] for r in robots.allowed(spark.createDataFrame([("o", p) for p in paths], "origin string, path string"), rules).collect()}


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.gif$\n\nUser-agent: Special\nUser-agent: other\nDisallow: /\nCrawl-delay: 3"
    assert allowed(spark, text, "mybot/1", "/a", "/a/b", "/x.gif", "/x.gif?y", "/z") == {"/a": False, "/a/b": True, "/x.gif": False, "/x.gif?y": True, "/z": True}
    assert allowed(spark, text, "special/2", "/z") == {"/z": False}
    assert allowed(spark, "", "bot", "/z") == {"/z": True} and allowed(spark, "User-agent: *\nDisallow:\n", "bot", "/z") == {"/z": True}
    delay = robots.parse(spark.createDataFrame([("o", text)], "origin string, text string")).where("group_no = 2").first()
    assert delay["crawl_delay"] == 3.0 and sorted(delay["agents"]) == ["other", "special"]


def test_json_corpus_and_clustered_tables(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"url": f"https://x.example/{k}", "title": "t", "fetchedAt": "2026-08-01T00:00:00.000Z"}, {"url": "u", "fetchedAt": "never"}]))
    df = read_json_corpus(spark, *map(str, tmp_path.glob("*.json")))
    assert df.count() == 4 and df.where("fetched_at IS NULL").count() == 2
    write_clustered(spark.range(100).withColumnRenamed("id", "k"), str(tmp_path / "out"), "k", 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_incremental_index_folds_batches(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, f"https://x.example/{i % 3}", "t", "d", "some text", None, None, None) for i in range(6)]
    schema = "id bigint, url string, title string, description string, text string, links array<string>, lang string, fetched_at timestamp"
    for k in range(2):
        spark.createDataFrame(rows[k * 3 : k * 3 + 3], schema).coalesce(1).write.parquet(str(source / f"part{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    seen: dict[str, int] = {}

    def fold(batch, _):
        for r in batch.select("url", "id").collect():
            seen[r["url"]] = max(r["id"], seen.get(r["url"], -1))

    jobs.incremental_index(stream, "", str(tmp_path / "cp"), fold).awaitTermination()
    assert seen == {f"https://x.example/{i}": i + 3 for i in range(3)}


def test_intermediate_tables_can_be_released(spark):
    from korpora.session import _written, materialize, release, shared_dir

    kept, _written[:] = list(_written), []
    materialize(spark.range(3), "test")
    (path,) = _written
    assert path.startswith(shared_dir(spark)) and release(spark) == 1
    _written[:] = kept


def test_hosts_are_asked_side_by_side_within_a_budget(spark, monkeypatch):
    from korpora.operators import discovery

    monkeypatch.setattr(discovery, "SLICE_ROWS", 3)
    rows = [(f"https://{'ab'[i % 2]}.example/{i}", i, 100 + 50 * i) for i in range(12)] + [("junk", 12, 1), ("https://c.example", 13, None)]
    got = {r["url"]: (r["starts"], r["outcome"]) for r in discovery.fetch_schedule(spark.createDataFrame(rows, "url string, at int, ms int"), 300, 1600).collect()}
    clock, want = {}, {}
    for url, _, ms in rows:
        if url.startswith("http"):
            host, ms = url[8], ms or 0
            at = clock.get(host, 0)
            want[url] = (at, "fetched" if at + ms <= 1600 else "remaining")
            clock[host] = at + max(ms, 300)
    assert got == want and any(o == "remaining" for _, o in want.values())


def test_discovered_pages_join_a_stored_index(spark, tmp_path):
    import datetime

    from korpora import cli
    from korpora.operators import discovery
    from korpora.operators.index import build_index
    from korpora.sources.index_store import drop_versions, open_index, save_index

    schema = "id bigint, url string, title string, description string, text string, links array<string>, lang string, fetched_at timestamp"
    at = datetime.datetime(2026, 1, 1)
    index = build_index(spark.createDataFrame([(1, "https://a.example/1", "kelp", "", "rope", [], None, at)], schema))
    web = spark.createDataFrame(
        [("https://b.example/2", 10, False, False, 2, "lamp", "", "kelp lamp", ["https://a.example/1"], None, at), ("https://b.example/3", 10, False, True, 3, "x", "", "y", [], None, at), ("https://b.example/4", 9000, False, False, 4, "late", "", "", [], None, at)],
        "url string, ms int, error boolean, noindex boolean, " + schema.replace("url string, ", ""),
    )
    found = spark.createDataFrame([(f"https://b.example/{k}#x", k) for k in (2, 3, 4, 5)] + [("https://a.example/1", 0), (None, 9)], "url string, at int")
    grown = discovery.expand(index, found, web)
    assert {r["url"][-1]: r["outcome"] for r in grown.outcomes.collect()} == {"1": "known", "2": "indexed", "3": "skipped", "4": "remaining", "5": "remaining"}
    assert {r["outcome"] for r in discovery.expand(index, found, web, budget=None).outcomes.collect()} == {"known", "indexed", "skipped", "error"}
    assert grown.index.edges.count() == 1 and {r["df"] for r in grown.index.terms.where("term = 'kelp'").collect()} == {2}
    folder = str(tmp_path / "index")
    save_index(index, folder)
    save_index(grown.index, folder)
    assert drop_versions(spark, folder) == 1 and open_index(spark, folder, cached=True).docs.count() == 2
    assert cli.main(["doctor", folder]) == 0 and cli.main(["suggest", folder, "ke"]) == 0
    with __import__("pytest").raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))
