"""Command line: ``python -m korpora.cli build|search|suggest|stats|doctor FOLDER ...``"""

from __future__ import annotations

import argparse
import datetime
import json

from korpora.engine import SearchEngine
from korpora.operators.index import build_index
from korpora.session import get_spark, release
from korpora.sources.index_store import open_index, save_index
from korpora.sources.tables import read_json_corpus


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="korpora")
    todo = parser.add_subparsers(dest="todo", required=True)
    for name, about in (("build", "index files of JSON arrays or a Parquet table"), ("search", "one page of results"), ("suggest", "words that continue what is typed"), ("stats", "size of the index"), ("doctor", "what is wrong with the index")):
        sub = todo.add_parser(name, help=about)
        sub.add_argument("folder")
        if name == "build":
            sub.add_argument("sources", nargs="+")
        if name in ("search", "suggest"):
            sub.add_argument("text")
        if name == "search":
            sub.add_argument("--page", type=int, default=1)
            sub.add_argument("--per-page", type=int, default=10)
            sub.add_argument("--now", default=datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S"))
    args = parser.parse_args(argv)
    spark = get_spark("korpora")
    if args.todo == "build":
        tables = [s for s in args.sources if s.rstrip("/").endswith(".parquet")]
        docs = spark.read.parquet(*tables) if tables else read_json_corpus(spark, *args.sources)
        if "id" not in docs.columns:
            from pyspark.sql import functions as F

            # Stable while the index is built: the hash of the URL.
            docs = docs.withColumn("id", F.xxhash64("url")).dropDuplicates(["id"])
        print(save_index(build_index(docs), args.folder))
        release(spark)
        return 0
    index = open_index(spark, args.folder)
    if args.todo == "doctor":
        orphans = index.postings.join(index.docs.selectExpr("id AS doc_id"), "doc_id", "left_anti").count()
        empty = index.docs.where("len = 0").count()
        stale = index.terms.join(index.postings.groupBy("term").count(), "term", "left").where("coalesce(count, 0) <> df").count()
        print(json.dumps({"postings_without_page": orphans, "pages_without_words": empty, "terms_with_stale_counts": stale}))
        return int(bool(orphans or stale))
    engine = SearchEngine(index, index.cap)
    if args.todo == "stats":
        print(json.dumps(engine.stats()))
    elif args.todo == "suggest":
        print(json.dumps(engine.suggest(args.text), ensure_ascii=False))
    else:
        print(json.dumps(vars(engine.search(args.text, args.now, args.page, args.per_page)), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
