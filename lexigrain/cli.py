"""Command line: index files or load an index, then answer queries, one a line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .engine import SearchEngine
from .operators.wildcard import STRATEGIES
from .plans.lang import QuerySyntaxError, UnsupportedQuery
from .session import local_session
from .sources.files import read_documents


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexigrain", description=__doc__)
    p.add_argument("paths", nargs="*", help="files and folders to index")
    p.add_argument("-r", "--recursive", action="store_true", help="go down into folders")
    p.add_argument("-e", "--extension", help="take only such files from folders")
    p.add_argument("-o", "--output", help="save the index here")
    p.add_argument("--from", dest="source", help="load this index; paths are appended to it")
    p.add_argument("-n", "--negation", action="store_true", help="answer queries that hold for documents without any of their words")
    p.add_argument("-m", "--mode", choices=["boolean", "zones", "bm25"], default="boolean")
    p.add_argument("--missing", choices=["skip", "stop"], default="skip", help="BM25: leave absent words out, or stop at the first")
    p.add_argument("-w", "--wildcards", action="append", default=[], choices=list(STRATEGIES), help="save an index for wildcards of this kind")
    p.add_argument("--bigrams", action="store_true", help="save an index of neighbouring words")
    p.add_argument("--no-positions", action="store_true", help="save no positions: phrases go by neighbouring words, distances aren't answered")
    p.add_argument("-s", "--stat", action="store_true", help="print the index's statistics")
    p.add_argument("-x", "--execute", action="append", help="a query to answer instead of those on standard input")
    a = p.parse_args(args)
    spark = local_session()
    if a.source:
        engine = SearchEngine.load(spark, a.source)
        if a.paths:
            engine = engine.append(a.source, read_documents(spark, a.paths, a.extension, a.recursive))
    else:
        engine = SearchEngine.of_files(spark, a.paths, a.extension, a.recursive)
    if a.output:
        engine.save(a.output, positions=not a.no_positions, bigrams=a.bigrams, wildcards=a.wildcards)
        engine = SearchEngine.load(spark, a.output)
    if a.stat:
        for k, v in engine.stats().first().asDict().items():
            print(f"{k}: {v}")
    shown = ["path"] if "path" in engine.index.documents.columns else [F.col("doc_id").alias("id")]
    for line in a.execute or sys.stdin:
        if not (query := line.strip()):
            continue
        try:
            if a.mode == "boolean":
                for row in engine.with_documents(engine.search(query, allow_negation=a.negation), shown).toLocalIterator():
                    print(row[-1])
            else:
                found = engine.search_zones(query, allow_negation=a.negation) if a.mode == "zones" else engine.search_bm25(query, a.missing, allow_negation=a.negation)
                for row in engine.with_documents(found, shown).toLocalIterator():
                    print(f"{row[-1]} -- {row.rating}")
        except (QuerySyntaxError, UnsupportedQuery) as e:
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
