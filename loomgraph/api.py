"""One object for the whole surface: build a graph, query it, page through results; and a small command line."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.operators import analytics, code, diagram, extract, gitlog, search
from loomgraph.plans import sparql
from loomgraph.sources import tree

PAGE = 50
QUERY_PAGE = 100
DIAGRAM = 200
COMMITS = 500


def page(df: DataFrame, limit: int = PAGE, offset: int = 0, order: list[str] | None = None) -> dict:
    """results, total, returned, offset, has_more [, next_offset, message] of one page in a defined order."""
    total = df.count()
    rows = df.orderBy(*(order or df.columns)) if order is None or order else df
    results = [r.asDict(recursive=True) for r in rows.offset(offset).limit(limit).collect()]  # one page
    out: dict = {"results": results, "total": total, "returned": len(results), "offset": offset, "has_more": offset + len(results) < total}
    if out["has_more"]:
        end = offset + len(results)
        out |= {"next_offset": end, "message": f"Showing {offset + 1}–{end} of {total} results. Use offset: {end} to see the next page."}
    return out


def build(files: DataFrame, commits: DataFrame | None = None, commit_files: DataFrame | None = None, debian: bool = False) -> DataFrame:
    """All facts (before duplicates are dropped) of a table of files and, if given, of a history."""
    facts = extract.file_facts(files, list(code.EXTENSIONS), debian).unionByName(code.code_facts(files))
    if commits is not None and commit_files is not None:
        facts = facts.unionByName(gitlog.history_facts(commits, commit_files))
    return facts


class CodebaseGraph:
    """A graph of facts (s, p, o).  A refresh builds the new graph first and swaps it in then."""

    def __init__(self, spark: SparkSession, triples: DataFrame | None = None, files: DataFrame | None = None):
        self.spark, self.root = spark, None
        empty = spark.createDataFrame([], "s string, p string, o string")
        self.facts = analytics.graph(triples) if triples is not None else empty
        self.files = files if files is not None else spark.createDataFrame([], tree.FILES)

    # -- store

    def ingest(self, root: str, exclude: list[str] | None = None, commits: int | None = COMMITS) -> dict:
        """Reads a source tree and its newest ``commits`` (None: all).

        raw_count: facts found; skipped_count: those of them with no subject or object, which can't be stored;
        distinct_count: facts kept.
        """
        self.root = os.path.abspath(root)
        files = tree.read_tree(self.spark, self.root, exclude)
        found = build(files, *tree.read_log(self.spark, self.root, commits)).persist()
        facts = analytics.graph(found).persist()
        counted = found.agg(F.count("*").alias("n"), F.count_if(F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull()).alias("skipped")).first()
        out = {"raw_count": counted["n"], "skipped_count": counted["skipped"], "distinct_count": facts.count()}
        found.unpersist()
        old, self.facts, self.files = self.facts, facts, files
        old.unpersist()
        return out

    def refresh(self, path: str | None = None, exclude: list[str] | None = None, commits: int | None = COMMITS) -> dict:
        if path is None and self.root is None:
            raise ValueError("nothing has been indexed yet: give a path")
        return self.ingest(path or self.root, exclude, commits)

    def index_repo(self, url: str, folder: str, exclude: list[str] | None = None) -> dict:
        """Fetches a remote repository (shallow: at most one commit of history) below ``folder`` and indexes it."""
        return self.ingest(tree.fetch(url, folder), exclude)

    def insert(self, s: str, p: str, o: str) -> None:
        """For a few facts; many belong in a DataFrame given to the constructor."""
        self.facts = analytics.graph(self.facts.unionByName(self.spark.createDataFrame([(s, p, o)], self.facts.schema)))

    def clear(self) -> None:
        self.facts = self.spark.createDataFrame([], "s string, p string, o string")

    def write(self, path: str) -> None:
        """The graph as Parquet, partitioned by predicate: a pattern with a constant predicate reads its part only."""
        self.facts.repartition("p").write.mode("overwrite").partitionBy("p").parquet(path)

    # -- queries

    def query(self, text: str) -> DataFrame:
        return sparql.query(self.facts, text)

    def query_page(self, text: str, limit: int = QUERY_PAGE, offset: int = 0) -> dict:
        return page(self.query(text), limit, offset, [])

    def __getattr__(self, name: str):
        """find_symbol, find_callers, find_callees, list_structures, file_stats, find_dead_code, find_dependencies, find_entry_points."""
        if name.startswith("find_") or name in ("list_structures", "file_stats"):
            f = getattr(analytics, name)
            return lambda *a, **k: f(self.facts, *a, **k)
        raise AttributeError(name)

    def search_pattern(self, pattern: str, language: str, exclude: list[str] | None = None, limit: int | None = PAGE) -> DataFrame:
        return search.search(self.files, pattern, language, exclude, limit, self.root)

    def generate_diagram(self, path: str | None = None, depth: int = 0, code_only: bool = True, exclude: list[str] | None = None, limit: int = DIAGRAM) -> str:
        return diagram.render(self.facts, path, depth, code_only, exclude, limit)

    def describe(self, what: str = "project") -> dict:
        """project, practices, testing, ci_cd, code_quality, architecture, documentation, dependencies or activity."""
        return getattr(analytics.Reports(self.facts), what)()


def excludes(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph")
    parser.add_argument("command", choices=["describe", "activity", "testing", "architecture", "dependencies", "practices", "stats", "query", "find", "diagram"])
    parser.add_argument("path")
    parser.add_argument("text", nargs="?", help="a query or a name")
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--limit", type=int, default=QUERY_PAGE, help="rows of a page")
    parser.add_argument("--offset", type=int, default=0, help="where the page begins")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    graph = CodebaseGraph(spark)
    graph.ingest(a.path, a.exclude)
    if a.command == "diagram":
        print(graph.generate_diagram(limit=500))
    elif a.command in ("query", "find", "stats"):
        if a.command != "stats" and not a.text:
            parser.error(f"{a.command} needs a text")
        df = graph.file_stats() if a.command == "stats" else graph.query(a.text) if a.command == "query" else graph.find_symbol(a.text)
        print(json.dumps(page(df, a.limit, a.offset, [] if a.command == "query" else None), indent=2, ensure_ascii=False, default=str))
    else:
        print(json.dumps(graph.describe("project" if a.command == "describe" else a.command), indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
