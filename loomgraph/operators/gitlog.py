"""Version-control history as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.terms import iri_safe

MARK = "\x1e"  # between commits in a log's text
FIELDS = f"{MARK}%H|%an|%aI|%s"


def parse_log(log: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of rows that each hold one log: seq counts from the newest.

    A block whose header has fewer than four parts is dropped.
    """
    blocks = log.select(F.posexplode(F.split(log[text], MARK)).alias("seq", "block")).withColumn("block", F.regexp_replace("block", r"(?U)^\s+|\s+$", "")).filter("block <> ''")
    rows = F.split("block", "\r?\n")
    parsed = blocks.select("seq", F.split(rows[0], r"\|", 4).alias("h"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("files")).filter(F.size("h") == 4)
    commits = parsed.select("seq", F.col("h")[0].alias("hash"), F.col("h")[1].alias("author"), F.col("h")[2].alias("date"), F.col("h")[3].alias("message"))
    touched = parsed.select("seq", F.col("h")[0].alias("hash"), F.explode("files").alias("file")).withColumn("file", F.regexp_replace("file", r"(?U)^\s+|\s+$", "")).filter("file <> ''")
    return commits, touched


def commit_facts(commits: DataFrame) -> DataFrame:
    """Five facts of every commit in one pass; a null part gives no fact."""
    h = iri_safe(F.col("hash"))
    pairs = [(F.lit("project"), "hasCommit", h), (h, "a", F.lit("Commit")), (h, "commitAuthor", iri_safe(F.col("author"))), (h, "commitDate", iri_safe(F.col("date"))), (h, "commitMessage", iri_safe(F.col("message")))]
    facts = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in pairs])
    return commits.filter(F.col("hash").isNotNull()).select(F.explode(F.filter(facts, lambda f: f["o"].isNotNull())).alias("f")).select("f.s", "f.p", "f.o")


def file_git_info(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """file, last_author, last_date (those of the first listing, i.e. the smallest seq), commit_count, contributors (sorted).

    Whole repeated rows count once.  Commits are joined on seq and hash.
    """
    c = commits.select("seq", "hash", "author", "date").distinct()
    t = commit_files.select("seq", "hash", "file").filter(F.col("file").isNotNull()).distinct()
    j = t.join(c, ["seq", "hash"]).select(iri_safe(F.col("file")).alias("file"), "seq", iri_safe(F.col("author")).alias("author"), iri_safe(F.col("date")).alias("date"))
    return j.groupBy("file").agg(F.min_by("author", "seq").alias("last_author"), F.min_by("date", "seq").alias("last_date"), F.count("*").alias("commit_count"), F.sort_array(F.collect_set("author")).alias("contributors"))


def history_facts(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """All facts of a history: of commits, of the files they touch, and of the files' aggregates."""
    touches = commit_files.filter(F.col("hash").isNotNull() & F.col("file").isNotNull()).select(iri_safe(F.col("hash")).alias("s"), F.lit("commitTouches").alias("p"), iri_safe(F.col("file")).alias("o"))
    info = file_git_info(commits, commit_files)
    one = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    facts = F.concat(F.array(one("lastModifiedBy", F.col("last_author")), one("lastModifiedDate", F.col("last_date")), one("commitCount", F.col("commit_count").cast("string"))), F.transform("contributors", lambda x: one("contributedBy", x)))
    per_file = info.select("file", F.explode(facts).alias("f")).select(F.col("file").alias("s"), "f.p", "f.o").filter("o is not null")
    return commit_facts(commits).unionByName(touches).unionByName(per_file)
