"""Queries over training data: problems 2, 3, 4, 6, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm import dedup, handwritten, names, packing, splitting, syntax, tokenize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The records of problem 2: which predicates hold records, and whether those are lists of fields.
RECORD_KINDS = {"declares": True, "commitMessage": False}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of records written in other ways, with the row that is kept."""
    return dedup.duplicates(table(spark, sf_dir, "triples"), RECORD_KINDS)


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record each with its number of copies."""
    return dedup.records(table(spark, sf_dir, "triples"), RECORD_KINDS)


def _languages(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Which extensions are source files: a small fixed table."""
    return {r["ext"]: r["language"] for r in table(spark, sf_dir, "ext_languages").collect()}


def _not_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [r["content"] for r in table(spark, sf_dir, "upstream_files").select("content").collect() if r["content"]]  # a fixed table
    return handwritten.not_handwritten(table(spark, sf_dir, "files"), _languages(spark, sf_dir), known)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that are machine-written, minified, third-party or data."""
    return _not_handwritten(spark, sf_dir).select("path")


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what each file is."""
    return _not_handwritten(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that are not valid in the language of their extension."""
    return syntax.invalid(table(spark, sf_dir, "files"), _languages(spark, sf_dir)).select("path")


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the language and the line of the first unrecoverable error."""
    return syntax.invalid(table(spark, sf_dir, "files"), _languages(spark, sf_dir))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files of every repository and language."""
    return syntax.rates(table(spark, sf_dir, "files"), _languages(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of the same person or organisation."""
    return names.variants(table(spark, sf_dir, "file_git_info"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokenize.encode(table(spark, sf_dir, "documents"))


def _limits(spark: SparkSession, sf_dir: str, problem: int) -> list:
    """The sizes to work with: a small fixed table."""
    return table(spark, sf_dir, "token_limits").filter(F.col("problem") == problem).orderBy("limit_id").collect()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (of every part of an oversized one) at every limit."""
    limits = [(r["limit_id"], r["max_tokens"]) for r in _limits(spark, sf_dir, 8)]
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), limits)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document above a limit."""
    limits = [(r["limit_id"], r["max_tokens"], r["overlap_tokens"]) for r in _limits(spark, sf_dir, 9)]
    return splitting.split(table(spark, sf_dir, "documents"), limits)


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p3_found, p3_kinds, p4_found, p4_errors, p4_rates, p6_found, p7_ids, p8_containers, p9_pieces)}
_RECORDS = r"""
  recs AS (SELECT triple_id, p, lower(o) AS x, regexp_extract_all(lower(o), '[\p{L}\p{Nd}]+') AS w FROM triples WHERE p IN ('declares', 'commitMessage') AND o IS NOT NULL),
  flds AS (SELECT triple_id, f, regexp_extract(f, '^([^:=]*)[:=]', 1) AS name, CASE WHEN regexp_matches(f, '[:=]') THEN regexp_replace(f, '^[^:=]*[:=]', '') ELSE f END AS val
    FROM (SELECT triple_id, unnest(string_split_regex(x, '[,;|\r\n]+')) AS f FROM recs WHERE p = 'declares' AND len(w) >= 3)),
  leaves AS (SELECT triple_id, array_to_string(regexp_extract_all(name, '[\p{L}\p{Nd}]+'), ' ') || '=' || array_to_string(regexp_extract_all(val, '[\p{L}\p{Nd}]+'), ' ') AS leaf FROM flds),
  forms AS (
    SELECT triple_id, 'declares' AS p, string_agg(leaf, '|' ORDER BY leaf) AS form FROM leaves WHERE leaf <> '=' GROUP BY triple_id
    UNION ALL SELECT triple_id, p, array_to_string(w, ' ') FROM recs WHERE p = 'commitMessage' AND len(w) >= 3)"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH {_RECORDS}
SELECT keep_id, triple_id AS dup_id FROM (SELECT triple_id, min(triple_id) OVER (PARTITION BY p, form) AS keep_id FROM forms) WHERE triple_id <> keep_id""",
    "p2_records": f"WITH {_RECORDS} SELECT min(triple_id) AS keep_id, p AS kind, count(*) AS copies FROM forms GROUP BY p, form",
}
