"""Queries of the core: the two general hierarchy and wide-table problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.operators.hierarchy import Hierarchy, dropped_links, edges_from_triples
from loomgraph.operators.wide import wide_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every node of the links."""
    return Hierarchy(edges_from_triples(table(spark, sf_dir, "triples"))).nodes.select("node", "root", "depth")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its path, depth, root and subtree size."""
    h = Hierarchy(edges_from_triples(table(spark, sf_dir, "triples")))
    return h.nodes.select("node", "root", "depth", F.concat_ws(" > ", "path").alias("path"), "subtree_size")


def p1_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that the hierarchy leaves out because their node has another, smaller parent."""
    return dropped_links(edges_from_triples(table(spark, sf_dir, "triples")).select(F.col("child").alias("node"), "parent"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return Hierarchy(edges_from_triples(table(spark, sf_dir, "triples")), sizes=False).descendants()


def _attributes(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The schema of the wide table: a small fixed table."""
    return {r["p"]: r["value_type"] for r in table(spark, sf_dir, "wide_attributes").orderBy("p").collect()}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the wide table whose values do not all denote one and the same."""
    wide = wide_table(table(spark, sf_dir, "triples"), _attributes(spark, sf_dir))
    return wide.select("s", F.explode("uncertain").alias("p"))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject with typed columns (instants in UTC) and its uncertain attributes."""
    attributes = _attributes(spark, sf_dir)
    wide = wide_table(table(spark, sf_dir, "triples"), attributes)
    utc = lambda c: F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros(`{c}`) / 1000000 as decimal(18, 6)))")
    return wide.select("s", *[utc(a).alias(a) if t == "timestamp" else F.col(a) for a, t in attributes.items()], F.concat_ws(",", "uncertain").alias("uncertain"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_dropped, p1_descendants, p5_found, p5_wide)}

_CELLS = r"""
  typed AS (
    SELECT s, t.p, o, value_type, regexp_replace(o, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS x FROM triples t JOIN wide_attributes w ON t.p = w.p WHERE s IS NOT NULL),
  parsed AS (
    SELECT *, lower(x) AS l, regexp_replace(lower(x), ' ?(z|utc|gmt)$', '+00:00') AS z FROM typed),
  vals AS (
    SELECT s, p, o, value_type,
      CASE value_type
        WHEN 'string' THEN nullif(x, '')
        WHEN 'boolean' THEN CASE WHEN l IN ('true', 'yes', '1') THEN 'true' WHEN l IN ('false', 'no', '0') THEN 'false' END
        WHEN 'bigint' THEN CAST(CASE
          WHEN regexp_full_match(l, '[+-]?([0-9]+|[0-9]{1,3}([,_''’\p{Zs}][0-9]{3})+)(\.0*)?') THEN TRY_CAST(regexp_replace(regexp_replace(l, '[,_''’+\p{Zs}]', '', 'g'), '\.0*$', '') AS BIGINT)
          WHEN regexp_full_match(l, '[+-]?[0-9]+(\.[0-9]*)?e[+-]?[0-9]{1,2}') AND TRY_CAST(l AS DECIMAL(38, 10)) = floor(TRY_CAST(l AS DECIMAL(38, 10))) THEN TRY_CAST(TRY_CAST(l AS DECIMAL(38, 10)) AS BIGINT)
          END AS VARCHAR)
        WHEN 'timestamp' THEN CASE WHEN regexp_full_match(z, '[0-9]{4}-?[0-9]{2}-?[0-9]{2}[t ][0-9]{2}:?[0-9]{2}(:?[0-9]{2}([.,][0-9]+)?)? ?[+-][0-9]{2}(:?[0-9]{2})?')
          THEN CAST(epoch_us(TRY_CAST(regexp_replace(regexp_replace(z, '([+-][0-9]{2})([0-9]{2})$', '\1:\2'), '([0-9])t([0-9])', '\1 \2') AS TIMESTAMPTZ)) AS VARCHAR) END
      END AS v FROM parsed),
  cells AS (
    SELECT s, p, any_value(value_type) AS value_type, count(o) AS n, count(v) AS ok, min(v) AS v, max(v) AS hi FROM vals GROUP BY s, p),
  judged AS (SELECT s, p, coalesce(n > 0 AND ok = n AND v = hi, false) AS certain, n, v FROM cells)"""

_EDGES = """
  edges AS (
    SELECT DISTINCT CASE WHEN p = 'contains' THEN s ELSE o END AS parent, CASE WHEN p = 'contains' THEN o ELSE s END AS child
    FROM triples WHERE p IN ('contains', 'partOf') AND s IS NOT NULL AND o IS NOT NULL),
  nodes AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges),
  walk AS (
    SELECT node, node AS root, CAST(0 AS BIGINT) AS depth, node AS path FROM nodes WHERE node NOT IN (SELECT child FROM edges)
    UNION ALL
    SELECT e.child, w.root, w.depth + 1, w.path || ' > ' || e.child FROM walk w JOIN edges e ON e.parent = w.node)"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_EDGES}
SELECT n.node, coalesce(w.root, '') AS root, coalesce(w.depth, CAST(-1 AS BIGINT)) AS depth FROM nodes n LEFT JOIN walk w ON w.node = n.node""",
    "p1_hierarchy": f"""WITH RECURSIVE {_EDGES},
  up AS (
    SELECT w.node AS node, w.node AS anc FROM walk w
    UNION ALL
    SELECT u.node, e.parent FROM up u JOIN edges e ON e.child = u.anc),
  sizes AS (SELECT anc AS node, count(*) AS subtree_size FROM up GROUP BY anc)
SELECT n.node, coalesce(w.root, '') AS root, coalesce(w.depth, CAST(-1 AS BIGINT)) AS depth, coalesce(w.path, '') AS path, z.subtree_size
FROM nodes n LEFT JOIN walk w ON w.node = n.node LEFT JOIN sizes z ON z.node = n.node""",
    "p1_dropped": f"""WITH RECURSIVE {_EDGES}
SELECT e.child AS node, e.parent FROM edges e JOIN (SELECT child, min(parent) AS kept FROM edges GROUP BY child) k ON e.child = k.child WHERE e.parent <> k.kept""",
    "p1_descendants": f"""WITH RECURSIVE {_EDGES},
  up AS (
    SELECT w.node AS node, e.parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM walk w JOIN edges e ON e.child = w.node
    UNION ALL
    SELECT u.node, e.parent, u.distance + 1 FROM up u JOIN edges e ON e.child = u.ancestor)
SELECT ancestor, node, distance FROM up""",
    "p5_found": f"WITH {_CELLS} SELECT s, p FROM judged WHERE n > 0 AND NOT certain",
    "p5_wide": f"""WITH {_CELLS}
SELECT s, {", ".join(f"max(CASE WHEN p = '{a}' AND certain THEN v END) AS {a}" for a in ("commitAuthor", "hasMimeType", "lastModifiedBy"))},
  {", ".join(f"make_timestamp(CAST(max(CASE WHEN p = '{a}' AND certain THEN v END) AS BIGINT)) AS {a}" for a in ("commitDate", "lastModifiedDate"))},
  {", ".join(f"CAST(max(CASE WHEN p = '{a}' AND certain THEN v END) AS BIGINT) AS {a}" for a in ("commitCount", "hasSize"))},
  CAST(max(CASE WHEN p = 'isTestFunction' AND certain THEN v END) AS BOOLEAN) AS "isTestFunction",
  coalesce(string_agg(CASE WHEN n > 0 AND NOT certain THEN p END, ',' ORDER BY p), '') AS uncertain
FROM judged GROUP BY s""",
}
