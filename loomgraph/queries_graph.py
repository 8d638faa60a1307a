"""Queries of the graph's own operators, each over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions import terms
from loomgraph.operators import analytics, code, diagram, extract, gitlog, rules, search
from loomgraph.plans import sparql

EXCLUDE = ["vendor", "tests"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.graph(table(spark, sf_dir, "triples"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        SQL[name] = sql


def _on_graph(name: str, f, sql: str | None = None) -> None:
    _add(name, lambda spark, d: f(_g(spark, d)), None if sql is None else f"WITH g AS (SELECT DISTINCT s, p, o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL) {sql}")


# what identifiers become in SQL: the characters of the names asked for are never escaped
_OUT = " AND ".join(f"('/' || s) NOT LIKE '%/{d}/%'" for d in EXCLUDE)

# -- store and canned analytics ---------------------------------------------------
_on_graph("graph_facts", lambda g: g.groupBy("p").agg(F.count("*").alias("facts")), "SELECT p, count(*) AS facts FROM g GROUP BY p")
_on_graph("find_symbol", lambda g: analytics.find_symbol(g, "parser", EXCLUDE), f"SELECT s AS subject, o AS type FROM g WHERE p = 'a' AND contains(s, 'parser') AND {_OUT}")
_on_graph("find_callers", lambda g: analytics.find_callers(g, "load", EXCLUDE), f"SELECT s AS caller, o AS callee FROM g WHERE p = 'calls' AND contains(o, 'load') AND {_OUT}")
_on_graph("find_callees", lambda g: analytics.find_callees(g, "verify", EXCLUDE), f"SELECT s AS caller, o AS callee FROM g WHERE p = 'calls' AND contains(s, 'verify') AND {_OUT}")
_on_graph("list_structures", lambda g: analytics.list_structures(g, "docs", "Section", EXCLUDE), f"SELECT s AS subject, o AS type FROM g WHERE p = 'a' AND o = 'Section' AND contains(s, 'docs') AND {_OUT} ORDER BY 1")
_on_graph("file_stats", analytics.file_stats, "SELECT o AS type, count(*) AS count FROM g WHERE p = 'a' GROUP BY o ORDER BY 2 DESC, 1")
_on_graph("dead_code", lambda g: analytics.find_dead_code(g, EXCLUDE), f"SELECT s AS func FROM g WHERE p = 'a' AND o = 'Function' AND {_OUT} AND regexp_extract(s, '[^/]*$') NOT IN (SELECT o FROM g WHERE p = 'calls') ORDER BY 1")
_on_graph("dependencies", analytics.find_dependencies, "SELECT s AS file, o AS dependency FROM g WHERE p = 'dependsOn' ORDER BY 1, 2")
_on_graph("entry_points", lambda g: analytics.find_entry_points(g, EXCLUDE), f"SELECT s AS subject, o AS type FROM g WHERE p = 'a' AND regexp_matches('/' || s, '/(main|index|app|server|cli|cmd)') AND {_OUT}")
_LABELS = ", ".join(f"('{label}', '{p}')" for label, p in analytics.CATEGORIES.items())
_on_graph("practices", lambda g: analytics.practice_lists(g).select("label", F.concat_ws(",", "values").alias("practice_values")), f"SELECT label, string_agg(o, ',' ORDER BY o) AS practice_values FROM g JOIN (VALUES {_LABELS}) c(label, pred) ON p = pred WHERE s = 'project' GROUP BY label")
_on_graph("practice_values", lambda g: analytics.practice_values(g, "usesLinter"), "SELECT o AS value FROM g WHERE s = 'project' AND p = 'usesLinter' ORDER BY 1")
_on_graph("count_kinds", lambda g: analytics.count_kinds(g, ["Function", "Class", "Config", "Document", "Section", "Binary", "Commit"]).select(*[F.col(k).alias(k.lower()) for k in ("Function", "Class", "Config", "Document", "Section", "Binary", "Commit")]), "SELECT " + ", ".join(f"count(*) FILTER (o = '{k}') AS {k.lower()}" for k in ("Function", "Class", "Config", "Document", "Section", "Binary", "Commit")) + " FROM g WHERE p = 'a'")
_TESTS = "SELECT s FROM g WHERE p = 'isTestFunction' AND o = 'true' UNION SELECT s FROM g WHERE p = 'a' AND o = 'Function' AND (contains(lower(s), 'test') OR contains(lower(s), 'spec'))"
_on_graph("test_functions", analytics.test_functions, _TESTS)
_on_graph("testing_ratio", lambda g: analytics.count_kinds(g, ["Function"]).crossJoin(analytics.test_functions(g).agg(F.count("*").alias("test_functions"))).select(F.col("Function").alias("total_functions"), "test_functions", F.floor(F.col("test_functions") * 100 / F.col("Function") + 0.5).alias("test_ratio_percent")),
          f", t AS ({_TESTS}), n AS (SELECT count(*) AS total_functions FROM g WHERE p = 'a' AND o = 'Function') SELECT total_functions, (SELECT count(*) FROM t) AS test_functions, CAST(floor((SELECT count(*) FROM t) * 100.0 / total_functions + 0.5) AS BIGINT) AS test_ratio_percent FROM n")
_PATTERNS = ", ".join(f"('{k}', '{v}')" for k, v in analytics.TEST_PATTERNS.items())
_on_graph("test_dependencies", analytics.test_dependencies, f"SELECT DISTINCT label FROM (SELECT DISTINCT o FROM g WHERE p = 'dependsOn'), (VALUES {_PATTERNS}) t(part, label) WHERE contains(lower(o), part)")
_on_graph("contributors", analytics.contributors, "SELECT o AS name, count(*) AS commits FROM g WHERE p = 'commitAuthor' GROUP BY o")
_on_graph("active_files", analytics.active_files, "SELECT s AS file, coalesce(TRY_CAST(regexp_extract(o, '^[0-9]+') AS BIGINT), 0) AS commits FROM g WHERE p = 'commitCount' ORDER BY commits DESC, file LIMIT 20")
_on_graph("recent_commits", analytics.recent_commits, """SELECT h.o AS hash, a.o AS author, d.o AS date, m.o AS message FROM g h JOIN g a ON a.s = h.o AND a.p = 'commitAuthor' JOIN g d ON d.s = h.o AND d.p = 'commitDate'
  JOIN g m ON m.s = h.o AND m.p = 'commitMessage' WHERE h.s = 'project' AND h.p = 'hasCommit' ORDER BY date DESC, hash, author, message LIMIT 10""")
_on_graph("bus_factor", lambda g: analytics.contributors(g).agg(F.max("commits").alias("most"), F.sum("commits").alias("total"), F.count("*").alias("people")).withColumn("at_risk", (F.col("people") >= 2) & (F.col("most") / F.col("total") > 0.8)),
          "SELECT CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total, count(*) AS people, count(*) >= 2 AND max(n) / sum(n) > 0.8 AS at_risk FROM (SELECT count(*) AS n FROM g WHERE p = 'commitAuthor' GROUP BY o)")
_on_graph("subjects_page", lambda g: analytics.list_structures(g).offset(100).limit(50), "SELECT s AS subject, o AS type FROM g WHERE p = 'a' ORDER BY 1, 2 LIMIT 50 OFFSET 100")


def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of the project report as JSON, with its insights."""
    import json

    report = analytics.Reports(_g(spark, sf_dir).cache()).project()
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, ensure_ascii=False)) for k, v in report.items()], "section string, report string")


_add("project_report", project_report)

# -- diagrams ----------------------------------------------------------------------
_ID = lambda c: f"(CASE WHEN regexp_matches({c}, '^[0-9]') THEN 'n' ELSE '' END || regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g'))"
_RESERVED = ", ".join(f"'{w}'" for w in terms.RESERVED)
_TO_ID = lambda c: f"({_ID(c)} || CASE WHEN {_ID(c)} IN ({_RESERVED}) THEN 'El' ELSE '' END)"
_NOT_SOURCE = " AND ".join(f"('/' || s) NOT LIKE '%/{d.replace('_', chr(92) + '_')}/%' ESCAPE '{chr(92)}'" for d in diagram.NOT_SOURCE)
_DRAWN = f"""drawn AS (SELECT s AS subject, o AS kind, regexp_extract(s, '^(.*)/[^/]*$', 1) AS path, regexp_extract(s, '[^/]*$') AS symbol FROM g WHERE p = 'a' AND o IN ('Function', 'Class') AND s LIKE '%/%' AND {_NOT_SOURCE}),
  placed AS (SELECT *, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '([^/]*(/[^/]*)?)/[^/]*$', 1) ELSE '.' END AS dir, regexp_extract(path, '[^/]*$') AS file FROM drawn),
  named AS (SELECT subject, kind, dir, file, symbol, {_TO_ID('dir')} || '.' || {_TO_ID('file')} || '.' || {_TO_ID('symbol')} AS id FROM placed)"""
_on_graph("diagram_elements", lambda g: diagram.elements(g, depth=3), f", {_DRAWN} SELECT * FROM named")
_on_graph("diagram_calls", lambda g: diagram.call_edges(g, diagram.elements(g, depth=3), 3), f", {_DRAWN} SELECT DISTINCT a.id AS source, b.id AS target FROM g JOIN named a ON g.s = a.subject JOIN named b ON g.o = b.symbol WHERE g.p = 'calls' AND a.id <> b.id")
_on_graph("diagram_externals", diagram.externals, f"SELECT {_TO_ID('o')} AS id, min(o) AS label FROM g WHERE p = 'dependsOn' AND o <> '' GROUP BY 1")


def diagram_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered diagram, a row a line."""
    text = diagram.render(_g(spark, sf_dir), code_only=False)
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"))], "n int, line string")


_add("diagram_text", diagram_text)

# -- SPARQL -----------------------------------------------------------------------
_R = "PREFIX r: <http://repo.example.org/> "
_SPARQL: dict[str, tuple[str, str]] = {
    "kinds": ("SELECT ?type (COUNT(?s) AS ?n) WHERE { ?s r:a ?type } GROUP BY ?type ORDER BY DESC(?n) ?type", "SELECT o AS type, count(*) AS n FROM g WHERE p = 'a' GROUP BY o"),
    "filter_or": ('SELECT ?s ?o WHERE { ?s r:dependsOn ?o . FILTER(CONTAINS(STR(?s), "config") || STRENDS(STR(?s), ".toml")) FILTER(!CONTAINS(STR(?s), "/vendor/")) }', "SELECT s, o FROM g WHERE p = 'dependsOn' AND (contains(s, 'config') OR s LIKE '%.toml') AND ('/' || s) NOT LIKE '%/vendor/%'"),
    "in_distinct": ("SELECT DISTINCT ?o WHERE { ?s ?p ?o . FILTER(?p IN (r:usesLinter, r:usesBuildTool)) }", "SELECT DISTINCT o FROM g WHERE p IN ('usesLinter', 'usesBuildTool')"),
    "star_join": ("SELECT ?c ?a ?m WHERE { r:project r:hasCommit ?c . ?c r:commitAuthor ?a ; r:commitMessage ?m }", "SELECT h.o AS c, a.o AS a, m.o AS m FROM g h JOIN g a ON a.s = h.o AND a.p = 'commitAuthor' JOIN g m ON m.s = h.o AND m.p = 'commitMessage' WHERE h.s = 'project' AND h.p = 'hasCommit'"),
    "union": ('SELECT (COUNT(DISTINCT ?s) AS ?n) WHERE { { ?s r:isTestFunction r:true } UNION { ?s r:a r:Function . FILTER(CONTAINS(LCASE(STR(?s)), "test")) } }', "SELECT count(*) AS n FROM (SELECT s FROM g WHERE p = 'isTestFunction' AND o = 'true' UNION SELECT s FROM g WHERE p = 'a' AND o = 'Function' AND contains(lower(s), 'test'))"),
    "optional": ("SELECT ?f ?t WHERE { ?f r:a r:Function OPTIONAL { ?f r:isTestFunction ?t } }", "SELECT a.s AS f, b.o AS t FROM g a LEFT JOIN g b ON b.s = a.s AND b.p = 'isTestFunction' WHERE a.p = 'a' AND a.o = 'Function'"),
    "optional_filter": ("SELECT ?f ?n WHERE { ?f r:a r:Binary OPTIONAL { ?f r:hasSize ?n . FILTER(STRLEN(STR(?n)) > 29) } }", "SELECT a.s AS f, b.o AS n FROM g a LEFT JOIN g b ON b.s = a.s AND b.p = 'hasSize' AND length(replace(replace(url_encode(b.o), '%2B', '+'), '%2C', ',')) + 24 > 29 WHERE a.p = 'a' AND a.o = 'Binary'"),
    "optional_twice": ("SELECT ?f ?x WHERE { ?f r:a r:Config OPTIONAL { ?f r:declares ?x } OPTIONAL { ?f r:dependsOn ?x } }",
                       "SELECT a.s AS f, coalesce(b.o, c.o) AS x FROM g a LEFT JOIN g b ON b.s = a.s AND b.p = 'declares' LEFT JOIN g c ON c.s = a.s AND c.p = 'dependsOn' AND (b.o IS NULL OR c.o = b.o) WHERE a.p = 'a' AND a.o = 'Config'"),
    "minus": ("SELECT ?s WHERE { ?s r:a r:Function MINUS { ?s r:isTestFunction ?t } }", "SELECT s FROM g WHERE p = 'a' AND o = 'Function' AND s NOT IN (SELECT s FROM g WHERE p = 'isTestFunction')"),
    "exists": ("SELECT ?s WHERE { ?s r:a r:Function . FILTER EXISTS { ?s r:calls ?c } }", "SELECT s FROM g WHERE p = 'a' AND o = 'Function' AND s IN (SELECT s FROM g WHERE p = 'calls')"),
    "not_exists": ("SELECT ?s WHERE { ?s r:a r:Function . FILTER NOT EXISTS { ?s r:calls ?c } }", "SELECT s FROM g WHERE p = 'a' AND o = 'Function' AND s NOT IN (SELECT s FROM g WHERE p = 'calls')"),
    "values": ("SELECT ?p ?o WHERE { VALUES ?p { r:usesLinter r:hasLayer } r:project ?p ?o }", "SELECT p, o FROM g WHERE s = 'project' AND p IN ('usesLinter', 'hasLayer')"),
    "bind": ('SELECT ?s ?up WHERE { ?s r:hasMimeType ?m BIND(UCASE(STRAFTER(STR(?m), "image/")) AS ?up) FILTER(?up != "") }', "SELECT s, upper(replace(url_encode(regexp_extract(o, 'image/(.*)$', 1)), '%2B', '+')) AS up FROM g WHERE p = 'hasMimeType' AND contains(o, 'image/') AND o <> 'image/'"),
    "subselect": ("SELECT ?a ?n WHERE { { SELECT ?a (COUNT(?c) AS ?n) WHERE { ?c r:commitAuthor ?a } GROUP BY ?a } FILTER(?n > 3) }", "SELECT o AS a, count(*) AS n FROM g WHERE p = 'commitAuthor' GROUP BY o HAVING count(*) > 3"),
    "having": ("SELECT ?d (COUNT(DISTINCT ?f) AS ?n) WHERE { ?f r:dependsOn ?d } GROUP BY ?d HAVING(COUNT(DISTINCT ?f) >= 3)", "SELECT o AS d, count(DISTINCT s) AS n FROM g WHERE p = 'dependsOn' GROUP BY o HAVING count(DISTINCT s) >= 3"),
    "aggregates": ("SELECT (SUM(?l) AS ?total) (AVG(?l) AS ?mean) (MIN(?l) AS ?least) (MAX(?l) AS ?most) (COUNT(*) AS ?n) WHERE { ?s r:calls ?o BIND(STRLEN(STRAFTER(STR(?o), \"org/\")) AS ?l) }", "SELECT CAST(sum(length(o)) AS BIGINT) AS total, avg(length(o)) AS mean, CAST(min(length(o)) AS BIGINT) AS least, CAST(max(length(o)) AS BIGINT) AS most, count(*) AS n FROM g WHERE p = 'calls'"),
    "group_concat": ('SELECT ?p (GROUP_CONCAT(DISTINCT ?v; SEPARATOR="|") AS ?all) WHERE { r:project ?p ?o FILTER(?p != r:hasCommit) BIND(STRAFTER(STR(?o), "org/") AS ?v) } GROUP BY ?p', "SELECT p, string_agg(DISTINCT o, '|' ORDER BY o) AS \"all\" FROM g WHERE s = 'project' AND p <> 'hasCommit' GROUP BY p"),
    "path_sequence": ("SELECT ?a ?b WHERE { ?a r:contains/r:contains ?b }", "SELECT x.s AS a, y.o AS b FROM g x JOIN g y ON x.o = y.s WHERE x.p = 'contains' AND y.p = 'contains'"),
    "path_alternative": ("SELECT ?a ?b WHERE { ?a (r:contains|^r:partOf) ?b }", "SELECT s AS a, o AS b FROM g WHERE p = 'contains' UNION ALL SELECT o, s FROM g WHERE p = 'partOf'"),
    "path_plus": ("SELECT ?a ?b WHERE { ?a r:partOf+ ?b }", "SELECT a, b FROM walk"),
    "path_star": ("SELECT ?b WHERE { r:project (r:hasCommit|r:hasLayer)* ?b }", "SELECT 'project' AS b UNION SELECT o FROM g WHERE s = 'project' AND p IN ('hasCommit', 'hasLayer') UNION SELECT y.o FROM g x JOIN g y ON x.o = y.s WHERE x.s = 'project' AND x.p IN ('hasCommit', 'hasLayer') AND y.p IN ('hasCommit', 'hasLayer')"),
    "path_negated": ("SELECT (COUNT(*) AS ?n) WHERE { ?a !(r:a|r:calls) ?b }", "SELECT count(*) AS n FROM g WHERE p NOT IN ('a', 'calls')"),
    "regex_if": ('SELECT ?s ?k WHERE { ?s r:dependsOn ?o BIND(IF(REGEX(STR(?o), "kit", "i"), "kit", "other") AS ?k) }', "SELECT s, CASE WHEN regexp_matches(o, '(?i)kit') THEN 'kit' ELSE 'other' END AS k FROM g WHERE p = 'dependsOn'"),
    "top": ("SELECT ?c ?d WHERE { ?c r:commitDate ?d } ORDER BY DESC(?d) ?c LIMIT 10 OFFSET 5", "SELECT s AS c, o AS d FROM g WHERE p = 'commitDate' ORDER BY o DESC, s LIMIT 10 OFFSET 5"),
    "coalesce_bound": ('SELECT ?f ?k WHERE { ?f r:a r:Function OPTIONAL { ?f r:isTestFunction ?t } BIND(IF(BOUND(?t), "test", "plain") AS ?k) }', "SELECT a.s AS f, CASE WHEN b.o IS NULL THEN 'plain' ELSE 'test' END AS k FROM g a LEFT JOIN g b ON b.s = a.s AND b.p = 'isTestFunction' WHERE a.p = 'a' AND a.o = 'Function'"),
    "hash": ("SELECT ?o (MD5(STR(?o)) AS ?h) WHERE { r:project r:hasLayer ?o }", "SELECT o, md5('http://repo.example.org/' || o) AS h FROM g WHERE s = 'project' AND p = 'hasLayer'"),
    "cartesian": ("SELECT ?a ?b WHERE { r:project r:usesLinter ?a . r:project r:usesFormatter ?b }", "SELECT x.o AS a, y.o AS b FROM g x, g y WHERE x.s = 'project' AND x.p = 'usesLinter' AND y.s = 'project' AND y.p = 'usesFormatter'"),
    "ask": ("ASK { ?s r:calls ?o . FILTER(CONTAINS(STR(?o), \"load\")) }", "SELECT count(*) > 0 AS ask FROM g WHERE p = 'calls' AND contains(o, 'load')"),
}
for _name, (_text, _sql) in _SPARQL.items():
    _on_graph(f"sparql_{_name}", lambda g, text=_text: sparql.query(g, _R + text), _sql)
SQL["sparql_path_plus"] = """WITH RECURSIVE g AS (SELECT DISTINCT s, o FROM triples WHERE p = 'partOf' AND s IS NOT NULL AND o IS NOT NULL),
  walk AS (SELECT s AS a, o AS b FROM g UNION SELECT w.a, g.o FROM walk w JOIN g ON w.b = g.s) SELECT a, b FROM walk"""

# -- extractors over the files ----------------------------------------------------
_F = "SELECT DISTINCT path, file_name, ext, length, decode(content) AS t, regexp_replace(decode(content), '\\r\\n', chr(10), 'g') AS x FROM files"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.graph(extract.file_facts(_files(spark, sf_dir), list(code.EXTENSIONS)))


_SAFE = "'[^A-Za-z0-9._~:@!$&''()*+,;=/-]', '_', 'g'"
_TRIM = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _of(kind: str, *exts: str):
    """Subjects of a kind from the files of some extensions."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _files(spark, sf_dir).filter(F.col("ext").isin(*exts))
        return analytics.graph(extract.file_facts(files, list(code.EXTENSIONS))).filter((F.col("p") == "a") & (F.col("o") == kind)).select("s")

    return run


_LINES = f"lines AS (SELECT path, ext, unnest(string_split(x, chr(10))) AS line FROM ({_F}) WHERE t IS NOT NULL)"
_add("markdown_sections", _of("Section", "md"), f"WITH {_LINES}, h AS (SELECT path, {_TRIM('regexp_replace(' + _TRIM('line') + ', $$^#+$$, $$$$)')} AS h FROM lines WHERE ext = 'md' AND {_TRIM('line')} LIKE '#%') SELECT DISTINCT path || '/' || regexp_replace(h, {_SAFE}) AS s FROM h WHERE h <> ''")
_add("css_styles", _of("Style", "css"), f"WITH {_LINES}, h AS (SELECT path, {_TRIM('regexp_replace(' + _TRIM('line') + ', $$\\{+$$, $$$$)').replace('$$\\{+$$', chr(39) + '\\{+$' + chr(39))} AS h FROM lines WHERE ext = 'css' AND {_TRIM('line')} LIKE '%{{') SELECT DISTINCT path || '/' || regexp_replace(h, {_SAFE}) AS s FROM h WHERE h <> '' AND h NOT LIKE '/%' AND h NOT LIKE '*%'")
_add("yaml_keys", lambda spark, d: _facts(spark, d).filter((F.col("p") == "declares") & F.col("s").endswith(".yaml")).select(F.col("s").alias("path"), F.col("o").alias("key")),
     f"WITH {_LINES} SELECT DISTINCT path, regexp_replace({_TRIM('string_split(line, $$:$$)[1]')}, {_SAFE}) AS key FROM lines WHERE ext = 'yaml' AND NOT regexp_matches(line, '^[ \\t#-]') AND {_TRIM('line')} <> '' AND {_TRIM('string_split(line, $$:$$)[1]')} <> ''")
_add("rst_sections", _of("Section", "rst"), f"WITH l AS (SELECT path, string_split(x, chr(10)) AS a FROM ({_F}) WHERE ext = 'rst' AND t IS NOT NULL), r AS (SELECT path, {_TRIM('a[i]')} AS h, {_TRIM('a[i + 1]')} AS u FROM l, generate_series(1, len(a) - 1) g(i)) SELECT DISTINCT path || '/' || regexp_replace(h, {_SAFE}) AS s FROM r WHERE h <> '' AND regexp_full_match(u, '[=~^+#`*.-]+') AND strlen(u) >= strlen(h)")
_add("json_keys", lambda spark, d: _facts(spark, d).filter((F.col("p") == "declares") & F.col("s").endswith(".json")).select(F.col("s").alias("path"), F.col("o").alias("key")),
     f"SELECT DISTINCT path, regexp_replace(key, {_SAFE}) AS key FROM (SELECT path, unnest(json_keys(t)) AS key FROM ({_F}) WHERE ext = 'json' AND t IS NOT NULL AND json_valid(t)) WHERE key <> ''")
_MIMES = ", ".join(f"('{e}', '{m}')" for e, m in extract.MIME.items())
_add("binary_facts", lambda spark, d: _facts(spark, d).filter(F.col("p").isin("hasMimeType", "hasSize")), f"SELECT DISTINCT path AS s, 'hasMimeType' AS p, mime AS o FROM files JOIN (VALUES {_MIMES}) m(e, mime) ON ext = e UNION SELECT path, 'hasSize', CAST(length AS VARCHAR) FROM files JOIN (VALUES {_MIMES}) m(e, mime) ON ext = e WHERE length IS NOT NULL")
_LAYERS = ", ".join(f"('{n}', '{label}')" for label, names in rules.LAYERS.items() for n in names.split())
_add("layers", lambda spark, d: _facts(spark, d).filter(F.col("p") == "hasLayer").select("o"), f"SELECT DISTINCT layer AS o FROM (SELECT unnest(string_split(path, '/')) AS d FROM files) JOIN (VALUES {_LAYERS}) l(name, layer) ON d = name")
_add("file_practices", lambda spark, d: _files(spark, d).select("path", rules.practice(F.col("path"), F.col("file_name")).alias("r")).filter("r is not null").select("path", "r.p", "r.o").distinct(),
     "SELECT DISTINCT path, 'usesBuildTool' AS p, 'make' AS o FROM files WHERE file_name = 'Makefile'")
_add("file_facts", _facts)
_add("code_facts", lambda spark, d: analytics.graph(code.code_facts(_files(spark, d))))
_add("graph_build", lambda spark, d: analytics.graph(extract.file_facts(_files(spark, d), list(code.EXTENSIONS)).unionByName(code.code_facts(_files(spark, d))).unionByName(gitlog.history_facts(table(spark, d, "commits"), table(spark, d, "commit_files")))))
_add("pattern_search", lambda spark, d: search.search(_files(spark, d), "for $X in $Y:", "python"))

# -- history -----------------------------------------------------------------------
_SAFE_OF = lambda c: f"regexp_replace({c}, {_SAFE})"
_COMMIT = " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM commits" for s, p, o in (
    ("'project'", "hasCommit", _SAFE_OF("hash")), (_SAFE_OF("hash"), "a", "'Commit'"), (_SAFE_OF("hash"), "commitAuthor", _SAFE_OF("author")), (_SAFE_OF("hash"), "commitDate", _SAFE_OF("date")), (_SAFE_OF("hash"), "commitMessage", _SAFE_OF("message"))))
_add("commit_facts", lambda spark, d: gitlog.commit_facts(table(spark, d, "commits")), f"SELECT * FROM ({_COMMIT}) WHERE o IS NOT NULL")
_INFO = f"""WITH t AS (SELECT DISTINCT seq, hash, file FROM commit_files WHERE file IS NOT NULL), c AS (SELECT DISTINCT seq, hash, author, date FROM commits),
  j AS (SELECT {_SAFE_OF('file')} AS file, seq, {_SAFE_OF('author')} AS author, {_SAFE_OF('date')} AS date FROM t JOIN c USING (seq, hash))"""
_add("file_git_info", lambda spark, d: gitlog.file_git_info(table(spark, d, "commits"), table(spark, d, "commit_files")).withColumn("contributors", F.concat_ws("|", "contributors")),
     f"{_INFO} SELECT file, first(author ORDER BY seq) AS last_author, first(date ORDER BY seq) AS last_date, count(*) AS commit_count, coalesce(string_agg(DISTINCT author, '|' ORDER BY author), '') AS contributors FROM j GROUP BY file")
_add("history_facts", lambda spark, d: analytics.graph(gitlog.history_facts(table(spark, d, "commits"), table(spark, d, "commit_files"))),
     f"""{_INFO}, i AS (SELECT file, first(author ORDER BY seq) AS la, first(date ORDER BY seq) AS ld, count(*) AS n FROM j GROUP BY file)
  SELECT DISTINCT s, p, o FROM (SELECT * FROM ({_COMMIT}) UNION ALL SELECT {_SAFE_OF('hash')}, 'commitTouches', {_SAFE_OF('file')} FROM commit_files WHERE hash IS NOT NULL AND file IS NOT NULL
    UNION ALL SELECT file, 'lastModifiedBy', la FROM i UNION ALL SELECT file, 'lastModifiedDate', ld FROM i UNION ALL SELECT file, 'commitCount', CAST(n AS VARCHAR) FROM i UNION ALL SELECT file, 'contributedBy', author FROM j) WHERE o IS NOT NULL""")

# -- identifiers -------------------------------------------------------------------
_ESCAPED = "url_encode(path)"
for _code, _char in (*terms.ALLOWED, ("%2A", "*")):
    _ESCAPED = f"replace({_ESCAPED}, '{_code}', '{_char.replace(chr(39), chr(39) * 2)}')"
_add("identifiers", lambda spark, d: _files(spark, d).select("path").distinct().select("path", terms.iri_safe(F.col("path")).alias("safe"), terms.iri_escape(F.col("path")).alias("escaped"), terms.to_id(F.col("path")).alias("id"), terms.split_path(F.col("path"))[0].alias("dir"), terms.split_path(F.col("path"))[1].alias("file")),
     f"SELECT path, {_SAFE_OF('path')} AS safe, {_ESCAPED} AS escaped, {_TO_ID('path')} AS id, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '([^/]*(/[^/]*)?)/[^/]*$', 1) ELSE '.' END AS dir, regexp_extract(path, '[^/]*$') AS file FROM (SELECT DISTINCT path FROM files)")
