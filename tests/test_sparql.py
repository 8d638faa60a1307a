"""The query compiler: constructs against plain Python on small random graphs, and its errors."""

import random

import pytest

from loomgraph.operators import analytics
from loomgraph.plans.sparql import SparqlError, local_name, query

R = "PREFIX r: <http://repo.example.org/> "


def graph(spark, rows):
    return analytics.graph(spark.createDataFrame(rows, "s string, p string, o string"))


def run(spark, rows, text):
    df = query(graph(spark, rows), R + text)
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "p", "d"), ("a", "q", "x"), ("b", "q", "y"), ("d", "n", "12"), ("e f", "p", "100%"), ("a", "p", "b")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?o WHERE { r:a r:p ?o }", [("b",)]),
        ("SELECT ?s ?z WHERE { ?s r:p ?m . ?m r:q ?z }", [("a", "y"), ("c", "x")]),
        ("SELECT ?s ?z WHERE { ?s r:p/r:q ?z }", [("a", "y"), ("c", "x")]),
        ("SELECT ?x WHERE { ?x r:p ?x }", []),
        ("SELECT ?o WHERE { r:a r:p+ ?o }", [("a",), ("b",), ("c",), ("d",)]),
        ("SELECT ?s WHERE { ?s r:p+ r:d }", [("a",), ("b",), ("c",)]),
        ("SELECT ?o WHERE { r:z r:p* ?o }", [("z",)]),
        ("SELECT ?o WHERE { r:a r:p? ?o }", [("a",), ("b",)]),
        ("SELECT ?o WHERE { r:c (r:p|r:q)/^r:p ?o }", [("c",), ("c",)]),
        ("SELECT ?o WHERE { r:a !r:p ?o }", [("x",)]),
        ("SELECT ?o WHERE { r:b !(r:p|^r:q) ?o }", [("a",), ("y",)]),
        ("SELECT ?s ?z WHERE { ?s r:p ?m OPTIONAL { ?s r:q ?z } }", [("a", "x"), ("b", "y"), ("c", None), ("c", None), ("e f", None)]),
        ("SELECT ?s WHERE { ?s r:p ?m MINUS { ?s r:q ?z } }", [("c",), ("c",), ("e f",)]),
        ("SELECT ?s WHERE { ?s r:p ?m MINUS { ?k r:q ?z } }", [("a",), ("b",), ("c",), ("c",), ("e f",)]),
        ("SELECT ?s WHERE { ?s r:p ?m FILTER NOT EXISTS { ?s r:q ?z } }", [("c",), ("c",), ("e f",)]),
        ("SELECT DISTINCT ?s WHERE { ?s r:p ?m FILTER(EXISTS { ?m r:q ?z } && ?s != r:a) }", [("c",)]),
        ("SELECT ?s WHERE { { ?s r:q ?z } UNION { ?s r:n ?z } }", [("a",), ("b",), ("d",)]),
        ("SELECT ?v ?w WHERE { VALUES (?v ?w) { (r:a UNDEF) (r:d 3) } }", [("a", None), ("d", 3)]),
        ("SELECT ?s ?z WHERE { VALUES (?s ?z) { (r:a UNDEF) (UNDEF r:y) } ?s r:q ?z }", [("a", "x"), ("b", "y")]),
        ("SELECT ?s (COUNT(?m) AS ?n) WHERE { ?s r:p ?m } GROUP BY ?s HAVING(COUNT(?m) > 1)", [("c", 2)]),
        ("SELECT (COUNT(*) AS ?n) WHERE { ?s r:none ?m }", [(0,)]),
        ("SELECT (SUM(?l) AS ?t) WHERE { ?s r:q ?o BIND(STRLEN(STR(?o)) AS ?l) }", [(50,)]),
        ("SELECT ?s WHERE { ?s ?p ?o . FILTER(CONTAINS(STR(?o), \"100%25\")) }", [("e f",)]),
        ("SELECT ?o WHERE { <http://repo.example.org/e%20f> r:p ?o }", [("100%",)]),
        ("SELECT ?a WHERE { BIND(1 + 2 * 3 AS ?a) }", [(7,)]),
        ("SELECT ?a WHERE { BIND(7 / 2 AS ?a) }", [(3.5,)]),
        ("SELECT ?a WHERE { BIND(1 / 0 AS ?a) }", [(None,)]),
        ("SELECT ?a WHERE { BIND(SUBSTR(\"foobar\", 4) AS ?a) }", [("bar",)]),
        ("SELECT ?a WHERE { BIND(REPLACE(\"a-b-c\", \"-\", \"+\") AS ?a) }", [("a+b+c",)]),
        ("SELECT ?a WHERE { BIND(STRBEFORE(\"k=v\", \"=\") AS ?a) }", [("k",)]),
        ("SELECT ?a WHERE { BIND(xsd:integer(\"42\") + 1 AS ?a) }", [(43,)]),
        ("SELECT ?a WHERE { BIND(xsd:integer(\"no\") AS ?a) }", [(None,)]),
        ("SELECT ?a WHERE { BIND(ROUND(-2.5) AS ?a) }", [(-2.0,)]),
        ("SELECT ?a WHERE { BIND(YEAR(\"2024-05-06T07:08:09Z\"^^xsd:dateTime) AS ?a) }", [(2024,)]),
        ("SELECT ?a WHERE { BIND(IF(isIRI(r:x), DATATYPE(1), r:no) AS ?a) }", [("<http://www.w3.org/2001/XMLSchema#integer>",)]),
        ("SELECT ?a WHERE { BIND(COALESCE(?no, \"d\") AS ?a) }", [("d",)]),
        ("SELECT ?a WHERE { BIND(ENCODE_FOR_URI(\"a b*~\") AS ?a) }", [("a%20b%2A~",)]),
        ("SELECT ?o WHERE { GRAPH r:g { r:a r:p ?o } }", []),
        ("ASK { r:a r:p r:b }", [(True,)]),
        ("ASK { r:a r:p r:c }", [(False,)]),
        ("SELECT ?s WHERE { ?s a ?t }", []),
        ("SELECT ?x WHERE { ?x r:p [ r:q ?y ] } ORDER BY DESC(?y) LIMIT 1", [("a",)]),
        ("SELECT * WHERE { ?s r:n ?o }", [("12", "d")]),
        ("SELECT (GROUP_CONCAT(?o; SEPARATOR=\",\") AS ?all) WHERE { ?s r:q ?z BIND(STRAFTER(STR(?z), \"org/\") AS ?o) }", [("x,y",)]),
    ],
)
def test_constructs(spark, text, want):
    assert run(spark, ROWS, text) == sorted(want, key=str)


def test_joins_with_unbound_variables(spark):
    """OPTIONAL then a join on what may be unbound, against nested loops."""
    r = random.Random(5)
    rows = list({(r.choice("abcd"), r.choice("pqr"), r.choice("abcd")) for _ in range(24)})
    got = run(spark, rows, "SELECT ?s ?x WHERE { ?s r:p ?m OPTIONAL { ?s r:q ?x } ?m r:r ?x }")
    want = []
    for s, p, m in rows:
        if p == "p":
            for x in [o for a, b, o in rows if a == s and b == "q"] or [None]:
                want += [(s, o) for a, b, o in rows if a == m and b == "r" and x in (None, o)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("text", ["CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "DESCRIBE r:a", "SELECT ?s", "SELECT ?s WHERE { ?s r:p }", "SELECT ?s WHERE { SERVICE r:x { ?s ?p ?o } }", "SELECT ?s WHERE { ?s nope:p ?o }", "DELETE WHERE { ?s ?p ?o }", "SELECT (NOPE(?s) AS ?x) WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p ?o } GARBAGE"])
def test_errors(spark, text):
    with pytest.raises(SparqlError):
        query(graph(spark, ROWS), R + text)


def test_local_names():
    assert local_name("http://repo.example.org/a%20b%C3%A9") == "a b\u00e9" and local_name("http://else/x") == "<http://else/x>"


def test_variables_that_may_be_unbound(spark):
    """Joins on them are joins on equal keys, one for each way of being bound; nothing unbounded is broadcast."""
    rows = [("a", "p", "1"), ("b", "p", "1"), ("c", "p", "1"), ("a", "q", "x"), ("c", "q", "z"), ("x", "n", "5"), ("w", "n", "6")]
    text = "SELECT ?f ?x ?y { ?f r:p ?o OPTIONAL { ?f r:q ?x } OPTIONAL { ?x r:n ?y } }"
    got = {tuple(v and v.strip("<>") for v in r) for r in run(spark, rows, text)}
    assert got == {("a", "x", "5"), ("b", "x", "5"), ("b", "w", "6"), ("c", "z", None)}
    empty = {tuple(v and v.strip("<>") for v in r) for r in run(spark, rows[:5], text)}
    assert empty == {("a", "x", None), ("b", None, None), ("c", "z", None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = query(graph(spark, rows), R + "SELECT ?f ?x { ?f r:p ?o OPTIONAL { ?f r:q ?x } { ?x r:n ?y } }")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_chain(spark):
    """All pairs of a chain of 60 links, in rounds that double."""
    rows = [(f"n{i}", "p", f"n{i + 1}") for i in range(60)]
    assert len(run(spark, rows, "SELECT ?a ?b { ?a r:p+ ?b }")) == 60 * 61 // 2
