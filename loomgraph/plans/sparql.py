"""SPARQL 1.1 SELECT and ASK compiled to DataFrame plans.

text -> tokens -> syntax tree -> DataFrame.  Triple patterns are filtered scans of a
triples table (s, p, o: local names), groups are joins on shared variables, and Catalyst
does the rest.  Every variable has a kind known when the query is compiled (iri, str,
int, dbl, bool, time) and may be marked as possibly unbound; only joins over such
variables need more than an equality.  Errors of expressions are nulls.  Property paths
``+ * ?`` iterate over a frontier with its lineage cut, so cycles end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.terms import PREFIX, iri_escape
from loomgraph.workspace import Workspace


class SparqlError(ValueError):
    """The text is not a query, or one of a kind that is not answered."""


_TOKEN = re.compile(
    r"\s+|\#[^\n]*|(?P<iri><[^<>\"{}|^`\\\x00-\x20]*>)|(?P<var>[?$]\w+)|(?P<str>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<pname>(?:[A-Za-z_][\w.-]*)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?)|(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;*/+?|^!=<>-])",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def local_name(iri: str) -> str:
    """How the triples table writes an IRI: without the prefix and escapes; a foreign one keeps its brackets."""
    if not iri.startswith(PREFIX):
        return f"<{iri}>"
    rest = iri[len(PREFIX) :]
    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace"), rest)


# -- parser ---------------------------------------------------------------------------


class Parser:
    def __init__(self, text: str):
        self.t: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"at {text[at:at + 30]!r}")
            at = m.end()
            if m.lastgroup:
                self.t.append((m.lastgroup, m.group()))
        self.t.append(("end", ""))
        self.i, self.prefixes, self.base, self.fresh = 0, {"xsd": XSD}, "", 0

    def peek(self, *words: str) -> bool:
        kind, text = self.t[self.i]
        return kind in ("word", "op") and text.upper() in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.i += 1
            return self.t[self.i - 1][1].upper()
        return None

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if got is None:
            raise SparqlError(f"expected {' or '.join(words)} before {self.t[self.i][1]!r}")
        return got

    def query(self) -> dict:
        while word := self.take("PREFIX", "BASE"):
            if word == "BASE":
                self.base = self.t[self.i][1][1:-1]
                self.i += 1
            else:
                name = self.t[self.i][1]
                self.prefixes[name[:-1]] = self._iri_text(self.t[self.i + 1][1])
                self.i += 2
        if self.peek("CONSTRUCT", "DESCRIBE", "INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP"):
            raise SparqlError(f"{self.t[self.i][1]} is not answered: only SELECT and ASK are")
        q = self.select() if self.peek("SELECT") else self.ask()
        if self.t[self.i][0] != "end":
            raise SparqlError(f"unexpected {self.t[self.i][1]!r}")
        return q

    def ask(self) -> dict:
        self.need("ASK")
        self.dataset()
        self.take("WHERE")
        return {"form": "ask", "where": self.group(), **self.modifiers()}

    def dataset(self) -> None:
        while self.take("FROM"):
            self.take("NAMED")
            self.i += 1

    def select(self) -> dict:
        self.need("SELECT")
        distinct = self.take("DISTINCT", "REDUCED") is not None
        project: list = []
        if not self.take("*"):
            while True:
                if self.t[self.i][0] == "var":
                    project.append((self.var(), None))
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    project.append((self.var(), e))
                    self.need(")")
                else:
                    break
            if not project:
                raise SparqlError("nothing is selected")
        self.dataset()
        self.take("WHERE")
        return {"form": "select", "distinct": distinct, "project": project, "where": self.group(), **self.modifiers()}

    def modifiers(self) -> dict:
        m: dict = {"group": [], "having": [], "order": [], "limit": None, "offset": None, "values": None}
        if self.take("GROUP"):
            self.need("BY")
            while True:
                if self.t[self.i][0] == "var":
                    m["group"].append((self.var(), None))
                elif self.take("("):
                    e = self.expression()
                    name = self.var() if self.take("AS") else self._fresh()
                    self.need(")")
                    m["group"].append((name, e))
                elif self.t[self.i][0] == "word" and self.t[self.i + 1][1] == "(" and not self.peek("HAVING", "ORDER"):
                    m["group"].append((self._fresh(), self.primary()))
                else:
                    break
        if self.take("HAVING"):
            while self.peek("(") or self.t[self.i][0] == "word" and self.t[self.i + 1][1] == "(" and not self.peek("ORDER", "LIMIT", "OFFSET", "VALUES"):
                m["having"].append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if word := self.take("ASC", "DESC"):
                    self.need("(")
                    e = self.expression()
                    self.need(")")
                    m["order"].append((e, word == "DESC"))
                elif self.t[self.i][0] == "var" or self.peek("(") or self.t[self.i][0] in ("word", "pname", "iri") and self.t[self.i + 1][1] == "(":
                    m["order"].append((self.primary(), False))
                else:
                    break
        while word := self.take("LIMIT", "OFFSET"):
            m[word.lower()] = int(self.t[self.i][1])
            self.i += 1
        if self.take("VALUES"):
            m["values"] = self.values()
        return m

    def _fresh(self) -> str:
        self.fresh += 1
        return f"_g{self.fresh}"

    def var(self) -> str:
        kind, text = self.t[self.i]
        if kind != "var":
            raise SparqlError(f"expected a variable before {text!r}")
        self.i += 1
        return text[1:]

    def group(self) -> tuple:
        self.need("{")
        if self.peek("SELECT"):
            sub = self.select()
            self.need("}")
            return ("group", [("sub", sub)])
        parts: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("OPTIONAL"):
                parts.append(("optional", self.group()))
            elif self.take("MINUS"):
                parts.append(("minus", self.group()))
            elif self.take("FILTER"):
                parts.append(("filter", self.primary()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                parts.append(("bind", self.var(), e))
                self.need(")")
            elif self.take("VALUES"):
                parts.append(self.values())
            elif self.take("GRAPH"):
                self.i += 1
                parts.append(("nothing", self.group()))
            elif self.peek("SERVICE"):
                raise SparqlError("SERVICE is not answered")
            elif self.peek("{"):
                alternatives = [self.group()]
                while self.take("UNION"):
                    alternatives.append(self.group())
                parts.append(("union", alternatives) if len(alternatives) > 1 else alternatives[0])
            else:
                triples: list = []
                self.triples(triples)
                parts.append(("bgp", triples))
        return ("group", parts)

    def values(self) -> tuple:
        names, rows = [], []
        if self.take("("):
            while not self.take(")"):
                names.append(self.var())
        else:
            names.append(self.var())
            single = True
            self.need("{")
            while not self.take("}"):
                rows.append([None if self.take("UNDEF") else self.term()])
            return ("values", names, rows)
        self.need("{")
        while not self.take("}"):
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(None if self.take("UNDEF") else self.term())
            rows.append(row)
        return ("values", names, rows)

    def triples(self, out: list) -> None:
        subject = self.node(out)
        if self.peek(".", "}"):
            return
        self.properties(subject, out)

    def properties(self, subject: tuple, out: list) -> None:
        while True:
            path = ("var", self.var()) if self.t[self.i][0] == "var" else self.path()
            while True:
                out.append((subject, path, self.node(out)))
                if not self.take(","):
                    break
            while self.take(";"):
                pass
            if self.peek(".", "}", "]") or self.t[self.i][0] == "end" or self.t[self.i - 1][1] != ";":
                return

    def node(self, out: list) -> tuple:
        if self.take("["):
            blank = ("var", self._fresh())
            if not self.take("]"):
                self.properties(blank, out)
                self.need("]")
            return blank
        if self.t[self.i][0] == "pname" and self.t[self.i][1].startswith("_:"):
            self.i += 1
            return ("var", "_b_" + self.t[self.i - 1][1][2:])
        return self.term()

    def path(self) -> tuple:
        alternatives = [self.path_sequence()]
        while self.take("|"):
            alternatives.append(self.path_sequence())
        return alternatives[0] if len(alternatives) == 1 else ("alt", alternatives)

    def path_sequence(self) -> tuple:
        parts = [self.path_step()]
        while self.take("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def path_step(self) -> tuple:
        if self.take("^"):
            return ("inv", self.path_step())
        if self.take("!"):
            items = []
            if self.take("("):
                while not self.take(")"):
                    items.append((bool(self.take("^")), self.predicate()))
                    self.take("|")
            else:
                items.append((bool(self.take("^")), self.predicate()))
            return ("neg", items)
        if self.take("("):
            p = self.path()
            self.need(")")
        else:
            p = ("iri", self.predicate())
        while mark := self.take("*", "+", "?"):
            p = ({"*": "star", "+": "plus", "?": "maybe"}[mark], p)
        return p

    def predicate(self) -> str:
        if self.t[self.i] == ("word", "a"):
            self.i += 1
            return local_name(RDF_TYPE)
        kind, value = self.term()[:2]
        if kind != "iri":
            raise SparqlError("a predicate is an IRI")
        return value

    def _iri_text(self, text: str) -> str:
        iri = re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), text[1:-1])
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) or not self.base else self.base + iri

    def term(self) -> tuple:
        kind, text = self.t[self.i]
        self.i += 1
        if kind == "var":
            return ("var", text[1:])
        if kind == "iri":
            return ("iri", local_name(self._iri_text(text)))
        if kind == "pname":
            prefix, _, rest = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"no prefix {prefix!r}")
            return ("iri", local_name(self.prefixes[prefix] + rest))
        if kind == "str":
            q = 3 if text[:3] in ('"""', "'''") else 1
            value = re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text[q:-q], flags=re.S)
            if self.t[self.i][0] == "lang":
                self.i += 1
            elif self.take("^^"):
                return _typed(value, self.term()[1])
            return ("str", value)
        if kind == "num":
            return ("int", int(text)) if text.isdigit() else ("dbl", float(text))
        if kind == "op" and text in "+-" and self.t[self.i][0] == "num":
            k, v = self.term()
            return (k, -v if text == "-" else v)
        if kind == "word" and text.lower() in ("true", "false"):
            return ("bool", text.lower() == "true")
        raise SparqlError(f"unexpected {text!r}")

    # -- expressions

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.take("||"):
            e = ("||", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.relation()
        while self.take("&&"):
            e = ("&&", e, self.relation())
        return e

    def relation(self) -> tuple:
        e = self.additive()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            return (op, e, self.additive())
        if self.peek("IN") or self.peek("NOT") and self.t[self.i + 1][1].upper() == "IN":
            negated = self.take("NOT")
            self.need("IN")
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.expression())
                self.take(",")
            return ("in", e, items, bool(negated))
        return e

    def additive(self) -> tuple:
        e = self.multiplicative()
        while op := self.take("+", "-"):
            e = (op, e, self.multiplicative())
        return e

    def multiplicative(self) -> tuple:
        e = self.unary()
        while op := self.take("*", "/"):
            e = (op, e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("!"):
            return ("!", self.unary())
        if self.take("-"):
            return ("-", ("int", 0), self.unary())
        if self.take("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        kind, text = self.t[self.i]
        if kind == "word" and text.upper() in ("EXISTS", "NOT"):
            negated = self.take("NOT") is not None
            self.need("EXISTS")
            return ("exists", self.group(), negated)
        if kind == "word" and self.t[self.i + 1][1] == "(":
            self.i += 2
            name = text.upper()
            if name in AGGREGATES:
                return self.aggregate(name)
            return ("call", name, self.arguments())
        if kind in ("iri", "pname") and self.t[self.i + 1][1] == "(":
            target = self.term()[1]
            self.i += 1
            return ("call", "CAST", [("str", target), *self.arguments()])
        return self.term()

    def arguments(self) -> list:
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def aggregate(self, name: str) -> tuple:
        distinct = self.take("DISTINCT") is not None
        e = None if self.take("*") else self.expression()
        separator = " "
        if self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.term()[1]
        self.need(")")
        return ("agg", name, distinct, e, separator)


def _typed(value: str, datatype: str) -> tuple:
    kind = datatype.strip("<>").removeprefix(XSD)
    try:
        if kind in ("integer", "int", "long", "short", "nonNegativeInteger"):
            return ("int", int(value))
        if kind in ("decimal", "double", "float"):
            return ("dbl", float(value))
    except ValueError:
        return ("str", value)
    if kind == "boolean":
        return ("bool", value in ("true", "1"))
    return ("time", value) if kind == "dateTime" else ("str", value)


# -- compiler -------------------------------------------------------------------------

#: Up to so many variables that may be unbound, a join is split by which of them are.
FORMS = 4


@dataclass
class Solutions:
    """A table of solutions: kind of each variable and which may be unbound."""

    df: DataFrame | None
    kinds: dict[str, str] = field(default_factory=dict)
    maybe: set[str] = field(default_factory=set)


_TYPE = {"iri": "string", "str": "string", "int": "bigint", "dbl": "double", "bool": "boolean", "time": "timestamp"}


class Compiler:
    def __init__(self, triples: DataFrame):
        self.triples = triples.select("s", "p", "o")
        self.spark = triples.sparkSession
        self.ws: Workspace | None = None
        self.n = 0

    # -- query forms

    def run(self, q: dict) -> DataFrame:
        if q["form"] == "ask":
            sol = self.pattern(q["where"])
            return self._df(sol).limit(1).agg((F.count("*") > 0).alias("ask"))
        sol = self.select(q)
        return sol.df

    def _unit(self) -> DataFrame:
        return self.spark.range(1).select()

    def _df(self, sol: Solutions) -> DataFrame:
        return self._unit() if sol.df is None else sol.df

    def select(self, q: dict) -> Solutions:
        sol = self.pattern(q["where"])
        if q["values"]:
            sol = self.join(sol, self.table(q["values"]))
        project = q["project"] or [(v, None) for v in sorted(sol.kinds) if not v.startswith("_")]
        aggregated = q["group"] or any(_has_agg(e) for _, e in project) or any(_has_agg(e) for e in q["having"]) or any(_has_agg(e) for e, _ in q["order"])
        having, order = q["having"], q["order"]
        if aggregated:
            sol, project, having, order = self.grouped(sol, q, project)
        for e in having:
            sol = Solutions(self._df(sol).filter(self.truth(e, sol)), sol.kinds, sol.maybe)
        df = self._df(sol)
        for v, e in project:
            if e is not None:
                c, kind = self.expr(e, sol)
                df = df.withColumn(v, c)
                sol = Solutions(df, {**sol.kinds, v: kind}, sol.maybe | {v})
        names = [v for v, _ in project]
        for v in names:
            if v not in sol.kinds:  # a variable that is nowhere bound
                df = df.withColumn(v, F.lit(None).cast("string"))
                sol = Solutions(df, {**sol.kinds, v: "str"}, sol.maybe | {v})
        if order:
            keys = [self.expr(e, sol)[0] for e, _ in order]
            keys = [k.desc() if d else k.asc() for k, (_, d) in zip(keys, order)]
            if q["distinct"] and all(_vars(e) <= set(names) for e, _ in order):
                df = df.select(*names).distinct().orderBy(*keys)
            else:
                df = df.orderBy(*keys).select(*names)
                df = df.distinct() if q["distinct"] else df
        else:
            df = df.select(*names)
            df = df.distinct() if q["distinct"] else df
        if q["offset"]:
            df = df.offset(q["offset"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return Solutions(df, {v: sol.kinds[v] for v in names}, sol.maybe & set(names))

    def grouped(self, sol: Solutions, q: dict, project: list) -> tuple:
        df, kinds = self._df(sol), dict(sol.kinds)
        for v, e in q["group"]:
            if e is not None:
                c, kind = self.expr(e, Solutions(df, kinds, sol.maybe))
                df = df.withColumn(v, c)
                kinds[v] = kind
        keys = [v for v, _ in q["group"]]
        found: dict[str, tuple] = {}

        def lift(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                name = next((k for k, x in found.items() if x == e), f"_a{len(found)}")
                found[name] = e
                return ("var", name)
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            return [lift(x) for x in e] if isinstance(e, list) else e

        project = [(v, lift(e) if e is not None else None) for v, e in project]
        having, order = [lift(e) for e in q["having"]], [(lift(e), d) for e, d in q["order"]]
        base = Solutions(df, kinds, sol.maybe)
        columns, out = [], {k: kinds.get(k, "str") for k in keys}
        for name, (_, fn, distinct, e, separator) in found.items():
            c, kind = (F.lit(1), "int") if e is None else self.expr(e, base)
            if fn == "COUNT":
                if e is None:
                    a = F.count_distinct(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in sorted(kinds)]) if distinct else F.count("*")
                else:
                    a = F.count_distinct(c) if distinct else F.count(c)
                kind = "int"
            elif fn in ("SUM", "AVG"):
                x = c if kind in ("int", "dbl") else c.try_cast("double")
                kind = kind if kind == "int" and fn == "SUM" else "dbl"
                a = F.coalesce((F.sum_distinct(x) if distinct else F.sum(x)) if fn == "SUM" else (F.avg(x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)), F.lit(0)).cast(_TYPE[kind])
            elif fn == "GROUP_CONCAT":
                text = self.string(c, kind)
                items = F.sort_array(F.collect_set(text) if distinct else F.collect_list(text))
                a, kind = F.array_join(items, separator), "str"
            else:
                a = {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[fn](c)
            columns.append(a.alias(name))
            out[name] = kind
        df = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()
        return Solutions(df, out, (sol.maybe & set(keys)) | set(found)), project, having, order

    # -- patterns

    def pattern(self, p: tuple) -> Solutions:
        sol, filters = Solutions(None), []
        for part in p[1]:
            kind = part[0]
            if kind == "bgp":
                for t in part[1]:
                    sol = self.join(sol, self.triple(*t))
            elif kind == "group":
                sol = self.join(sol, self.pattern(part))
            elif kind == "union":
                sol = self.join(sol, self.union([self.pattern(x) for x in part[1]]))
            elif kind == "optional":
                sol = self.optional(sol, part[1])
            elif kind == "minus":
                sol = self.minus(sol, self.pattern(part[1]))
            elif kind == "bind":
                c, k = self.expr(part[2], sol)
                sol = Solutions(self._df(sol).withColumn(part[1], c), {**sol.kinds, part[1]: k}, sol.maybe | {part[1]})
            elif kind == "values":
                sol = self.join(sol, self.table(part))
            elif kind == "sub":
                sol = self.join(sol, self.select(part[1]))
            elif kind == "nothing":  # there is no named graph
                inner = self.pattern(part[1])
                sol = self.join(sol, Solutions(self._df(inner).limit(0), inner.kinds, inner.maybe))
            else:
                filters.append(part[1])
        for f in filters:  # a filter holds for its whole group
            sol = self.filtered(sol, f)
        return sol

    def filtered(self, sol: Solutions, e: tuple) -> Solutions:
        if e[0] == "&&":
            return self.filtered(self.filtered(sol, e[1]), e[2])
        if e[0] == "!" and e[1][0] == "exists":
            e = ("exists", e[1][1], not e[1][2])
        if e[0] == "exists":
            return self.exists(sol, self.pattern(e[1]), e[2])
        return Solutions(self._df(sol).filter(self.truth(e, sol)), sol.kinds, sol.maybe)

    def triple(self, s: tuple, p: tuple, o: tuple) -> Solutions:
        if p[0] == "var":
            df = self.triples
        elif p[0] == "iri":
            df = self.triples.filter(F.col("p") == p[1])
        else:
            df = self.path(p, s, o).withColumn("p", F.lit(None).cast("string"))
        columns, names = [], {}
        for term, column in ((s, "s"), (p, "p"), (o, "o")):
            if column == "p" and p[0] != "var":
                continue
            if term[0] == "var":
                if term[1] in names:
                    df = df.filter(F.col(names[term[1]]) == F.col(column))
                else:
                    names[term[1]] = column
                    columns.append(F.col(column).alias(term[1]))
            elif term[0] == "iri":
                df = df.filter(F.col(column) == term[1])
            else:  # literals are never stored
                df = df.filter(F.lit(False))
        df = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("s", "o")]))
        return Solutions(df.select(*columns), dict.fromkeys(names, "iri"))

    def path(self, p: tuple, s: tuple = ("var", ""), o: tuple = ("var", "")) -> DataFrame:
        """The pairs (s, o) of a property path."""
        kind = p[0]
        if kind == "iri":
            return self.triples.filter(F.col("p") == p[1]).select("s", "o")
        if kind == "inv":
            return self.path(p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            return reduce(DataFrame.unionByName, [self.path(x) for x in p[1]])
        if kind == "seq":
            out = self.path(p[1][0])
            for x in p[1][1:]:
                nxt = self.path(x).select(F.col("s").alias("m"), F.col("o").alias("e"))
                out = out.join(nxt, out["o"] == nxt["m"]).select("s", F.col("e").alias("o"))
            return out
        if kind == "neg":
            plain, inverse = [x for inv, x in p[1] if not inv], [x for inv, x in p[1] if inv]
            parts = []
            if plain or not inverse:
                parts.append(self.triples.filter(~F.col("p").isin(*plain)).select("s", "o"))
            if inverse:
                parts.append(self.triples.filter(~F.col("p").isin(*inverse)).select(F.col("o").alias("s"), F.col("s").alias("o")))
            return reduce(DataFrame.unionByName, parts)
        inner = self.path(p[1])
        if kind in ("star", "maybe"):
            nodes = self.triples.select("s").unionByName(self.triples.select(F.col("o").alias("s")))
            fixed = [t[1] for t in (s, o) if t[0] == "iri"]
            if fixed:
                nodes = nodes.unionByName(self.spark.createDataFrame([(x,) for x in fixed], "s string"))
            same = nodes.filter(F.col("s").isNotNull()).distinct().select("s", F.col("s").alias("o"))
            if kind == "maybe":
                return inner.unionByName(same).distinct()
            return self.closure(inner, s, o).unionByName(same).distinct()
        return self.closure(inner, s, o)

    def closure(self, pairs: DataFrame, s: tuple, o: tuple) -> DataFrame:
        """Transitive closure.

        From a fixed end the frontier takes a step a round.  Without one, the pairs found in the last round are
        joined to all pairs known, so the length of the paths covered doubles and rounds are logarithmic in it.
        """
        self.ws = self.ws or Workspace(self.spark)
        ws = self.ws
        step = ws.cut(pairs.filter("s is not null and o is not null").distinct(), "step")
        backwards = s[0] != "iri" and o[0] == "iri"
        if backwards:
            edge = step.select(F.col("o").alias("s"), F.col("s").alias("o"))
            seed = edge.filter(F.col("s") == o[1])
        else:
            edge = step
            seed = step.filter(F.col("s") == s[1]) if s[0] == "iri" else step
        hop = edge.select(F.col("s").alias("m"), F.col("o").alias("e"))
        seen = ws.cut(seed, "seen")
        parts, frontier = [seen], seen
        if s[0] != "iri" and o[0] != "iri":
            while not frontier.isEmpty():
                onwards = seen.select(F.col("s").alias("m"), F.col("o").alias("e"))
                frontier = ws.cut(frontier.join(onwards, frontier["o"] == onwards["m"]).select("s", F.col("e").alias("o")).distinct().join(seen, ["s", "o"], "left_anti"), "frontier")
                seen = seen.unionByName(frontier)
            return seen
        while not frontier.isEmpty():
            known = reduce(DataFrame.unionByName, parts)
            frontier = ws.cut(frontier.join(hop, frontier["o"] == hop["m"]).select("s", F.col("e").alias("o")).distinct().join(known, ["s", "o"], "left_anti"), "frontier")
            parts.append(frontier)
            if len(parts) > 16:  # keep the plan small
                parts = [ws.cut(reduce(DataFrame.unionByName, parts), "seen")]
        out = reduce(DataFrame.unionByName, parts)
        return out.select(F.col("o").alias("s"), F.col("s").alias("o")) if backwards else out

    def table(self, v: tuple) -> Solutions:
        _, names, rows = v
        kinds, maybe = {}, set()
        for i, name in enumerate(names):
            present = [r[i][0] for r in rows if r[i] is not None]
            kinds[name] = present[0] if present and len(set(present)) == 1 else "str"
            if len(present) < len(rows) or not rows:
                maybe.add(name)
        schema = ", ".join(f"`{n}` {_TYPE[kinds[n]]}" for n in names)
        data = [tuple(None if t is None else t[1] if kinds[n] != "str" else str(t[1]) for n, t in zip(names, r)) for r in rows]
        return Solutions(self.spark.createDataFrame(data, schema), kinds, maybe)

    def union(self, parts: list[Solutions]) -> Solutions:
        names = sorted({v for x in parts for v in x.kinds})
        kinds, maybe, frames = {}, set(), []
        for v in names:
            have = [x.kinds[v] for x in parts if v in x.kinds]
            kinds[v] = have[0] if len(set(have)) == 1 else "str"
            if len(have) < len(parts) or any(v in x.maybe for x in parts):
                maybe.add(v)
        for x in parts:
            frames.append(self._df(x).select(*[(F.col(v).cast(_TYPE[kinds[v]]) if v in x.kinds else F.lit(None).cast(_TYPE[kinds[v]])).alias(v) for v in names]))
        return Solutions(reduce(DataFrame.unionByName, frames), kinds, maybe)

    def _renamed(self, right: Solutions) -> tuple[DataFrame, dict[str, str]]:
        self.n += 1
        names = {v: f"_r{self.n}_{v}" for v in right.kinds}
        return self._df(right).select(*[F.col(v).alias(n) for v, n in names.items()]), names

    def _compatible(self, left: Solutions, right: Solutions, names: dict[str, str]) -> Column:
        cond = F.lit(True)
        for v in sorted(set(left.kinds) & set(right.kinds)):
            same = F.col(v) == F.col(names[v])
            if v in left.maybe:
                same = same | F.col(v).isNull()
            if v in right.maybe:
                same = same | F.col(names[v]).isNull()
            cond = cond & same
        return cond

    def join(self, left: Solutions, right: Solutions) -> Solutions:
        if left.df is None:
            return right
        if right.df is None:
            return left
        shared = sorted(set(left.kinds) & set(right.kinds))
        kinds = {**right.kinds, **left.kinds}
        if not shared:
            return Solutions(left.df.crossJoin(right.df), kinds, left.maybe | right.maybe)
        if not any(v in left.maybe or v in right.maybe for v in shared):
            return Solutions(left.df.join(right.df, shared), kinds, left.maybe | right.maybe)
        df, names = self._renamed(right)
        j = self._by_bound(left, right, df, names, shared)
        columns = [F.coalesce(F.col(v), F.col(names[v])).alias(v) if v in shared else F.col(v) for v in left.kinds] + [F.col(names[v]).alias(v) for v in right.kinds if v not in left.kinds]
        return Solutions(j.select(*columns), kinds, {v for v in left.maybe | right.maybe if v not in shared or v in left.maybe and v in right.maybe})

    @staticmethod
    def _form(names: list[str], bound: int) -> Column:
        """Which of ``names`` are bound (bits)."""
        return reduce(Column.__and__, [F.col(n).isNotNull() if bound >> i & 1 else F.col(n).isNull() for i, n in enumerate(names)], F.lit(True))

    def _by_bound(self, left: Solutions, right: Solutions, df: DataFrame, names: dict[str, str], shared: list[str]) -> DataFrame:
        """Compatible pairs, as one join on equal keys for each way in which variables are bound on the two sides."""
        mine, theirs = [v for v in shared if v in left.maybe], [v for v in shared if v in right.maybe]
        if len(mine) + len(theirs) > FORMS:
            return left.df.join(df, self._compatible(left, right, names))
        parts = []
        for a in range(1 << len(mine)):
            for b in range(1 << len(theirs)):
                x, y = left.df.filter(self._form(mine, a)), df.filter(self._form([names[v] for v in theirs], b))
                free = {v for i, v in enumerate(mine) if not a >> i & 1} | {v for i, v in enumerate(theirs) if not b >> i & 1}
                keys = [F.col(v) == F.col(names[v]) for v in shared if v not in free]
                parts.append(x.join(y, reduce(Column.__and__, keys)) if keys else x.crossJoin(y))
        return reduce(DataFrame.unionByName, parts)

    def _left_by_bound(self, left: DataFrame, df: DataFrame, names: dict[str, str], shared: list[str], loose: list[str]) -> DataFrame:
        """The same for a left join whose right side is always bound."""
        parts = []
        for a in range(1 << len(loose)):
            x = left.filter(self._form(loose, a))
            keys = [F.col(v) == F.col(names[v]) for v in shared if v not in loose or a >> loose.index(v) & 1]
            if keys:
                parts.append(x.join(df, reduce(Column.__and__, keys), "left"))
            else:  # goes with every row; by itself only where there is none
                alone = x.join(df.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti")
                parts += [x.crossJoin(df), alone.select("*", *[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])]
        return reduce(DataFrame.unionByName, parts)

    def optional(self, left: Solutions, p: tuple) -> Solutions:
        filters = [x[1] for x in p[1] if x[0] == "filter"]
        right = self.pattern(("group", [x for x in p[1] if x[0] != "filter"]))
        if left.df is None:
            left = Solutions(self._unit(), {}, set())
        df, names = self._renamed(right)
        cond = self._compatible(left, right, names)
        both = Solutions(None, {**right.kinds, **left.kinds}, left.maybe | set(right.kinds))
        for f in filters:  # an inner filter sees both sides
            cond = cond & self.truth(f, both, {v: n for v, n in names.items() if v not in left.kinds})
        shared = sorted(set(left.kinds) & set(right.kinds))
        loose = [v for v in shared if v in left.maybe]
        if not filters and loose and len(loose) < FORMS and not any(v in right.maybe for v in shared):
            j = self._left_by_bound(left.df, df, names, shared, loose)
        else:
            j = left.df.join(df, cond, "left")
        columns = [F.coalesce(F.col(v), F.col(names[v])).alias(v) if v in right.kinds and v in left.maybe else F.col(v) for v in left.kinds] + [F.col(names[v]).alias(v) for v in right.kinds if v not in left.kinds]
        return Solutions(j.select(*columns), both.kinds, left.maybe | {v for v in right.kinds if v not in left.kinds})

    def minus(self, left: Solutions, right: Solutions) -> Solutions:
        shared = sorted(set(left.kinds) & set(right.kinds))
        if not shared or left.df is None:
            return left
        df, names = self._renamed(right)
        cond = self._compatible(left, right, names)
        if any(v in left.maybe or v in right.maybe for v in shared):  # at least one variable bound on both sides
            cond = cond & reduce(Column.__or__, [F.col(v).isNotNull() & F.col(names[v]).isNotNull() for v in shared])
        return Solutions(left.df.join(df, cond, "left_anti"), left.kinds, left.maybe)

    def exists(self, left: Solutions, right: Solutions, negated: bool) -> Solutions:
        df, names = self._renamed(right)
        how = "left_anti" if negated else "left_semi"
        return Solutions(self._df(left).join(df, self._compatible(left, right, names), how), left.kinds, left.maybe)

    # -- expressions

    def string(self, c: Column, kind: str) -> Column:
        if kind == "iri":
            return F.when(c.startswith("<") & c.endswith(">"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(F.concat(F.lit(PREFIX), iri_escape(c)))
        if kind == "bool":
            return F.when(c, "true").when(~c, "false")
        return c.cast("string")

    def truth(self, e: tuple, sol: Solutions, renamed: dict[str, str] | None = None) -> Column:
        c, kind = self.expr(e, sol, renamed)
        if kind == "bool":
            return c
        if kind in ("int", "dbl"):
            return c != 0
        return F.length(c) > 0 if kind == "str" else F.lit(None).cast("boolean")

    def expr(self, e: tuple, sol: Solutions, renamed: dict[str, str] | None = None) -> tuple[Column, str]:
        sub = lambda x: self.expr(x, sol, renamed)
        op = e[0]
        if op == "var":
            if e[1] not in sol.kinds:
                return F.lit(None).cast("string"), "str"
            return F.col((renamed or {}).get(e[1], e[1])), sol.kinds[e[1]]
        if op == "iri" or op == "str":
            return F.lit(e[1]), op
        if op == "int":
            return F.lit(e[1]).cast("bigint"), "int"
        if op == "dbl":
            return F.lit(float(e[1])), "dbl"
        if op == "bool":
            return F.lit(bool(e[1])), "bool"
        if op == "time":
            return F.lit(e[1]).try_cast("timestamp"), "time"
        if op in ("||", "&&"):
            a, b = self.truth(e[1], sol, renamed), self.truth(e[2], sol, renamed)
            return (a | b if op == "||" else a & b), "bool"
        if op == "!":
            return ~self.truth(e[1], sol, renamed), "bool"
        if op == "exists":
            raise SparqlError("EXISTS stands alone in a FILTER, or joined by &&")
        if op == "in":
            found = reduce(Column.__or__, [self.compare("=", sub(e[1]), sub(x)) for x in e[2]], F.lit(False))
            return (~found if e[3] else found), "bool"
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return self.compare(op, sub(e[1]), sub(e[2])), "bool"
        if op in ("+", "-", "*", "/"):
            (a, ka), (b, kb) = sub(e[1]), sub(e[2])
            a, b = (x if k in ("int", "dbl") else F.lit(None).cast("double") for x, k in ((a, ka), (b, kb)))
            if op == "/":
                return F.try_divide(a.cast("double"), b.cast("double")), "dbl"
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b), "int" if ka == kb == "int" else "dbl"
        return self.call(e[1], e[2], sub, sol, renamed)

    def compare(self, op: str, left: tuple[Column, str], right: tuple[Column, str]) -> Column:
        (a, ka), (b, kb) = left, right
        number = ("int", "dbl")
        if ka != kb and not (ka in number and kb in number):
            if op in ("=", "!="):
                return F.when(a.isNotNull() & b.isNotNull(), F.lit(op == "!="))
            return F.lit(None).cast("boolean")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    def call(self, name: str, args: list, sub, sol: Solutions, renamed) -> tuple[Column, str]:
        if name == "BOUND":
            return sub(args[0])[0].isNotNull(), "bool"
        if name == "IF":
            (b, kb), (c, kc) = sub(args[1]), sub(args[2])
            if kb != kc:
                b, c, kb = self.string(b, kb), self.string(c, kc), "str"
            cond = self.truth(args[0], sol, renamed)
            return F.when(cond, b).when(~cond, c), kb
        if name == "COALESCE":
            parts = [sub(x) for x in args]
            kinds = {k for _, k in parts}
            return (F.coalesce(*[c for c, _ in parts]), parts[0][1]) if len(kinds) == 1 else (F.coalesce(*[self.string(c, k) for c, k in parts]), "str")
        parts = [sub(x) for x in args]
        text = lambda i: self.string(*parts[i]) if parts[i][1] != "iri" else F.lit(None).cast("string")
        c, kind = parts[0] if parts else (F.lit(None).cast("string"), "str")
        if name == "STR":
            return self.string(c, kind), "str"
        if name in ("IRI", "URI"):
            return (c, "iri") if kind == "iri" else (F.when(c.startswith(PREFIX), F.url_decode(F.replace(F.substring(c, F.lit(len(PREFIX) + 1), F.length(c)), F.lit("+"), F.lit("%2B")))).otherwise(F.concat(F.lit("<"), c, F.lit(">"))), "iri")
        if name in ("ISIRI", "ISURI"):
            return F.when(c.isNotNull(), F.lit(kind == "iri")), "bool"
        if name == "ISLITERAL":
            return F.when(c.isNotNull(), F.lit(kind != "iri")), "bool"
        if name == "ISBLANK":
            return F.when(c.isNotNull(), F.lit(False)), "bool"
        if name == "ISNUMERIC":
            return F.when(c.isNotNull(), F.lit(kind in ("int", "dbl"))), "bool"
        if name == "SAMETERM":
            return self.compare("=", parts[0], parts[1]), "bool"
        if name == "LANG":
            return (F.lit(None).cast("string") if kind == "iri" else F.when(c.isNotNull(), "")), "str"
        if name == "LANGMATCHES":
            return F.when(text(1) == "*", text(0) != "").otherwise(F.lower(text(0)).startswith(F.lower(text(1)))), "bool"
        if name == "DATATYPE":
            label = {"str": "string", "int": "integer", "dbl": "double", "bool": "boolean", "time": "dateTime"}.get(kind)
            return (F.when(c.isNotNull(), f"<{XSD}{label}>") if label else F.lit(None).cast("string")), "iri"
        if name in ("STRDT", "STRLANG"):
            return text(0), "str"
        if name == "CAST":
            value, vk = parts[1]
            return self.cast(self.string(value, vk), args[0][1].strip("<>").removeprefix(XSD))
        one = {"UCASE": F.upper, "LCASE": F.lower, "MD5": F.md5, "SHA1": F.sha1}
        if name in one:
            return one[name](text(0)), "str"
        if name in ("SHA256", "SHA384", "SHA512"):
            return F.sha2(text(0), int(name[3:])), "str"
        if name == "STRLEN":
            return F.length(text(0)).cast("bigint"), "int"
        if name == "SUBSTR":
            n = parts[2][0].cast("int") if len(parts) > 2 else F.length(text(0))
            return F.substring(text(0), parts[1][0].cast("int"), n), "str"
        if name == "CONCAT":
            return F.concat(*[text(i) for i in range(len(parts))]) if parts else F.lit(""), "str"
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](text(0), text(1)), "bool"
        if name in ("STRBEFORE", "STRAFTER"):
            at = F.locate(args[1][1], text(0)) if args[1][0] == "str" else F.position(text(1), text(0))
            n = F.length(text(1))
            return F.when(at == 0, "").otherwise(F.substring(text(0), F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(text(0), at + n, F.length(text(0)))), "str"
        if name == "ENCODE_FOR_URI":
            x = F.replace(F.url_encode(text(0)), F.lit("+"), F.lit("%20"))
            return F.replace(F.replace(x, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")), "str"
        if name in ("REGEX", "REPLACE"):
            if args[1][0] != "str":
                raise SparqlError(f"{name} needs a constant pattern")
            at = 2 if name == "REGEX" else 3
            flags = "".join(f for f in (args[at][1] if len(args) > at else "") if f in "ismx")
            pattern = (f"(?{flags})" if flags else "") + args[1][1]
            return (F.regexp_like(text(0), F.lit(pattern)), "bool") if name == "REGEX" else (F.regexp_replace(text(0), F.lit(pattern), text(2)), "str")
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            x = c if kind in ("int", "dbl") else F.lit(None).cast("double")
            f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda y: F.floor(y + F.lit(0.5))}[name]
            return f(x).cast(_TYPE.get(kind, "double")), kind if kind in ("int", "dbl") else "dbl"
        if name == "RAND":
            return F.rand(), "dbl"
        if name == "NOW":
            return F.current_timestamp(), "time"
        if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"):
            t = c if kind == "time" else c.try_cast("timestamp") if kind == "str" else F.lit(None).cast("timestamp")
            f = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}[name]
            return f(t).cast("bigint"), "int"
        if name in ("TZ", "TIMEZONE"):
            return F.when(c.isNotNull(), F.lit("Z" if name == "TZ" else "PT0S")), "str"
        if name in ("UUID", "STRUUID"):
            return (F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), "iri") if name == "UUID" else (F.uuid(), "str")
        raise SparqlError(f"no function {name}")

    def cast(self, text: Column, to: str) -> tuple[Column, str]:
        if to in ("integer", "int", "long"):
            return text.try_cast("double").cast("bigint"), "int"
        if to in ("decimal", "double", "float"):
            return text.try_cast("double"), "dbl"
        if to == "boolean":
            return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False), "bool"
        if to == "dateTime":
            return text.try_cast("timestamp"), "time"
        if to == "string":
            return text, "str"
        raise SparqlError(f"no cast to {to}")


def _has_agg(e) -> bool:
    return isinstance(e, (tuple, list)) and (bool(e) and isinstance(e, tuple) and e[0] == "agg" or any(_has_agg(x) for x in e))


def _vars(e) -> set[str]:
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "var":
        return {e[1]}
    return set().union(*(_vars(x) for x in e)) if isinstance(e, (tuple, list)) else set()


def query(triples: DataFrame, text: str) -> DataFrame:
    """The solutions of a SELECT (a column per variable, IRIs as local names, unbound null) or ``ask``: one boolean."""
    return Compiler(triples).run(Parser(text).query())
