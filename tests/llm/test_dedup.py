"""Hidden duplicates against grouping in plain Python."""

import random
import re

from loomgraph.llm import dedup

KINDS = {"declares": True, "commitMessage": False}
SCHEMA = "triple_id bigint, p string, o string, keep_id bigint, digest string"


def form(p, o):
    words = lambda x: tuple(re.findall(r"[^\W_]+", x.lower()))
    if p == "commitMessage":
        return words(o)
    fields = []
    for f in re.split(r"[,;|\r\n]+", o):
        name, value = (re.split(r"[:=]", f, maxsplit=1) + [""])[:2] if re.search(r"[:=]", f) else ("", f)
        if words(name) or words(value):
            fields.append((words(name), words(value)))
    return tuple(sorted(fields))


def expected(rows):
    groups = {}
    for i, p, o in rows:
        if p in KINDS and o is not None and len(re.findall(r"[^\W_]+", o)) >= 3:
            groups.setdefault((p, form(p, o)), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}, sorted((min(g), len(g)) for g in groups.values())


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    pairs, counts = expected(rows)
    assert {tuple(r) for r in dedup.duplicates(df, KINDS).collect()} == pairs
    assert sorted((r["keep_id"], r["copies"]) for r in dedup.records(df, KINDS).collect()) == counts


def test_forms(spark):
    texts = ["Name: a b; version: 1.2", "version = 1.2 | name = 'A  B'", "{\"name\": \"a\u00a0b\", \"version\": \"1.2\"}", "name: b a; version: 1.2", "version: a b, name: 1.2", "name=a b,name=a b,version=1.2", "two words", "", None, "...", "NAME=A B\nVERSION=1.2\n", "a, b, c", "c, b, a"]
    rows = [(i, "declares", t) for i, t in enumerate(texts)]
    rows += [(100 + i, "commitMessage", t) for i, t in enumerate(["fix the bug", "Fix, the-bug!", "the fix bug", "fix the bug now", "\u00d6l f\u00fcr alle", "\u00f6l F\u00dcR ALLE", None])] + [(200, "calls", "fix the bug"), (201, None, "fix the bug")]
    check(spark, rows)


def test_hot_group_and_random(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta"]
    rows = [(i, "commitMessage", "bump the version" if i % 3 == 0 else r.choice([" ", "-", ", "]).join(r.choice(words) for _ in range(r.randrange(1, 5)))) for i in range(3000)]
    rows += [(5000 + i, "declares", r.choice([";", "|", "\n"]).join(f"{r.choice('ab')}{r.choice([':', '= '])}{r.choice(words)} {r.choice('xy')}" for _ in range(r.randrange(1, 4)))) for i in range(1000)]
    check(spark, rows)


def test_nothing(spark):
    assert dedup.duplicates(spark.createDataFrame([], SCHEMA), KINDS).count() == 0
    assert dedup.records(spark.createDataFrame([], SCHEMA), KINDS).count() == 0


def test_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, "commitMessage", long, 0, ""), (2, "commitMessage", long.upper(), 0, ""), (3, "commitMessage", long + " x", 0, "")], SCHEMA)
    assert [tuple(r) for r in dedup.duplicates(df, KINDS).collect()] == [(1, 2)]
