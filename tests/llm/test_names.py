"""Name variants: readings, the metric join against all pairs, classes of small sets."""

import random

import pytest

from loomgraph.llm.names import classes, pairs_within, read_name, variants
from loomgraph.workspace import Workspace


@pytest.mark.parametrize(("name", "want"), [
    ("Kenneth_Foruk", [("f", "kenneth foruk")]), ("Dr._Kenneth_B._Foruk", [("f", "kenneth foruk")]), ("Foruk,_Ken", [("f", "kenneth foruk")]), ("KENNETH_FORUK", [("f", "kenneth foruk")]), ("foruk-kenneth", [("f", "kenneth foruk")]), ("KennethForuk", [("f", "kenneth foruk")]),
    ("K._Foruk", [("i", "k foruk")]), ("Foruk,_K.", [("i", "k foruk")]), ("KB_Foruk", [("i", "k foruk")]), ("JR_Foruk", [("i", "j foruk")]), ("kforuk", [("i", "k foruk"), ("s", "kforuk")]), ("Kenneth_F_ruk", [("w", "kenneth f?ruk")]),
    ("Zazo_Institute_GmbH", [("f", "org zazo institute")]), ("The_Zazo_Inst.", [("f", "org zazo institute")]), ("ZazoInstitute", [("f", "org zazo institute")]), ("Zazo_Eng._Grp.,_S.A.", [("f", "org zazo engineering group")]), ("zazo-institute", [("f", "org zazo institute")]),
    ("ci-release-bot", [("f", "ci release bot")]), ("Kit_Foruk", [("a", "christopher foruk"), ("a", "katherine foruk")]), ("...", [("f", "...")]), ("Unknown_Person", [("f", "unknown person"), ("f", "person unknown")]),
])
def test_readings(name, want):
    assert read_name(name) == want


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def swap(a, b):
    return len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))


def test_no_pair_is_lost(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abco") for _ in range(r.randrange(3, 12))) for _ in range(140)]
    forms = set(base)
    for x in base[:80]:
        i = r.randrange(len(x))
        forms.add(r.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "z" + x[i + 1 :], x[:i] + x[i : i + 2][::-1] + x[i + 2 :]]))
    got = [tuple(p) for p in pairs_within(spark.createDataFrame([(f,) for f in [*forms, None]], "form string"), Workspace(spark)).collect()]
    s = sorted(forms)
    want = {(a, b) for i, a in enumerate(s) for b in s[i + 1 :] if lev(a, b) <= 1 or swap(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_classes(spark):
    same = ["Alexander_Mevomart", "Alexander_Mevomsrt", "Allexander_Mevomart", "Mevomart,_A.", "sasha_mevomart", "amevomart", "Alexander_M_vomart", "Mevomart_Alexander"]
    org = ["Gogukiphe_Technologies_Ltd", "Gogukiphe_Technologies", "Gogkiphe_Technologies", "GOGUKIPHE_TECHNOLOGIES"]
    others = ["Gogukiphe_Systems_Ltd", "Gabriela_Mevomart", "Edward_Dogo", "Elizabeth_Dogo", "E._Dogo"]
    c = {r["name"]: r["class"] for r in classes(spark.createDataFrame([(n,) for n in same + org + others + [None, same[0]]], "name string")).collect()}
    assert len({c[n] for n in same}) == 1 and len({c[n] for n in org}) == 1
    assert len({c[n] for n in others + [same[0], org[0]]}) == 7  # an initial that may be two people is nobody's


def test_variants(spark):
    rows = [("Ann_Bolo", ["A._Bolo", None, "Cid_Dara"]), (None, None), ("Ann_Bolo", []), ("Bolo,_Ann", ["Ann_Bolo"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "last_author string, contributors array<string>, name string")
    assert {tuple(r) for r in variants(df).collect()} == {("A._Bolo", "Ann_Bolo"), ("A._Bolo", "Bolo,_Ann"), ("Ann_Bolo", "Bolo,_Ann")}
    assert variants(df.limit(0)).count() == 0
