"""Variant spellings of names typed by people.

Method: metric-space partitioning.  Every distinct spelling is read into normal forms:
"given surname" with titles, middle initials and nicknames resolved, or "root kind" of an
organisation with its legal form left out.  The distinct forms are points of a metric
space under the Levenshtein distance.  A sample of forms serves as pivots; each form
lives in the cell of its nearest pivot and is copied into every cell whose pivot is at
most 2 r farther (the triangle inequality: no pair within radius r is lost); inside a
cell an exact radius join runs, pruned by length and by the distances to the pivot.
A swap of neighbouring letters (two Levenshtein steps, one of Damerau's) is found among
forms with the same letters.  Linked spellings form classes by label propagation over
the links.  Initials are resolved last, and only where one class fits.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.workspace import Workspace

RADIUS = 1
#: Pivots are a sample of at most this many forms, the square root of the forms times two.
MAX_PIVOTS = 1024

# -- fixed values: what names are made of ------------------------------------------
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "dame", "ing", "phd", "md", "jr", "sr", "ii", "iii", "iv", "herr", "frau", "dipl"}
LEGAL = {"gmbh", "inc", "incorporated", "ltd", "limited", "llc", "llp", "sa", "ab", "ag", "bv", "nv", "oy", "plc", "kg", "pty", "corp", "corporation", "co", "company", "srl", "sarl", "spa", "se", "as", "aps", "kk"}
KINDS = {
    "international": "international", "intl": "international", "internat": "international", "systems": "systems", "system": "systems", "sys": "systems", "syst": "systems",
    "institute": "institute", "inst": "institute", "laboratories": "laboratories", "laboratory": "laboratories", "labs": "laboratories", "lab": "laboratories",
    "foundation": "foundation", "fdn": "foundation", "fndn": "foundation", "found": "foundation", "technologies": "technologies", "technology": "technologies", "tech": "technologies", "techn": "technologies", "techs": "technologies",
    "software": "software", "softw": "software", "sw": "software", "engineering": "engineering", "eng": "engineering", "engg": "engineering", "engr": "engineering", "group": "group", "grp": "group", "gp": "group",
    "solutions": "solutions", "services": "services", "svcs": "services", "research": "research", "university": "university", "univ": "university", "department": "department", "dept": "department", "association": "association", "assoc": "association", "consulting": "consulting", "industries": "industries", "holdings": "holdings", "partners": "partners", "project": "project", "team": "team", "community": "community", "consortium": "consortium",
}
_NICKNAMES = """
alexander: alex sasha xander lex alec sandy al; amina: mina; andrzej: jedrek andy endrju; andrew: andy drew; anthony: tony; benjamin: ben benny benji; barbara: barb babs;
charles: charlie chuck; christopher: chris kit topher kris; daniel: dan danny; david: dave davy; dmitri: dima mitya dimitri; dorothy: dot dottie dolly dory; edward: ed ned ted eddie teddy;
eleanor: nell ellie nora ella nellie lena; elizabeth: beth betty liz lizzie eliza libby bess betsy lisa; francisco: paco pancho fran cisco; frederick: fred freddie fritz; gabriela: gabi gaby gabby;
haruto: haru; henry: harry hank hal; ignacio: nacho iggy; ingrid: inga; isabella: bella izzy isa belle; james: jim jimmy jamie; jennifer: jen jenny; johannes: hannes hans jo; john: jack johnny;
jonathan: jon jonny nathan johnny; joseph: joe joey; katherine: kate kathy kit katie kat kitty katy; kenneth: ken kenny; lakshmi: laxmi; leonard: leo len lenny; margaret: maggie meg peggy marge greta madge margie daisy;
michael: mike mick mickey mikey micky; nicholas: nick nicky nico klaus cole; olivia: liv livvy ollie; oskar: ossi oscar; patricia: pat trish patty tricia patsy; peter: pete; pilar: pili; quentin: quint quin;
rasmus: ras; rebecca: becky; richard: rick dick rich richie ricky; robert: bob bobby rob bert robbie; samuel: sam sammy; stephen: steve; susan: sue; theodora: dora thea teddy theo; thomas: tom tommy;
tomasz: tomek tom; ursula: uschi ulla ursel; victoria: vicky tori vicki vic; vikram: vik; william: bill will billy willy liam; wiremu: wi wire; yevgenia: zhenya genia evgenia jenny; zachary: zach zack zac zak
"""
FORMAL: dict[str, tuple[str, ...]] = {}
for _entry in _NICKNAMES.split(";"):
    _full, _, _nicks = _entry.strip().partition(":")
    FORMAL[_full] = (_full,)
for _entry in _NICKNAMES.split(";"):
    _full, _, _nicks = _entry.strip().partition(":")
    for _nick in _nicks.split():
        FORMAL[_nick] = (*FORMAL.get(_nick, ()), _full) if FORMAL.get(_nick) != (_nick,) else FORMAL[_nick]
VOWELS = "aeiouy"
LOST = "?"  # a character that was replaced


def _unaccent(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def read_name(name: str) -> list[tuple[str, str]]:
    """(strength, form) of one spelling.

    strength: f a full form; i an initial with a surname ("i surname"); w a full form in
    which ? stands for a lost letter; a one of several forms of an ambiguous nickname.
    A spelling of which nothing is left (punctuation only) is its own form.
    """
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", _unaccent(name.strip())) if not re.search(r"[_\s.,\-]", name.strip().strip(".")) else _unaccent(name.strip())
    comma = re.match(r"([^,]+),[_\s]*(.+)$", s)
    raw = [x for x in re.split(r"[_\s,\-/]+", s) if x.strip(".")]
    flat = re.sub(r"(?<=\w)\.(?=\w\.?(?:$|[_\s,]))", "", s)  # S.A. is one word
    words = [x for x in re.split(r"[_\s,.\-/@]+", flat.lower()) if x]
    if not words:
        return [("f", name)]
    if words[0] == "the" and len(words) > 1:
        words = words[1:]
    # -- organisations
    kinds = [KINDS[w] for w in words[1:] if w in KINDS]
    legal = [w for w in words[1:] if w in LEGAL]
    if kinds or legal and len(words) > 2 or (legal and len(words) == 2 and not comma):
        root = [w for w in words if w not in LEGAL and (w not in KINDS or w == words[0])]
        return [("f", "org " + " ".join(root + kinds))]
    # -- letters lost inside a word: a part that begins in lower case after one that began in upper case
    pieces = s.split("_")
    if s[:1].isupper() and not s.isupper() and not comma and len(pieces) > 1:
        at = next((i for i, x in enumerate(pieces[1:], 1) if x[:1].islower() or x == "" and i == len(pieces) - 1), None)
        if at is not None:
            begin = at if pieces[at] == "" and at < len(pieces) - 1 else at - 1
            given = [x.strip(".").lower() for x in pieces[:begin] if x and x.strip(".").lower() not in TITLES]
            if begin == 0:
                given, begin = [pieces[0].lower()], 1
            surname = LOST.join(x.lower() for x in pieces[begin:])
            if given and len(surname) > 2:
                return [("w" if len(FORMAL.get(given[0], (given[0],))) == 1 else "a", f"{g} {surname}") for g in FORMAL.get(given[0], (given[0],))]
    # -- initials and middle initials
    if len(raw) == 2 and re.fullmatch(r"[A-Z]{2}", raw[0]) and not s.isupper() and not comma:
        return [("i", f"{words[0][0]} {words[-1]}")]
    words = [w for w in words if w not in TITLES] or words
    if comma:
        last = [w for w in re.split(r"[_\s.\-]+", comma[1].lower()) if w and w not in TITLES]
        first = [w for w in re.split(r"[_\s.\-,]+", comma[2].lower()) if w and w not in TITLES]
        if last and first:
            return _person(first, last[-1] if len(last) == 1 else " ".join(last), ordered=True)
    if len(words) == 1:
        w = words[0]
        return [("i", f"{w[0]} {w[1:]}"), ("s", w)] if len(w) > 4 else [("f", w)]
    if len(words) > 2:
        middle = [w for w in words[1:-1] if len(w) > 1]
        if middle:
            return [("f", " ".join(words))]
        return _person([words[0]], words[-1], ordered=True)
    a, b = words
    if len(b) <= 1:
        return [("i", f"{b} {a}")]
    return _person([a], b, ordered=len(a) == 1)


def _person(given: list[str], surname: str, ordered: bool) -> list[tuple[str, str]]:
    g = given[0]
    if len(g) == 1:
        return [("i", f"{g} {surname}")]
    if not ordered and g not in FORMAL and surname in FORMAL:
        g, surname = surname, g
        ordered = True
    formal = FORMAL.get(g)
    if formal:
        return [("f" if len(formal) == 1 else "a", f"{x} {surname}") for x in formal]
    forms = [("f", f"{g} {surname}")]
    if not ordered:  # it isn't known which is the surname
        forms.append(("f", f"{surname} {g}"))
    return forms


# -- the metric space ----------------------------------------------------------------


def pairs_within(forms: DataFrame, ws: Workspace, column: str = "form", radius: int = RADIUS) -> DataFrame:
    """a, b (a < b): all pairs of different non-null strings within a Levenshtein radius, or with two neighbouring letters swapped.

    Few bytes, much work: partitions are set by the number of cores, not by size.
    """
    parts = 4 * forms.sparkSession.sparkContext.defaultParallelism
    points = ws.cut(forms.select(forms[column].alias("x")).filter(F.col("x").isNotNull()).distinct().repartition(parts, "x"), "points")
    n = points.count()
    if n < 2:
        return points.select(F.col("x").alias("a"), F.col("x").alias("b")).filter(F.lit(False))
    k = min(MAX_PIVOTS, max(8, int(2 * math.sqrt(n))))
    pivots = [r["x"] for r in points.orderBy(F.xxhash64("x"), "x").limit(k).collect()]
    k = len(pivots)
    d = F.transform(F.array(*[F.lit(p) for p in pivots]), lambda p: F.levenshtein(F.col("x"), p))
    placed = points.repartition(parts, "x").select("x", d.alias("d")).withColumn("near", F.array_min("d"))
    placed = placed.select(
        "x", F.length("x").alias("n"), "near", F.array_position("d", F.col("near")).cast("int").alias("home"),
        F.filter(F.transform("d", lambda v, i: F.struct((i + 1).alias("cell"), v.alias("v"))), lambda c: c["v"] <= F.col("near") + 2 * radius).alias("cells"),
    )
    placed = ws.cut(placed, "placed")
    homes = placed.select(F.col("home").alias("cell"), F.col("x").alias("a"), F.col("near").alias("da"), F.col("n").alias("len"))
    copies = placed.select("x", "n", F.explode("cells").alias("c")).select(F.col("c.cell").alias("cell"), F.col("x").alias("b"), F.col("c.v").alias("db"), F.explode(F.sequence(F.col("n") - radius, F.col("n") + radius)).alias("len"))
    close = homes.repartition(parts, "cell", "len").join(copies.repartition(parts, "cell", "len"), ["cell", "len"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("da") - F.col("db")) <= radius) & (F.levenshtein("a", "b", radius) >= 0)).select("a", "b")

    letters = F.array_join(F.array_sort(F.split("x", "")), "")
    bag = points.select("x", F.xxhash64(letters).alias("bag"))

    def swapped(a: Column, b: Column) -> Column:
        whole = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
        return (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: whole(i) == b)

    same = bag.select(F.col("x").alias("a"), "bag").join(bag.select(F.col("x").alias("b"), "bag"), "bag").filter((F.col("a") < F.col("b")) & swapped(F.col("a"), F.col("b"))).select("a", "b")
    return close.unionByName(same)


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """v, label: the smallest member of each vertex's component, by label propagation until nothing changes."""
    both = ws.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = ws.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("v"), "label"), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("heard"))
        jumped = labels.select(F.col("v").alias("l"), F.col("label").alias("further"))
        nxt = labels.join(heard, labels["v"] == heard["a"]).join(jumped, labels["label"] == F.col("l"), "left").select(
            "v", F.least("label", "heard", "further").alias("new"), F.col("label").alias("old")
        )
        nxt = ws.cut(nxt, "labels")
        done = nxt.filter(F.col("new") != F.col("old")).isEmpty()
        labels = nxt.select("v", F.col("new").alias("label"))
        if done:
            return labels


def classes(names: DataFrame, column: str = "name") -> DataFrame:
    """name, class: every distinct non-null spelling with the class of the entity it names."""
    ws = Workspace(names.sparkSession)
    distinct = names.select(names[column].alias("name")).filter(F.col("name").isNotNull()).distinct()

    def run(batches):
        for b in batches:
            out = [(n, s, f) for n in b.column(0).to_pylist() for s, f in read_name(n)]
            yield pa.record_batch([pa.array([x[i] for x in out], pa.string()) for i in range(3)], names=["name", "strength", "form"])

    read = ws.cut(distinct.mapInArrow(run, "name string, strength string, form string"), "read")
    full = read.filter(F.col("strength") == "f")
    given, surname = F.substring_index("form", " ", 1), F.substring_index("form", " ", -1)
    # spellings with lost letters: the same once every vowel is lost, and equal where letters are left
    lossy = read.filter(F.col("strength") == "w")
    bare = lambda c: F.regexp_replace(c, f"[{VOWELS}]", LOST)
    wild = lossy.select(F.col("form").alias("b"), bare(F.col("form")).alias("bare")).distinct().join(full.select(F.col("form").alias("a"), bare(F.col("form")).alias("bare")).distinct(), "bare")
    wild = wild.filter(F.length("a") == F.length("b")).filter(F.forall(F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: (x == y) | (y == LOST)), lambda ok: ok))
    # every full form of a person also stands in the space of initials
    initial = F.concat(F.lit("~"), F.substring("form", 1, 1), F.lit(" "), surname)
    person = full.filter(~F.col("form").startswith("org ") & F.col("form").contains(" "))
    weak = read.filter(F.col("strength") == "i").select("name", F.concat(F.lit("~"), F.col("form")).alias("form"))
    shorts = person.select(initial.alias("form")).unionByName(weak.select("form")).distinct()
    unclear = read.filter(F.col("strength") == "a").select("name", "form")
    near = pairs_within(full.select("form").unionByName(lossy.select("form")).unionByName(unclear.select("form")).unionByName(shorts), ws)
    # an initial is never the letter mistyped, and two known given names are two people
    known_given = lambda c: F.substring_index(c, " ", 1).isin(*FORMAL)
    differ = F.substring_index("a", " ", 1) != F.substring_index("b", " ", 1)
    near = ws.cut(near.filter(~(differ & (F.col("a").startswith("~") | F.col("b").startswith("~") | known_given(F.col("a")) & known_given(F.col("b"))))), "near")
    strong_near = near.filter(~F.col("a").startswith("~") & ~F.col("b").startswith("~"))
    # a spelling is tied to its forms, forms to forms; spellings are marked to keep the two apart
    tie = read.filter(F.col("strength").isin("f", "w")).select(F.concat(F.lit("n:"), "name").alias("a"), F.concat(F.lit("f:"), "form").alias("b"))
    form_edges = strong_near.unionByName(wild.select("a", "b")).select(F.concat(F.lit("f:"), "a").alias("a"), F.concat(F.lit("f:"), "b").alias("b"))
    label = ws.cut(components(tie.unionByName(form_edges), ws), "strong")
    form_label = label.filter(F.col("v").startswith("f:")).select(F.substring("v", 3, 1 << 30).alias("form"), "label")
    strong = label.filter(F.col("v").startswith("n:")).select(F.substring("v", 3, 1 << 30).alias("name"), "label")

    # what a weak spelling may stand for: classes that have its form, else classes within the radius
    short_label = person.select("form", initial.alias("short")).join(form_label, "form").select(F.col("short").alias("form"), "label").distinct()
    known = short_label.unionByName(form_label)
    asked = weak.unionByName(unclear).unionByName(read.filter(F.col("strength") == "s").select("name", "form"))
    exact = asked.join(known, "form").select("name", "label", F.lit(0).alias("far"))
    around = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    close = asked.join(around, asked["form"] == around["a"]).join(known.withColumnRenamed("form", "other"), F.col("b") == F.col("other")).select("name", "label", F.lit(1).alias("far"))
    found = exact.unionByName(close).groupBy("name", "far").agg(F.countDistinct("label").alias("n"), F.min("label").alias("label"))
    best = found.groupBy("name").agg(F.min(F.struct("far", "n", "label")).alias("x")).select("name", "x.n", "x.label")
    decided = asked.select("name", "form").groupBy("name").agg(F.min("form").alias("form")).join(best, "name", "left")
    # one class: that one; none: weak spellings of one form belong together; several: undecided, each by itself
    weak_class = decided.select("name", F.when(F.col("n") == 1, F.col("label")).when(F.col("n").isNull(), F.concat(F.lit("w:"), "form")).otherwise(F.concat(F.lit("u:"), "name")).alias("class"))
    return ws.cut(strong.select("name", F.col("label").alias("class")).unionByName(weak_class), "classes")


def variants(git_info: DataFrame, author: str = "last_author", contributors: str = "contributors") -> DataFrame:
    """name_a, name_b (name_a < name_b): all pairs of different spellings of one person or organisation.

    Nulls, empty lists and null entries are left out; repeated rows count once.
    """
    names = git_info.select(git_info[author].alias("name")).unionByName(git_info.select(F.explode(git_info[contributors]).alias("name")))
    c = classes(names)
    return c.select(F.col("name").alias("name_a"), "class").join(c.select(F.col("name").alias("name_b"), "class"), "class").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
