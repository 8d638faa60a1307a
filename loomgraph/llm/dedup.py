"""Duplicates hidden by formatting differences.

Method: Merkle-style bottom-up hashing.  A record is normalised from its leaves: a leaf
is a run of words (longest runs of letters and digits, letter case folded), a field is a
node of a name leaf and a value leaf, a record of fields is an unordered node whose
child digests are sorted, any other record is one leaf.  Records are grouped by the root
digest and, in the same grouping, by their whole normal form: equal digests of different
structures never meet.  Groups are pre-aggregated before the shuffle.  Rows find their
group's representative by a join in which the groups that hold a thousandth of all
records or more (so at most a thousand) are broadcast: their rows are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.workspace import Workspace

WORDS = r"[\p{L}\p{Nd}]+"
FIELD_MARKS = r"[,;|\r\n]+"
MIN_WORDS = 3
HOT_SHARE = 1000
#: A normal form above this length is never broadcast (a thousand of them stay below 64 MB).
HOT_LENGTH = 65_536


def words(x: Column) -> Column:
    """The words of a text, letter case folded (also that of letters with a longer upper case)."""
    return F.regexp_extract_all(F.lower(F.upper(x)), F.lit(WORDS), F.lit(0))


def normal_forms(rows: DataFrame, kinds: dict[str, bool], key: str, kind: str, text: str) -> DataFrame:
    """id, kind, digest, form of the records with at least three words; ``kinds`` tells which kinds are lists of fields."""
    r = rows.select(rows[key].alias("id"), rows[kind].alias("kind"), rows[text].alias("x")).filter(F.col("kind").isin(*kinds) & F.col("x").isNotNull())
    r = r.withColumn("words", words(F.col("x"))).filter(F.size("words") >= MIN_WORDS)

    def leaf(x: Column) -> Column:
        return F.array_join(words(x), " ")

    def field(x: Column) -> Column:
        at = F.instr(F.translate(x, "=", ":"), ":")
        return F.when(at > 0, F.concat(leaf(F.substring(x, F.lit(1), at - 1)), F.lit("\x01"), leaf(F.substring(x, at + 1, F.length(x))))).otherwise(F.concat(F.lit("\x01"), leaf(x)))

    fields = F.filter(F.transform(F.split("x", FIELD_MARKS), field), lambda f: f != "\x01")
    nodes = F.array_sort(F.transform(fields, lambda f: F.struct(F.xxhash64(f).alias("digest"), f.alias("form"))))
    listed = F.struct(F.xxhash64(F.transform(nodes, lambda n: n["digest"])).alias("digest"), F.array_join(F.transform(nodes, lambda n: n["form"]), "\x02").alias("form"))
    flat = F.array_join("words", " ")
    plain = F.struct(F.xxhash64(flat).alias("digest"), flat.alias("form"))
    is_list = F.col("kind").isin(*[k for k, v in kinds.items() if v])
    return r.select("id", "kind", F.when(is_list, listed).otherwise(plain).alias("n")).select("id", "kind", "n.digest", "n.form")


def records(rows: DataFrame, kinds: dict[str, bool], key: str = "triple_id", kind: str = "p", text: str = "o") -> DataFrame:
    """One row for each different record: keep_id (its smallest key), kind, copies.

    Records are the non-null texts with at least three words of the asked kinds.  Two are
    the same if they are of one kind and have the same words in the same order or, where
    ``kinds[kind]``, the same fields in any order (a repeated field counts as often as it
    stands).  Other columns are ignored; an empty table gives no rows.
    """
    forms = normal_forms(rows, kinds, key, kind, text)
    return forms.groupBy("kind", "digest", "form").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).select("keep_id", "kind", "copies")


def duplicates(rows: DataFrame, kinds: dict[str, bool], key: str = "triple_id", kind: str = "p", text: str = "o") -> DataFrame:
    """keep_id, dup_id: a row for each copy of a record besides the one with the smallest key.

    Keys are expected to be unique; rows that repeat the smallest key are not copies of themselves.
    """
    ws = Workspace(rows.sparkSession)
    forms = ws.cut(normal_forms(rows, kinds, key, kind, text), "forms")
    same = ["kind", "digest", "form"]
    groups = ws.cut(forms.groupBy(*same).agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).filter(F.col("copies") > 1), "groups")
    total = forms.count()
    hot = (F.col("copies") * HOT_SHARE >= total) & (F.length("form") <= HOT_LENGTH)
    by_hot = forms.join(F.broadcast(groups.filter(hot).select(*same, F.col("keep_id").alias("hot_id"))), same, "left")
    cold = by_hot.filter(F.col("hot_id").isNull()).drop("hot_id").join(groups.filter(~hot).select(*same, "keep_id"), same)
    pairs = by_hot.filter(F.col("hot_id").isNotNull()).select(F.col("hot_id").alias("keep_id"), "id").unionByName(cold.select("keep_id", "id"))
    return pairs.filter(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("dup_id"))
