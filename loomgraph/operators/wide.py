"""Attribute-value rows into wide tables.

Method: one pass parses every value by its attribute's type and pre-aggregates the
rows of a cell (entity, attribute) before they are shuffled, so an entity or a cell
that holds a third of all rows costs one row a task.  The cells are written once,
partitioned by attribute: each attribute is a typed narrow table that is read
without the others.  The narrow tables are combined by one multiway full outer join on
the entity.  Spark forgets the partitioning of a full outer join's result, so a tree of
two-way joins shuffles every level again; here all narrow tables meet in a single
exchange by entity, the rows of an entity side by side (a cell is one row, so an entity
has at most as many rows as there are attributes), and are merged into one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.values import to_bigint, to_boolean, to_instant, to_text
from loomgraph.workspace import Workspace

TYPES = ("string", "bigint", "timestamp", "boolean")


def cells(rows: DataFrame, attributes: dict[str, str], entity: str = "s", attribute: str = "p", value: str = "o") -> DataFrame:
    """One row for each cell: entity, attribute, n (non-null values), ok (those that denote something), least and greatest value."""
    def names(kind: str) -> list[str]:
        return [a for a, t in attributes.items() if t == kind]

    e, a, v = rows[entity], rows[attribute], rows[value]
    kept = rows.filter(a.isin(*attributes) & e.isNotNull()).select(e.alias("entity"), a.alias("attribute"), v.alias("v"))
    a, v = F.col("attribute"), F.col("v")
    number: Column = F.lit(None).cast("bigint")
    for kind, parse in (("bigint", to_bigint), ("timestamp", to_instant), ("boolean", to_boolean)):
        if names(kind):
            number = F.when(a.isin(*names(kind)), parse(v)).otherwise(number)
    text = F.when(a.isin(*names("string")), to_text(v)) if names("string") else F.lit(None).cast("string")
    typed = kept.select("entity", "attribute", "v", number.alias("num"), text.alias("txt"))
    return typed.groupBy("entity", "attribute").agg(
        F.count("v").alias("n"), (F.count("num") + F.count("txt")).alias("ok"),
        F.min("num").alias("num"), F.max("num").alias("num_hi"), F.min("txt").alias("txt"), F.max("txt").alias("txt_hi"),
    )


def wide_table(rows: DataFrame, attributes: dict[str, str], entity: str = "s", attribute: str = "p", value: str = "o") -> DataFrame:
    """One row per entity with one typed column per attribute, and ``uncertain``.

    ``attributes`` maps an attribute to string, bigint, timestamp or boolean (it is the
    schema of the result, so it is small and known).  A cell has a value if all its
    non-null values denote one and the same; else it is null and, if it had any
    non-null value, its attribute stands in the array ``uncertain`` (in the order of
    ``attributes``).  Rows with a null entity and attributes not asked for are left out;
    an entity whose values are all null has a row of nulls.  Other columns of ``rows``
    are ignored.  An attribute column whose name is taken gets the suffix ``_value``.
    """
    if not attributes or any(t not in TYPES for t in attributes.values()):
        raise ValueError(f"attributes need a type of {TYPES}")
    ws = Workspace(rows.sparkSession)
    path = f"{ws.root}/cells"
    c = cells(rows, attributes, entity, attribute, value)
    certain = (F.col("ok") == F.col("n")) & (F.col("n") > 0) & F.coalesce(F.col("num") == F.col("num_hi"), F.col("txt") == F.col("txt_hi"), F.lit(False))
    index = F.lit(-1)
    for i, a in enumerate(attributes):
        index = F.when(F.col("attribute") == a, i).otherwise(index)
    c.select("entity", F.when(certain, F.col("num")).alias("num"), F.when(certain, F.col("txt")).alias("txt"), ((F.col("n") > 0) & ~certain).alias("bad"), index.alias("i")).write.partitionBy("i").parquet(path)
    stored = rows.sparkSession.read.schema("entity string, num bigint, txt string, bad boolean, i int").parquet(path)

    kinds = list(attributes.values())

    def narrow(i: int) -> DataFrame:
        """The typed table of one attribute, beside empty columns for the others'."""
        num = F.col("num")
        v = {"string": F.col("txt"), "bigint": num, "timestamp": F.timestamp_micros(num), "boolean": num == 1}
        row = ["entity"]
        for k, kind in enumerate(kinds):
            row += [v[kind].alias(f"c{k}"), F.col("bad").alias(f"b{k}")] if k == i else [F.lit(None).cast(kind).alias(f"c{k}"), F.lit(None).cast("boolean").alias(f"b{k}")]
        return stored.filter(F.col("i") == i).select(*row)

    tables = reduce(DataFrame.unionByName, [narrow(i) for i in range(len(kinds))])
    merged = tables.groupBy("entity").agg(*[F.max(f"{x}{i}").alias(f"{x}{i}") for i in range(len(kinds)) for x in "cb"])
    taken, columns = {entity.lower(), "uncertain"}, []
    for i, a in enumerate(attributes):
        name = a
        while name.lower() in taken:
            name += "_value"
        taken.add(name.lower())
        columns.append(F.col(f"c{i}").alias(name))
    bad = F.array_compact(F.array(*[F.when(F.col(f"b{i}"), F.lit(a)) for i, a in enumerate(attributes)]))
    return merged.select(F.col("entity").alias(entity), *columns, bad.alias("uncertain"))
