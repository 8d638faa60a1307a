"""Parent-child rows to full hierarchies.

Method: bottom-up leaf peeling.  Every round removes all leaves; each leaf sends
its subtree size to its parent.  Removing leaves alone needs as many rounds as the
tallest tree has levels, so a round also takes out single-child nodes whose random
key is a local maximum and lets their child hang on their parent ("rake and
compress"): chains shrink by a constant factor a round and the number of rounds is
logarithmic in the number of nodes whatever the shape.  The removed nodes form the
peel log; read backwards it assigns every node its root, depth and path from a
parent that already has them.  What can't be peeled is a node that has become its
own parent: those nodes stand for the cycles, and all that hangs on them never
reaches a root.

All tables are keyed by node.  A node with very many children appears in the rounds up
as a pre-aggregated count, and a spliced node is met by its only child's key; on the way
down the parents with more than a thousandth of all links (a thousand of them at most)
are joined by broadcast, so their children are not shuffled to one task.  Descendants
are given as rows (ancestor, node, distance), never as one list in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.workspace import Workspace

CYCLE_DEPTH = -1
CYCLE_ROOT = ""
#: A parent with more than this share of all links is joined by broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def edges_from_triples(triples: DataFrame) -> DataFrame:
    """Distinct (parent, child) of ``contains`` and ``partOf`` triples.

    Rows with a null end are left out; repeated and doubly stated links count once.
    """
    down = F.col("p") == "contains"
    return (
        triples.filter(F.col("p").isin("contains", "partOf") & F.col("s").isNotNull() & F.col("o").isNotNull())
        .select(F.when(down, F.col("s")).otherwise(F.col("o")).alias("parent"), F.when(down, F.col("o")).otherwise(F.col("s")).alias("child"))
        .distinct()
    )


def dropped_links(links: DataFrame) -> DataFrame:
    """node, parent: the links left out because the node has a smaller parent too; none in a forest."""
    several = links.groupBy("node").agg(F.min("parent").alias("kept"), F.max("parent").alias("last")).filter("kept < last")
    return links.join(several, "node").filter("parent <> kept").select("node", "parent").distinct()


def _key(col: Column) -> Column:
    """Another random order each round; the round is a column, so all rounds run the same compiled code."""
    return F.xxhash64(col, F.col("round"))


class Hierarchy:
    """Peels the links once; the results are DataFrames over the written peel log.

    ``edges`` has columns ``parent`` and ``child`` (strings).  Null ends are ignored,
    repeated links count once.  If a node is given several parents, the smallest
    one (in string order) is kept and the other links are the rows of ``dropped``
    (node, parent), so no link is lost unsaid.  No links: no rows.

    nodes: node, root, depth, subtree_size [, path].  ``depth`` is the number of links
    up to the root, ``path`` an array from the root to the node.  A node whose chain
    of parents never ends has root '', depth -1, a null path and a null size.
    """

    def __init__(self, edges: DataFrame, paths: bool = True, sizes: bool = True):
        self.paths, self.sizes = paths, sizes
        self.ws = Workspace(edges.sparkSession)
        self.links = edges.filter(F.col("parent").isNotNull() & F.col("child").isNotNull()).select(F.col("child").alias("node"), "parent")
        self.hot: list[str] = []
        self.nodes = self._run()

    @property
    def dropped(self) -> DataFrame:
        return dropped_links(self.links)

    # -- bottom up -----------------------------------------------------------------

    def _run(self) -> DataFrame:
        ws, links = self.ws, self.links
        # one shuffle on the node gives every node its parent (null for a root)
        active = (
            links.unionByName(links.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
            .groupBy("node").agg(F.min("parent").alias("parent"))
            .withColumn("w", F.lit(1).cast("bigint")).withColumn("round", F.lit(1))
        )
        if self.paths:  # names between this node's present parent (left out) and the node
            active = active.withColumn("seg", F.array("node"))
        if self.sizes:  # acc: size of what was peeled below; extra: of spliced nodes above
            active = active.withColumn("acc", F.lit(1).cast("bigint")).withColumn("extra", F.lit(0).cast("bigint"))
        active = ws.cut(active, "active")
        least = active.count() * HOT_SHARE
        self.hot = [r[0] for r in active.filter("parent is not null").groupBy("parent").count().filter(F.col("count") > least).select("parent").collect()]
        log: list[DataFrame] = []
        rest = active
        while True:
            log.append(ws.cut(self._peel(rest), "marked"))
            rest = self._rest(log[-1])
            # an open node is one that still has a parent other than itself
            if log[-1].filter((F.col("what") == 0) & F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))).isEmpty():
                break
        ws.drop(active)
        return self._down(rest, log)

    def _peel(self, active: DataFrame) -> DataFrame:
        """Adds ``what``: 0 stays, 1 leaf, 2 spliced out (``kid``: its only child)."""
        aggs = [F.count("*").alias("kids"), F.min("node").alias("kid")]
        kids = active.filter(F.col("parent").isNotNull()).groupBy("parent").agg(*aggs)
        a = active.join(kids.withColumnRenamed("parent", "node"), "node", "left")
        inner = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
        mine = _key(F.col("node"))
        chain = inner & (F.col("kids") == 1) & (F.col("kid") != F.col("node")) & (mine > _key(F.col("kid"))) & (mine > _key(F.col("parent")))
        what = F.when(inner & F.col("kids").isNull(), 1).when(chain, 2).otherwise(0)
        return a.withColumn("what", what).drop("kids")

    def _rest(self, marked: DataFrame) -> DataFrame:
        """What is left after a round, hung on the spliced nodes' parents."""
        cols = ["node", "parent", "w", "round"] + ["seg"] * self.paths + ["acc", "extra"] * self.sizes
        stay = marked.filter(F.col("what") == 0).select(*cols)
        out = marked.filter(F.col("what") == 2).select(
            F.col("kid").alias("v"), F.col("parent").alias("up"), F.col("w").alias("vw"),
            *([F.col("seg").alias("vseg")] if self.paths else []),
            *([(F.col("acc") + F.col("extra")).alias("vacc")] if self.sizes else []),
        )
        j = stay.join(out, stay["node"] == out["v"], "left")
        hung = F.col("v").isNotNull()
        keep = [
            F.col("node"), F.when(hung, F.col("up")).otherwise(F.col("parent")).alias("parent"),
            F.when(hung, F.col("w") + F.col("vw")).otherwise(F.col("w")).alias("w"), (F.col("round") + 1).alias("round"),
        ]
        if self.paths:
            keep.append(F.when(hung, F.concat("vseg", "seg")).otherwise(F.col("seg")).alias("seg"))
        if not self.sizes:
            return j.select(*keep)
        j = j.select(*keep, "acc", F.when(hung, F.col("extra") + F.col("vacc")).otherwise(F.col("extra")).alias("extra"))
        # leaves send their size (and that of the nodes spliced out above them) upwards
        sent = marked.filter(F.col("what") == 1)
        target = marked.filter(F.col("what") == 2).select(F.col("kid").alias("v"), F.col("parent").alias("up"), (F.col("acc") + F.col("extra")).alias("vacc"))
        s = sent.join(target, sent["node"] == target["v"], "left")
        s = s.groupBy(F.coalesce("up", "parent").alias("node")).agg(F.sum(F.col("acc") + F.col("extra") + F.coalesce("vacc", F.lit(0))).alias("got"))
        return j.join(s, "node", "left").withColumn("acc", F.col("acc") + F.coalesce("got", F.lit(0))).drop("got")

    # -- top down ------------------------------------------------------------------

    def _down(self, left: DataFrame, log: list[DataFrame]) -> DataFrame:
        ws = self.ws
        loop = F.col("parent").isNotNull()
        first = [
            F.col("node"), F.when(loop, F.lit(CYCLE_ROOT)).otherwise(F.col("node")).alias("root"),
            F.when(loop, F.lit(CYCLE_DEPTH)).otherwise(F.lit(0)).cast("bigint").alias("depth"),
        ]
        if self.paths:
            first.append(F.when(~loop, F.array("node")).alias("path"))
        if self.sizes:
            first.append(F.when(~loop, F.col("acc")).alias("subtree_size"))
        # each round's nodes are written once and never again; a round reads those of all rounds before it in one scan
        parts = [ws.cut(left.select(*first), "done")]
        for marked in reversed(log):
            done = ws.together(parts)
            spliced = self._attach(self._sized(marked, done), done)
            leaves = marked.filter(F.col("what") == 1)
            if self.sizes:
                leaves = leaves.withColumn("size", F.col("acc"))
            parts.append(ws.cut(spliced.unionByName(self._attach(leaves, done.unionByName(spliced))), "done"))
            ws.drop(marked)
        return ws.together(parts)

    def _sized(self, marked: DataFrame, done: DataFrame) -> DataFrame:
        """The spliced nodes; size: of the only child (a leaf of this round or done before), what was spliced between, and its own."""
        spliced = marked.filter(F.col("what") == 2)
        if not self.sizes:
            return spliced
        kids = marked.select(F.col("node").alias("kid"), F.col("extra").alias("kextra"), F.when(F.col("what") == 1, F.col("acc")).alias("kacc"))
        known = done.select(F.col("node").alias("kid"), F.col("subtree_size").alias("ksize"))
        return spliced.join(kids, "kid").join(known, "kid", "left").withColumn("size", F.col("acc") + F.col("kextra") + F.coalesce("kacc", "ksize"))

    def _attach(self, peeled: DataFrame, done: DataFrame) -> DataFrame:
        """Root, depth and path of peeled nodes from those of their parents."""
        up = done.select(F.col("node").alias("up"), F.col("root").alias("uroot"), F.col("depth").alias("udepth"), *([F.col("path").alias("upath")] if self.paths else []))
        j = self._met(peeled, up)
        lost = F.col("udepth") < 0
        cols = [F.col("node"), F.col("uroot").alias("root"), F.when(lost, F.lit(CYCLE_DEPTH)).otherwise(F.col("udepth") + F.col("w")).cast("bigint").alias("depth")]
        if self.paths:
            cols.append(F.when(~lost, F.concat("upath", "seg")).alias("path"))
        if self.sizes:
            cols.append(F.when(~lost, F.col("size")).alias("subtree_size"))
        return j.select(*cols)

    def _met(self, peeled: DataFrame, up: DataFrame) -> DataFrame:
        """``peeled`` joined to its parents' rows; children of a hot parent stay where they are."""
        if not self.hot:
            return peeled.join(up, peeled["parent"] == up["up"])
        hot, above = peeled["parent"].isin(self.hot), up["up"].isin(self.hot)
        few = F.broadcast(up.filter(above))  # at most 1 / HOT_SHARE rows
        rest = peeled.filter(~hot)
        return rest.join(up, rest["parent"] == up["up"]).unionByName(peeled.filter(hot).join(few, F.col("parent") == F.col("up")))

    # -- results -------------------------------------------------------------------

    def descendants(self) -> DataFrame:
        """ancestor, node, distance: one row for each node and each of its ancestors.

        Each path is taken apart where it lies; no shuffle, no lists by ancestor.
        Nodes on or below a cycle have no rows.
        """
        if not self.paths:
            raise ValueError("descendants need paths=True")
        return self.nodes.filter(F.col("depth") > 0).select(F.posexplode(F.slice("path", 1, F.col("depth").cast("int"))).alias("at", "ancestor"), "node", "depth").select(
            "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance")
        )
