"""Components over candidate cells without making all pairs of a cell.

A cell is a set of nodes among which every pair is a candidate. In each round every active cell, one with nodes of
different components, picks one component by a hash and one node of it as a partner for its other nodes, and each node is compared with
one of the partners that its cells name: at most one pair a node. What is linked falls together, so a dense group of near copies costs one
or two pairs a node. When about as many pairs of components are left as there are rows (FEW, after two rounds SOME times), or a round links nothing, all
that is left is compared: pairs of different components in one cell that haven't been compared yet. No link is lost.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds by one node of a cell at most; what they leave is compared whole.
ROUNDS, FEW, SOME = 6, 2, 32


def _labelled(cells: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return cells.withColumn("comp", F.col("node"))
    return cells.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def components(cells: DataFrame, verify, candidates=None, known: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable, of every node with a link.

    cells has (s, node, and columns that candidates uses), verify takes distinct pairs (u, v) and gives those that are links, candidates takes
    aliases a, b of cells and gives a condition that all links of a cell fulfil, known has links (u, v) to begin with.
    """
    kept = [c for c in cells.columns if c not in ("s", "node")]
    pick = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "comp").alias("h"), "comp", "node", *kept))
    links, labels, tried, left = known, None, None, None
    if known is not None:
        links = common.materialise(known.select("u", "v"), "links")
        labels = common.materialise(common.connected_components(links), "labels")
    for i in range(ROUNDS + 1):
        now = _labelled(cells, labels)
        kinds = now.groupBy("s", "comp").agg(F.count("*").alias("n"), pick(i).alias("p"))
        active = kinds.groupBy("s").agg(F.min("p").alias("p"), F.sum("n").alias("n"), F.count("*").alias("many")).where("many > 1")
        active = common.materialise(active, "active")
        size = active.agg(F.sum("n"), F.sum(F.col("n") * F.col("n") * (1 - 1 / F.col("many"))) / 2).first()
        if not size[0]:
            common.release(active)
            break
        rest = i == ROUNDS or left == 0 or size[1] <= (FEW if i < 2 else SOME) * size[0]
        if rest:
            mine = now.join(active.select("s"), "s", "left_semi")
            a, b = mine.alias("a"), mine.alias("b")
            fits = (F.col("a.s") == F.col("b.s")) & (F.col("a.comp") != F.col("b.comp")) & (F.col("a.node") > F.col("b.node"))
            pairs = a.join(b, fits & candidates("a", "b") if candidates else fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        else:
            a, b = now.alias("a"), active.select("s", "p.*").alias("b")
            fits = (F.col("a.s") == F.col("b.s")) & (F.col("a.comp") != F.col("b.comp"))
            named = a.join(b, fits & candidates("a", "b") if candidates else fits).select(F.col("a.node"), F.col("b.h"), F.col("b.node").alias("partner"))
            pairs = named.groupBy("node").agg(F.min(F.struct("h", "partner")).alias("p")).select(F.greatest("node", "p.partner").alias("u"), F.least("node", "p.partner").alias("v"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = common.materialise(pairs, "pairs")
        found = common.materialise(verify(pairs).select("u", "v"), "links")
        left = found.count()
        common.release(active)
        common.drop_finished_shuffles(cells.sparkSession)
        tried = pairs if tried is None else tried.union(pairs)
        if left:
            links = found if links is None else links.union(found)
            if labels is not None:
                common.release(labels)
            labels = common.materialise(common.connected_components(links), "labels")
        if rest:
            break
    return labels if labels is not None else cells.select("node", F.col("node").alias("component")).limit(0)
