"""Directed graphs as edge tables: layers, reachability, strong components, and findings on modules.

All are level-synchronous: a round is a few equi joins and combining aggregations over what is left of
the edges, written to the shared folder, and ends when nothing changes. Rounds follow the graph's depth,
not its size. A hub's edges meet a single row of the other side, so adaptive execution can split them,
and what is grouped by node is combined before it is shuffled.

Nulls and edges: edges with a null end are left out, parallel edges count once, and empty tables give
empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import discard, stored


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def _union(tables: list[DataFrame], like: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables, like.where("false"))


def _gathered(tables: list[DataFrame]) -> list[DataFrame]:
    """Tables of rounds, made one where there are many, so that plans stay small in deep graphs."""
    if len(tables) < 16:
        return tables
    one = stored(reduce(DataFrame.unionByName, tables), "gathered")
    discard(*tables)
    return [one]


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, layer), edges left): layer is the number of edges of the longest path to a node.

    Each round takes the nodes that no edge left leads to, and the edges that start there. Nodes on a
    cycle or behind one have no layer; their edges are left.
    """
    left = stored(_clean(edges), "edges")
    at = nodes.select("node").where("node is not null").distinct()
    done, layer = [], 0
    while True:
        free = stored(at.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("layer", F.lit(layer)), "layer")
        if free.isEmpty():
            discard(free)
            break
        done = [*_gathered(done), free]
        at = stored(left.select(F.col("dst").alias("node")).distinct(), "at")
        rest = stored(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "edges")
        discard(left)
        left, layer = rest, layer + 1
    return _union(done, at.select("node", F.lit(0).alias("layer"))), left


def reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the starts and all that edges lead to from them; each round goes on from new nodes only."""
    edges = _clean(edges)
    seen = stored(starts.select("node").where("node is not null").distinct(), "seen")
    done, front = [seen], seen
    while True:
        near = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = stored(reduce(lambda x, old: x.join(old, "node", "left_anti"), [_union(done, seen)], near), "seen")
        if front.isEmpty():
            discard(front)
            return _union(done, seen)
        # the last front is read by the next round
        done = [*_gathered(done), front]


def trim(edges: DataFrame) -> DataFrame:
    """Edges on cycles or between cycles: what peeling leaves from both ends."""
    ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    _, left = peel(ends(edges), edges)
    turned = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    _, left = peel(ends(turned), turned)
    return stored(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "cyclic")


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches it, itself included."""
    colours = stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
    while True:
        given = edges.join(colours.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("given"))
        now = stored(colours.join(given, "node", "left").select("node", F.least("colour", F.coalesce("given", "colour")).alias("colour"), (F.col("given") < F.col("colour")).alias("new")), "colour")
        changed = not now.where("new").isEmpty()
        discard(colours)
        colours = now
        if not changed:
            return now.select("node", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle: component is the least node of its strong component.

    Forward and backward: after trimming, every node takes the least node that reaches it as its colour;
    what reaches a colour's own node within the colour is that node's component. Components go, and the rest
    is trimmed again. Every round settles a component of each colour at once. An edge from a node to itself
    is a cycle; a component of one node without such an edge goes too, but has no row.
    """
    edges = stored(_clean(edges), "edges")
    loops = stored(edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")), "loops")
    done = []
    left = trim(edges.where("src <> dst"))
    while not left.isEmpty():
        colour = _least_reaching(left)
        of = lambda side: colour.select(F.col("node").alias(side), F.col("colour").alias(f"{side}_colour"))
        inner = left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour")
        back = reach(colour.where("node = colour").select("node"), inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = stored(back.join(colour, "node").select("node", F.col("colour").alias("component")), "component")
        done.append(found)
        gone = found.select("node")
        left = trim(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    parts = _union(done, loops)
    # a node between cycles that no lesser one reaches is alone in its component, and on no cycle
    several = parts.where("node <> component").select("component").distinct()
    return parts.join(several, "component", "left_semi").unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path to each node, cycles being broken for the ranking only.

    Nodes are numbered in the order in which they are written down. Within a strong component an edge that
    does not lead to a later node is set aside; edges between components never are. What is left has no
    cycle, so every node has a layer. Edges to or from what is no node are left out.
    """
    known = nodes.select("node").where("node is not null").distinct()
    edges = stored(_clean(edges).join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi"), "edges")
    parts = stored(strong_components(edges), "parts")
    of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))
    back = edges.where("src >= dst").join(of("src"), "src").join(of("dst"), "dst").where("src_part = dst_part").select("src", "dst")
    return peel(known, edges.join(back, ["src", "dst"], "left_anti"))[0]


def module_findings(modules: DataFrame) -> DataFrame:
    """(lesson, module_no, item, code, reference) for modules (lesson, module_no, id, requires array<string>).

    ``unresolved_reference`` for each required id that is no module of the lesson; ``graph_cycle`` for each
    module that requires itself, and once (null module) for a lesson whose other edges hold a cycle;
    ``orphan_module``, in lessons without such a cycle, for modules that no module without requirements
    leads to. ``module_no`` is unique over all lessons. Where a lesson has an id twice, the later module
    answers to it. A null list is an empty one.
    """
    modules = stored(modules.select("lesson", "module_no", "id", F.coalesce("requires", F.array().cast("array<string>")).alias("requires")), "modules")
    answers = modules.groupBy("lesson", F.col("id").alias("reference")).agg(F.max("module_no").alias("src"))
    asked = modules.select("lesson", "module_no", F.posexplode("requires").alias("item", "reference"))
    met = stored(asked.join(answers, ["lesson", "reference"], "left"), "met")
    finding = lambda d, code: d.select("lesson", "module_no", "item", F.lit(code).alias("code"), "reference")
    lost = finding(met.where("src is null"), "unresolved_reference")
    itself = finding(met.where("src = module_no"), "graph_cycle")
    edges = met.where("src <> module_no").select("lesson", "src", F.col("module_no").alias("dst"))
    nodes = modules.select(F.col("module_no").alias("node"))
    _, left = peel(nodes, edges)
    cyclic = stored(modules.join(left.select(F.col("dst").alias("module_no")).distinct(), "module_no", "left_semi").select("lesson").distinct(), "cyclic")
    none = lambda kind: F.lit(None).cast(kind)
    cycle = cyclic.select("lesson", none("bigint").alias("module_no"), none("int").alias("item"), F.lit("graph_cycle").alias("code"), none("string").alias("reference"))
    open_ = modules.join(cyclic, "lesson", "left_anti")
    reached = reach(open_.where(F.size("requires") == 0).select(F.col("module_no").alias("node")), edges.join(cyclic, "lesson", "left_anti"))
    orphans = open_.join(reached.withColumnRenamed("node", "module_no"), "module_no", "left_anti").select("lesson", "module_no", none("int").alias("item"), F.lit("orphan_module").alias("code"), none("string").alias("reference"))
    return lost.unionByName(itself).unionByName(cycle).unionByName(orphans)
