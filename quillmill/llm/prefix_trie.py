"""A trie of conversations by their turns (operator 13).

Conversations that begin with the same turns (role and text) share the nodes of those turns; the root
is shared by all. Conversations that are equal throughout are one sequence with a number of copies: equal
sequences are found by their length and two sums of 64-bit hashes of (place, turn), so nothing is collected.

Sequences are dealt by the digest of their first turn. The tries of a task are dictionaries of pointers
built in ``applyInPandas`` and read by a postorder without recursion. A first turn whose sequences have
more than ``TRIE_ROWS`` turns together is split: the turns that all its sequences share become a chain
of nodes, made by aggregation, and the sequences are dealt anew by the next turn, until what is left
fits. Sums over subtrees then go up the chains, the deepest first. A chain may be as long as the longest
conversation: it is summed in blocks.

Nulls and edges: turns are ordered by turn (nulls first), equal turns by role and digest of the text; a
null role or text is empty; rows without a conversation take no part. Repeated rows are turns of their own.
An empty table has no nodes, not even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .turns import before, digests, ordered

#: Turns that one task holds in a trie; groups of tries are dealt by hash, so a task has a few times as many.
TRIE_ROWS = 50_000
NODE = "grp string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long"
#: Turns of another conversation that one may begin with.
MOST_HEAD = 8


def numbered_turns(rows: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, d, bytes): the turns numbered from 1, with a digest and the text's UTF-8 length."""
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    d = F.md5(F.concat(F.length(value(role)).cast("string"), F.lit(":"), value(role), value(text)))
    own = rows.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), value(role).alias("role"), d.alias("d"), F.octet_length(value(text)).cast("long").alias("bytes"))
    out = before(ordered(own, "conv_id", ["turn", "role", "d"], scratch), "conv_id", "id", F.lit(1), "n")
    return scratch.cut(out.select("conv_id", (F.col("n") + 1).cast("int").alias("depth"), "d", "bytes"))


def head_of(conv_id):
    """How many turns of its group's first conversation a conversation begins with."""
    return (F.crc32(F.col(conv_id).cast("string")) % (MOST_HEAD + 1)).cast("int")


def shared_heads(turns: DataFrame, scratch: Scratch, group: int = 5) -> DataFrame:
    """The turns of every conversation c, its first h = ``head_of(c)`` turns being those of c - c mod
    ``group`` (all, if fewer; none, if there is no such conversation)."""
    convs = turns.select("conv_id").distinct()
    first = turns.where(F.col("depth") <= MOST_HEAD).where(F.pmod("conv_id", F.lit(group)) == 0)
    heads = first.withColumn("conv_id", F.explode(F.array(*[F.col("conv_id") + k for k in range(group)]))).where(F.col("depth") <= head_of("conv_id")).join(convs, "conv_id", "left_semi")
    heads = scratch.cut(heads)
    n = heads.groupBy("conv_id").agg(F.count("*").cast("int").alias("n_head"))
    own = turns.where(F.col("depth") > head_of("conv_id")).join(n, "conv_id", "left")
    own = own.withColumn("depth", F.col("depth") - head_of("conv_id") + F.coalesce("n_head", F.lit(0))).drop("n_head")
    return scratch.cut(heads.unionByName(own))


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n, s1, s2) of every conversation of ``convs``: equal for equal sequences of turns."""
    sums = [F.sum(F.xxhash64(F.lit(k), "depth", "d").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    own = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), *sums)
    zero = F.lit(0).cast("decimal(38,0)")
    return convs.join(own, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s1", zero).alias("s1"), F.coalesce("s2", zero).alias("s2"))


def build(rows: list[tuple], out: list[tuple]) -> None:
    """Nodes of the tries of ``rows`` (grp, parent, conv_id, copies, n, depth, d, bytes), sorted by group,
    conversation and depth; each group's rows begin at one depth, with one turn."""
    children: list[dict[str, int]] = []
    grp, parent, depth, low, size, own, end = [], [], [], [], [], [], []
    over: list[int | None] = []  # the conversation above a group's top
    tops: list[int] = []
    last, at, top_of = None, -1, {}
    for g, above, conv, copies, n, level, d, length in rows:
        if (g, conv) != last:
            last, at = (g, conv), -1
        known = top_of if at < 0 else children[at]
        key = g if at < 0 else d
        node = known.get(key)
        if node is None:
            node = known[key] = len(children)
            children.append({})
            grp.append(g)
            parent.append(at)
            over.append(above if at < 0 else None)
            depth.append(level)
            low.append(conv)
            size.append(0)
            own.append(length)
            end.append(None)
            if at < 0:
                tops.append(node)
        low[node] = min(low[node], conv)
        size[node] += copies
        if n == level:
            end[node] = conv
        at = node
    leaves, saved = [0] * len(children), [0] * len(children)
    for top in tops:
        stack = [(top, iter(children[top].values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(children[child].values())))
                continue
            stack.pop()
            below = children[node].values()
            leaves[node] = sum(leaves[c] for c in below) or 1
            saved[node] = (size[node] - 1) * own[node] + sum(saved[c] for c in below)
    for i in range(len(children)):
        above = over[i] if parent[i] < 0 else low[parent[i]]
        out.append((grp[i], low[i], depth[i], above, size[i], len(children[i]), leaves[i], saved[i], end[i]))


def tries(rows: DataFrame, tasks: int) -> DataFrame:
    """Nodes (``NODE``) of the groups of ``rows``, many groups to a task."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["grp", "conv_id", "depth"], kind="stable")
        out: list[tuple] = []
        build(list(pdf[["grp", "parent", "conv_id", "copies", "n", "depth", "d", "bytes"]].itertuples(index=False, name=None)), out)
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in NODE.split(", ")])
        return frame.astype({"end_rep": "Int64", "parent_conv_id": "Int64"})

    return rows.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks))).groupBy("task").applyInPandas(run, NODE)


def chains(live: DataFrame, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(chain nodes, the groups below) of groups that are too large for one trie.

    ``live`` has the sequences (grp, top, parent, conv_id, copies, n), ``rows`` their turns from ``top``
    on. A chain holds the turns from ``top`` to the last that all sequences of the group share.
    """
    groups = live.groupBy("grp", "top", "parent").agg(F.count("*").alias("n_seq"), F.sum("copies").alias("n_convs"), F.min("conv_id").alias("low"))
    levels = rows.groupBy("grp", "depth").agg(F.count("*").alias("k"), F.min("d").alias("a"), F.max("d").alias("b"), F.max("bytes").alias("bytes"))
    levels = scratch.cut(levels.join(groups, "grp").withColumn("shared", (F.col("k") == F.col("n_seq")) & (F.col("a") == F.col("b"))))
    stop = levels.groupBy("grp").agg(F.coalesce(F.min(F.when(~F.col("shared"), F.col("depth"))), F.max("depth") + 1).alias("stop"))
    nodes = scratch.cut(levels.join(stop, "grp").where("depth < stop").select("grp", "depth", "bytes", "top", "parent", "n_convs", "low", (F.col("stop") - 1).alias("bottom")))
    bottoms = nodes.where("depth = bottom").select("grp", "bottom", "low")
    nxt = rows.join(bottoms, "grp").where(F.col("depth") == F.col("bottom") + 1).select("conv_id", F.md5(F.concat("grp", "d")).alias("below"), F.col("grp").alias("above"), F.col("depth").alias("next_top"), F.col("low").alias("next_parent"))
    child = live.join(nxt, "conv_id").select(F.col("below").alias("grp"), F.col("next_top").alias("top"), F.col("next_parent").alias("parent"), "conv_id", "copies", "n", "above")
    ended = live.join(bottoms.select("grp", "bottom"), "grp").where("n = bottom").select("grp", F.col("conv_id").alias("end_rep"))
    return nodes.join(ended, "grp", "left"), child


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` are (conv_id, depth, d, bytes) with depths from 1 on without gaps, ``convs`` all conversations
    (conv_id), with or without turns.
    """
    spark = turns.sparkSession
    seq = scratch.cut(sequences(turns, convs))
    same = ["n", "s1", "s2"]
    kinds = scratch.cut(seq.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")))
    # written, so that the number of tasks follows its size and not an estimate of the join
    members = scratch.cut(seq.join(kinds, same).select("rep", "conv_id", F.col("conv_id").cast("string").alias("id")))
    ends = digests(members, "rep", ["conv_id"], "id", ",", "ends_sha256")

    first = turns.where("depth = 1").select("conv_id", F.col("d").alias("grp"))
    reps = kinds.select(F.col("rep").alias("conv_id"), "copies", "n")
    lowest = seq.agg(F.min("conv_id")).first()[0]
    if lowest is None:
        return spark.createDataFrame([], "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    child = reps.join(first, "conv_id").select("grp", F.lit(1).alias("top"), F.lit(lowest).cast("long").alias("parent"), "conv_id", "copies", "n", F.lit("").alias("above"))
    done, spines, level = [], [], 0
    while True:
        live = scratch.cut(child)
        size = F.sum(F.col("n") - F.col("top") + 1).alias("size")
        sizes = scratch.cut(live.groupBy("grp", "above").agg(size))
        total, large = sizes.agg(F.sum("size"), F.count_if(F.col("size") > trie_rows)).first()
        if not total:
            break
        of = lambda part: live.join(sizes.where(part).select("grp"), "grp", "left_semi")
        turns_of = lambda x: turns.join(x.drop("above"), "conv_id").where("depth >= top")
        if total and large < sizes.count():
            small = turns_of(of(f"size <= {trie_rows}"))
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // trie_rows))
            nodes = scratch.cut(tries(small, tasks))
            done.append(nodes)
            tops = nodes.join(sizes.select("grp", "above"), "grp").join(live.select("grp", "top").distinct(), "grp").where("depth = top").select("above", "n_leaves", "saved_tokens")
        else:
            tops = None
        spine = None
        if large:
            rest = scratch.cut(of(f"size > {trie_rows}").drop("above"))
            spine, child = chains(rest, scratch.cut(turns_of(rest)), scratch)
            spine = scratch.cut(spine.join(sizes.select("grp", "above"), "grp"))
        spines.append((spine, tops))
        level += 1
        if not large:
            break
    below = None  # (above, n_leaves, saved_tokens) of the tops of the level under the one at hand
    for spine, tops in reversed(spines):
        if spine is not None:
            none = spark.createDataFrame([], "above string, n_leaves long, saved_tokens long")
            under = (below or none).groupBy(F.col("above").alias("grp")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            own = before(spine.withColumn("back", -F.col("depth")), "grp", "back", (F.col("n_convs") - 1) * F.col("bytes"), "deeper")
            at_bottom = F.col("depth") == F.col("bottom")
            full = own.join(under, "grp", "left").select(
                "grp", F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"), "n_convs",
                F.when(at_bottom, F.coalesce("k", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("bytes") + F.col("deeper") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), F.when(at_bottom, F.col("end_rep")).alias("end_rep"), "above", "top",
            )
            full = scratch.cut(full)
            done.append(full.drop("above", "top"))
            heads = full.where("depth = top").select("above", "n_leaves", "saved_tokens")
            tops = heads if tops is None else tops.unionByName(heads)
        below = tops
    root = kinds.agg(F.sum("copies").alias("n_convs"), F.min(F.when(F.col("n") == 0, F.col("rep"))).alias("end_rep"))
    sums = (below if below is not None else spark.createDataFrame([], "n_leaves long, saved_tokens long")).agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    # both sides are one row
    root = root.join(F.broadcast(sums)).select(F.lit("").alias("grp"), F.lit(lowest).cast("long").alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep")
    nodes = root
    for x in done:
        nodes = nodes.unionByName(x)
    nothing = F.sha2(F.lit(""), 256)
    return nodes.join(ends.withColumnRenamed("rep", "end_rep"), "end_rep", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
