"""Capture: items to stored records, as a plan of rows and a commit.

``plan_captures`` decides in one batch what each item is, whether its source is held already and
which name it gets; ``commit_captures`` writes the planned files, each only if it does not exist.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import NAME_ATTEMPTS, SLUG_LENGTH
from ..functions.text import SPACE, let, local_timestamp, slug, stamp, trim, yaml_quoted
from ..functions.urls import normalize_url, source_id
from .stored import stored


def identify(items: DataFrame) -> DataFrame:
    """Adds kind (text, source or refused), source_id and reason to items(item, …)."""
    def known(u):
        kind = F.when(u.isNull(), "text").when(u["ok"], "source").when(u["code"] == "not-a-url", "text").otherwise("refused")
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "source", source_id(u)).alias("source_id"), F.when(k == "refused", u["reason"]).alias("reason")))

    url = let(trim(F.col("item")), lambda t: F.when(~t.rlike(SPACE), normalize_url(t)))
    d = items.withColumn("_k", let(url, known))
    return d.withColumns({c: F.col("_k").getField(c) for c in ("kind", "source_id", "reason")}).drop("_k")


def plan_captures(items: DataFrame, held: DataFrame, taken: DataFrame) -> DataFrame:
    """items(item_no, item, at) to (item_no, action, folder, name, id, content, reason).

    ``held`` is (source_id) of stored sources, ``taken`` (folder, name) of files that exist. A source
    held already, or captured earlier in the batch, is a duplicate and writes nothing. Equal names
    get -2, -3, … past what is taken, up to NAME_ATTEMPTS.
    """
    d = identify(items)
    held = held.select("source_id", F.lit(True).alias("_held")).distinct()
    # only sources meet in windows; texts have no source
    first = Window.partitionBy("source_id").orderBy("item_no")
    sources = d.where("kind = 'source'").join(held, "source_id", "left").withColumn("again", F.col("_held").isNotNull() | (F.row_number().over(first) > 1)).drop("_held")
    d = sources.unionByName(d.where("kind <> 'source'").withColumn("again", F.lit(False)))
    d = d.withColumn("action", F.when(F.col("kind") == "refused", "refuse").when(F.col("again"), "duplicate").otherwise("write"))
    # an inbox file is named by its moment and its words, a source by its id
    inbox = F.concat(stamp(F.col("at")), F.lit("-"), slug(F.col("item"), SLUG_LENGTH))
    d = d.withColumns({"folder": F.when(F.col("kind") == "source", "sources").otherwise("inbox"), "base": F.when(F.col("kind") == "source", F.col("source_id")).otherwise(inbox)})
    # identity and names are made once; what follows reads the columns it needs
    d = stored(d, "captures")
    order = Window.partitionBy("folder", "base").orderBy("item_no")
    writes = d.where("action = 'write'").withColumn("turn", F.row_number().over(order))
    numbered = lambda k: F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), k.cast("string")))
    # names that exist may stand in the way of a base: their own, or what is before their number
    stem = F.regexp_extract("name", r"^(.*)-([0-9]+)$", 1)
    ways = taken.select("folder", F.explode(F.array(F.col("name"), stem)).alias("base")).distinct()
    contested = writes.select("folder", "base").distinct().join(ways, ["folder", "base"], "left_semi")
    # candidates only for those: the turn-th free one is its own
    tries = contested.select("*", F.explode(F.sequence(F.lit(1), F.lit(NAME_ATTEMPTS))).alias("k")).withColumn("name", numbered(F.col("k")))
    open_ = tries.join(taken.select("folder", "name"), ["folder", "name"], "left_anti").withColumn("turn", F.row_number().over(Window.partitionBy("folder", "base").orderBy("k")))
    named = writes.join(contested.withColumn("contested", F.lit(True)), ["folder", "base"], "left").join(open_.select("folder", "base", "turn", F.col("name").alias("free")), ["folder", "base", "turn"], "left")
    named = named.withColumn("name", F.when(F.col("contested"), F.col("free")).when(F.col("turn") <= NAME_ATTEMPTS, numbered(F.col("turn"))))
    named = named.withColumn("action", F.when(F.col("name").isNull(), "refuse").otherwise(F.col("action"))).withColumn("reason", F.when(F.col("name").isNull(), F.concat(F.lit("no free name for "), "base")))
    rest = d.where("action <> 'write'").withColumn("name", F.lit(None).cast("string"))
    columns = ["item_no", "action", "kind", "folder", "base", "name", "source_id", "item", "at", "reason"]
    return render(named.select(columns).unionByName(rest.select(columns)))


def render(plan: DataFrame) -> DataFrame:
    """Adds id and content, the bytes to store."""
    body = trim(F.col("item"))
    created = local_timestamp(F.col("at"))
    ident = F.when(F.col("kind") == "source", F.col("source_id")).otherwise(F.col("name"))
    text = F.format_string("---\nid: %s\ncreated: %s\n---\n\n%s\n", ident, created, body)
    source = F.format_string("---\nid: %s\ncreated: %s\nurl: %s\n---\n\n%s\n", ident, created, yaml_quoted(body), body)
    content = F.when(F.col("action") == "write", F.when(F.col("kind") == "source", source).otherwise(text))
    return plan.select("item_no", "action", "kind", "base", F.when(F.col("action") == "write", F.col("folder")).alias("folder"), "name", F.when(F.col("action") != "refuse", ident).alias("id"), content.alias("content"), "reason")


def commit_captures(plan: DataFrame, root: str) -> list[str]:
    """Writes the planned files one by one, in item order, never over an existing one; returns what was written.

    A name that was taken since the plan was made gives way to the next one of its base, up to
    NAME_ATTEMPTS; an inbox file's id moves with its name, a source's does not. A name that leads outside
    the root is passed over in the same way. The batch is what a person captured; rows come to the driver
    a partition at a time.
    """
    done = []
    for r in plan.where("action = 'write'").orderBy("item_no").toLocalIterator():
        folder = os.path.join(root, r.folder)
        if inside(folder, root):
            os.makedirs(folder, exist_ok=True)
        first = 1 if r.name == r.base else int(r.name.rsplit("-", 1)[1])
        for attempt in range(first, NAME_ATTEMPTS + 1):
            name = r.base if attempt == 1 else f"{r.base}-{attempt}"
            path = os.path.join(folder, name + ".md")
            if not inside(path, root):
                continue
            content = r.content if r.kind == "source" else r.content.replace(f"id: {r.name}\n", f"id: {name}\n", 1)
            try:
                with open(path, "x", encoding="utf-8", newline="") as f:
                    f.write(content)
            except FileExistsError:
                continue
            done.append(f"{r.folder}/{name}.md")
            break
        else:
            raise FileExistsError(f"no unused name was free in {r.folder}/ after {NAME_ATTEMPTS} tries; {len(done)} files of the batch are written")
    return done


def inside(path: str, root: str) -> bool:
    """Whether a path, its links resolved, is the root or below it."""
    path, root = os.path.realpath(path), os.path.realpath(root)
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)
