"""Repair of damaged conversations by the cheapest edits (operator 11).

The rows of a conversation, by turn (nulls first; equal turns by role, then text), are to read as an
optional system turn and then pairs of user and assistant turns: role initials ``(s?(ua)+)?``. Keeping a
row costs 0, giving it another role 2, deleting it 3, inserting an empty turn 2; a row that is left
although it is truncated costs 1 more, and blank rows and duplicates must go.

Edits are the arcs of a directed acyclic graph whose nodes are (rows consumed, state of the pattern).
Forward and backward minimum costs tell which arcs are tight, that is on a cheapest path; from the start,
the set of nodes reached by the letters so far is kept, and the least letter among its tight arcs comes
next (D, I, K, R). All nodes of the set have consumed equally many rows, so it is a set of states.

A conversation may hold any share of the rows, so it is cut into blocks of at most 4,096. A block is a
matrix of minimum costs between states; the blocks' matrices give the costs at their ends, then each block
is a map from sets of states to sets of states, and at last each gives its letters. The letters alone tell
the roles: the pattern's length is the number of letters but D, and fixes what stands at each place.

Nulls and edges: a null role or text is one space, which no pattern holds, and a null conversation is a
conversation. A role's initial is its first character as written; an empty role has none and is never
kept. Rows that repeat are rows. Texts of any length are compared by digest. An empty table gives none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .turns import block, ordered

WHITE = " \t\n\x0b\x0c\r"
#: Of the pattern: nothing yet, the system turn, a user turn, an assistant turn. By role: system, user, assistant.
STATES = range(4)
MOVES = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}
#: Where a user or assistant turn leads.
TURN = {p: next(q for role, q in m.items() if role) for p, m in MOVES.items()}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 50
#: Costs from each state to the pattern's end where no row is left.
END = [0, 2 * INSERT, INSERT, 0]


class Repair(NamedTuple):
    #: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation with rows
    audits: DataFrame
    #: (conv_id, id, sub, edit, role, text): the repaired turns, in order of id and sub
    turns: DataFrame


def arcs(code: int, p: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of the edits that consume a row. A code is 3 * role + fault, the role 3 for
    others; the fault 1 is truncated, 2 blank or duplicate."""
    role, fault = divmod(code, 3)
    out = [("D", DELETE, p)]
    if fault < 2:
        if role in MOVES[p]:
            out.append(("K", KEEP + fault * TRUNCATED, MOVES[p][role]))
        out.append(("R", REROLE + fault * TRUNCATED, TURN[p]))
    return out


ARCS = [[arcs(code, p) for p in STATES] for code in range(12)]


def inserted(costs: list[int]) -> list[int]:
    """Forward costs with insertions before the next row."""
    out = list(costs)
    for _ in STATES:
        for p in STATES:
            out[TURN[p]] = min(out[TURN[p]], out[p] + INSERT)
    return out


def consumed(costs: list[int], code: int) -> list[int]:
    """Forward costs behind a row, from those before it with insertions."""
    out = [FAR] * 4
    for p, c in enumerate(costs):
        for _, cost, q in ARCS[code][p]:
            out[q] = min(out[q], c + cost)
    return out


def backward(costs: list[int], code: int) -> list[int]:
    out = [min(cost + costs[q] for _, cost, q in ARCS[code][p]) for p in STATES]
    for _ in STATES:
        for p in STATES:
            out[p] = min(out[p], INSERT + out[TURN[p]])
    return out


def times(a: list[int], m: list[int]) -> list[int]:
    """A row of costs through a matrix, in the algebra of minimum and sum."""
    return [min(a[p] + m[4 * p + q] for p in STATES) for q in STATES]


def matrix(codes: bytes) -> list[int]:
    out = []
    for p in STATES:
        costs = [0 if q == p else FAR for q in STATES]
        for code in codes:
            costs = consumed(inserted(costs), code)
        out += [min(c, FAR) for c in costs]
    return out


def traverse(codes: bytes, forth: list[int], back: list[int], total: int, states: set[int], last: bool) -> tuple[str, set[int]]:
    """The letters of one block from the frontier ``states``, and the frontier at its end.

    ``forth`` are the costs to the block's start and ``back`` those from its end.
    """
    behind = [back]
    for code in reversed(codes):
        behind.append(backward(behind[-1], code))
    behind.reverse()
    out, here = [], forth
    for i in range(len(codes) + last):
        here = inserted(here)
        while True:
            found: dict[str, set[int]] = {}
            for p in states:
                if here[p] + INSERT + behind[i][TURN[p]] == total:
                    found.setdefault("I", set()).add(TURN[p])
                if i < len(codes):
                    for letter, cost, q in ARCS[codes[i]][p]:
                        if here[p] + cost + behind[i + 1][q] == total:
                            found.setdefault(letter, set()).add(q)
            if not found:  # the end of the conversation
                break
            letter = min(found)
            out.append(letter)
            states = found[letter]
            if letter != "I":
                break
        if i < len(codes):
            here = consumed(here, codes[i])
    return "".join(out), states


def _table(kind: str, rows: list[tuple]):
    """Arrow record batch of rows whose schema is ``kind`` (name type, ...)."""
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    fields = [x.split() for x in kind.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _each(df: DataFrame, kind: str, rows_of) -> DataFrame:
    """mapInArrow with ``rows_of(row as dict) -> tuples`` of the schema ``kind``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield _table(kind, [x for row in batch.slice(at, 512).to_pylist() for x in rows_of(row)])

    return df.mapInArrow(run, kind)


def _block_row(row: dict):
    codes = bytes(row["codes"])
    roles = [c // 3 for c in codes]
    illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(roles, roles[1:], strict=False))
    yield row["start"], row["conv"], codes, matrix(codes), illegal, roles[0], roles[-1]


def _ends(row: dict):
    """Costs at both ends of each block of a conversation."""
    blocks = row["blocks"]
    back = [END]
    for b in reversed(blocks[1:]):
        back.append([min(b["m"][4 * p + q] + back[-1][q] for q in STATES) for p in STATES])
    back.reverse()
    forth = [[0, FAR, FAR, FAR]]
    for b in blocks:
        forth.append(times(forth[-1], b["m"]))
    total = min(f + e for f, e in zip(forth[-1], END, strict=True))
    illegal = sum(b["illegal"] for b in blocks) + sum((a["last"], b["first"]) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(blocks, blocks[1:], strict=False))
    for i, b in enumerate(blocks):
        yield b["start"], forth[i], back[i], total, illegal, i + 1 == len(blocks), len(blocks) > 1


def _mask(states: set[int]) -> int:
    return sum(1 << p for p in states)


def _set(mask: int) -> set[int]:
    return {p for p in STATES if mask >> p & 1}


def _map(row: dict):
    """The frontier at the block's end for every frontier at its start, 0 where none is."""
    out, costs = [0] * 16, row["back"]
    for code in reversed(row["codes"]):
        costs = backward(costs, code)
    # a frontier holds only states on a cheapest path
    on = _mask({p for p in STATES if row["forth"][p] + costs[p] == row["total"]})
    for mask in range(1, 16):
        if mask & on == mask:
            out[mask] = _mask(traverse(row["codes"], row["forth"], row["back"], row["total"], _set(mask), False)[1])
    yield row["start"], row["conv"], out


def _frontiers(row: dict):
    mask = 1
    for b in row["blocks"]:
        yield b["start"], mask
        mask = b["map"][mask]


def _letters(row: dict):
    out, _ = traverse(row["codes"], row["forth"], row["back"], row["total"], _set(row["mask"]), row["closing"])
    yield row["start"], row["conv"], out, len(out) - out.count("D"), row["total"], row["illegal"]


def _edits(row: dict):
    at, sub, place = row["start"], 0, row["place"]
    shift = row["turns"] % 2
    for letter in row["letters"]:
        role = None if letter in "DK" else "user" if (place - shift) % 2 == 0 else "assistant"
        yield at, sub, row["conv"], letter, role
        place += letter != "D"
        at, sub = (at, sub + 1) if letter == "I" else (at + 1, 0)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): a repeatable damage that depends on crc32 of ``conversation:turn`` alone.

    Of its remainder by 20, 0 drops a row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``, 3 repeats
    it, 4 makes it a user turn. A null is one space, in the key too.
    """
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    own = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), word(role).alias("role"), word(text).alias("text"), (F.crc32(F.concat(word(conv), F.lit(":"), word(turn))) % 20).alias("fate"))
    changed = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    left = own.where("fate <> 0").withColumns({"text": changed, "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")), "n": F.explode(twice)})
    return left.select("conv_id", "turn", "role", "text")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of every conversation of ``rows``, conversations being named by whole numbers."""
    scratch = Scratch(rows.sparkSession, "repair")
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    own = rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), value(role).alias("role"), value(text).alias("text"))
    shown = F.rtrim("text", F.lit(WHITE))
    own = ordered(own, "conv", ["turn", "role", "text"], scratch).select(
        "id", "conv", "turn", "role", "text",
        (shown == "").alias("blank"),
        (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    first = own.where("not blank").groupBy("conv", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("truncated"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = 3 * kind + F.when(fault == 0, 0).when(fault == 3, 1).otherwise(2)
    marked = scratch.cut(own.join(first, "id", "left").select("id", "conv", "turn", fault.alias("fault"), code.cast("int").alias("code")))
    counts = [F.count_if(F.col("fault") == k).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    stats = marked.groupBy("conv").agg(gaps.alias("gaps"), *counts)

    # blocks of a conversation: ids are consecutive within
    each = F.transform(F.sort_array(F.collect_list(F.struct("id", "code"))), lambda x: x["code"])
    blocks = marked.groupBy("conv", block()).agg(F.min("id").alias("start"), each.alias("codes")).select("conv", "start", "codes")
    blocks = scratch.cut(_each(blocks, "start long, conv long, codes binary, m array<long>, illegal long, first int, last int", _block_row))
    by_conversation = lambda df, *c: df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("start", *c))).alias("blocks"))
    ends = scratch.cut(_each(by_conversation(blocks, "m", "illegal", "first", "last"), "start long, forth array<long>, back array<long>, total long, illegal long, closing boolean, several boolean", _ends))
    work = blocks.select("start", "conv", "codes").join(ends, "start")
    maps = _each(work.where("several"), "start long, conv long, map array<long>", _map)
    masks = _each(by_conversation(maps, "map"), "start long, mask int", _frontiers)
    ready = work.join(masks, "start", "left").withColumn("mask", F.coalesce("mask", F.lit(1)))
    letters = scratch.cut(_each(ready, "start long, conv long, letters string, n long, total long, illegal long", _letters))

    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "letters"))), lambda x: x["letters"]), "")
    audits = letters.groupBy("conv").agg(F.max("illegal").alias("illegal"), F.max("total").alias("cost"), audit.alias("audit"))
    audits = stats.join(audits, stats["conv"].eqNullSafe(audits["conv"])).select(stats["conv"].alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = letters.withColumns({"place": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "turns": F.sum("n").over(whole)})
    edits = _each(placed.select("start", "conv", "letters", "place", "turns"), "id long, sub int, conv long, edit string, new_role string", _edits).where("edit <> 'D'")
    turns = edits.join(own.select("id", "role", "text"), "id", "left").select(F.col("conv").alias("conv_id"), "id", "sub", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    return Repair(audits, turns)
