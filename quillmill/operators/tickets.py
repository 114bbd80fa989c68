"""Tickets as Markdown: extraction, key order, eligibility, estimates, path overlap, dispatch, status.

A ticket is (key, title, body). Keys are dotted numbers (``53.2`` before ``53.10``). All steps are column
expressions within a row, equi joins on keys or paths, and aggregations that combine before the shuffle;
a path or blocker that many tickets name is one row of the other side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import discard, stored

# fixed values
STATUSES = ("Proposed", "Ready", "In Progress", "Complete", "Cancelled", "Superseded")
TERMINAL = ("Complete", "Cancelled", "Superseded")
ABANDONED = ("Cancelled", "Superseded")
UNREAD = "Unrecognised"
ACTIVE = ("working", "review")
COMPLEXITY = (3, 7)
CONTEXT = (3, 8)

TEXTS = "array<string>"


# --- keys ---


def key_order(key: Column) -> Column:
    """A binary whose byte order is the numeric order of dotted keys: each number as its count of digits
    and its digits. Numbers may have up to 255 digits; leading zeros do not count, what is no key is null."""
    numbers = F.transform(F.split(key, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    part = lambda x: F.concat(F.unhex(F.lpad(F.hex(F.length(x)), 2, "0")), F.encode(x, "UTF-8"))
    whole = F.aggregate(numbers, F.lit(b""), lambda a, x: F.concat(a, part(x)))
    return F.when(key.rlike(r"\A[0-9]+(\.[0-9]+)*\z"), whole)


def in_key_order(tickets: DataFrame, tasks: int) -> DataFrame:
    """Rows globally ordered by key, dealt by ranges; equal keys by title."""
    by = [key_order(F.col("key")), F.col("title")]
    return tickets.repartitionByRange(tasks, *by).sortWithinPartitions(*by)


# --- extraction ---


def section(body: Column, heading: str) -> Column:
    """What stands under ``## heading`` (any case) up to the next ``## ``; null where there is none."""
    found = F.regexp_extract_all(body, F.lit(rf"(?mi)^## {heading}[ \t]*\r?\n((?:(?!## )[^\n]*+(?:\n|\z))*+)"), F.lit(1))
    return F.get(found, F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def local_status(body: Column) -> Column:
    """One of ``STATUSES``, or ``UNREAD``, by the first line with text under ``## Status``."""
    first = F.get(F.filter(F.transform(lines_of(section(body, "Status")), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    known = F.create_map(*[F.lit(x) for s in STATUSES for x in (s.lower(), s)])
    return F.coalesce(F.element_at(known, F.lower(F.coalesce(first, F.lit("")))), F.lit(UNREAD))


def blockers(body: Column) -> Column:
    """The first backticked key of each list line under ``## Blocked by``, each once."""
    keys = F.transform(lines_of(section(body, "Blocked by")), lambda x: F.regexp_extract(x, r"^\s*[-*]\s+`([0-9]+\.[0-9]+)`", 1))
    return F.array_distinct(F.filter(keys, lambda x: x != ""))


def count_changes(body: Column) -> Column:
    """List items at the start of a line under ``## Changes``."""
    return F.size(F.filter(lines_of(section(body, "Changes")), lambda x: x.rlike(r"^([-*+]|[0-9]+[.)])\s+\S")))


def _looks_like_path(token: Column) -> Column:
    first = F.split_part(F.regexp_replace(token, r"^\./", ""), F.lit("/"), F.lit(1))
    named = ~token.rlike(r"(?i)^[a-z][a-z0-9+.-]*://") & ~token.rlike(r"^v?[0-9]+(\.[0-9]+)+$")
    return named & F.when(F.contains(token, F.lit("/")), ~first.rlike(r"^[^.][^/]*\.[^/]*$")).otherwise(token.rlike(r"(?i)\.[a-z][a-z0-9]*$"))


def _expand(tokens: Column) -> Column:
    """One brace group of each token expanded: ``src/{a,b}.x`` to ``src/a.x`` and ``src/b.x``."""
    group = r"^([^{}]*(?:\{[^{}]*)*?)\{([^{}]*)\}(.*)$"
    each = lambda t: F.when(t.rlike(group), F.transform(F.split(F.regexp_extract(t, group, 2), ","), lambda x: F.concat(F.regexp_extract(t, group, 1), x, F.regexp_extract(t, group, 3)))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens, each))


#: Brace groups of a token that are expanded; further ones stay as written.
BRACES = 4


def _normal(token: Column) -> Column:
    """Without leading ``./`` and trailing ``/``; cut before the first segment with a wildcard."""
    cut = F.regexp_replace(F.regexp_replace(token, r"^(\./)+", ""), r"(^|/)[^/]*[*?\[\]].*$", "")
    return F.regexp_replace(cut, "/+$", "")


def paths_in(text: Column) -> Column:
    """The distinct paths among the backticked tokens of a text, in order of their bytes."""
    tokens = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"`([^`\s]+)`"), F.lit(1)), _looks_like_path)
    for _ in range(BRACES):
        tokens = _expand(tokens)
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, _normal), lambda p: p != "")))


def context_paths(body: Column) -> Column:
    return paths_in(section(body, "Context"))


def relevant_areas(body: Column) -> Column:
    """Paths on the ``- Relevant area:`` lines under ``## Context`` and on the bullets nested under them."""
    indent = lambda x: F.length(F.regexp_extract(x, r"^(\s*)[-*+]\s+", 1))
    bullet = lambda x: x.rlike(r"^\s*[-*+]\s+")
    head = lambda x: x.rlike(r"(?i)^\s*[-*+]\s+Relevant area\s*:")
    # the fold keeps the indent of the line that picks (-1: none)
    start = F.struct(F.lit(-1).alias("at"), F.array().cast(TEXTS).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        nested = bullet(x) & (a["at"] >= 0) & (indent(x) > a["at"])
        at = F.when(nested, a["at"]).when(head(x), indent(x)).otherwise(F.lit(-1))
        return F.struct(at.alias("at"), F.when(nested | head(x), F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"))

    kept = F.aggregate(lines_of(section(body, "Context")), start, step, lambda a: a["kept"])
    return paths_in(F.array_join(kept, "\n"))


def read_tickets(notes: DataFrame) -> DataFrame:
    """(key, title, status, blockers, n_changes, paths, areas) of notes (key, title, body); the first row
    by title answers where a key is repeated, and what has no key is no ticket."""
    b = F.col("body")
    own = notes.where(key_order(F.col("key")).isNotNull()).select("key", "title", local_status(b).alias("status"), blockers(b).alias("blockers"), count_changes(b).cast("long").alias("n_changes"), context_paths(b).alias("paths"), relevant_areas(b).alias("areas"))
    rest = [c for c in own.columns if c != "key"]
    return own.groupBy("key").agg(F.min_by(F.struct(*rest), F.coalesce("title", F.lit(""))).alias("t")).select("key", "t.*")


# --- eligibility ---


def board(tickets: DataFrame) -> DataFrame:
    """(key, title, status, eligible, waiting, missing, reason): what may start now, and what keeps the rest.

    Division by counting: a ticket is eligible if it may start and as many of its blockers are complete as
    it has. Lists are in the order in which the ticket names its blockers.
    """
    asked = tickets.select("key", F.posexplode("blockers").alias("n", "blocker"))
    known = tickets.select(F.col("key").alias("blocker"), F.col("status").alias("blocker_status"))
    met = asked.join(known, "blocker", "left")
    state = F.col("blocker_status")
    problem = (
        F.when(state.isNull(), F.format_string("blocker %s does not exist", "blocker"))
        .when(state == UNREAD, F.format_string("blocker %s has an unrecognised status", "blocker"))
        .when(state.isin(*ABANDONED), F.concat(F.lit("blocker "), "blocker", F.lit(" is "), state, F.lit(" — a planning question")))
    )
    listed = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("n", value.alias("v"))))), lambda x: x["v"])
    waits = problem.isNull() & (state != "Complete")
    sums = met.groupBy("key").agg(F.count_if(state == "Complete").alias("complete"), listed(problem, problem.isNotNull()).alias("problems"), listed(F.col("blocker"), waits).alias("waiting"), listed(F.col("blocker"), state.isNull()).alias("missing"))
    d = tickets.join(sums, "key", "left")
    none = F.array().cast(TEXTS)
    may = F.col("status").isin("Proposed", "Ready")
    reason = (
        F.when(F.col("status") == UNREAD, "status unrecognised")
        .when(~may, F.lower("status"))
        .when(F.size("problems") > 0, F.array_join("problems", "; "))
        .when(F.size("waiting") > 0, F.concat(F.lit("blocked by "), F.array_join("waiting", ", ")))
    )
    eligible = may & (F.coalesce("complete", F.lit(0)) == F.size("blockers"))
    keep = lambda c: F.when(may, F.coalesce(c, none)).otherwise(none).alias(c)
    return d.select("key", "title", "status", eligible.alias("eligible"), keep("waiting"), keep("missing"), F.when(~eligible, reason).alias("reason"))


# --- paths ---


def is_file(path: Column) -> Column:
    return path.rlike(r"(?i)\.[a-z0-9]+$")


def containers(path: Column) -> Column:
    """The directories above a path, from the top: ``a/b/c`` lies in ``a`` and ``a/b``; names of files hold nothing."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.filter(above, lambda p: ~is_file(p))).otherwise(F.array().cast(TEXTS))


def path_overlaps(areas: DataFrame) -> DataFrame:
    """(path, inner, kind, n_path, n_inner) for areas (key, path): each pair of overlapping named paths once.

    ``equal`` pairs a path that several keys name with itself; ``contains`` a directory and a path within.
    n are the keys that name each. Every path meets its own ancestors by an equi join, so the work is the
    paths' depth and no path is compared with another; keys stand as counts, not as pairs.
    """
    named = areas.where("path is not null and key is not null").select("key", "path").distinct().groupBy("path").agg(F.count("*").alias("n"))
    equal = named.where("n > 1").select("path", F.col("path").alias("inner"), F.lit("equal").alias("kind"), F.col("n").alias("n_path"), F.col("n").alias("n_inner"))
    up = named.select(F.col("path").alias("inner"), F.col("n").alias("n_inner"), F.explode(containers(F.col("path"))).alias("path"))
    return equal.unionByName(up.join(named.withColumnRenamed("n", "n_path"), "path").select("path", "inner", F.lit("contains").alias("kind"), "n_path", "n_inner"))


def _named(tickets: DataFrame) -> DataFrame:
    return tickets.select("key", F.explode("areas").alias("path"))


def _first_by_path(rows: DataFrame) -> DataFrame:
    """(path, k1, k2): the two first keys, in key order, that name a path: enough to find one that is not one's own."""
    ordered = F.struct(key_order(F.col("key")).alias("o"), "key")
    first = rows.groupBy("path").agg(F.min(ordered).alias("a"))
    second = rows.join(first, "path").where("key <> a.key").groupBy("path").agg(F.min(ordered).alias("b"))
    return first.join(second, "path", "left").select("path", F.col("a.key").alias("k1"), F.col("b.key").alias("k2"))


def parallel_safety(tickets: DataFrame, in_flight: DataFrame) -> DataFrame:
    """(key, safety, reason) of tickets beside others in flight (key, areas).

    ``serialize`` if a file is named by another in flight, ``shared-surface`` if paths overlap, else
    ``isolated``. The reason names the first other ticket in key order, then its first path, then one's own.
    """
    mine, theirs = _named(tickets), _named(in_flight)
    first = _first_by_path(theirs)
    mine = mine.withColumn("file", is_file(F.col("path")))
    same = mine.select("key", "path", F.col("path").alias("their"), "file")
    below = first.select(F.col("path").alias("their"), F.explode(containers(F.col("path"))).alias("path")).join(mine.where("not file"), "path").select("key", "path", "their", F.lit(False).alias("file"))
    above = mine.select("key", "path", F.explode(containers(F.col("path"))).alias("their"), F.lit(False).alias("file"))
    met = same.unionByName(below).unionByName(above).join(first.withColumnRenamed("path", "their"), "their")
    other = F.when(F.col("k1") != F.col("key"), F.col("k1")).otherwise(F.col("k2"))
    met = met.withColumn("other", other).where("other is not null")
    best = met.groupBy("key").agg(F.min(F.struct((~F.col("file")).alias("soft"), key_order(F.col("other")).alias("o"), "their", "path", "other")).alias("m"))
    others = in_flight.agg(F.count("*").alias("n"), F.min("key").alias("only"))
    out = tickets.select("key", F.size("areas").alias("n_areas")).join(best, "key", "left").join(F.broadcast(others))
    alone = (F.col("n") == 0) | ((F.col("n") == 1) & (F.col("only") == F.col("key")))
    safety = F.when(F.col("m").isNull(), "isolated").when(F.col("m.soft"), "shared-surface").otherwise("serialize")
    reason = (
        F.when(alone, "no other ticket is in flight")
        .when(F.col("n_areas") == 0, "the ticket names no Relevant area")
        .when(F.col("m").isNull(), "no Relevant area overlaps an in-flight ticket")
        .when(F.col("m.soft"), F.concat("m.path", F.lit(" overlaps "), "m.their", F.lit(" in "), "m.other"))
        .otherwise(F.concat(F.lit("names "), "m.path", F.lit(", which "), "m.other", F.lit(" also names")))
    )
    return out.select("key", safety.alias("safety"), reason.alias("reason"))


def estimates(tickets: DataFrame, in_flight: DataFrame) -> DataFrame:
    """(key, complexity, context, safety, safety_reason, risk): thresholds over counts, and the one risk rule."""
    by = lambda n, low, most, names: F.when(n <= low, names[0]).when(n <= most, names[1]).otherwise(names[2])
    d = tickets.join(parallel_safety(tickets, in_flight).withColumnRenamed("reason", "safety_reason"), "key")
    d = d.select("key", by(F.col("n_changes"), *COMPLEXITY, ("low", "medium", "high")).alias("complexity"), by(F.size("paths"), *CONTEXT, ("small", "medium", "large")).alias("context"), "safety", "safety_reason")
    low = (F.col("complexity") == "low") & (F.col("context") == "small") & (F.col("safety") == "isolated")
    high = (F.col("complexity") == "high") & (F.col("context") == "large")
    return d.withColumn("risk", F.when(low, "low").when(high, "high").otherwise("unassessed"))


# --- dispatch ---


def first_independent(candidates: DataFrame) -> DataFrame:
    """(key) of the candidates (key, rank, path) that a pass in order of rank would choose, if each is refused
    that shares a path with one chosen before.

    In each round, who has the least rank on all its paths is chosen, and whoever shares a path with
    those is refused: the same choice as the pass makes, in as many rounds as its longest chain of waiting.
    A candidate without a path has one row with a null path and is chosen.
    """
    free = candidates.where("path is null").select("key").distinct()
    left, chosen = stored(candidates.where("path is not null").select("key", "rank", "path").distinct(), "candidates"), []
    while not left.isEmpty():
        least = left.groupBy("path").agg(F.min("rank").alias("least"))
        wins = stored(left.join(least, "path").groupBy("key").agg(F.bool_and(F.col("rank") == F.col("least")).alias("wins")).where("wins").select("key"), "chosen")
        chosen.append(wins)
        taken = left.join(wins, "key", "left_semi").select("path").distinct()
        refused = left.join(taken, "path", "left_semi").select("key").distinct()
        rest = stored(left.join(refused, "key", "left_anti"), "candidates")
        discard(left)
        left = rest
    return reduce(DataFrame.unionByName, chosen, free)


def dispatch_plan(tickets: DataFrame, claims: DataFrame, workers: int) -> DataFrame:
    """(key, decision, reason): ``dispatch``, ``deferred`` or ``blocked`` for each ticket that is not claimed
    and not over.

    Eligible tickets are taken in key order, up to as many as workers are free; one that names a file which
    a ticket in flight or an earlier choice also names waits, and so does the rest. ``claims`` are (key,
    state, live, orphan): a live one at work holds a worker, every one is in flight but an orphan. As many
    tickets are dispatched as there are workers at most, so those are a small table.
    """
    rows = stored(board(tickets), "board")
    claimed = claims.select("key").distinct()
    flight = claims.where("not orphan").select("key").distinct().join(tickets.select("key", "areas"), "key")
    busy = claims.where(~F.col("orphan") & F.col("live") & F.coalesce("state", F.lit("working")).isin(*ACTIVE)).count()
    slots = max(0, workers - busy)
    ready = tickets.join(rows.where("eligible").select("key"), "key", "left_semi").join(claimed, "key", "left_anti").select("key", "areas")
    files = ready.select("key", key_order(F.col("key")).alias("rank"), F.explode_outer(F.filter("areas", is_file)).alias("path"))
    held = _named(flight).where(is_file(F.col("path"))).select("path").distinct()
    barred = files.join(held, "path", "left_semi").select("key").distinct()
    chosen = first_independent(files.join(barred, "key", "left_anti"))
    # no more rows than workers
    first = stored(chosen.withColumn("rank", key_order(F.col("key"))).orderBy("rank").limit(slots).select("key"), "dispatch")
    # a choice is held up by the flight and earlier choices only; no two choices share a file
    rest = files.join(F.broadcast(first), "key", "left_anti").where("path is not null")
    other = F.struct(key_order(F.col("key")).alias("o"), "key").alias("other")
    flying = _named(flight).groupBy("path").agg(F.min(other).alias("other"), F.lit(True).alias("claimed"))
    chosen_files = files.join(F.broadcast(first), "key", "left_semi").where("path is not null").select("path", other, F.lit(False).alias("claimed"))
    met = rest.join(flying.unionByName(chosen_files), "path").where(F.col("claimed") | (F.col("other.o") < F.col("rank")))
    hard = met.groupBy("key").agg(F.min(F.struct("other", "path")).alias("m")).select("key", F.concat(F.lit("serialize: names "), "m.path", F.lit(", which "), "m.other.key", F.lit(" also names")).alias("why"))
    late = ready.join(F.broadcast(first), "key", "left_anti").join(hard, "key", "left").select("key", F.lit("deferred").alias("decision"), F.coalesce("why", F.lit(f"worker limit {workers} reached")).alias("reason"))
    now = first.select("key", F.lit("dispatch").alias("decision"), F.lit(None).cast("string").alias("reason"))
    over = rows.where(~F.col("eligible") & ~F.col("status").isin(*TERMINAL)).join(claimed, "key", "left_anti").select("key", F.lit("blocked").alias("decision"), "reason")
    return now.unionByName(late).unionByName(over)


# --- claims and status ---


def merge_claims(worktrees: DataFrame, branches: DataFrame, refs: DataFrame) -> DataFrame:
    """One claim a key from three sources, the first that knows the key deciding: worktrees (key, branch,
    worktree, state, gate), branches (key, branch, elsewhere), refs (key).

    (key, source, branch, worktree, elsewhere, state, gate, orphan). A full outer merge by one aggregation:
    sources are stacked with their precedence and the least of a key wins. Where one source names a key
    twice, the least branch holds.
    """
    columns = ["branch", "worktree", "elsewhere", "state", "gate"]
    stack = [d.select("key", F.lit(n).alias("n"), *[(F.col(c) if c in d.columns else F.lit(None)).cast("string").alias(c) for c in columns]) for n, d in enumerate((worktrees, branches, refs))]
    all_ = reduce(DataFrame.unionByName, stack).where(key_order(F.col("key")).isNotNull())
    best = all_.groupBy("key").agg(F.min_by(F.struct("n", *columns), F.struct("n", F.coalesce("branch", F.lit("")), F.coalesce("worktree", F.lit("")))).alias("c")).select("key", "c.*")
    source = F.element_at(F.array(F.lit("worktree"), F.lit("branch"), F.lit("ref")), F.col("n") + 1)
    return best.select("key", source.alias("source"), *columns, (F.col("n") > 0).alias("orphan"))


def status_view(tickets: DataFrame, claims: DataFrame, live: DataFrame) -> DataFrame:
    """(key, lifecycle, state, place, gate, title): one row for each ticket or claim, by precedence.

    Complete tickets are integrated; a claim's own state follows unless its ticket was given up, its
    worktree is gone, its state is invalid, or it was at work and no session is ``live`` (key): all of those
    are stale. Without a claim a ticket is working, ready or blocked. Tickets that were given up and are not
    claimed have no row; claims of unknown tickets have one.
    """
    mark = lambda d: d.select("key").distinct().withColumn("live", F.lit(True))
    d = board(tickets).join(claims.withColumn("claimed", F.lit(True)), "key", "full").join(mark(live), "key", "left")
    d = d.where(F.col("claimed") | ~F.coalesce(F.col("status").isin(*ABANDONED), F.lit(False)))
    status, state, dash = F.coalesce("status", F.lit("—")), F.col("state"), F.lit("—")
    live_ = F.coalesce("live", F.lit(False))
    bad = F.startswith(state, F.lit("invalid:"))
    shown = (
        F.when(status == "Complete", "integrated")
        .when(F.col("claimed") & (status.isin(*ABANDONED) | F.col("orphan")), "stale")
        .when(F.col("claimed") & state.isNull(), F.when(live_, "working").otherwise("stale"))
        .when(F.col("claimed") & (bad | (state.isin(*ACTIVE) & ~live_)), "stale")
        .when(F.col("claimed"), state)
        .when(status == "In Progress", "working")
        .when(F.col("eligible"), "ready")
        .otherwise("blocked")
    )
    tree = F.concat(F.coalesce("branch", F.lit("?")), F.lit(" @ "), F.coalesce("worktree", F.lit("?")))
    lost = F.when(F.col("elsewhere").isNotNull(), F.concat("branch", F.lit(" @ "), "elsewhere", F.lit(" (elsewhere)"))).when(F.col("branch").isNotNull(), F.concat("branch", F.lit(" (branch only)"))).otherwise("claim ref only")
    open_ = F.col("claimed") & (status != "Complete")
    place = F.when(open_ & F.col("orphan") & ~status.isin(*ABANDONED), lost).when(F.col("claimed") & ~F.col("orphan"), tree).when(F.col("claimed").isNull() & (status == "In Progress"), "no claim").otherwise(dash)
    gate = (
        F.when(open_ & status.isin(*ABANDONED), F.format_string("ticket is %s but still claimed; release it", status))
        .when(open_ & F.col("orphan"), F.when(F.col("elsewhere").isNotNull(), "checked out elsewhere; a person decides").otherwise("worktree missing; resume or release"))
        .when(open_ & bad, F.concat(F.lit("state file says "), F.substr(state, F.lit(9))))
        .when(F.col("claimed"), F.coalesce("gate", dash))
        .when(~F.col("eligible") & ~status.isin("Complete", "In Progress"), F.coalesce("reason", dash))
        .otherwise(dash)
    )
    return d.select("key", status.alias("lifecycle"), shown.alias("state"), place.alias("place"), gate.alias("gate"), F.coalesce("title", F.lit("(not in the store)")).alias("title"))
