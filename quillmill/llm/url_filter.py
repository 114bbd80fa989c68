"""URL filters with redirect equivalence, with DataFrame functions only (operator 7).

A rule is (host, path, verdict): it fits its host and all subdomains if the url's path starts with
the rule's path, and the longest fitting rule (host and path together; then the longer host) decides.
Urls that redirect to one another or name one another as canonical are aliases: connected components
over those edges, found by distributed star contraction. A url that no rule fits is blocked if some
alias of it is blocked by a rule. An explicit allow precedes: a url that an allow rule decides stays
allowed whatever its aliases are. All else is allowed.

Edges come from the pages' canonical links and meta refreshes, resolved against the page's address or
its base element, and from a table of redirects if given. Nodes are urls in one spelling (``node``):
scheme and host in lower case, no default port, no dot segments, no fragment, no needless percent
signs; in the components a node is the 128-bit digest of its url. Html is read in one pass without
going back, whatever stands in it: comments go first (one that is not closed reaches the end), a tag
ends at its first ``>``, and attributes are read in order, values with their quotes. Rules judge a page by
its url as it is written, and its aliases by their nodes.

Nulls and edges: a null url, or one without ``://``, has an empty host and path, fits no rule and has no
aliases; null html has no links. A url or html of any length is read whole; a component of any size is
joined in the components' steps, whose hubs are dealt over tasks. Repeated rows give a row each; an
empty table stays empty; without rules all is allowed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Scratch, connected_components


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, or nulls; the rules are tried longest first."""
    text, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def _without_dots(path: Column) -> Column:
    """A path from the root on, its ``.`` and ``..`` resolved."""
    names = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(names, 2, F.size(names)),
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    open_end = F.element_at(names, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))).otherwise(path)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def _plain_percent(url: Column) -> Column:
    """Percent signs that stand for unreserved characters resolved, others with upper-case digits."""
    code = lambda x: F.conv(F.substring(x, 1, 2), 16, 10).cast("int")

    def part(x: Column, i: Column) -> Column:
        sign = F.char(code(x))
        resolved = F.when(sign.rlike("^[A-Za-z0-9._~-]$"), sign).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2))))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), F.concat(resolved, F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%"), x))

    return F.when(F.contains(url, F.lit("%")), F.array_join(F.transform(F.split(url, "%", -1), part), "")).otherwise(url)


def node(url: Column) -> Column:
    """The one spelling of a url: scheme and host in lower case, no default port, no dot segments, no fragment."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*@)?([^/?@]*?)(:[0-9]*)?(/[^?]*)?(\?[\s\S]*)?$"

    def spell(plain: Column) -> Column:
        parts = F.struct(plain.alias("plain"), *[F.regexp_extract(plain, pattern, i).alias(f"p{i}") for i in range(1, 7)])
        return _let(parts, joined)

    def joined(x: Column) -> Column:
        scheme, port = _lower(x["p1"]), x["p4"]
        default = (port == ":") | (scheme == "http") & (port == ":80") | (scheme == "https") & (port == ":443")
        path = F.when(x["p5"] == "", "/").otherwise(_without_dots(x["p5"]))
        return F.when(x["p1"] != "", F.concat(scheme, F.lit("://"), x["p2"], _lower(x["p3"]), F.when(default, "").otherwise(port), path, x["p6"])).otherwise(x["plain"])

    return _let(F.regexp_replace(F.trim(_plain_percent(url)), r"#[\s\S]*$", ""), spell)


def absolute(link: Column, base: Column) -> Column:
    """A link resolved against an address; null for what is no address itself (mailto: and the like)."""

    def of(x: Column) -> Column:
        link, base, whole = x["link"], x["base"], x["whole"]
        folder = F.regexp_extract(whole, r"^([^:]*://[^/?]*(?:/[^?]*/|/)?)", 1)
        return (
            F.when(link == "", whole)
            .when(link.rlike(SCHEME), F.when(link.rlike(SCHEME + "//"), link))
            .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*)://", 1), F.lit(":"), link))
            .when(link.startswith("/"), F.concat(F.regexp_extract(whole, "^([^:]*://[^/?]*)", 1), link))
            .when(link.startswith("?"), F.concat(F.substring_index(whole, "?", 1), link))
            .otherwise(_let(folder, lambda f: F.concat(F.when(f.endswith("/"), f).otherwise(F.concat(f, F.lit("/"))), link)))
        )

    plain = F.regexp_replace(F.trim(link), r"#[\s\S]*$", "")
    return _let(base, lambda b: _let(F.struct(plain.alias("link"), b.alias("base"), F.regexp_replace(b, r"#[\s\S]*$", "").alias("whole")), of))


COMMENT = r"<!--[\s\S]*?(?:-->|\z)"
TAG = r"(?i)<(?:link|meta|base)\b[^<>]*+>"
ATTRIBUTE = r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?"""


def _attributes(tag: Column) -> Column:
    """array<struct(name, value)> of a tag, its own name first; names in lower case, values without quotes."""
    found = lambda i: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(i))
    value = lambda x: F.replace(F.when(x.rlike("^[\"']"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x), F.lit("&amp;"), F.lit("&"))
    return F.zip_with(found(1), found(2), lambda n, x: F.struct(_lower(n).alias("name"), value(x).alias("value")))


def _attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute; null without one."""
    return F.get(F.filter(tag, lambda x: x["name"] == name), F.lit(0))["value"]


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): the canonical link and the meta refresh of each page's html."""
    may = F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv\s*+=\s*+[\"']?refresh")
    tags = F.transform(F.regexp_extract_all(F.regexp_replace("html", COMMENT, ""), F.lit(TAG), F.lit(0)), _attributes)
    d = pages.where(may & F.contains("url", F.lit("://"))).select("url", tags.alias("tags"))
    kind = lambda x: F.get(x, F.lit(0))["name"]
    first = lambda test: F.get(F.filter("tags", test), F.lit(0))
    words = lambda x: F.split(_lower(F.trim(F.coalesce(_attribute(x, "rel"), F.lit("")))), r"\s+")
    canonical = _attribute(first(lambda x: (kind(x) == "link") & F.array_contains(words(x), "canonical")), "href")
    content = _attribute(first(lambda x: (kind(x) == "meta") & (_lower(F.trim(F.coalesce(_attribute(x, "http-equiv"), F.lit("")))) == "refresh")), "content")
    refresh = F.regexp_extract(content, r"(?i)\burl\s*+=\s*+[\"']?([^\"';\s]+)", 1)
    home = _attribute(first(lambda x: (kind(x) == "base") & _attribute(x, "href").isNotNull()), "href")
    d = d.select("url", F.coalesce(home, F.lit("")).alias("home"), F.explode(F.array(canonical, refresh)).alias("link")).where("link <> ''")
    base = F.when(F.col("home") == "", F.col("url")).otherwise(F.coalesce(absolute(F.col("home"), F.col("url")), F.col("url")))
    return d.select(F.col("url").alias("from_url"), absolute(F.col("link"), base).alias("to_url")).where("to_url is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, aliased) per page; ``redirects`` is (from_url, to_url)."""
    scratch = Scratch(pages.sparkSession, "urls")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url").where("from_url is not null and to_url is not null"))
    links = scratch.cut(links.select(node(F.col("from_url")).alias("u"), node(F.col("to_url")).alias("v")).where("u <> v").distinct())
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), F.md5(node(F.col("url"))).alias("node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", rule).withColumn("own", verdict)
    if links.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(False).alias("aliased"))
    parts = connected_components(links.select(F.md5("u").alias("a"), F.md5("v").alias("b")), scratch)
    h, p = host_and_path(F.col("url"))
    told = links.select(F.explode(F.array("u", "v")).alias("url")).distinct().select(F.md5("url").alias("node"), rule_of(h, p, rules)[1].alias("v")).where("v = 'block'")
    blocked = parts.join(told.select("node"), "node", "left_semi").select("component").distinct().withColumn("bad", F.lit(True))
    parts = parts.join(blocked, "component", "left").select("node", F.coalesce("bad", F.lit(False)).alias("bad"))
    out = own.join(parts, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), F.col("bad").isNotNull().alias("aliased"))
