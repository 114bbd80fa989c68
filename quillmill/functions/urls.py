"""Identity of source urls.

``normalize_url`` is a column expression for the plain part of the url standard: http and https,
ASCII letters, digits, hyphens and dots in the host, percent-encoded ASCII elsewhere. Inputs outside
it are marked ``plain = false`` and resolved by ``normalize_url_exact``, an Arrow UDF.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DIGEST_LENGTH, VIDEO_CANONICAL, VIDEO_HOSTS, VIDEO_PREFIXES, VIDEO_SHORT_HOSTS
from .text import let, redact, trim

KEY = r"^[A-Za-z0-9_-]{11}\z"
RESULT = "ok boolean, url string, rule string, key string, code string, reason string"
PLAIN = r"(?i)\Ahttps?://(?:[^/?#@\s]*@)?(?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*(?::[0-9]{1,5})?(?:[/?#][\x21-\x7E]*)?\z"


def _video(host: Column, segments: Column, v: Column) -> Column:
    first, second = F.get(segments, F.lit(0)), F.get(segments, F.lit(1))
    key = lambda c: F.when(c.rlike(KEY), c)
    return (
        F.when(host.isin(*VIDEO_SHORT_HOSTS), F.when(F.size(segments) == 1, key(first)))
        .when(~host.isin(*VIDEO_HOSTS), F.lit(None).cast("string"))
        .when((F.size(segments) == 1) & (first == "watch"), key(v))
        .when((F.size(segments) == 2) & first.isin(*VIDEO_PREFIXES), key(second))
    )


def _form(c: Column) -> Column:
    """A form-encoded part as it reads back: %XX of unreserved characters resolved is rare and left to the exact path."""
    return F.replace(c, F.lit("%20"), F.lit("+"))


def is_plain(c: Column) -> Column:
    """What the column expression handles: no escapes in the query, no dot segments, no backslash."""
    t = trim(c)
    return t.rlike(PLAIN) & ~t.rlike(r"[\\\"<>`{}|^']|/\.{1,2}(?:[/?#]|\z)|(?i)/%2e|\?[^#]*[%~!()]|:\d+[/?#]?.*[^\x00-\x7F]")


def _parts(t: Column) -> Column:
    authority = F.regexp_replace(F.regexp_extract(t, r"^[^:]+://([^/?#]*)", 1), "^[^@]*@", "")
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.struct(t.alias("text"), scheme.alias("scheme"), authority.alias("authority"), F.regexp_extract(t, r"^[^:]+://[^/?#]*(.*)$", 1).alias("rest"))


def _pieces(a: Column) -> Column:
    pairs = F.filter(F.split(F.regexp_extract(a["rest"], r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    path = let(F.regexp_extract(a["rest"], r"^([^?#]*)", 1), lambda p: F.when(p == "", "/").otherwise(p))
    return F.struct(
        a["text"].alias("text"),
        a["scheme"].alias("scheme"),
        F.lower(F.regexp_replace(a["authority"], r":\d*$", "")).alias("host"),
        F.regexp_extract(a["authority"], r":(\d+)$", 1).alias("port"),
        path.alias("path"),
        pairs.alias("pairs"),
        F.regexp_extract(a["rest"], r"(#.*)$", 1).alias("fragment"),
    )


def _normalized(p: Column) -> Column:
    scheme, host, port, path, pairs, fragment = (p[x] for x in ("scheme", "host", "port", "path", "pairs", "fragment"))
    default = F.when(scheme == "https", "443").otherwise("80")
    shown_port = F.when((port == "") | (port.try_cast("int") == default.cast("int")), "").otherwise(F.concat(F.lit(":"), port.try_cast("int").cast("string")))
    keyed = F.transform(pairs, lambda x, i: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("k"), i.alias("i"), F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))).alias("p")))
    ordered = F.array_join(F.transform(F.array_sort(keyed), lambda x: _form(x["p"])), "&")
    search = let(ordered, lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("?"), x)))
    v = F.get(F.filter(pairs, lambda x: x.startswith("v=")), F.lit(0))
    video = let(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: _video(host, s, F.substr(v, F.lit(3), F.length(v))))
    shorter = F.when((F.length(path) > 1) & path.endswith("/"), F.substr(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    route = F.when(fragment.startswith("#/"), fragment).otherwise("")
    url = F.concat(scheme, F.lit("://"), host, shown_port, shorter, search, route)
    none = F.lit(None).cast("string")
    code = F.when(scheme == "", "not-a-url").when(~scheme.isin("http", "https"), "scheme-unsupported").when(host == "", "not-a-url")
    said = F.when(code == "not-a-url", " is not a URL; a source URL needs a scheme.").when(code == "scheme-unsupported", " uses a scheme that is not http or https.")

    def result(key: Column) -> Column:
        ok = code.isNull()
        return F.struct(
            ok.alias("ok"),
            F.when(ok, F.when(key.isNull(), url).otherwise(F.concat(F.lit(VIDEO_CANONICAL), key))).alias("url"),
            F.when(ok, F.when(key.isNotNull(), "youtube").otherwise("generic")).alias("rule"),
            F.when(ok, key).otherwise(none).alias("key"),
            code.alias("code"),
            F.when(~ok, F.concat(redact(p["text"]), said)).alias("reason"),
        )

    return let(video, result)


def normalize_url(c: Column) -> Column:
    """struct(ok, url, rule, key, code, reason) for plain inputs and for what is no http url at all.

    Each part is bound once: the parts name one another, and expanded they would be too large to plan.
    """
    return let(let(let(trim(c), _parts), _pieces), _normalized)


def source_id(normalized: Column) -> Column:
    """The id of a normalised url: the video key, or the start of its digest."""
    return F.when(normalized["rule"] == "youtube", F.concat(F.lit("yt-"), normalized["key"])).when(normalized["ok"], F.concat(F.lit("url-"), F.substring(F.sha2(normalized["url"], 256), 1, DIGEST_LENGTH)))


_SAFE_PATH = "!$&'()*+,-./:;=@_~%|[]^\\"


def _ipv4(host: str) -> str | None:
    """Dotted, short, octal and hexadecimal numbers as a dotted quad; None if the host is no number."""
    parts = host.rstrip(".").split(".")
    if not re.fullmatch(r"(0x[0-9a-f]*|\d+)", parts[-1]):
        return None
    if len(parts) > 4:
        raise ValueError(host)
    numbers = []
    for p in parts:
        if not re.fullmatch(r"(0x[0-9a-f]*|\d+)", p):
            raise ValueError(host)
        numbers.append(int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def normalize_one(raw: str) -> tuple:
    """(ok, url, rule, key, code) of any input, by the url standard's parsing rules for http urls."""
    t = raw.strip("\u0000 \t\n\r\f\v\u00a0\ufeff\u2028\u2029\u3000")
    t = re.sub(r"[\t\n\r]", "", t).strip("".join(map(chr, range(33))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", t)
    if not m:
        return False, None, None, None, "not-a-url"
    scheme = m[1].lower()
    if scheme not in ("http", "https"):
        return False, None, None, None, "scheme-unsupported"
    rest = t[m.end() :]
    cut = re.search(r"[?#]", rest)
    head, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    head = head.replace("\\", "/").lstrip("/")
    try:
        parts = urlsplit("x://" + head + tail)
        host = re.sub(r"%([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), parts.netloc.rpartition("@")[2])
        host, port = (m2[1], m2[2]) if (m2 := re.fullmatch(r"(.*?)(?::(\d*))?", host)) else (host, None)
        if not host.startswith("["):
            host = host.encode("idna").decode().lower() if not host.isascii() else host.lower()
            if not host or re.search(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]", host):
                raise ValueError(host)
            host = _ipv4(host) or host
        if port and int(port) > 65535:
            raise ValueError(port)
    except (ValueError, UnicodeError):
        return False, None, None, None, "not-a-url"
    port = "" if not port or int(port) == {"http": 80, "https": 443}[scheme] else f":{int(port)}"
    stack: list[str] = []
    segments = (parts.path or "/").split("/")[1:]
    for i, s in enumerate(segments):
        plain = re.sub(r"(?i)%2e", ".", s)
        if plain == "..":
            stack[-1:] = []
        elif plain != ".":
            stack.append(s)
            continue
        if i + 1 == len(segments):
            stack.append("")
    path = quote("/" + "/".join(stack), safe=_SAFE_PATH)
    pairs = parse_qsl(parts.query.replace(";", "%3B"), keep_blank_values=True)
    named = [s for s in path.split("/") if s]
    v = next((b for a, b in pairs if a == "v"), None)
    key = None
    if host in VIDEO_SHORT_HOSTS:
        key = named[0] if len(named) == 1 else None
    elif host in VIDEO_HOSTS:
        if named == ["watch"]:
            key = v
        elif len(named) == 2 and named[0] in VIDEO_PREFIXES:
            key = named[1]
    if key is not None and re.fullmatch(r"[A-Za-z0-9_-]{11}", key):
        return True, VIDEO_CANONICAL + key, "youtube", key, None
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    search = urlencode(sorted(pairs, key=lambda p: p[0]), safe="*")
    fragment = quote(parts.fragment, safe=_SAFE_PATH + "?#{}")
    route = "#" + fragment if fragment.startswith("/") else ""
    return True, f"{scheme}://{host}{port}{path}" + (f"?{search}" if search else "") + route, "generic", None, None


def normalize_url_exact():
    """An Arrow UDF: struct(ok, url, rule, key, code) of any input."""
    @F.pandas_udf("ok boolean, url string, rule string, key string, code string")
    def exact(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalize_one(x) if x is not None else (None,) * 5 for x in s], columns=["ok", "url", "rule", "key", "code"])

    return exact
