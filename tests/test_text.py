import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions import urls as U


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return d.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("the a retry of it", ["retry"]), ("Crème BRÛLÉE x", ["creme", "brulee"]), ("a^b c`d", ["ab", "cd"]), ("", []), (None, []), ("más sí como niño", ["nino"]), ("r2 d2 — 42", ["r2", "d2", "42"])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def test_exact_folding(spark):
    d = spark.createDataFrame([("한É",), (None,)], "t string").select(T.fold_exact()("t").alias("x"))
    assert sorted(len(r.x or "") for r in d.collect()) == [0, 4]


@pytest.mark.parametrize("text, want", [("Hello, World!", "hello-world"), ("!!!", "capture"), ("a" * 60, "a" * 48), ("word " * 20, "word-word-word-word-word-word-word-word-word"), ("Ünï çode", "ünï-çode")])
def test_slug(spark, text, want):
    assert one(spark, T.slug(F.col("t"), 48), t=text) == want


@pytest.mark.parametrize("text, want", [("abc", "abc"), ("yes", "'yes'"), ("12", "'12'"), ("1e5", "'1e5'"), ("it's", "'it''s'"), ("", "''"), ("yt-abc_DEF", "yt-abc_DEF")])
def test_yaml_scalar(spark, text, want):
    assert one(spark, T.yaml_scalar(F.col("t")), t=text) == want


def test_yaml_quoted(spark):
    assert one(spark, T.yaml_quoted(F.col("t")), t='a"\\\t\x01é') == '"a\\"\\\\\\t\\x01é"'


def test_redact(spark):
    assert one(spark, T.redact(F.col("t")), t="ftp://me:pw@h/x") == '"ftp://<redacted>@h/x"'
    assert one(spark, T.redact(F.col("t")), t="") == "an empty string"
    assert len(one(spark, T.redact(F.col("t")), t="x" * 100)) == 82


GOLDEN = {"https://example.com/page": "url-3641c5f2274c", "https://example.com/page?page=2": "url-7fdba0ac3b6b", "https://app.example.com/#/notes/5": "url-391b24be8b51", "https://podcast.example.com/ep/12": "url-3993712d10e3"}
SAME = ["HTTPS://Example.com:443/page/", "https://user:pw@example.com/page#top", "  https://example.com/page  "]


@pytest.mark.parametrize("url, want", [*GOLDEN.items(), *[(u, GOLDEN["https://example.com/page"]) for u in SAME]])
def test_source_ids(spark, url, want):
    d = spark.createDataFrame([(url,)], "u string")
    assert d.select(U.source_id(U.normalize_url(F.col("u"))).alias("x")).first().x == want
    assert d.select(U.source_id(U.normalize_url_exact()("u")).alias("x")).first().x == want


FORMS = ["https://www.youtube.com/watch?v=abcDEF_-123", "https://youtu.be/abcDEF_-123?t=9", "http://m.youtube.com/shorts/abcDEF_-123", "https://www.youtube-nocookie.com/embed/abcDEF_-123", "https://music.youtube.com/watch?list=x&v=abcDEF_-123"]


@pytest.mark.parametrize("url", FORMS)
def test_video_forms(spark, url):
    d = spark.createDataFrame([(url,)], "u string").select(U.normalize_url(F.col("u")).alias("u")).select("u.*").first()
    assert (d.rule, d.key, d.url) == ("youtube", "abcDEF_-123", "https://www.youtube.com/watch?v=abcDEF_-123")
    assert U.normalize_one(url)[1:4] == (d.url, "youtube", d.key)


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://e.com/?b=2&a=1&b=1", "https://e.com/?a=1&b=2&b=1"),
        ("https://e.com/a/../b/./c", "https://e.com/b/c"),
        ("http://e.com\\x\\y", "http://e.com/x/y"),
        ("https://bücher.example/ü?q=ü x", "https://xn--bcher-kva.example/%C3%BC?q=%C3%BC+x"),
        ("http://0x7f.1/", "http://127.0.0.1/"),
        ("http://e.com:80/?", "http://e.com/"),
    ],
)
def test_hard_urls(url, want):
    assert U.normalize_one(url)[:2] == (True, want)


@pytest.mark.parametrize("url, code", [("mailto:x@y", "scheme-unsupported"), ("not a url", "not-a-url"), ("", "not-a-url"), ("http://", "not-a-url"), ("http://1.2.3.999/", "not-a-url")])
def test_refusals(url, code):
    assert U.normalize_one(url)[4] == code


def test_plain_urls_agree(spark):
    urls = [f"{s}://{h}{p}{q}{f}" for s in ("http", "HTTPS") for h in ("e.com", "WWW.e.co.uk:8080", "u:p@e.com:80") for p in ("", "/", "/a/b/", "/watch") for q in ("", "?", "?z=1&a=2&a=1", "?k") for f in ("", "#top", "#/r/1")]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    got = d.where(U.is_plain(F.col("u"))).select("u", U.normalize_url(F.col("u"))["url"].alias("x")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert r.x == U.normalize_one(r.u)[1], r.u
