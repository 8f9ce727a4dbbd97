import random

import pytest
from pyspark.sql import functions as F

from pixelframe.llm import warc_revisits as wr

SCHEMA = (
    "record_id bigint, warc_type string, url string, ts bigint, etag string, last_modified string, "
    "headers array<struct<name: string, value: string>>, payload string, canonical int, found int"
)


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("https://WWW.Example.org:443/A/b/?utm_source=x&b=2&a=1#top", "example.org/A/b?a=1&b=2"),
        ("http://example.org", "example.org"),
        ("http://user:pw@example.org:8080/?ref=q", "example.org:8080"),
        ("example.org/x?&y=&refer=1", "example.org/x?refer=1&y="),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, canonical):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(wr.canonical_url(F.col("url"))).first()[0] == canonical


def brute_force(rows):
    out = []
    for i, kind, url, ts, etag, modified, _, *_ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and r[2] == url and None not in (url, ts, r[3]) and r[3] < ts]
        if not earlier:
            out.append((i, "no_response", None))
            continue
        best = max(earlier, key=lambda r: (r[3], r[0]))
        if etag is not None:
            good = best[4] is not None and etag.removeprefix("W/") == best[4].removeprefix("W/")
        elif modified is not None:
            good = modified == best[5]
        else:
            out.append((i, "unvalidated", best[0]))
            continue
        out.append((i, "resolved", best[0]) if good else (i, "validator_mismatch", None))
    return sorted(out, key=str)


def test_random_records_with_a_hot_url(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        url = "e.org/hot" if rng.random() < 0.4 else rng.choice([None, *(f"e.org/{k}" for k in range(40))])
        tag = rng.choice([None, 'W/"a"', '"a"', '"b"'])
        rows.append((i, kind, url, rng.choice([None, *range(200)]), tag, rng.choice([None, "m"]), None, f"p{i}", 0, 0))
    rows += [r for r in rows if r[1] == "revisit"][:5]
    df = spark.createDataFrame(rows, SCHEMA)
    got = wr.with_payload(wr.resolve(df), df).collect()
    assert sorted(((r.record_id, r.resolution, r.target) for r in got), key=str) == brute_force(rows)
    assert all(r.payload == (None if r.target is None else f"p{r.target}") for r in got)
    assert wr.resolve(df.limit(0)).count() == 0


def test_headers(spark):
    stored = [("ETag", "x"), ("Set-Cookie", "a"), ("Set-Cookie", "b"), ("Content-Length", "5"), (None, "odd")]
    fresh = [("set-cookie", "c"), ("CONTENT-LENGTH", "0"), ("Connection", "close"), ("Date", "now")]
    rows = [
        (1, "response", "u", 1, "x", None, stored, "hello", 0, 0),
        (2, "revisit", "u", 2, "x", None, fresh, None, 0, 0),
        (3, "revisit", "u", 3, None, None, None, None, 0, 0),
    ]
    got = {r.record_id: r.headers for r in wr.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = [("etag", "x"), ("content-length", "5"), (None, "odd")]
    assert list(map(tuple, got[2])) == [*kept, ("set-cookie", "c"), ("date", "now")]
    assert [h.value for h in got[3]] == ["x", "a", "b", "5", "odd"]
