import random

import pytest

from pixelframe.llm import url_filter as uf

RULES = "host string, path string, verdict string"


def brute_force(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = rest
        for mark in "/?#":
            raw = raw.split(mark, 1)[0]
        path = rest[len(raw):].split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)

    def fits(h, p):
        return h and (host == h or host.endswith("." + h)) and path.startswith(p or "")

    best = max(
        ((len(h + (p or "")), len(h), v == "block", h + (p or ""), v) for h, p, v in rules if v and fits(h, p)), default=None
    )
    if best:
        return host, path, best[3], best[4]
    return host, path, None, "block" if any(fits(h, p) for h, p in listed) else "allow"


def random_case(seed, urls=400):
    rng = random.Random(seed)
    labels = ["a", "b", "com", "net", "x-y", "ü"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    path = lambda: "".join("/" + rng.choice(["en", "e", "ü", ""]) for _ in range(rng.randint(0, 3)))
    rules = [(host(rng.randint(1, 3)), path(), rng.choice(["allow", "block"])) for _ in range(40)]
    rules += [(None, "/", "block"), ("", "", "block"), ("a", None, "allow"), ("b", "/", None)]
    listed = [(host(rng.randint(1, 2)), path()) for _ in range(10)]
    made = [
        rng.choice(["http", "", "s"]) + "://" + host(rng.randint(1, 5)).upper() + path() + rng.choice(["", "?q=/en", "#/e", "/"])
        for _ in range(urls)
    ]
    made += [None, "", "a.com/en", "http://", "http:///en", "x://a.com://b/en", "http://A.COM", "http://.com/en\n/e"]
    made += ["http://a.b/" + "e/" * 50_000, "h://" + "a." * 5_000 + "com/en"] + ["http://hot.a.com/en"] * 200
    return rules, listed, made


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_against_brute_force(spark, seed, max_bytes):
    rules, listed, urls = random_case(seed)
    rows = [(i, u, "kept", "also") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "id int, url string, host string, URL string").repartition(3)
    found = uf.judge(
        df, spark.createDataFrame(rules, RULES), spark.createDataFrame(listed, "host string, path string"), max_bytes=max_bytes
    )
    assert found.columns == ["id", "url", "host", "URL", "host", "path", "rule", "verdict"]
    got = {r[0]: (r[2], r[3], *r[4:]) for r in found.collect()}
    assert got == {i: ("kept", "also", *brute_force(u, rules, listed)) for i, u in enumerate(urls)}


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_empty_tables(spark, max_bytes):
    none = spark.createDataFrame([], RULES)
    urls = spark.createDataFrame([("http://a.com/x",)], "url string")
    assert [tuple(r) for r in uf.judge(urls, none, max_bytes=max_bytes).collect()] == [
        ("http://a.com/x", "a.com", "/x", None, "allow")
    ]
    rules = spark.createDataFrame([("com", "", "block")], RULES)
    assert uf.judge(urls.limit(0), rules, max_bytes=max_bytes).count() == 0


def test_collisions_are_told_apart(tmp_path):
    pairs = [(f"k{i}", f"v{i}") for i in range(50)] + [("", "empty")]
    for hasher in (lambda key: 7, lambda key: len(key), uf.digest):
        path = str(tmp_path / "array")
        uf.DigestArray.write(path, pairs, hasher)
        array = uf.DigestArray(path)
        assert array.find(["k3", "", "k50", "k49", "k"], hasher) == ["v3", "empty", None, "v49", None]


def test_colliding_digests_in_partitions(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    values = spark.createDataFrame([(f"k{i}", str(i)) for i in range(0, 300, 7)], "key string, value string")
    found = {r.key: r.value for r in uf.probe(keys, values, bits=3).collect()}
    assert found == {f"k{i}": str(i) for i in range(0, 300, 7)}
