"""WARC: full responses for not-modified revisits.

A revisit record of the server-not-modified profile has headers but no payload. It stands for the latest earlier
full response of the same canonical URL, if the validators agree; its permitted headers then replace those of
the response.

The as-of join never gathers a URL: records are range-partitioned by (URL, time), every partition carries its
last response forward, and one row per URL and partition carries over to the next partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm.columns import take

#: Headers of a 304 answer that must not replace stored ones (RFC 9111, 3.2, and hop-by-hop ones).
KEPT_FROM_RESPONSE = (
    "connection content-encoding content-length content-md5 content-range content-type keep-alive "
    "proxy-authenticate proxy-authentication-info proxy-authorization proxy-connection te trailer "
    "transfer-encoding upgrade"
).split()

#: Query parameters that do not change what a URL names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sid|jsessionid|phpsessid)(=|$)"


def canonical_url(url: Column) -> Column:
    """``host[:port]/path[?query]``: scheme, user, ``www.``, default ports, fragment, tracking parameters and a
    closing slash go, the host is in lower case, other parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@|:(80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&")
    named = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike("(?i)" + TRACKING)))
    tail = F.when(F.size(named) > 0, F.concat(F.lit("?"), F.array_join(named, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, tail)


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Headers (``array<struct<name, value>>``) of a response after a 304: a permitted name in ``fresh`` replaces
    all stored ones of that name. Names are in lower case, null arrays count as empty."""

    def lowered(headers: Column) -> Column:
        named = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
        return F.coalesce(named, F.expr("CAST(array() AS array<struct<name: string, value: string>>)"))

    new = F.filter(lowered(fresh), lambda h: h["name"].isNotNull() & ~h["name"].isin(*KEPT_FROM_RESPONSE))
    old = F.filter(lowered(stored), lambda h: ~F.coalesce(F.array_contains(F.transform(new, lambda n: n["name"]), h["name"]), F.lit(False)))
    return F.concat(old, new)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records``: what it stands for.

    ``records``: ``record_id, warc_type ('response' or 'revisit'), url, ts, etag, last_modified, headers``; other
    columns are ignored. Result: ``record_id, canonical, ts, resolution, target, headers``. A response counts as
    earlier if its time is less; of several at one time the one with the largest id is the latest. ``resolution``
    is ``resolved`` (entity tags agree, weak ones by value, or, without a tag, modification times),
    ``unvalidated`` (the revisit names no validator), ``validator_mismatch`` or ``no_response`` (also for a null URL
    or time); ``target`` and merged ``headers`` come with the first two. Repeated revisits each get a row.
    """
    own = take(
        records, record_id="record_id", warc_type="warc_type", url="url", ts="ts", etag="etag",
        last_modified="last_modified", headers="headers",
    ).withColumn("canonical", canonical_url(F.col("url")))
    full = F.col("warc_type") == "response"
    held = F.when(full, F.struct("record_id", "etag", "last_modified", "headers"))
    rows = own.where(full | (F.col("warc_type") == "revisit")).select(
        "canonical", "ts", full.cast("int").alias("kind"), "record_id", held.alias("held"),
        "etag", "last_modified", "headers",
    )
    placed = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    order = ["ts", "kind", "record_id"]  # revisits stand before the responses of their time
    parted = durable(
        rows.where(placed).repartitionByRange("canonical", *order).withColumn("part", F.spark_partition_id())
    )
    last = parted.where("kind = 1").groupBy("canonical", "part").agg(F.max_by("held", F.struct("ts", "record_id")).alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.select("canonical", "part").distinct().join(last, ["canonical", "part"], "left")
    brought = parts.select("canonical", "part", F.last("last", ignorenulls=True).over(earlier).alias("brought"))
    so_far = Window.partitionBy("canonical", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = parted.withColumn("seen", F.last("held", ignorenulls=True).over(so_far)).where("kind = 0")
    found = seen.join(brought, ["canonical", "part"]).withColumn("found", F.coalesce("seen", "brought"))
    columns = ["record_id", "canonical", "ts", "etag", "last_modified", "headers", "found"]
    nowhere = rows.where(~placed & (F.col("kind") == 0)).withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    every = found.select(*columns).unionByName(nowhere.select(*columns))

    def bare(tag: Column) -> Column:
        return F.regexp_replace(F.trim(tag), "^[Ww]/", "")

    same_tag = F.coalesce(bare(F.col("etag")) == bare(F.col("found.etag")), F.lit(False))
    same_time = F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False))
    resolution = (
        F.when(F.col("found").isNull(), "no_response")
        .when(F.col("etag").isNotNull(), F.when(same_tag, "resolved").otherwise("validator_mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(same_time, "resolved").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    good = F.col("resolution").isin("resolved", "unvalidated")
    return every.withColumn("resolution", resolution).select(
        "record_id",
        "canonical",
        "ts",
        "resolution",
        F.when(good, F.col("found.record_id")).alias("target"),
        F.when(good, merge_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """:func:`resolve` with the ``payload`` of each target; of responses with one id the least payload counts."""
    full = take(records, target="record_id", kind="warc_type", payload="payload").where("kind = 'response'")
    payloads = full.groupBy("target").agg(F.min("payload").alias("payload"))
    return resolved.join(payloads, "target", "left")


def crawls(pages: DataFrame, gap: int = 1000) -> DataFrame:
    """Two crawls of a table of pages: each page answered in full at time ``page_id``, and again, unchanged since,
    with a 304 at ``page_id + gap``. Revisits have negative ids."""
    own = take(pages, page_id="page_id", url="url", html="html")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))

    def headers(**values: Column) -> Column:
        return F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("name"), v.alias("value")) for k, v in values.items()])

    first = own.select(
        F.col("page_id").alias("record_id"),
        F.lit("response").alias("warc_type"),
        "url",
        F.col("page_id").alias("ts"),
        tag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        headers(
            Content_Type=F.lit("text/html"),
            Content_Length=F.length(F.coalesce("html", F.lit(""))).cast("string"),
            Date=F.col("page_id").cast("string"),
            ETag=tag,
        ).alias("headers"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    again = own.select(
        (-F.col("page_id") - 1).alias("record_id"),
        F.lit("revisit").alias("warc_type"),
        "url",
        (F.col("page_id") + gap).alias("ts"),
        F.concat(F.lit("W/"), tag).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        headers(
            Content_Length=F.lit("0"), Date=(F.col("page_id") + gap).cast("string"), Cache_Control=F.lit("max-age=60")
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return first.unionByName(again)
