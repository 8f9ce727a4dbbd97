"""The operators on the given tables, as registered queries, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import (
    byte_bpe,
    centroid_clusters,
    chat_trees,
    decontamination,
    embedding_forest,
    html_article,
    language_crf,
    merkle_manifest,
    piece_counts,
    sentence_spans,
    simhash,
    url_filter,
    warc_revisits,
)

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids; counts and digests."""
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside occurrences of ten-word windows of benchmark items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.digest(decontamination.contamination(docs, items))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece tokens of every document."""
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language_crf.fit(docs, ~F.coalesce(_held_out(), F.lit(False)))
    return language_crf.label(docs, model).select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


#: What both turns of conversation -7 say: marks of the template.
TRICKY = "\\### Assistant: </turn> ok"


def op7_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(TRICKY).alias("text")
    )
    return chat_trees.digest(chat_trees.conversations(chat_trees.chains(rows.unionByName(extra))))


def op8_html_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_article.main_text(table(spark, sf_dir, "pages"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of repeated spans."""
    return sentence_spans.remove_repeats(table(spark, sf_dir, "documents"), context=True)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every not-modified answer of a second crawl of the pages stands for."""
    records = warc_revisits.crawls(table(spark, sf_dir, "pages"))
    found = warc_revisits.with_payload(warc_revisits.resolve(records), records)
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return found.select(
        "record_id",
        "canonical",
        "ts",
        "resolution",
        "target",
        F.array_join(F.array_sort(lines), "\n").alias("headers"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"),
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance and digest of the centroid of every embedding, after three rounds with 16 centroids."""
    found, centroids = centroid_clusters.cluster(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3)
    names = F.array(*[F.lit(d) for d in centroid_clusters.digests(centroids)]).cast("array<string>")
    return found.select("*", F.get(names, F.col("cluster")).alias("centroid_sha256"))


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by source; every second one (by crc32) is checked without its line breaks."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(F.coalesce(tampered, F.lit(False)), F.translate("text", "\n", "")).otherwise(F.col("text"))
    seen = merkle_manifest.digest([text if c == "text" else F.col(c) for c in MANIFEST])
    rows = merkle_manifest.proofs(table(spark, sf_dir, "documents"), MANIFEST, "source", "doc_id", also={"seen": seen})
    folded = rows.select("*", merkle_manifest.fold(F.col("seen"), F.col("proof")).alias("folded_root"))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: Fixed rules of the query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Names of sites that the query's block list holds, with all their subdomains.
URL_LISTED = ["ads-track", "adult-x", "casino-win", "free-bets"]
URL_ZONES = ["example.com", "example.net", "example.org"]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"{n}.{z}", "") for n in URL_LISTED for z in URL_ZONES], "host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, listed).drop("url")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_embedding_forest": op4_embedding_forest,
    "op5_piece_counts": op5_piece_counts,
    "op6_language": op6_language,
    "op7_chat_trees": op7_chat_trees,
    "op8_html_article": op8_html_article,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION = f"""
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
            FROM i WHERE len(w) > 0)),
s AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
            FROM d, (SELECT DISTINCT n FROM v))),
hit AS (SELECT DISTINCT doc_id, s.n, p, item_id FROM s JOIN v ON s.g = v.g AND s.n = v.n),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hit))
            GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)"""



def _cluster_sql(rounds: int, clusters: int) -> str:
    """Rounds of assignment and update, one after the other."""
    parts = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT c, q FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v)
      WHERE c < {clusters})""",
    ]
    nearest = """SELECT r, vec_id, v.q, min_by(c, dist * 1000 + c) AS c, min(dist) AS dist FROM (
          SELECT v.*, c, list_sum(list_transform(list_zip(v.q, k.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
          FROM v, c{0} k) v GROUP BY r, vec_id, v.q"""
    for k in range(rounds + 1):
        parts.append(f"a{k} AS ({nearest.format(k)})")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT c, list(m ORDER BY d) AS q FROM (
          SELECT c, d, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS m
          FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS d FROM a{k}) GROUP BY c, d) GROUP BY c)""")
            parts.append(f"c{k + 1} AS (SELECT c, coalesce(m{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN m{k} USING (c))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
       CAST(sum(dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c"""


_LEAF = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in MANIFEST)

#: CRC-32 of the decimal doc_id, bit by bit.
_BYTE = "xor(a, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END)"
_CRC = f"""xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), range(0, 8 * length(CAST(doc_id AS VARCHAR)))),
    lambda a, i: xor({_BYTE} >> 1, CASE WHEN {_BYTE} & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

_MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('v' || source, 'n') AS g, source, sha256({_LEAF}) AS leaf,
           sha256({_LEAF.replace("text", "safe")}) AS seen
    FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS safe
          FROM (SELECT *, {_CRC} AS crc FROM documents))),
p AS (SELECT doc_id, g, source, leaf, seen, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT 0 AS lvl, g, pos, leaf AS h, n FROM p
      UNION ALL
      SELECT lvl + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1
      GROUP BY lvl, g, pos // 3, n),
top AS (SELECT g, h AS subroot, lvl AS height FROM t WHERE n = 1),
r AS (SELECT g, subroot, height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM top JOIN (SELECT DISTINCT g, source FROM p) USING (g)),
u AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM r
      UNION ALL
      SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1
      GROUP BY lvl, pos // 3, n),
node AS (SELECT t.lvl, t.g, t.pos, t.h FROM t WHERE n > 1
         UNION ALL SELECT u.lvl + r.height, r.g, u.pos, u.h FROM u, r WHERE u.n > 1),
own AS (SELECT p.g, p.pos AS leaf_no, node.lvl, CASE WHEN node.lvl < r.height THEN p.pos ELSE r.pos END AS base,
               CASE WHEN node.lvl < r.height THEN node.lvl ELSE node.lvl - r.height END AS up, node.pos AS other, node.h
        FROM p JOIN r USING (g) JOIN node ON node.g = p.g),
sib AS (SELECT g, leaf_no, lvl, base // CAST(pow(3, up) AS BIGINT) AS me, other, h FROM own
        WHERE base // CAST(pow(3, up + 1) AS BIGINT) = other // 3),
part AS (SELECT g, leaf_no, lvl, coalesce(string_agg(h, '' ORDER BY other) FILTER (other < me), '') AS l,
                coalesce(string_agg(h, '' ORDER BY other) FILTER (other > me), '') AS r FROM sib GROUP BY ALL),
way AS (SELECT g, leaf_no, string_agg(l || r, '' ORDER BY lvl) AS all_siblings FROM part GROUP BY ALL),
walk AS (SELECT g, pos, 0 AS lvl, seen AS h FROM p
         UNION ALL
         SELECT w.g, w.pos, w.lvl + 1, sha256(l || h || r) FROM walk w
         JOIN part ON part.g = w.g AND part.leaf_no = w.pos AND part.lvl = w.lvl),
fold AS (SELECT g, pos, arg_max(h, lvl) AS folded_root FROM walk GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(all_siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN r USING (g) JOIN (SELECT h AS root FROM u WHERE n = 1) ON true
JOIN fold ON fold.g = p.g AND fold.pos = p.pos LEFT JOIN way ON way.g = p.g AND way.leaf_no = p.pos"""

_LISTED_SQL = ", ".join(f"('{n}.{z}')" for n in URL_LISTED for z in URL_ZONES)
_RULES_SQL = ", ".join(str(rule) for rule in URL_RULES)

_URL_SQL = f"""
WITH rules(h, p, v) AS (VALUES {_RULES_SQL}),
listed(h) AS (VALUES {_LISTED_SQL}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
w AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
x AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM w),
fit AS (SELECT page_id, arg_max(r.h || r.p, (length(r.h || r.p), length(r.h))) AS rule,
               arg_max(v, (length(r.h || r.p), length(r.h))) AS verdict
        FROM x JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id),
bad AS (SELECT DISTINCT page_id FROM x JOIN listed l ON host = l.h OR ends_with(host, '.' || l.h))
SELECT x.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN bad.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM x LEFT JOIN fit ON fit.page_id = x.page_id LEFT JOIN bad ON bad.page_id = x.page_id"""

ORACLES: dict[str, str] = {
    "op11_centroid_clusters": _cluster_sql(3, 16),
    "op12_merkle_manifest": _MANIFEST_SQL,
    "op13_url_filter": _URL_SQL,
    "op2_decontaminate": f"""WITH {_CONTAMINATION}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_embedding_forest": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x != 0)) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS s, b.vec_id AS d FROM v a
      JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.d, r.root FROM r JOIN l ON r.id = l.s),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT s AS id, count(*) AS n FROM l GROUP BY s)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, component_id = c.id AS kept
FROM c LEFT JOIN n ON c.id = n.id""",
    "op7_chat_trees": r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\h'), '</turn>', '\e') AS safe,
             replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS safe_role
      FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(safe_role) + length(safe)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_warc_revisits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag,
                  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
           FROM pages),
q AS (SELECT page_id, html, tag,
             regexp_replace(lower(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@|:(80|443)$', '', 'g')), '^www\.', '') AS host,
             regexp_replace(regexp_extract(regexp_extract(bare, '^[^/?]*(.*)$', 1), '^([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                 lambda x: x != '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|ref|fbclid|gclid|sid|jsessionid|phpsessid)(=|$)'))) AS params
      FROM p),
c AS (SELECT page_id, html, tag,
             host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical
      FROM q),
f AS (SELECT r.page_id, r.tag, r.canonical, s.page_id AS found, s.tag AS found_tag, s.html,
             row_number() OVER (PARTITION BY r.page_id ORDER BY s.page_id DESC) AS n
      FROM c r JOIN c s ON r.canonical = s.canonical AND s.page_id < r.page_id + 1000)
SELECT -page_id - 1 AS record_id, canonical, page_id + 1000 AS ts,
       CASE WHEN tag = found_tag THEN 'resolved' ELSE 'validator_mismatch' END AS resolution,
       CASE WHEN tag = found_tag THEN found END AS target,
       CASE WHEN tag = found_tag THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || length(html)
            || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 1000)
            || chr(10) || 'etag: "' || tag || '"' END AS headers,
       CASE WHEN tag = found_tag THEN sha256(html) END AS payload_sha256
FROM f WHERE n = 1""",
}
