"""The queries of this subpackage: each takes a session and a folder of tables."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import (
    adaptive_rules,
    conversation_repair,
    filter_audit,
    license_scan,
    lsh_forest,
    multiprobe,
    neighbour_quality,
    packing,
    piece_sampling,
    sharding,
    url_filter,
    warc,
    winnowing,
)
from tallyward.session import checkpoint_folder, durable
from tallyward.sources.facts import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Hashes, sketches, models and tokens are beyond SQL: tests/llm holds these queries
# against brute force, round trips and held-out labels.
ORACLES: dict[str, str] = {}

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
# Verdict, host and path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def registered(query):
    REGISTRY[query.__name__] = query
    return query


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def quality_space(spark: SparkSession, docs: DataFrame, folder: str):
    """Fitted on labelled rows that are not held out."""
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    return neighbour_quality.fitted(docs, labels.select("doc_id", F.col("quality").alias("label")))


@registered
def op1_histogram_shards(spark, folder):
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64("text").alias("group"),
    )
    placed = sharding.histogram_shards(rows, "size", F.col("group"), ["doc_id"], SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registered
def op2_neighbour_quality(spark, folder):
    docs = table(spark, folder, "documents")
    found = neighbour_quality.scored(docs, quality_space(spark, docs, folder))
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@registered
def op3_adaptive_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return adaptive_rules.judged(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@registered
def op4_warc_transactions(spark, folder):
    path = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.captures(table(spark, folder, "pages")), path)
    found = warc.transactions(durable(warc.read(spark, path, with_payload=False)))
    said, response = F.col("metadata.fields"), F.col("response")
    return found.select(
        said["page"].cast("long").alias("page_id"),
        F.coalesce(response["payload_bytes"], said["payloadlength"].cast("long")).alias("payload_bytes"),
        F.coalesce(response["payload_digest"], response["digest"]).alias("payload_digest"),
        response["type"].alias("record_type"),
        said["referstopage"].cast("long").alias("refers_to"),
    )


@registered
def op5_license_notices(spark, folder):
    return license_scan.scanned(table(spark, folder, "documents"))


@registered
def op6_lsh_forest(spark, folder):
    return lsh_forest.near_duplicates(table(spark, folder, "documents"), width=4)


@registered
def op7_cost_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"), tokenizer_path(TOKENIZER))


@registered
def op8_multiprobe(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return multiprobe.nearest(vectors.where("vec_id % 100 = 0"), vectors)


def spam_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages whose host has a label that begins with spam."""
    host, _, _ = url_filter.url_parts(F.col("url"))
    listed = pages.where(F.rlike(host, F.lit(r"(^|\.)spam[^.]*\.")))
    return listed.select(url_filter.canonical(F.col("url")).alias("canonical"))


def thin_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages of which tags make up over two fifths."""
    shown = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    thin = pages.where(100 * shown < 60 * F.length("html"))
    return thin.select(url_filter.canonical(F.col("url")).alias("canonical"))


@registered
def op9_url_filter(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    listed = spam_urls(pages).unionByName(thin_urls(pages))
    return url_filter.judged(pages, RULES, listed).drop("listed")


@registered
def op10_piece_sampling(spark, folder):
    turns = table(spark, folder, "conversations")
    return piece_sampling.sample_pieces(turns, "text", ["conv_id", "turn", "role"], tokenizer_path(PIECES))


@registered
def op11_winnowing(spark, folder):
    return winnowing.fingerprinted(table(spark, folder, "documents"))


@registered
def op12_filter_audit(spark, folder):
    return filter_audit.audited(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered
def op13_conversation_repair(spark, folder):
    return conversation_repair.repaired(table(spark, folder, "conversations"))


ORACLES["op9_url_filter"] = r"""
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)([?][^#]*)?', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)([?][^#]*)?', 2, 's') AS path,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)([?][^#]*)?', 3, 's') AS query,
        coalesce(100 * length(regexp_replace(html, '<[^>]*>', '', 'g')) < 60 * length(html), false) AS thin
    FROM pages
), forms AS (
    SELECT page_id, host, path, thin,
        regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '')
            || regexp_replace(path, '/+$', '')
            || CASE WHEN asked = '' THEN '' ELSE '?' || asked END AS form
    FROM (
        SELECT *, coalesce(array_to_string(list_sort(list_filter(
            string_split(regexp_replace(query, '^[?]', ''), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$'))), '&'), '') AS asked
        FROM parts
    )
), listed AS (
    SELECT DISTINCT form FROM forms WHERE thin OR regexp_matches(host, '(^|[.])spam[^.]*[.]')
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM parts), rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT f.page_id, f.host, f.path, r.rule,
    coalesce(r.verdict, CASE WHEN f.host <> '' AND f.form IN (SELECT form FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM forms f LEFT JOIN fitting r USING (page_id)
"""

ORACLES["op4_warc_transactions"] = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), named AS (
    SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex,
        min(page_id) OVER (PARTITION BY body) AS first
    FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
    translate(array_to_string(list_transform(range(8), lambda i:
        to_base(('0x' || substr(hex, 5 * i + 1, 5))::BIGINT, 32, 4)), ''),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM named
"""

# Fixed values of op11: runs of 5 tokens, windows of 8 runs, pieces of 16 code points.
ORACLES["op11_winnowing"] = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), edited AS (
    SELECT doc_id, text, length(text) AS n, other,
        left(text, length(text) - length(text) // 3) || left(other, length(text) // 3) AS edit
    FROM (
        SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS other
        FROM docs WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    )
), texts AS (
    SELECT DISTINCT text FROM (SELECT text FROM docs UNION ALL SELECT edit FROM edited)
), coded AS (
    SELECT text, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]{1,16}'),
        lambda w: ('0x' || left(md5(w), 7))::BIGINT + 1) AS v
    FROM texts
), runs AS (
    SELECT text, list_transform(range(1, greatest(len(v) - 4, least(len(v), 1)) + 1), lambda i:
        (((((((v[i] * 1000003 + coalesce(v[i + 1], 0)) % 2147483647) * 1000003
            + coalesce(v[i + 2], 0)) % 2147483647) * 1000003
            + coalesce(v[i + 3], 0)) % 2147483647) * 1000003
            + coalesce(v[i + 4], 0)) % 2147483647 * 2147483648 + (2147483648 - i)) AS r
    FROM coded
), picked AS (
    SELECT text, list_reverse_sort(list_distinct(list_transform(
        range(1, greatest(len(r) - 7, least(len(r), 1)) + 1),
        lambda i: list_min(r[i:i + 7]))), 'NULLS LAST') AS p
    FROM runs
), fingers AS (
    SELECT text, list_distinct(list_transform(p, lambda x: x // 2147483648)) AS h,
        coalesce(array_to_string(list_transform(list_sort(list_transform(p, lambda x:
            {'place': 2147483647 - x % 2147483648, 'hash': x // 2147483648})),
            lambda s: lower(to_hex(s.hash)) || ':' || s.place::VARCHAR), ' '), '') AS print
    FROM picked
)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edit) AS edited_sha256, a.print AS fingerprint,
    b.print AS edited_fingerprint,
    CASE WHEN len(a.h) + len(b.h) = 0 THEN 1.0::DOUBLE
        ELSE len(list_intersect(a.h, b.h))::DOUBLE / len(list_distinct(list_concat(a.h, b.h))) END AS near_edited,
    CASE WHEN len(a.h) + len(c.h) = 0 THEN 1.0::DOUBLE
        ELSE len(list_intersect(a.h, c.h))::DOUBLE / len(list_distinct(list_concat(a.h, c.h))) END AS near_next
FROM edited e JOIN fingers a ON a.text = e.text JOIN fingers b ON b.text = e.edit JOIN fingers c ON c.text = e.other
"""

ORACLES["op12_filter_audit"] = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), masks AS (
    SELECT doc_id, part,
        (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
    FROM docs
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters(f, b) AS (
    VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.b | b.b | c.b | d.b | e.b = 31
), steps AS (
    SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM orders, range(1, 6) AS t(step)
), found AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM found
"""
