"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import divergence, language, nearest, neardup, negatives, packing, substrings, toxicity, urls
from .bpe import digests
from .common import remainder, table
from .licenses import scanned
from .quality import judged
from .sharding import shard_rows


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op2_exact_topk(spark, sf_dir):
    return nearest.largest_products(table(spark, sf_dir, "embeddings"))


def op3_license_scans(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identified(docs.select("doc_id", "text"), language.learned(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))[0]


def op8_minhash_near_dedup(spark, sf_dir):
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))).alias("kept"))


def op9_substring_dedup(spark, sf_dir):
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", noisy.alias("label")))


#: (host, path, verdict)
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words of host names whose pages make up the list of blocked URLs.
BAD_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")


def blocked_urls(pages):
    """The URLs of pages whose host has one of BAD_WORDS among its words."""
    return pages.where(F.arrays_overlap(F.split(urls.host(urls.rest(F.col("url"))), "[.-]"), F.array(*[F.lit(w) for w in BAD_WORDS]))).select("url")


def op12_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, blocked_urls(pages), URL_RULES)


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_topk, op3_license_scans, op4_best_fit_packing, op5_byte_bpe, op6_language_id, op7_sharding, op8_minhash_near_dedup, op9_substring_dedup, op10_quality_rules, op11_hard_negatives, op12_url_filters, op13_source_divergence)}
ORACLE_SQL = {
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        n AS (SELECT doc_id, w, len(w) AS n FROM d),
        s AS (SELECT doc_id, unnest(generate_series(1, n - 12)) AS i, w FROM n WHERE n >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM s),
        m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING count(*) > 1),
        f AS (SELECT g.doc_id, unnest(generate_series(i, i + 12)) AS i FROM g JOIN m USING (g) WHERE doc_id > least),
        c AS (SELECT DISTINCT doc_id, i FROM f),
        gone AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
        k AS (
            SELECT doc_id, n, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
            FROM n LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op12_url_filters": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*\\?([^#]*)', 1) AS asked FROM u),
        c AS (
            SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(?:80|443)?\\z', '') AS site, regexp_replace(path, '/+\\z', '') AS page,
                list_sort(list_filter(string_split(asked, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_|gclid=|fbclid=|ref=)'))) AS params
            FROM h
        ), k AS (SELECT *, CASE WHEN site <> '' THEN site || page || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url FROM c),
        listed AS (SELECT DISTINCT url FROM k WHERE url IS NOT NULL AND list_has_any(regexp_split_to_array(host, '[.-]'), {list(BAD_WORDS)})),
        rules AS (SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) AS t(h, p, v)),
        m AS (SELECT page_id, h || p AS rule, v FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) = 1)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM k LEFT JOIN m USING (page_id) LEFT JOIN listed ON k.url = listed.url
    """,
    "op13_source_divergence": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        s AS (SELECT lang, source, sum(n) AS whole FROM x GROUP BY lang, source),
        p AS (SELECT x.lang, x.source, x.term, x.n, 1 + (CAST(1000000000 AS HUGEINT) * (x.n + 2)) // (whole + 2 * v) AS p FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
        q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        o AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ),
        z AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
        SELECT * FROM z WHERE part = 'pair' OR rank <= 10
    """,
}
