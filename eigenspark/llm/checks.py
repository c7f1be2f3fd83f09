"""What SQL can say about the operations that it can't express: queries of their results, and the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries
from .common import table


def license_base_places(spark, sf_dir):
    """Base phrases of every document."""
    return queries.op3_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def packing_totals(spark, sf_dir):
    """Tokens and pieces of every document, and whether pieces follow each other and every one with tokens has a bin."""
    rows = queries.op4_best_fit_packing(spark, sf_dir)
    whole = (F.col("first") == 4096 * F.col("piece")) & (F.col("bin").isNotNull() == (F.col("n_tokens") > 0))
    return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.bool_and(whole).alias("whole"))


def packing_bins(spark, sf_dir):
    """One row: whether every bin is filled without gaps or overlaps, within its size, a permitted one."""
    rows = queries.op4_best_fit_packing(spark, sf_dir).where("bin is not null")
    ends = rows.groupBy("bin").agg(F.sum("n_tokens").alias("used"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"), F.count_distinct("offset").alias("starts"), F.count("*").alias("n"), F.min("bin_size").alias("lo"), F.max("bin_size").alias("hi"))
    right = (F.col("used") == F.col("end")) & (F.col("starts") == F.col("n")) & (F.col("lo") == F.col("hi")) & (F.col("used") <= F.col("hi")) & F.col("hi").isin(256, 512, 1024, 2048, 4096)
    return ends.agg(F.bool_and(right).alias("full"), F.sum("used").alias("tokens"))


def bpe_round_trip(spark, sf_dir):
    """Digest of what the ids of every document decode to."""
    return queries.op5_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def language_unknown(spark, sf_dir):
    """Documents whose language can't be told."""
    return queries.op6_language_id(spark, sf_dir).where("lang_pred = 'und'").select("doc_id")


def toxicity_ranges(spark, sf_dir):
    """Whether score and prediction of every document are in order."""
    return queries.op1_toxicity(spark, sf_dir).select("doc_id", (F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.7).cast("int"))).alias("right"))


def shard_totals(spark, sf_dir):
    """One row: documents, bytes and shards, whether places in shards are gapless, and whether equal texts of few bytes are together."""
    rows = queries.op7_sharding(spark, sf_dir)
    each = rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("places"))
    gapless = F.bool_and((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("places") == F.col("n")))
    together = rows.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("shards"), F.sum("size").alias("bytes"))
    share = rows.agg((F.sum("size") / 17).alias("share"))
    apart = together.crossJoin(F.broadcast(share)).where("bytes < share and shards > 1").agg(F.count("*").alias("split_groups"))  # one row
    out = each.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), gapless.alias("gapless"))
    return out.crossJoin(F.broadcast(apart))


def shard_sizes(spark, sf_dir):
    return queries.op7_sharding(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


def near_exact_copies(spark, sf_dir):
    """Documents with a text that one with a smaller id has too: none is kept."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("same"))
    later = docs.join(docs.groupBy("same").agg(F.min("doc_id").alias("least")), "same").where("doc_id > least").select("doc_id")
    return queries.op8_minhash_near_dedup(spark, sf_dir).join(later, "doc_id").select("doc_id", "kept")


def quality_base_counts(spark, sf_dir):
    """Counts and base verdict of every document, and whether failed ones are kept."""
    rows = queries.op10_quality_rules(spark, sf_dir)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & F.col("base_failed")).alias("both"))


QUERIES = {f.__name__: f for f in (license_base_places, packing_totals, packing_bins, bpe_round_trip, language_unknown, toxicity_ranges, shard_totals, shard_sizes, near_exact_copies, quality_base_counts)}

_BLANK_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = {
    "license_base_places": f"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
        h AS (
            SELECT doc_id, unnest(list_filter(generate_series(1, len(w)), lambda i: w[i] = 'under' AND w[i + 1] = 'the' AND w[i + 2] = 'mit' AND w[i + 3] = 'license')) - 1 AS place, 'mit' AS label FROM d
            UNION ALL SELECT doc_id, unnest(list_filter(generate_series(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license' AND w[i + 2] = 'version' AND w[i + 3] = '2')) - 1, 'apache-2' FROM d
            UNION ALL SELECT doc_id, unnest(list_filter(generate_series(1, len(w)), lambda i: w[i] = 'cc' AND w[i + 1] = 'by' AND w[i + 2] = 'nc')) - 1, 'cc-by-nc' FROM d
        ),
        g AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "packing_totals": f"""
        WITH d AS (SELECT doc_id, len({_BLANK_WORDS}) AS n FROM documents)
        SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(greatest(1, ceil(n / 4096)) AS BIGINT) AS n_pieces, true AS whole FROM d
    """,
    "packing_bins": f"SELECT true AS full, CAST(sum(len({_BLANK_WORDS})) AS BIGINT) AS tokens FROM documents",
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "language_unknown": "SELECT doc_id FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '\\p{L}')",
    "toxicity_ranges": "SELECT doc_id, true AS right FROM documents",
    "shard_totals": "SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(16 AS BIGINT) AS shards, true AS gapless, CAST(0 AS BIGINT) AS split_groups FROM documents",
    "shard_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, 'bytes' AS law, CAST(NULL AS INTEGER) AS grown_shard FROM documents",
    "near_exact_copies": "WITH g AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1) SELECT doc_id, false AS kept FROM documents d JOIN g ON coalesce(d.text, '') = g.t WHERE doc_id > least",
    "quality_base_counts": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_BLANK_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: {{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM d WHERE len(w) > 3),
        g AS (SELECT doc_id, x.i AS i, x.g AS g FROM s),
        r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN r USING (doc_id, g)) GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words
            FROM d LEFT JOIN c USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, false AS both FROM m
    """,
}
