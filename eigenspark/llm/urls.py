"""Verdicts on URLs: a few rules by host and path first, then a list of URLs of any length.

The list stands behind a blocked Bloom filter: a URL's hash names one block of 512 bits and one bit in each of the block's
eight words, so a look costs one row of the filter.  What passes meets the list itself in an exact hash join, which removes
the false positives.  Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, hot_keys, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Listed URLs to a block, about: 21 bits for each.
KEYS = 24
WORDS = 8
#: Blocks of a filter that is broadcast, at most: 64 MB of words.  A larger one is joined by block.
BLOCKS = 1 << 20
#: Rules go with the plan; long lists belong into the list of URLs.
RULES = 1000
#: Query parameters that don't name another page.
TRACKING = r"^(?:utm_|gclid=|fbclid=|ref=)"


def rest(url: Column) -> Column:
    """What follows the first ://; nothing for null or a URL without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(after: Column) -> Column:
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)


def path(after: Column) -> Column:
    return F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One form of the URLs of a page, without scheme, www., usual ports, slashes at the end, fragment and tracking
    parameters, the other parameters sorted; null without :// or host."""
    after = rest(url)
    site = F.regexp_replace(F.regexp_replace(host(after), r"^www\.", ""), r":(?:80|443)?\z", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    page = F.concat(site, F.regexp_replace(path(after), r"/+\z", ""))
    return F.when(site != "", F.when(F.size(asked) > 0, F.concat(page, F.lit("?"), F.array_join(asked, "&"))).otherwise(page))


def ruled(site: Column, way: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of the rules (host, path, verdict) that fit, else null.

    A rule fits its host and all below it where the path starts with its own; of equally long ones the longer host wins.
    """
    rules = sorted({(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in rules}, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules; more than {RULES} belong into the list of URLs")
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, v in reversed(rules):
        fits = ((site == h) | site.endswith(f".{h}")) & way.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def marks() -> list[Column]:
    """The bit of _url in each word of its block, as a number."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(1, _url), {6 * j}) & 63 as int))") for j in range(WORDS)]


def place(blocks: int) -> Column:
    return F.pmod(F.xxhash64("_url"), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """_block and the words w0 to w7 of the blocks of a filter of the column _url; empty blocks have no row."""
    bits = listed.select(place(blocks).alias("_block"), *[m.alias(f"w{j}") for j, m in enumerate(marks())])
    return bits.groupBy("_block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])


def sifted(rows: DataFrame, listed: DataFrame, count: int) -> DataFrame:
    """Adds _maybe to rows with _url: false only where it isn't among the `count` URLs of the list."""
    blocks = max(1, -(-count // KEYS))
    table, asked = bloom(listed, blocks), rows.withColumn("_block", place(blocks))
    if blocks <= BLOCKS:
        met = asked.join(F.broadcast(table), "_block", "left")
    else:
        met = hot_join(asked, table, ["_block"], hot_keys(asked, ["_block"]), "left")
    held = F.lit(True)
    for j, m in enumerate(marks()):
        held &= F.col(f"w{j}").bitwiseAND(m) == m
    return met.withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("_block", *[f"w{j}" for j in range(WORDS)])


def judged(pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page by its url.

    listed: a DataFrame whose column url is the list of blocked URLs; a page is blocked if no rule fits it and its
    canonical URL is that of a listed one.  Null URLs and those without :// have an empty host and path, fit no rule and
    are allowed; null and such ones in the list match nothing, and an empty list blocks nothing.  URLs of any length are
    judged whole.  Repeated rows and null ids are judged like others; other columns don't matter; an empty table gives no
    rows.  Rows of one URL are spread however many they are.
    """
    listed = stored(listed.select(canonical(F.col("url")).alias("_url")).where("_url is not null").distinct())
    count = listed.count()
    after = rest(F.col("url"))
    rows = pages.select("page_id", "url", host(after).alias("host"), path(after).alias("path"))
    rows = rows.withColumn("_rule", ruled(F.col("host"), F.col("path"), rules)).withColumn("_url", F.when(F.col("_rule").isNull(), canonical(F.col("url")))).drop("url")
    rows = sifted(rows, listed, count)
    sure = rows.where("not _maybe").withColumn("_hit", F.lit(False))
    asked = rows.where("_maybe")
    exact = hot_join(asked, listed.withColumn("_hit", F.lit(True)).hint("shuffle_hash"), ["_url"], hot_keys(asked, ["_url"]), "left")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_hit"), "block").otherwise("allow"))
    return sure.unionByName(exact).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def false_positives(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: different canonical URLs of pages that aren't listed, and how many of them pass the filter."""
    listed = stored(listed.select(canonical(F.col("url")).alias("_url")).where("_url is not null").distinct())
    rows = sifted(pages.select(canonical(F.col("url")).alias("_url")).where("_url is not null").distinct(), listed, listed.count())
    return rows.join(listed, "_url", "left_anti").agg(F.count("*").alias("unlisted"), F.coalesce(F.sum(F.col("_maybe").cast("long")), F.lit(0)).alias("passed"))
