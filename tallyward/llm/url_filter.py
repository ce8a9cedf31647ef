"""Listed URLs: a blocked Bloom filter first, an exact hash join for what it passes.

URLs are compared in canonical form. The filter of the list has a bounded size and
goes to every task; URLs it rules out are not listed for certain and never leave
their task. The others, listed or false positives, meet the list in a hash join on
the canonical URL itself.
"""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# 256-bit blocks: eight words of 32 bits, each with one bit of a URL.
WORDS = 8
BITS_PER_URL = 16
MOST_BLOCKS = 1 << 18
# Odd multipliers of 31 bits, one for each word of a block.
LOW = (1 << 31) - 1
SALTS = tuple((2654435761 * (2 * i + 1)) & LOW | 1 for i in range(WORDS))

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
# Query parameters that say where a visit came from.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; all empty for a null URL or one without ``://``."""
    body = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(body, URL, i)
    return lowered(part(1)), part(2), part(3)


def canonical(url: Column) -> Column:
    """One form for URLs that lead to the same page: no scheme, no leading ``www.``,
    no default port, no final slash, no tracking parameters, the others sorted, no
    fragment. Null without a host."""
    host, path, query = url_parts(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    pairs = F.split(F.regexp_replace(query, r"^\?", ""), "&")
    kept = F.filter(pairs, lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    asked = F.array_join(F.array_sort(kept), "&")
    end = F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked))
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), end))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, and its verdict; null
    if none does. A rule fits its host and all subdomains, where the path starts with
    the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(
            path, F.lit(own_path)
        )
        rule = F.when(fits, own_host + own_path).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def bloom(listed: DataFrame, url: str) -> np.ndarray:
    """The filter, a row of eight words per block; at most ``MOST_BLOCKS`` blocks,
    8 MB, whatever the length of the list. A fuller filter passes more URLs, never fewer.
    """
    count = listed.count()
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * 32 * WORDS < BITS_PER_URL * count:
        blocks *= 2
    key = F.xxhash64(url)
    low = key.bitwiseAND(F.lit(LOW).cast("long"))
    bit = lambda salt: F.shiftright((low * salt).bitwiseAND(F.lit(LOW).cast("long")), 26).cast("int")
    words = [
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(s))).alias(f"word{i}")
        for i, s in enumerate(SALTS)
    ]
    block = F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(blocks - 1)).alias("block")
    rows = listed.groupBy(block).agg(*words).toPandas()
    table = np.zeros((blocks, WORDS), np.uint32)
    if len(rows):
        table[rows["block"].to_numpy()] = rows.drop(columns="block").to_numpy().astype(np.uint32)
    return table


def _possible(shared):
    """Task code: which hashes may be of a listed URL."""

    def possible(keys: pd.Series) -> pd.Series:
        table = shared.value
        hashes = keys.fillna(0).to_numpy(np.int64).view(np.uint64)
        rows = table[((hashes >> np.uint64(32)) & np.uint64(len(table) - 1)).astype(np.int64)]
        low = (hashes & np.uint64(LOW))[:, None]
        bits = ((low * np.array(SALTS, np.uint64)) & np.uint64(LOW)) >> np.uint64(26)
        found = ((rows >> bits.astype(np.uint32)) & np.uint32(1)).all(axis=1)
        return pd.Series(found & keys.notna().to_numpy())

    return F.pandas_udf(possible, "boolean")


def judged(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    listed: DataFrame,
    url: str = "url",
    carry: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """The columns named in ``carry`` with host, path, rule, verdict and listed.

    ``rules`` are few and known in full: (verdict, host, path), the longest that fits
    wins. Where none does, a URL of the list is blocked and any other allowed.
    ``listed`` has a column ``canonical``; nulls and repeats in it do not matter. Null
    URLs and those without a host have an empty host and path and are allowed. Repeated
    pages are judged alike. Runs jobs to build the filter.
    """
    host, path, _ = url_parts(F.col(url))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    keys = durable(listed.where("canonical IS NOT NULL").select("canonical").distinct())
    shared = pages.sparkSession.sparkContext.broadcast(bloom(keys, "canonical"))
    rows = (
        pages.select(*carry, host.alias("host"), path.alias("path"), canonical(F.col(url)).alias("_url"))
        .withColumn("rule", rule)
        .withColumn("_said", said)
    )
    rows = rows.withColumn("_maybe", _possible(shared)(F.when(F.col("_url").isNotNull(), F.xxhash64("_url"))))
    sure = rows.where("NOT _maybe").withColumn("listed", F.lit(False))
    known = keys.select(F.col("canonical").alias("_url"), F.lit(True).alias("_hit")).hint("shuffle_hash")
    met = rows.where("_maybe").join(known, "_url", "left")
    met = met.withColumn("listed", F.coalesce("_hit", F.lit(False)))
    names = [*carry, "host", "path", "rule", "_said", "listed"]
    both = sure.select(*names).unionByName(met.select(*names))
    verdict = F.coalesce("_said", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.withColumn("verdict", verdict).drop("_said")
