"""URL filters: a blocked Bloom filter of listed URLs ahead of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 256
BITS_PER_KEY = 16
# 2**20 blocks of 256 bits are 32 MB: the most that is ever broadcast.  A longer list only
# makes more false hits, which the exact join removes.
MAX_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Stands between host and path in a key, so that no two rules share one.
GAP = "\x01"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _bits(key: Column) -> list[Column]:
    """Two bits in each of the block's four words."""
    h = F.xxhash64(key, F.lit(101))

    def bit(k: int) -> Column:
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, w0..w3`` of all values of ``keys.key``, or-ed together in the tasks first."""
    bits = _bits(F.col("key"))
    return (
        keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
    )


def url_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict`` appended (existing columns of these names go).

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all subdomains if the
    URL's path starts with the rule's; the longest fitting rule wins (host and path together,
    then the longer host, then the larger text).  If a rule is listed with both verdicts, block
    holds.  Rules without a host fit nothing; a null path is an empty one.  URLs that are null,
    empty or without ``://`` have an empty host and path and get ``default``, as do all that no
    rule fits.  Repeated URLs are judged once and every row is kept.

    Each distinct (host, path) yields the keys that a listed rule could have: host suffixes
    and path prefixes of the sizes that occur in the list.  The keys meet the Bloom filter by a
    broadcast hash join on the block number; only possible hits reach the exact join.
    """
    names = ["host", "path", "rule", "verdict"]
    judged = urls.drop(*[c for c in names if c != url]).withColumns(
        {"host": url_host(F.col(url)), "path": url_path(F.col(url))}
    )
    listed = (
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("h"),
            F.coalesce("path", F.lit("")).alias("p"),
            "verdict",
        )
        .where("h <> ''")
        .groupBy(F.concat("h", F.lit(GAP), "p").alias("key"))
        .agg(
            F.max("verdict").alias("listed"),
            F.max(F.length("h")).alias("host_len"),
            F.max(F.size(F.split("h", r"\."))).alias("labels"),
            F.max(F.length("p")).alias("prefix"),
        )
    )
    # Sizes of rules: bounded by the labels of a host and the length of a URL, not by the list.
    shapes = listed.agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.struct("labels", "prefix"))).alias("shapes"),
    ).first()
    blocks = min(MAX_BLOCKS, max(1, -(-shapes["n"] * BITS_PER_KEY // BLOCK_BITS)))
    labels = F.split("host", r"\.")
    options = [
        F.when(
            (F.size(labels) >= s["labels"]) & (F.length("path") >= s["prefix"]),
            F.concat(
                F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."),
                F.lit(GAP),
                F.substring("path", 1, s["prefix"]),
            ),
        )
        for s in shapes["shapes"]
    ] or [F.lit(None).cast("string")]
    asked = (
        judged.select("host", "path")
        .where("host <> ''")
        .distinct()
        .select("host", "path", F.explode(F.array_compact(F.array(*options))).alias("key"))
    )
    bits = _bits(F.col("key"))
    filter_ = F.broadcast(bloom_blocks(listed.select("key"), blocks))
    possible = asked.withColumn("block", _block(F.col("key"), blocks)).join(filter_, "block")
    for i, b in enumerate(bits):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(b) == b)
    decided = (
        possible.select("host", "path", "key")
        .join(listed.select("key", "listed", "host_len"), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("key"), "host_len", "key", "listed")).alias("won"))
        .select("host", "path", F.replace("won.key", F.lit(GAP), F.lit("")).alias("rule"), F.col("won.listed").alias("listed_verdict"))
    )
    return judged.join(decided, ["host", "path"], "left").select(
        *[c for c in judged.columns],
        "rule",
        F.coalesce("listed_verdict", F.lit(default)).alias("verdict"),
    )
