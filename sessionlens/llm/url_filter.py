"""URL filters: a blocked Bloom filter before an exact hash join, in DataFrame functions alone.

A listed entry is a canonical key: host, then a path that starts with ``/``.
An entry covers its host and all subdomains where the url's path starts with
the entry's.  Every url is taken apart into the keys that could cover it (each
suffix of the host at a dot, each listed path length), the keys are probed in
the filter, and the few possible hits go through an exact join that removes the
false positives.  The longest entry wins.

The filter is a table of blocks of four 64-bit words; one key touches one block,
so a probe is one hash join against at most ``max_blocks`` rows of 40 bytes,
which bounds what is broadcast.  A longer list makes the filter denser, never
wrong.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no entry; repeated entries count once, on a tie ``block`` wins; an empty
list lets everything through; equal urls are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.llm.common import free_name, keep

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 4
KEYS_PER_BLOCK = 16  # 16 bits a key


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, SMALL)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(hashed: Column) -> list[Column]:
    """One bit in each word of a block, from 24 bits of the hash."""
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftright(hashed, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(hashed, 28), F.lit(blocks))


def build_filter(keys: DataFrame, max_blocks: int = 1 << 16) -> tuple[DataFrame, int]:
    """The filter's table (``_block``, ``_w0`` ..) of a column ``key`` and its number of blocks."""
    blocks = max(1, min(max_blocks, keys.count() // KEYS_PER_BLOCK + 1))
    h = F.xxhash64("key")
    words = {f"_w{i}": w for i, w in enumerate(_bits(h))}
    table = keys.select(_block(h, blocks).alias("_block"), *(w.alias(n) for n, w in words.items())) \
        .groupBy("_block").agg(*(F.bit_or(n).alias(n) for n in words))
    return table, blocks


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_blocks: int = 1 << 16) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the entry that decides, else null) and ``verdict``.

    ``rules``: ``host``, ``path``, ``verdict`` (allow or block).
    """
    listed = keep(rules.where("host is not null and path is not null")
                  .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
                  .select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict"), "rules")
    table, blocks = build_filter(listed.select("key"), max_blocks)
    lengths = F.array(*(F.lit(r["n"]) for r in listed.select("n").distinct().collect())).cast("array<int>")  # at most the longest path
    urls = pages.select(F.col(url).alias("url")).where("url is not null").distinct() \
        .select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = F.expr("transform(filter(sequence(1, length(host)), i -> i = 1 or substr(host, i - 1, 1) = '.'), i -> substr(host, i))")
    keys = urls.where("host <> ''").select("url", F.explode(hosts).alias("suffix"), "path", lengths.alias("lengths")) \
        .select("url", "suffix", "path", F.explode(F.expr("filter(lengths, n -> n <= length(path))")).alias("n")) \
        .select("url", F.expr("concat(suffix, substr(path, 1, n))").alias("key"), "n").withColumn("h", F.xxhash64("key"))
    possible = keys.join(F.broadcast(table), _block(F.col("h"), blocks) == F.col("_block"))
    for i, bit in enumerate(_bits(F.col("h"))):
        possible = possible.where(F.col(f"_w{i}").bitwiseAND(bit) != 0)
    hits = possible.select("url", "key", "n").join(listed.select("key", "n", "verdict"), ["key", "n"]) \
        .groupBy("url").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), "verdict")).alias("hit"))
    own, rule, verdict = (free_name(pages, n) for n in ("_url", "_rule", "_verdict"))
    hits = hits.select(F.col("url").alias(own), F.col("hit.key").alias(rule), F.col("hit.verdict").alias(verdict))
    return pages.join(hits, pages[url] == hits[own], "left") \
        .withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url)), "rule": F.col(rule),
                      "verdict": F.coalesce(verdict, F.lit(default))}).drop(own, rule, verdict)
