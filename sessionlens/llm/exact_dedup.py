"""Exact dedup with an extendible-hash index on shared files.

1. Texts are counted by the first 16 bits of a 64-bit hash.  From these 65 536
   counts the directory is grown: a bucket above its capacity splits by one
   more bit, and the directory doubles whenever such a bucket is as deep as
   the directory itself.
2. Every task first folds the equal texts of a batch into one entry, so that a
   text that is a third of all rows reaches its owner once per batch.  Entries
   are dealt to owner tasks by bucket, that is by a range of hash values.
3. An owner walks its entries in hash order.  Texts of one hash form a chain;
   an entry is compared with the chain byte by byte and either joins its twin
   or becomes a new link.  Only the chain at hand is in memory.
4. The index records (hash, chain link, digest, row that stays, count) are
   written to the shared folder beside the directory; documents find their
   record by hash and SHA-256.

Defined cases: a null text counts as empty; of equal texts the largest id
stays, and rows that repeat this id stay too; a null id stays only where its
group has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import keep

MAX_DEPTH = 16
ENTRY = "bucket int, h bigint, text binary, keep_id bigint, n bigint"
RECORD = "bucket int, h bigint, link int, text_sha256 string, keep_id bigint, group_size bigint"


def grow_directory(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket number of each of the 2^MAX_DEPTH hash prefixes; ``counts`` are bytes per prefix."""
    depth, directory, local, prefix = 0, [0], [0], [0]  # directory slot -> bucket; per bucket its depth and prefix
    sums = [counts.reshape(1 << d, -1).sum(axis=1) for d in range(MAX_DEPTH + 1)]
    pending = [0]
    while pending:
        bucket = pending.pop()
        d, at = local[bucket], prefix[bucket]
        if sums[d][at] <= capacity or d == MAX_DEPTH:
            continue  # fits, or one deep prefix: its owner chains
        if d == depth:  # double the directory: every slot twice
            directory = [b for b in directory for _ in (0, 1)]
            depth += 1
        other = len(local)
        local[bucket] = d + 1
        prefix[bucket] = 2 * at
        local.append(d + 1)
        prefix.append(2 * at + 1)
        width = 1 << (depth - d - 1)
        start = (2 * at + 1) * width
        directory[start:start + width] = [other] * width
        pending += [bucket, other]
    return np.repeat(np.array(directory, np.int32), 1 << (MAX_DEPTH - depth))


def _fold(directory: np.ndarray):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries: dict[bytes, list] = {}
            for h, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                entry = entries.get(text)
                if entry is None:
                    entries[text] = [h, key, 1]
                else:
                    entry[1] = key if entry[1] is None else entry[1] if key is None else max(key, entry[1])
                    entry[2] += 1
            h = np.array([e[0] for e in entries.values()], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(directory[(h.view(np.uint64) >> np.uint64(64 - MAX_DEPTH)).astype(np.int64)], pa.int32()), pa.array(h, pa.int64()),
                pa.array(entries.keys(), pa.binary()), pa.array([e[1] for e in entries.values()], pa.int64()),
                pa.array([e[2] for e in entries.values()], pa.int64())], ["bucket", "h", "text", "keep_id", "n"])
    return fold


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, chain, records = None, [], []

    def close() -> None:
        records.extend((at[0], at[1], i, hashlib.sha256(text).hexdigest(), key, n) for i, (text, key, n) in enumerate(chain))

    def packed() -> pa.RecordBatch:
        columns = list(zip(*records)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         ["bucket", "h", "link", "text_sha256", "keep_id", "group_size"])
        records.clear()
        return out

    for batch in batches:
        for bucket, h, text, key, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if at != (bucket, h):
                if at is not None:
                    close()
                at, chain = (bucket, h), []
            for link in chain:
                if link[0] == text:  # bytes against bytes
                    link[1] = key if link[1] is None else link[1] if key is None else max(key, link[1])
                    link[2] += n
                    break
            else:
                chain.append([text, key, n])
        yield packed()
    if at is not None:
        close()
        yield packed()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 256 << 10) -> tuple[DataFrame, DataFrame]:
    """The index records and the directory (prefix, bucket), both written in the shared folder.

    ``bucket_bytes`` is a bucket's capacity; on large inputs it is raised so
    that there are at most 16 384 buckets, whose entries the owner streams.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(body).alias("h"), body.alias("text"), F.col(key).cast("bigint").alias("id"))
    counts = np.zeros(1 << MAX_DEPTH, np.int64)
    found = rows.groupBy(F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int").alias("prefix")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    for row in found:  # 65 536 rows at most
        counts[row["prefix"]] = row["n"]
    directory = grow_directory(counts, max(bucket_bytes, int(counts.sum()) // 8192))
    shelf = keep(spark.createDataFrame([(i, int(b)) for i, b in enumerate(directory)], "prefix int, bucket int"), "directory")
    entries = rows.mapInArrow(_fold(directory), ENTRY).repartition("bucket").sortWithinPartitions("bucket", "h")
    return keep(entries.mapInArrow(_own, RECORD), "index"), shelf


def mark_copies(docs: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (columns of these names are replaced)."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = index.select(F.col("h").alias("_h"), F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    rows = docs.withColumns({"_doc_h": F.xxhash64(body), "_doc_sha": F.sha2(body, 256)})
    return rows.join(found, (F.col("_doc_h") == F.col("_h")) & (F.col("_doc_sha") == F.col("_sha"))) \
        .withColumns({"keep_id": F.col("_keep"), "group_size": F.col("_size"), "kept": F.col(key).eqNullSafe(F.col("_keep")),
                      "text_sha256": F.col("_sha")}).drop("_h", "_sha", "_keep", "_size", "_doc_h", "_doc_sha")
