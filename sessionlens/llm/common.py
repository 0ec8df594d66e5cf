"""Shared helpers of the corpus operators: intermediate tables, text bytes in tasks, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master that sets none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        context = spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may have ended: its files then stay with the cluster's own clean-up
        return


def keep(frame: DataFrame, name: str = "table", batch_bytes: int | None = None) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and lets
    Spark delete the shuffle files of the finished write at once.
    ``batch_bytes``: size of the Arrow batches of this write, for tables of large rows.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    settings = {CLEANUP: "true", **({BATCH: str(batch_bytes)} if batch_bytes else {})}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        frame.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = spark.read.schema(frame.schema).parquet(path)
    table.kept_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.kept_at)


def free_name(frame: DataFrame, name: str) -> str:
    """``name`` or a longer one that no column of ``frame`` has (Spark ignores case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- text bytes in tasks -----------------------------------------------------------

BLOCK = 4 << 20  # bytes of text that a task works on at once: bounds its numpy temporaries


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


ROOT = np.uint64(0x9E6C63D0876A9A47)
INVERSE = np.uint64(pow(int(ROOT), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, n of them at least."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096) if n < 2 * BLOCK else n
        have = np.empty(size, np.uint64)
        have[0] = 1
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < size:  # doubling: powers done .. 2 done - 1 are those before times base^done
                more = min(done, size - done)
                have[done:done + more] = have[:more] * step
                done += more
                step = step * step
        if size <= BLOCK + 4096:
            _powers[int(base)] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte times power, n + 1 of them: the hash of any range is a difference of two."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(ROOT, len(data))[:len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of each pair, independent of their place."""
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts])


def byte_runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one kind (kind 0 separates) within rows: starts, ends, kinds, rows."""
    kind = kinds[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    return starts, ends, kind[starts], np.searchsorted(offsets, starts, "right") - 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but space and the bytes 9 to 13.
WORD_KINDS = np.ones(256, np.uint8)
WORD_KINDS[[9, 10, 11, 12, 13, 32]] = 0


# --- connected components ------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each linked id: columns ``node``, ``component``.

    Rounds of hooking to the smallest neighbour and pointer jumping; each is a
    few joins over tables in the shared folder, and only a count reaches the
    driver.  Ids without links have no row.
    """
    edges = keep(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
                 .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    both = edges.union(edges.select("y", "x"))
    labels = keep(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("y"), F.col("component").alias("near"))
        best = both.join(of, "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(best, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("to"))
        # the old root follows its members, so that whole trees move at once
        roots = hooked.groupBy(F.col("component").alias("node")).agg(F.min("to").alias("root"))
        moved = hooked.join(roots.withColumnRenamed("node", "component"), "component", "left") \
            .select("node", "component", F.least("to", F.coalesce("root", "to")).alias("to"))
        moved = keep(moved, "labels")
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = keep(moved.join(jump, "to", "left").select("node", F.col("component").alias("before"),
                                                           F.coalesce("further", "to").alias("component")), "labels")
        changed = after.where("before <> component").limit(1).count()
        drop(labels, moved)
        labels = after.drop("before")
        labels.kept_at = after.kept_at
        if not changed:
            drop(edges)
            return labels
