"""Records of quoted CSV files, each file read by many tasks.

Whether a line starts a record depends on the quotes before it, for a quoted cell
may hold line breaks.  Every split counts its quotes; running sums over the splits
of a file tell each whether it starts inside a cell; with that its task joins lines
to records.  Only the pieces of records that straddle splits are shuffled.

Quotes stand around whole cells and are doubled inside, as the sink writes them.
Other quotes, or a file that ends inside a cell, are errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sessionlens.session import cut_lineage

_CELL = rb'(?:[^",]*|"[^"]*(?:""[^"]*)*")'
_RECORD = re.compile(rb"\xef?\xbb?\xbf?" + _CELL + rb"(?:," + _CELL + rb")*\r?")
_KINDS = {"file": pa.string(), "block": pa.int64(), "base": pa.int64(), "ordinal": pa.int64(), "value": pa.binary()}
_DDL = "file string, block bigint, base bigint, ordinal bigint, value binary"


def check_record(value: bytes) -> bytes:
    if b'"' in value and not _RECORD.fullmatch(value):
        raise ValueError(f"a quote inside an unquoted cell, or text behind a quoted one: {value[:80]!r}")
    return value


class _Split:
    """Joins the lines of one split; ``base`` is the id of its first line."""

    def __init__(self, file: str, block: int, base: int, inside: int):
        self.place, self.inside, self.held = (file, block, base), inside, []
        self.ordinal = -1  # of the record being read; -1: it started in an earlier split

    def feed(self, lines: list[bytes], quotes: np.ndarray) -> Iterator[tuple[int, bytes, bool]]:
        """(ordinal, value, is a piece) of the records that end in these lines."""
        after = (self.inside + np.cumsum(quotes)) % 2
        begin = 0
        for end in np.flatnonzero(after == 0) + 1:
            fresh = not self.held and (self.inside == 0 or begin > 0)
            if fresh and not lines[begin].strip():
                begin = int(end)  # a blank line is no record
                continue
            if fresh:
                self.ordinal += 1
            yield self.ordinal, b"\n".join([*self.held, *lines[begin:end]]), self.ordinal < 0
            self.held, begin, self.inside = [], int(end), 0
        if begin < len(lines):
            if not self.held and (self.inside == 0 or begin > 0):
                self.ordinal += 1
            self.held += lines[begin:]
            self.inside = 1

    def close(self) -> Iterator[tuple[int, bytes, bool]]:
        if self.held:
            yield self.ordinal, b"\n".join(self.held), True


def _joined(pieces: bool):
    """Whole records of every split, or the pieces of records that straddle splits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None

        def batch_of(found: Iterator[tuple[int, bytes, bool]]) -> pa.RecordBatch:
            rows = [(*split.place, n, value if pieces else check_record(value)) for n, value, piece in found if piece == pieces]
            columns = zip(*rows) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values())], list(_KINDS))

        for batch in batches:
            block = batch.column("block").to_numpy()
            file = batch.column("file").dictionary_encode()
            code = file.indices.to_numpy()
            edges = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(block)]):
                if a == b:
                    continue
                name = file.dictionary[int(code[a])].as_py()
                if split is None or split.place[:2] != (name, int(block[a])):
                    if split is not None:
                        yield batch_of(split.close())
                    split = _Split(name, int(block[a]), batch.column("id")[a].as_py(), batch.column("inside")[a].as_py())
                lines = batch.column("value").slice(a, b - a)
                quotes = pc.count_substring(lines, '"').to_numpy()
                yield batch_of(split.feed(lines.to_pylist(), quotes))
        if split is not None:
            yield batch_of(split.close())
    return run


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, row_id, header, value) of all records; blank lines between them are none.

    ``block`` is the split a record starts in; ``row_id`` follows the order of the records and is gapless within
    a split; ``header`` marks the first record of a file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).selectExpr(
        "value", "_metadata.file_path file", "_metadata.file_block_start block", "monotonically_increasing_id() id")
    counted = lines.groupBy("file", "block").agg(F.sum(F.regexp_count("value", F.lit('"'))).alias("quotes"))
    order = Window.partitionBy("file").orderBy("block")
    upto = F.sum("quotes").over(order)
    last = F.lead("block").over(order).isNull() & (F.pmod(upto, F.lit(2)) == 1)
    splits = cut_lineage(counted.select("file", "block", F.pmod(upto - F.col("quotes"), F.lit(2)).cast("int").alias("inside"),
                                        F.pmod(upto, F.lit(2)).cast("int").alias("open"), last.alias("torn")))
    torn = splits.where("torn").select("file").limit(1).collect()
    if torn:
        raise ValueError(f"{torn[0]['file']} ends inside a quoted cell")

    def joined(among: DataFrame, pieces: bool) -> DataFrame:
        # one small row per split; the broadcast keeps the lines of a split in their order
        how = "inner" if pieces else "left"
        known = F.coalesce("inside", F.raise_error(F.lit("the splits of the file changed while it was read")).cast("int"))
        placed = lines.join(F.broadcast(among.select("file", "block", "inside")), ["file", "block"], how)
        return placed.select("file", "block", "id", F.col("value").cast("binary").alias("value"), known.alias("inside")).mapInArrow(_joined(pieces), _DDL)

    whole = joined(splits, False)
    straddling = splits.where("inside = 1 or open = 1")
    if straddling.limit(1).count():
        pieces = cut_lineage(joined(straddling, True))  # two per split at most
        follows = Window.partitionBy("file").orderBy("block", "ordinal")
        numbered = pieces.withColumn("record", F.sum(F.when(F.col("ordinal") >= 0, 1).otherwise(0)).over(follows))
        parts = F.sort_array(F.collect_list(F.struct("block", "ordinal", "base", "value")))
        glued = numbered.groupBy("file", "record").agg(parts.alias("p")).selectExpr(
            "file", "p[0].block block", "p[0].base base", "p[0].ordinal ordinal",
            "cast(array_join(transform(p, x -> cast(x.value as string)), '\\n') as binary) value")
        whole = whole.unionByName(glued)
    text = "cast(value as string)"
    return whole.selectExpr("file", "block", "base + ordinal row_id", "block = 0 and ordinal = 0 header",
                            f"case when endswith({text}, '\\r') then left({text}, length({text}) - 1) else {text} end value")
