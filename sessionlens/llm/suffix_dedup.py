"""Repeated passages by prefix-free parsing and suffix sorting.

A passage is a string of ``span`` bytes.  Bytes of a document go where a
passage covers them that also starts in a document with a smaller id.

1. *Parse.*  A rolling hash of ``span`` bytes triggers a phrase at about every
   ``spacing``-th place; a phrase runs from one trigger to the end of the next, so
   neighbours overlap by ``span`` - 1 bytes or more and every passage lies whole
   in one phrase.  Triggers depend on the passage alone: repeated text gives
   repeated phrases.
2. *Dictionary.*  Phrases meet by hash.  A phrase repeated in a document with a
   larger id is removed whole; its occurrence in the smallest one is its entry
   in the dictionary, so repeated text is stored and sorted once.
3. *Anchors.*  Passages that two entries share contain the same least hash of
   ``ANCHOR`` bytes.  Only places whose anchor occurs in entries of two documents
   go on; the rest of the dictionary is unique.
4. *Suffix order.*  The suffixes of the dictionary that are left are dealt by
   anchor (very frequent anchors by the suffix itself) and sorted by their first
   ``span`` bytes, byte by byte.  Equal runs, with the documents of the parse, tell
   which passages started in a smaller document.

Defined cases: null and empty texts lose nothing; texts shorter than ``span`` have
no passage; rows with the same id do not affect each other; a null id counts as
larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col

from sessionlens.llm.common import INVERSE, blocks, drop, keep, mixed, powers, prefix_hash, text_bytes

ANCHOR = 24
HOT = 5000  # entries of one anchor from which its suffixes are dealt one by one
LAST = (1 << 63) - 1  # stands for a null id
BLOCK_BYTES = 1 << 20
SORTED_PLACES = 500_000  # suffixes sorted at once
BATCH_BYTES = 4 << 20  # of the Arrow batches whose rows are blocks or pieces of them
OCCURRENCE = "ha bigint, hb bigint, doc bigint, row bigint, starts binary, phrase binary"
PARSED = ("doc bigint, row bigint, spans binary, block bigint, data binary, offsets binary, docs binary, rows binary, "
          "starts binary, counts binary")
SPANS = "doc bigint, row bigint, spans binary"


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes in a row."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    with np.errstate(over="ignore"):
        return mixed((sums[width:] - sums[:-width]) * powers(INVERSE, len(sums))[:n])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:len(values) - (width - reach)], values[width - reach:]) if width > reach else values


def phrases(data: np.ndarray, offsets: np.ndarray, span: int, spacing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the phrases of all rows."""
    at = np.flatnonzero(window_hashes(data, span) % np.uint64(spacing) == 0)
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[at + span <= offsets[row + 1]]
    starts = np.union1d(at, offsets[:-1][np.diff(offsets) >= span]).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    ends = offsets[row + 1].copy()
    same = row[1:] == row[:-1]
    ends[:-1][same] = starts[1:][same] + span - 1
    return starts, np.minimum(ends, offsets[row + 1]), row


def _spans(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.column_stack([starts, ends]).astype(np.int32).tobytes()


def _parse(span: int, spacing: int):
    """Each batch's distinct phrases with their occurrences in the smallest document; other occurrences go as spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_bytes(batch.column(2))
            found: dict[bytes, list] = {}  # phrase hash -> id, row, starts, phrase
            marks: dict[int, list] = {}  # number in the batch -> starts and ends
            number = {}
            for lo, hi in blocks(offsets):
                part = data[offsets[lo]:offsets[hi]]
                starts, ends, owner = phrases(part, offsets[lo:hi + 1] - offsets[lo], span, spacing)
                begin = (offsets[lo:hi] - offsets[lo])[owner]
                raw = part.tobytes()
                for s, e, o, b in zip(starts.tolist(), ends.tolist(), (owner + lo).tolist(), begin.tolist()):
                    phrase = raw[s:e]
                    h = xxhash.xxh3_128_digest(phrase)
                    old = found.get(h)
                    if old is None or docs[o] < docs[old[0]]:
                        if old is not None:
                            marks.setdefault(old[0], []).extend((x, x + e - s) for x in old[1])
                        found[h] = [o, [s - b], phrase]
                    elif o == old[0]:
                        old[1].append(s - b)
                    elif docs[o] > docs[old[0]]:
                        marks.setdefault(o, []).append((s - b, s - b + e - s))
                    else:  # the same id in another row of the table
                        number[(h, o)] = number.get((h, o), []) + [s - b]
            twins = [(h, o, starts, found[h][2]) for (h, o), starts in number.items() if docs[o] == docs[found[h][0]]]
            for (h, o), starts in number.items():
                if docs[o] > docs[found[h][0]]:
                    marks.setdefault(o, []).extend((s, s + len(found[h][2])) for s in starts)
            entries = [(h, *v) for h, v in found.items()] + twins
            halves = np.frombuffer(b"".join(h for h, *_ in entries), ">i8").astype(np.int64).reshape(-1, 2)
            who = np.array([o for _, o, _, _ in entries], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs[who]), pa.array(rows[who]),
                pa.array([np.array(s, np.int32).tobytes() for _, _, s, _ in entries], pa.binary()), pa.array([p for *_, p in entries], pa.binary())],
                ["ha", "hb", "doc", "row", "starts", "phrase"])
            who = np.array(list(marks), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[who]), pa.nulls(len(who), pa.int64()), pa.array(docs[who]), pa.array(rows[who]),
                pa.array([np.array(m, np.int32).tobytes() for m in marks.values()], pa.binary()), pa.nulls(len(who), pa.binary())],
                ["ha", "hb", "doc", "row", "starts", "phrase"])
    return run


def _parsed_batch(spans: list[tuple], block: list[tuple], number: int) -> pa.RecordBatch:
    """Spans as rows, and the entries gathered so far as one row."""
    n = len(spans)
    one = []
    if block:
        data = [b[3] for b in block]
        one = [(number, b"".join(data), np.cumsum([0, *map(len, data)]).astype(np.int64).tobytes(), np.array([b[0] for b in block], np.int64).tobytes(),
                np.array([b[1] for b in block], np.int64).tobytes(), b"".join(b[2] for b in block),
                np.array([len(b[2]) // 4 for b in block], np.int32).tobytes())]
    kinds = (pa.int64(), pa.int64(), pa.binary()), (pa.int64(), *[pa.binary()] * 6)
    left = [pa.array([s[i] for s in spans] + [None] * len(one), k) for i, k in enumerate(kinds[0])]
    right = [pa.array([None] * n + [o[i] for o in one], k) for i, k in enumerate(kinds[1])]
    return pa.RecordBatch.from_arrays(left + right, [x.split()[0] for x in PARSED.split(", ")])


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each phrase the occurrences in the smallest document become entries; the others are spans to remove."""
    spans, block, size, at, least = [], [], 0, None, 0
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for ha, hb, doc, row, starts, phrase in zip(*(c.to_pylist() for c in batch.columns)):
            if phrase is None:
                spans.append((doc, row, starts))
                continue
            if at != (ha, hb):
                at, least = (ha, hb), doc  # rows come by hash, then id
            if doc > least:
                begin = np.frombuffer(starts, np.int32)
                spans.append((doc, row, _spans(begin, begin + len(phrase))))
                continue
            block.append((doc, row, starts, phrase))
            size += len(phrase)
            if size >= BLOCK_BYTES or len(spans) >= 50_000:
                yield _parsed_batch(spans, block, number)
                spans, block, size, number = [], [], 0, number + 1
    yield _parsed_batch(spans, block, number)


class _Block:
    """The entries of a block and, for each place where a passage starts, its anchor."""

    def __init__(self, data: bytes, offsets: bytes, docs: bytes, rows: bytes, starts: bytes, counts: bytes, span: int, ranges: int):
        self.data = np.frombuffer(data, np.uint8)
        self.offsets, self.docs, self.rows = np.frombuffer(offsets, np.int64), np.frombuffer(docs, np.int64), np.frombuffer(rows, np.int64)
        self.starts, self.counts = np.frombuffer(starts, np.int32), np.frombuffer(counts, np.int32)
        self.first = np.cumsum(np.append(0, self.counts))
        edge = np.zeros(len(self.data) + 1, np.int32)  # entries are at least a passage long
        np.add.at(edge, self.offsets[:-1], 1)
        np.add.at(edge, self.offsets[1:] - span + 1, -1)
        self.places = np.flatnonzero(np.cumsum(edge) > 0)
        self.entry = np.searchsorted(self.offsets, self.places, "right") - 1
        # mixed again: least hashes are small, so their own ranges would be very uneven
        value = mixed(least_of(window_hashes(self.data, ANCHOR), span - ANCHOR + 1)[self.places])
        part = ((value >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        self.anchor = (part << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))


def _anchors(span: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, *columns = (c[i].as_py() for c in batch.columns)
                block = _Block(*columns, span, ranges)
                change = np.ones(len(block.anchor), bool)
                change[1:] = (block.anchor[1:] != block.anchor[:-1]) | (block.entry[1:] != block.entry[:-1])
                anchor, doc = block.anchor[change], block.docs[block.entry[change]]
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                anchor, doc = anchor[new], doc[new]
                cuts = np.searchsorted(anchor >> np.uint64(32), np.arange(ranges + 1).astype(np.uint64))
                out = [(r, number, (anchor[a:b]).astype(np.uint32).tobytes(), doc[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                 ["part", "block", "anchors", "docs"])
    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows by their first column, which comes sorted."""
    part, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if part is not None and row[0] != part:
                yield part, held
                held = []
            part = row[0]
            held.append(row[1:])
    if held:
        yield part, held


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to every block: which of its anchors occur in entries of two documents, and which are very frequent."""
    for part, rows in _grouped(batches):
        anchors = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        docs = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])
        cuts = np.cumsum([0, *(len(r[1]) // 4 for r in rows)])
        values, inverse, count = np.unique(anchors, return_inverse=True, return_counts=True)
        low, high = np.full(len(values), LAST), np.full(len(values), -LAST - 1)
        np.minimum.at(low, inverse, docs)
        np.maximum.at(high, inverse, docs)
        shared, hot = (low < high)[inverse], (count >= HOT)[inverse]
        full = anchors.astype(np.uint64) | np.uint64(part << 32)
        out = []
        for i, row in enumerate(rows):
            some = slice(cuts[i], cuts[i + 1])
            mine = shared[some]
            if mine.any():
                out.append((row[0], full[some][mine].tobytes(), hot[some][mine].tobytes()))
        columns = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["block", "anchors", "hot"])


SUFFIXES = "part int, data binary, sizes binary, docs binary, rows binary, starts binary"


def _suffixes(span: int, ranges: int):
    """Runs of places with a shared anchor, as text with its document and place, dealt by anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                *columns, anchors, hot = (c[i].as_py() for c in batch.columns)
                block = _Block(*columns, span, ranges)
                known = np.concatenate([np.frombuffer(a, np.uint64) for a in anchors])
                often = np.concatenate([np.frombuffer(h, bool) for h in hot])
                order = np.argsort(known)
                known, often = known[order], often[order]
                at = np.minimum(np.searchsorted(known, block.anchor), len(known) - 1)
                shared = known[at] == block.anchor
                place, entry, anchor, often = block.places[shared], block.entry[shared], block.anchor[shared], often[at][shared]
                new = np.ones(len(place), bool)
                new[1:] = often[1:] | (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1) | (entry[1:] != entry[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(place)) - 1
                begin, size, entry = place[first], place[last] - place[first] + span, entry[first]
                part = (anchor[first] >> np.uint64(32)).astype(np.int64)
                single = np.flatnonzero(often[first])
                if len(single):
                    part[single] = (window_hashes(block.data, span)[begin[single]] % np.uint64(ranges)).astype(np.int64)
                copies = block.counts[entry]  # every start of the entry in its document
                where = np.repeat(np.arange(len(begin)), copies)
                nth = np.arange(len(where)) - np.repeat(np.cumsum(copies) - copies, copies)
                start = block.starts[block.first[entry[where]] + nth] + (begin - block.offsets[entry])[where]
                order = np.argsort(part[where], kind="stable")
                where, start = where[order], start[order]
                cuts = np.searchsorted(part[where], np.arange(ranges + 1))
                raw = block.data.tobytes()
                for r in np.unique(part):
                    some = where[cuts[r]:cuts[r + 1]]
                    out.append((int(r), b"".join(raw[b:b + n] for b, n in zip(begin[some].tolist(), size[some].tolist())), size[some].astype(np.int32).tobytes(),
                                block.docs[entry[some]].tobytes(), block.rows[entry[some]].tobytes(), start[cuts[r]:cuts[r + 1]].astype(np.int32).tobytes()))
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 5))],
                                                 [x.split()[0] for x in SUFFIXES.split(", ")])
    return run


def _turns(data: np.ndarray, sizes: np.ndarray, span: int, rounds: int) -> np.ndarray:
    """The round of every place in these segments, by the hash of its passage."""
    inside = np.ones(len(data), bool)  # whether a passage that lies whole in its segment starts here
    ends = np.cumsum(sizes, dtype=np.int64)
    for i in range(1, span):
        inside[ends - i] = False
    return (window_hashes(data, span)[np.flatnonzero(inside)] % np.uint64(rounds)).astype(np.uint16)


def _sorted_suffixes(span: int):
    """Sort the suffixes of each part, in rounds by their hash; places whose passage also starts in a smaller document
    are spans to remove."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            data = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
            sizes, docs, keys, starts = (np.concatenate([np.frombuffer(r[i], k) for r in rows]) for i, k in ((1, np.int32), (2, np.int64), (3, np.int64), (4, np.int32)))
            rows.clear()
            offsets = np.cumsum(np.append(0, sizes), dtype=np.int64)
            nth = np.cumsum(np.append(0, sizes - (span - 1)), dtype=np.int64)  # first place of each segment
            rounds = -(-int(nth[-1]) // SORTED_PLACES)
            turn = np.concatenate([np.zeros(0, np.uint16), *(_turns(data[offsets[lo]:offsets[hi]], sizes[lo:hi], span, rounds) for lo, hi in blocks(offsets, BLOCK_BYTES))])
            found = [np.zeros(0, np.int64)]
            for r in range(rounds):
                some = np.flatnonzero(turn == r)
                if not len(some):
                    continue
                segment = np.searchsorted(nth, some, "right") - 1
                text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, span)[offsets[segment] + some - nth[segment]]).view(f"S{span}").ravel()
                order = np.argsort(text)
                text = text[order]
                head = np.ones(len(text), bool)
                head[1:] = text[1:] != text[:-1]
                del text
                doc = docs[segment[order]]
                least = np.minimum.reduceat(doc, np.flatnonzero(head))
                found.append(some[order[doc > least[np.cumsum(head) - 1]]])
            gone = np.sort(np.concatenate(found))
            segment = np.searchsorted(nth, gone, "right") - 1
            place = starts[segment] + (gone - nth[segment])
            new = np.ones(len(gone), bool)
            new[1:] = (segment[1:] != segment[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(gone)) - 1
            owner, begin, end = segment[first], place[first], place[last] + span if len(first) else place[first]
            order = np.lexsort((keys[owner], docs[owner]))
            owner, begin, end = owner[order], begin[order], end[order]
            d, k = docs[owner], keys[owner]
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))) if len(d) else np.zeros(0, np.int64)
            stop = np.append(cut[1:], len(d))
            yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(k[cut]),
                                              pa.array([_spans(begin[a:b], end[a:b]) for a, b in zip(cut, stop)], pa.binary())], ["doc", "row", "spans"])
    return run


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lists in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if not lists:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                spans = np.concatenate([np.frombuffer(s, np.int32).reshape(-1, 2) for s in lists])
                level = np.zeros(len(text) + 1, np.int32)
                np.add.at(level, spans[:, 0], 1)
                np.add.at(level, spans[:, 1], -1)
                gone = np.cumsum(level[:-1]) > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((len(text), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names)
    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 50, spacing: int = 256) -> DataFrame:
    """``doc`` (the id, LAST for null), ``row`` (a hash of the text) and ``spans``: pairs of 32-bit byte places to remove, to be united."""
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.select(F.coalesce(col(key).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(body).alias("row"), body.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, total // (12 << 20))
    met = rows.mapInArrow(_parse(span, spacing), OCCURRENCE).repartition("ha").sortWithinPartitions("ha", "hb", "doc")
    parsed = keep(met.mapInArrow(_dictionary, PARSED), "parse")
    entries = parsed.where("block is not null").select("block", "data", "offsets", "docs", "rows", "starts", "counts")
    anchors = entries.mapInArrow(_anchors(span, ranges), "part int, block bigint, anchors binary, docs binary").repartition("part").sortWithinPartitions("part")
    shared = anchors.mapInArrow(_shared_anchors, "block bigint, anchors binary, hot binary")
    shared = keep(shared.groupBy("block").agg(F.collect_list("anchors").alias("anchors"), F.collect_list("hot").alias("hot")), "anchors", BATCH_BYTES)
    dealt = entries.join(shared, "block").select("data", "offsets", "docs", "rows", "starts", "counts", "anchors", "hot") \
        .mapInArrow(_suffixes(span, ranges), SUFFIXES).repartition("part").sortWithinPartitions("part")
    edges = keep(dealt.mapInArrow(_sorted_suffixes(span), SPANS), "suffixes", BATCH_BYTES)
    whole = keep(parsed.where("block is null and spans is not null").select("doc", "row", "spans"), "repeats")
    drop(parsed, shared)
    return whole.union(edges)


def remove_repeats(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(key), body.alias("_text"), F.coalesce(col(key).cast("bigint"), F.lit(LAST)).alias("_doc"), F.xxhash64(body).alias("_row"))
    lists = spans.groupBy(col("doc").alias("_d"), col("row").alias("_r")).agg(F.collect_list("spans").alias("_spans"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.join(lists, (col("_doc") == col("_d")) & (col("_row") == col("_r")), "left").select(key, "_text", "_spans") \
        .mapInArrow(_cut([key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]), f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
