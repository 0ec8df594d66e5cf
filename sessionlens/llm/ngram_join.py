"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct shingles (five words; a shorter text is
one shingle).  Equal sets are one class.  Cutting the order of the hashes into
fragments cuts every set into segments.  Prefixes follow a second global order, from
shingles that few classes have to those that many have, ties by hash.

1. *Rare shingles.*  Hash ranges of all sets meet at their owners, which count
   for each class how many of its shingles other classes have.  A class with
   fewer than 80 % of such shingles can have no partner and is done.
2. *Prefixes.*  For the rest the classes of each shingle are counted.  Partners
   share a shingle among the first ``n - ceil(0.8 n) + 1`` of either, so only these
   become postings; passages that very many share come last and seldom do.
3. *Candidates.*  Within the postings of a shingle a few leaders are paired with
   the members, never all with all.  The first shingle that partners share has enough
   shingles after it in either set; pairs without such a shingle are no candidates.  Groups whose members are already
   connected are done; the leaders leave the others and the next ones follow,
   twice as many each round, until no group holds members of two components that
   could have a partner.  So pairs that could connect something are all tested.
4. *Counts.*  The overlap of a candidate pair is counted in each fragment
   separately and summed per pair.

Result rows carry the component over links, which needs no link between members
that are connected anyway.

Defined cases: null and empty texts, or texts without words, have an empty set
and are linked with nothing; equal texts are linked; rows that repeat an id are
rows of their own; a null id never names a component unless all ids in it are
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col

from sessionlens.llm.common import LOWER, WORD_KINDS, blocks, byte_runs, components, drop, keep, mixed, prefix_hash, range_hash, text_bytes

WIDTH = 5
FRAGMENTS = 8
RANGE_SHINGLES = 2_000_000  # shingles that the owner of a hash range holds
BATCH_BYTES = 12 << 20  # text that a task takes at once
FACTORS = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(WIDTH)], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every row."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, _, row = byte_runs(data, offsets, WORD_KINDS)
    words = range_hash(prefix_hash(data), starts, ends)
    at = np.searchsorted(row, np.arange(n + 1))
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width if len(full) else 0):
            full += words[i:i + len(full)] * FACTORS[i]
        full = mixed(full)
        sets = []
        for i in range(n):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                sets.append(np.unique(full[a:b - width + 1]))
            elif b > a:
                sets.append(mixed(np.array([(words[a:b] * FACTORS[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> int:
    """One number for a set."""
    with np.errstate(over="ignore"):
        total = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _ranges(tokens: np.ndarray, count: int) -> np.ndarray:
    """Number of the hash range of each of the sorted tokens."""
    return ((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


class _Packer:
    """Gathers (class, size, sorted tokens) and yields one row per hash range."""

    def __init__(self, ranges: int, wide: bool):
        self.ranges, self.wide = ranges, wide
        self.reset()

    def reset(self) -> None:
        self.classes, self.sizes, self.lengths, self.tokens, self.held = [], [], [], [], 0

    def add(self, sig: int, size: int, tokens: np.ndarray) -> None:
        """``size``: of the whole set, of which ``tokens`` may be a segment."""
        self.classes.append(sig)
        self.sizes.append(size)
        self.lengths.append(len(tokens))
        self.tokens.append(tokens)
        self.held += len(tokens)

    def rows(self) -> pa.RecordBatch:
        tokens = np.concatenate([np.zeros(0, np.uint64), *self.tokens])
        owner = np.repeat(np.arange(len(self.classes)), self.lengths)
        part = _ranges(tokens, self.ranges).astype(np.int64)
        order = np.argsort(part, kind="stable")
        tokens, owner, part = tokens[order], owner[order], part[order]
        cuts = np.searchsorted(part, np.arange(self.ranges + 1))
        classes, sizes = np.array(self.classes, np.int64), np.array(self.sizes, np.int32)
        out = []
        for r in range(self.ranges):
            a, b = cuts[r], cuts[r + 1]
            if b > a:
                who, first = np.unique(owner[a:b], return_index=True)
                counts = np.diff(np.append(first, b - a)).astype(np.int32)
                here = tokens[a:b] if self.wide else tokens[a:b].astype(np.uint32)
                out.append((r, classes[who].tobytes(), sizes[who].tobytes(), counts.tobytes(), here.tobytes()))
        self.reset()
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "classes", "sizes", "counts", "tokens"])


PACKED = "part int, classes binary, sizes binary, counts binary, tokens binary"


def _owned(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per hash range: tokens in order with their class and its size, each (token, class) once."""
    kind = np.uint64 if wide else np.uint32
    part, held = None, []

    def merged():
        classes, sizes, counts, tokens = ([np.frombuffer(r[i], k) for r in held] for i, k in enumerate((np.int64, np.int32, np.int32, kind)))
        counts = np.concatenate(counts)
        tokens = np.concatenate(tokens)
        owner, size = np.repeat(np.concatenate(classes), counts), np.repeat(np.concatenate(sizes), counts)
        order = np.lexsort((owner, tokens))
        tokens, owner, size = tokens[order], owner[order], size[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        return tokens[new], owner[new], size[new]

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if part is not None and row[0] != part:
                yield merged()
                held = []
            part = row[0]
            held.append(row[1:])
    if held:
        yield merged()


def _shared(tokens: np.ndarray) -> np.ndarray:
    """Which of the sorted tokens occur more than once."""
    same = np.zeros(len(tokens) + 1, bool)
    same[1:-1] = tokens[1:] == tokens[:-1]
    return same[:-1] | same[1:]


def _documents(ranges: int):
    """Rows (class, size) of all documents and the packed shingles of each batch's distinct classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(ranges, wide=False)
        blank = lambda n: [pa.nulls(n, pa.binary())] * 4

        def packed() -> pa.RecordBatch:
            rows = packer.rows()
            return pa.RecordBatch.from_arrays([*[pa.nulls(rows.num_rows, pa.int64())] * 3, pa.nulls(rows.num_rows, pa.int32()), *rows.columns], names)

        names = ["id", "row", "sig", "n", "part", "classes", "sizes", "counts", "tokens"]
        seen: set[int] = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            own = batch.column(0).fill_null(0).to_numpy().view(np.uint64) ^ batch.column(2).to_numpy().view(np.uint64)
            spread = -1 - (mixed(own) % np.uint64(max(1024, ranges))).astype(np.int32)  # document rows ride along, copies apart
            for lo, hi in blocks(offsets):
                sets = shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                sigs = [signature(s) for s in sets]
                for sig, tokens in zip(sigs, sets):
                    if len(tokens) and sig not in seen:
                        seen.add(sig)
                        packer.add(sig, len(tokens), tokens)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(sigs, pa.int64()),
                                                  pa.array([len(s) for s in sets], pa.int32()), pa.array(spread[lo:hi]), *blank(hi - lo)], names)
                if packer.held >= 3_000_000:
                    yield packed()
                    seen.clear()
        yield packed()
    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class and hash range how many of its shingles other classes have; document rows pass."""
    names = ["id", "row", "sig", "n", "shared"]

    def parts():
        for batch in batches:
            part = batch.column(4).to_numpy(zero_copy_only=False)
            docs = part < 0
            if docs.any():
                some = batch.filter(pa.array(docs))
                documents.append(pa.RecordBatch.from_arrays([*some.columns[:4], pa.nulls(some.num_rows, pa.int64())], names))
            if not docs.all():
                some = batch.filter(pa.array(~docs))
                yield pa.RecordBatch.from_arrays(some.columns[4:], ["part", "classes", "sizes", "counts", "tokens"])

    documents: list[pa.RecordBatch] = []
    for tokens, owner, _ in _owned(parts(), wide=False):
        yield from documents
        documents.clear()
        sig, n = np.unique(owner[_shared(tokens)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(sig), pa.int64()), pa.nulls(len(sig), pa.int64()), pa.array(sig), pa.nulls(len(sig), pa.int32()), pa.array(n.astype(np.int64))], names)
    yield from documents


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, size, fragment, tokens) of each document whose set is the wanted class."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        wanted = batch.column(1).to_pylist()
        for lo, hi in blocks(offsets):
            rows = []
            for i, tokens in enumerate(shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])):
                if signature(tokens) == wanted[lo + i]:
                    cuts = np.searchsorted(tokens >> np.uint64(61), np.arange(FRAGMENTS + 1))
                    rows += [(wanted[lo + i], len(tokens), f, tokens[cuts[f]:cuts[f + 1]].tobytes()) for f in range(FRAGMENTS) if cuts[f + 1] > cuts[f]]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                             ["sig", "n", "fragment", "tokens"])


def _repack(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(ranges, wide=True)
        for batch in batches:
            for sig, n, _, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(sig, n, np.frombuffer(tokens, np.uint64))
                if packer.held >= 2_000_000:
                    yield packer.rows()
        yield packer.rows()
    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, size, tokens that other classes have, number of classes of each) of each hash range."""
    for tokens, owner, size in _owned(batches, wide=True):
        shared = _shared(tokens)
        tokens, owner, size = tokens[shared], owner[shared], size[shared]
        _, which, classes = np.unique(tokens, return_inverse=True, return_counts=True)
        common = classes[which]
        order = np.lexsort((tokens, owner))
        tokens, owner, size, common = tokens[order], owner[order], size[order], common[order]
        sig, first = np.unique(owner, return_index=True)
        ends = np.append(first[1:], len(owner))
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(size[first].astype(np.int32)),
                                          pa.array([tokens[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                                          pa.array([common[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], ["sig", "n", "tokens", "common"])


def _prefixes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows = None, [], []

        def close() -> None:
            sig, n = at
            tokens = np.concatenate([np.frombuffer(t, np.uint64) for t, _ in held])
            common = np.concatenate([np.frombuffer(c, np.int64) for _, c in held])
            own = n - len(tokens)
            take = n - -(-least * n // 100) + 1 - own
            if take > 0:
                tokens = tokens[np.lexsort((tokens, common))[:take]]
                rows.append((np.full(len(tokens), sig, np.int64), n, own, tokens.view(np.int64)))

        def out() -> pa.RecordBatch:
            sig = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)])
            each = [len(r[0]) for r in rows]
            token = np.concatenate([np.zeros(0, np.int64), *(r[3] for r in rows)])
            n, own = np.repeat(np.array([r[1] for r in rows], np.int32), each), np.repeat(np.array([r[2] for r in rows], np.int32), each)
            before = own + np.concatenate([np.zeros(0, np.int64), *(np.arange(e) for e in each)])
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(sig), *(pa.array(x.astype(np.int32)) for x in (n, own, before))],
                                              ["token", "sig", "n", "own", "before"])

        for batch in batches:
            for sig, n, *tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None and at[0] != sig:
                    close()
                    held = []
                at = (sig, n)
                held.append(tokens)
            yield out()
        if at is not None:
            close()
            yield out()
    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                  for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["a", "b", "both"])


def _linked(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """Of the pairs (a, b) those whose overlap, summed over fragments, is enough."""
    of_b = segments.select(col("sig").alias("b"), col("fragment").alias("part_b"), col("tokens").alias("tokens_b"))
    of_a = segments.select(col("sig").alias("a"), "fragment", col("tokens").alias("tokens_a"))
    beside = pairs.join(of_b, "b").join(of_a.withColumnRenamed("a", "a_"), (col("a") == col("a_")) & (col("part_b") == col("fragment")))
    partial = beside.select("a", "b", "tokens_a", "tokens_b").mapInArrow(_overlaps, "a bigint, b bigint, both bigint")
    both = partial.groupBy("a", "b").agg(F.sum("both").alias("both"))
    n_a, n_b = (sizes.select(col("sig").alias(x), col("n").alias(f"n_{x}")) for x in "ab")
    return both.join(n_a, "a").join(n_b, "b").where(100 * col("both") >= least * (col("n_a") + col("n_b") - col("both"))).select("a", "b")


def _open(postings: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """What can still connect something: groups with members of two components, and in them the members with enough
    shingles from this one on for a partner as small as the smallest."""
    named = postings.join(labels.select(col("node").alias("sig"), "component"), "sig")
    groups = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")) \
        .where("low <> high").select("token", "least")
    enough = (100 + least) * (col("n") - col("before")) >= least * (col("n") + col("least"))
    return keep(named.join(groups, "token").where(enough).select("token", "sig", "n", "own", "before", "component"), "postings")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 80) -> DataFrame:
    """Per row of ``docs``: the key, ``n_shingles``, ``component_id`` and ``row``, a hash of the text.  ``least``: similarity in percent."""
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(key).cast("bigint").alias("id"), body.alias("text"), F.xxhash64(body).alias("row"))
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    ranges = max(64, -(-words // RANGE_SHINGLES))
    dealt = rows.mapInArrow(_documents(ranges), f"id bigint, row bigint, sig bigint, n int, {PACKED}").repartition("part").sortWithinPartitions("part")
    counted = keep(dealt.mapInArrow(_count_shared, "id bigint, row bigint, sig bigint, n int, shared bigint"), "shared", BATCH_BYTES)
    documents = counted.where("n is not null").select("id", "row", "sig", "n")
    classes = documents.where("n > 0").groupBy("sig", "n").agg(F.min("id").alias("first"))
    shared = counted.where("shared is not null").groupBy("sig").agg(F.sum("shared").alias("shared"))
    left = keep(classes.join(shared, "sig").where(100 * col("shared") >= least * col("n")), "left")

    chosen = rows.join(left.select("sig", col("first").alias("id")), "id").select("text", "sig")
    segments = keep(chosen.mapInArrow(_segments, "sig bigint, n int, fragment int, tokens binary").dropDuplicates(["sig", "fragment"]), "segments")
    part = segments.mapInArrow(_repack(ranges), PACKED).repartition("part").sortWithinPartitions("part")
    tokens = part.mapInArrow(_shared_tokens, "sig bigint, n int, tokens binary, common binary").repartition("sig").sortWithinPartitions("sig")
    postings = keep(tokens.mapInArrow(_prefixes(least), "token bigint, sig bigint, n int, own int, before int"), "postings")

    sizes = left.select("sig", "n")
    labels = left.select(col("sig").alias("node"), col("sig").alias("component"))
    tested, leaders = None, 1
    postings = _open(postings, labels, least)
    while postings.limit(1).count():
        slot = F.pmod(F.xxhash64("sig"), F.lit(leaders)).alias("slot")
        groups = keep(postings.groupBy("token", slot).agg(F.min(F.struct("own", "sig", "n", "before", "component")).alias("lead")).select("token", "lead"), "leaders")
        bound = F.least(col("n") - col("before"), col("lead.n") - col("lead.before"))
        pairs = postings.join(groups, "token").where("component <> lead.component") \
            .where((100 + least) * bound >= least * (col("n") + col("lead.n"))) \
            .select(F.least("lead.sig", "sig").alias("x"), F.greatest("lead.sig", "sig").alias("y"), col("lead.sig").alias("a"), col("sig").alias("b"))
        pairs = pairs.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("x", "y", "p.a", "p.b")
        if tested is not None:
            pairs = pairs.join(tested.select("x", "y"), ["x", "y"], "left_anti")
        pairs = keep(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = keep(_linked(pairs.select("a", "b"), segments, sizes, least), "links")
        if found.limit(1).count():
            of = lambda side: labels.select(col("node").alias(side), col("component").alias(f"c{side}"))
            ends = found.join(of("a"), "a").join(of("b"), "b").select(col("ca").alias("a"), col("cb").alias("b"))
            grown = components(ends).select(col("node").alias("component"), col("component").alias("to"))
            labels = keep(labels.join(grown, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        # leaders have met all members of their groups and leave them
        rest = postings.select("token", "sig", "n", "own", "before").join(groups.select("token", col("lead.sig").alias("sig")), ["token", "sig"], "left_anti")
        after = _open(rest, labels, least)
        drop(postings, groups)
        postings, leaders = after, leaders * 2

    member = left.select("sig", "first").join(labels.withColumnRenamed("node", "sig"), "sig").select("sig", "first", "component")
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    member = member.join(smallest, "component").select("sig", "component_id")
    known = classes.select("sig", "first").join(member, "sig", "left").select("sig", F.coalesce("component_id", "first").alias("component_id"))
    known = keep(known, "components")
    return documents.join(known, "sig", "left").select(
        col("id").alias(key), col("n").cast("bigint").alias("n_shingles"),
        F.when(col("n") > 0, col("component_id")).otherwise(col("id")).alias("component_id"), "row")


def one_of_each(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text", group_key: str | None = None) -> DataFrame:
    """The document with the smallest id of every component of :func:`jaccard_components` (a kept table).

    ``group_key``: the key's name in ``groups`` where it differs.
    Rows that repeat it stay once.  Where all ids of a component are null,
    one row of every distinct text stays.
    """
    of = groups.select(col(group_key or key).alias("_i"), col("row").alias("_r"), col("component_id").alias("_c")).where(col("_i").eqNullSafe(col("_c")))
    empty = F.when(col("_c").isNull(), col("_r"))
    chosen = of.groupBy("_c", empty.alias("_e")).agg(F.min("_r").alias("_r"), F.count("*").alias("_n")).select(col("_c").alias("_i"), "_r", "_n")
    body = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    rows = docs.join(chosen, docs[key].eqNullSafe(col("_i")) & (body == col("_r")))
    once = rows.where("_n = 1")
    again = rows.where("_n > 1").dropDuplicates(["_i", "_r"])
    return once.union(again).drop("_i", "_r", "_n")
