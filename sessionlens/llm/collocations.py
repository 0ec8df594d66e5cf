"""Phrase collocations by dynamic itemset counting.

The texts are dealt into shards that are scanned cyclically.  A scan counts the
phrases that are active: single words from the start, a longer phrase from the
scan after both its subphrases (without its last and without its first word)
have reached the threshold in what has been counted so far.  Lengths are
therefore counted side by side, and each phrase is counted for one full cycle,
whose sum is its exact frequency.  No phrase of the threshold is missed, as its
subphrases are as frequent as it is.

Which phrases have reached the threshold, and since which scan, is a table of
one byte per slot that tasks look phrases up in by hash.  Its size is a
parameter, so what is broadcast does not grow with the texts.  A slot keeps the
first scan that was written to it: two phrases that share a slot only make
counting start early, for a full cycle nevertheless, and counts stay exact at
any load of the table; a fuller table prunes less.  Phrases are counted by
96-bit hashes of their words.  Per block of text a task adds up before
anything is shuffled, and Spark adds up per task, so a phrase that is
everywhere leaves one row per task.  At the end the texts of the frequent
phrases are read back, from few files first, looking only for those not named yet.

Words: A-Z lower case, texts cut into pieces at ``.,;:!?`` and the bytes 10 to
13, pieces into words at spaces and tabs.  Everything is per language.

Defined cases: null and empty texts hold no words; a null language is ``und``
and one with the language ``und``; other columns and keys play no part, rows
that repeat count each; ties are ordered by the phrase in UTF-8 bytes; empty
tables give empty tables.  A piece, the text between two cuts, is worked on
whole; a longer text is worked on in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.llm.common import drop, keep, mixed

BLOCK = 4 << 20  # bytes of text that a task works on at once
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
PREPARE = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"," * len(BREAKS) + b" ")
UNSET = 255
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint32(0x85EBCA77))
REMEMBERED = 100_000  # hashes of words per task
BATCH = 8 << 20  # bytes of text in an Arrow batch
LENGTH = np.uint64(0xA0761D6478BD642F)  # tells phrases of different lengths apart
COUNTS = "h1 bigint, h2 int, n bigint, kind int"  # kind: length + 8 * first scan
NAMES = "h1 bigint, h2 int, lang string, phrase string"


def slot_of(keys: np.ndarray, size: int) -> np.ndarray:
    return mixed(keys) >> np.uint64(64 - (size - 1).bit_length())


class Level:
    """The distinct phrases of one length in a block and where each place of the block has one."""

    def __init__(self, k: int, h1, h2, last, since, names, slots: np.ndarray):
        self.k, self.h1, self.h2, self.last, self.names = k, h1, h2, last, names
        with np.errstate(over="ignore"):
            self.key = h1 + np.uint64(k) * LENGTH
        self.slot = slot_of(self.key, len(slots))
        self.reached = slots[self.slot]
        #: a shared slot may be older than those of the subphrases, without which no scan meets the phrase
        self.open = np.maximum(self.reached, since)


class Hashes:
    """96-bit hashes of words of a language, a bounded number of them remembered."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    def __call__(self, words: list[bytes], lang: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for w in words:
            key = lang + b"\0" + w
            h = self.known.get(key)
            if h is None:
                h = xxhash.xxh3_128_digest(key)
                if len(w) < 60:
                    self.known[key] = h
            out.append(h)
        both = np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].astype(np.uint32)


def levels(block: bytes, lang: bytes, hashes: Hashes, slots: np.ndarray, longest: int) -> Iterator[tuple[Level, np.ndarray, np.ndarray, Callable]]:
    """Length by length: the phrases whose subphrases have been reached, how often, since when, and a function to their texts."""
    tokens = pa.array(block.replace(b",", b" , ").split(), pa.large_binary()).dictionary_encode()
    dictionary = tokens.dictionary.to_pylist()
    ids = tokens.indices.to_numpy()
    if b"," in dictionary:
        place = np.flatnonzero(ids != dictionary.index(b","))
        ids = ids[place]
        together = np.diff(place) == 1
    else:
        together = np.ones(max(0, len(ids) - 1), bool)
    if not len(ids):
        return
    h1, h2 = hashes(dictionary, lang)

    def texts(names, at, k):
        """The texts of some phrases of ``k`` words, from the first place that has each."""
        def of(some: np.ndarray) -> list[bytes]:
            first = np.zeros(int(names.max()) + 1, np.int64)
            first[names[::-1]] = at[::-1]
            return [b" ".join([dictionary[w] for w in ids[i:i + k].tolist()]) for i in first[some].tolist()]
        return of

    counts = np.bincount(ids, minlength=len(dictionary))
    since = np.zeros(len(dictionary), np.int32)
    level = Level(1, h1, h2, np.arange(len(dictionary)), since, ids, slots)
    at, usable = np.arange(len(ids)), np.append(together, False)
    yield level, counts, since, texts(ids, at, 1)
    while level.k < longest:
        k = level.k + 1
        names = level.names
        alive = np.zeros(len(ids) + 1, bool)
        alive[at] = level.reached[names] != UNSET
        named = np.full(len(ids) + 1, -1, np.int64)
        named[at] = names
        at = at[usable[at] & alive[at] & alive[at + 1]]
        if not len(at):
            return
        left, right = named[at], named[at + 1]
        pairs = pa.array(left * len(level.h1) + right).dictionary_encode()
        distinct, names = pairs.dictionary.to_numpy(), pairs.indices.to_numpy()
        a, b = np.divmod(distinct, len(level.h1))
        last = level.last[b]
        since = np.maximum(level.open[a], level.open[b])
        with np.errstate(over="ignore"):
            level = Level(k, level.h1[a] * BASE[0] + h1[last], level.h2[a] * BASE[1] + h2[last], last, since, names, slots)
        counts = np.bincount(names, minlength=len(distinct))
        yield level, counts, since, texts(names, at, k)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Prepared text of one language after another, whole pieces, about ``BLOCK`` bytes at a time."""
    for batch in batches:
        of: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            if text:
                of.setdefault(lang, []).append(text)
        for lang, texts in of.items():
            first, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size < BLOCK and i + 1 < len(texts):
                    continue
                joined = b" , ".join(texts[first:i + 1]).translate(PREPARE)
                first, size, start = i + 1, 0, 0
                while start < len(joined):
                    end = len(joined)
                    if end - start > 2 * BLOCK:
                        end = joined.rfind(b",", start + 1, start + BLOCK)
                        end = end if end >= 0 else joined.find(b",", start + BLOCK)
                        end = end if end >= 0 else len(joined)
                    yield lang, joined[start:end]
                    start = end


def count_shard(shard: DataFrame, slots, step: int, shards: int, longest: int) -> DataFrame:
    """What one scan adds to the active phrases; rows of length 0 hold the words of a language."""
    def work(batches):
        table, hashes = slots.value, Hashes()
        for lang, block in blocks_of(batches):
            for level, counts, since, _ in levels(block, lang.encode(), hashes, table, longest):
                active = (counts > 0) & (since + shards > step)
                if level.k == 1 and step < shards:
                    h1, h2 = hashes([b""], lang.encode())
                    yield batch_of(0, h1, h2, counts[active].sum(keepdims=True), np.zeros(1, np.int32))
                if active.any():
                    yield batch_of(level.k, level.key[active], level.h2[active], counts[active], since[active])

    return shard.mapInArrow(work, COUNTS)


def batch_of(k: int, h1, h2, n, since) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(n.astype(np.int64)),
                                       pa.array(k + 8 * since.astype(np.int32))], ["h1", "h2", "n", "kind"])


def name_shard(shard: DataFrame, slots, wanted, longest: int) -> DataFrame:
    """Texts of the phrases whose slot is in ``wanted``, once per task as far as the task remembers them."""
    def work(batches):
        table, asked, hashes, said = slots.value, wanted.value, Hashes(), set()
        for lang, block in blocks_of(batches):
            for level, counts, _, texts in levels(block, lang.encode(), hashes, table, longest):
                if level.k == 1:
                    h1, h2 = hashes([b""], lang.encode())
                    yield names_of(h1, h2, lang, [b""])
                sel = np.flatnonzero((counts > 0) & asked[level.slot])
                sel = sel[[key not in said for key in level.key[sel].tolist()]]
                if len(said) > 10 * REMEMBERED:
                    said.clear()
                said.update(level.key[sel].tolist())
                for some in np.array_split(sel, len(sel) // 50_000 + 1):
                    if len(some):
                        yield names_of(level.key[some], level.h2[some], lang, texts(some))

    return shard.mapInArrow(work, NAMES)


def names_of(h1, h2, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array([lang] * len(texts), pa.string()),
                                       pa.array(texts, pa.binary()).cast(pa.string())], ["h1", "h2", "lang", "phrase"])


def slots_of(phrases: DataFrame, size: int) -> np.ndarray:
    """The distinct slots of hashed phrases: never more than the table has, which bounds what the driver takes."""
    def work(batches):
        for b in batches:
            slots = slot_of(b.column(0).to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots).astype(np.int32))], ["slot"])

    return phrases.select("h1").mapInArrow(work, "slot int").distinct().toArrow().column(0).to_numpy()


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, shards: int = 2,
                     slots: int = 1 << 24) -> DataFrame:
    """Phrases of up to ``longest`` words that occur ``least`` times in a language: ``lang``, ``phrase``, ``k`` (words), ``a`` (frequency).

    A row of k = 0 and an empty phrase per language holds the number of all words.
    ``shards``: scans of a cycle; ``slots``: size of the table of reached phrases, a power of two.
    """
    if slots & (slots - 1) or not 2 <= slots <= 1 << 31 or not 1 <= shards <= 40 or not 1 <= longest <= 5:
        raise ValueError("slots must be a power of two, shards 1 to 40 and longest 1 to 5")
    spark = docs.sparkSession
    context = spark.sparkContext
    dealt = keep(docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text")), "texts")
    files = sorted(dealt.inputFiles())
    scans = [spark.read.schema(dealt.schema).parquet(*files[i::shards]) if files[i::shards] else None for i in range(shards)]
    table = np.full(slots, UNSET, np.uint8)
    length, since, often = F.col("kind") % 8, F.floor(F.col("kind") / 8), (F.col("n") >= least) | (F.col("kind") % 8 == 0)
    state, latest, step = None, 0, 0
    while step < latest + shards:
        if scans[step % shards] is not None:
            sent = context.broadcast(table)
            counted = count_shard(scans[step % shards], sent, step, shards, longest)
            if state is not None:
                counted = counted.unionByName(state)
            merged = counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("kind").alias("kind"))
            merged = keep(merged.where((since + shards > step + 1) | often), "counts", BATCH)
            sent.destroy()
            if state is not None:
                drop(state)
            state = merged
            reached = state.where((F.col("n") >= least) & (length > 0))
            for starts in (True, False):  # the longest phrases start no others
                new = slots_of(reached.where((length < longest) == starts), slots)
                new = new[table[new] == UNSET]
                table[new] = step + 1
                if starts and len(new):
                    latest = step + 1
        step += 1
    if state is None:
        return spark.createDataFrame([], "lang string, phrase string, k int, a bigint")
    frequent = keep(state.where(often).select("h1", "h2", length.alias("k"), F.col("n").alias("a")), "frequent")
    drop(state)
    named, unnamed, wide = None, frequent, -(-len(files) // 16)
    sent = context.broadcast(table)
    while files:  # few files name most phrases; each scan is twice as wide as the one before
        some, files = files[:wide], files[wide:]
        wide, scan = 2 * wide, spark.read.schema(dealt.schema).parquet(*some)
        asked = np.zeros(slots, bool)
        asked[slots_of(unnamed.where("k > 0"), slots)] = True
        if not (asked.any() or named is None):
            break
        wanted = context.broadcast(asked)
        once = name_shard(scan, sent, wanted, longest).groupBy("h1", "h2").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"))
        got = keep(unnamed.join(once, ["h1", "h2"], "left"), "names", BATCH)
        wanted.destroy()
        found = got.where("lang is not null")
        named = found if named is None else named.unionByName(found)
        unnamed = got.where("lang is null").drop("lang", "phrase")
    sent.destroy()
    return keep(named.select("lang", "phrase", "k", "a"), "phrases")


def collocations(frequent: DataFrame, best: int = 2000) -> DataFrame:
    """The ``best`` phrases of two words and more per language by the score of their weakest cut.

    Phrases that lie in a longer one of the same frequency are left out.
    """
    parts = frequent.where("k > 0").select("lang", "phrase", "a")
    phrases = frequent.where("k > 1").select("lang", "phrase", "k", "a")
    words = F.split("phrase", " ")
    # a longer phrase of the same frequency holds one longer by one word that has it too
    within = phrases.where("k > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stay = phrases.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = stay.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    of = lambda name, n: parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    totals = frequent.where("k = 0").select("lang", F.col("a").alias("n"))
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    scored = cuts.withColumn("score", F.expr(f"(cast({big('a')} * {big('n')} as decimal(35, 0)) * cast(1000 as decimal(4, 0))) div ({big('l')} * {big('r')})"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    ranked = weakest.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
