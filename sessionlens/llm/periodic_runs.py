"""Periodic runs of words, found by seeds on diagonals and extension.

A run is a stretch with smallest period q of at least ``least`` words and three
periods that no neighbouring word extends.  On the diagonal of lag q its words
agree with those q places on over max(least - q, 2q) places at least, so every
run holds two equal k-grams at that lag, k being the least such overlap of the
lags in question.  Lags fall into classes: the first holds all lags below the
least overlap k0 of any lag; the class of lags from Q to 2Q, Q doubling from
k0, uses 2Q-grams, two of which overlap at these lags.

Per class the k-grams of a document are indexed by a rolling hash, pairs of
occurrences at lags of the class are enumerated, and each pair is extended word
by word to both sides.  A table keeps per lag the place that extension has
reached, so a diagonal is walked once.  Only positions whose gram of the class
before had a partner take part, and from the second class on positions inside
a found run of a period up to k/4 do not: of the k/2 or more grams of a run in
the class, one at least has a longer period, as neighbouring grams of short
periods would share it and so shorten the run's own.  What is left recurs at
distances over k/4, so a position has three partners at most and the pairs stay
linear in the text; a text of one repeated word costs no more than prose.

Equal hashes only propose pairs: words are compared by their numbers, and a
stretch already found with a shorter period is not reported again, so results
are exact.

Defined cases: null and empty texts have no words and no runs and collapse to
the empty text; keys may be null or repeat, rows are worked on each on its own;
columns of the input other than key and text are left out; empty tables give
empty tables.  A document is worked on in one task, in memory of a few dozen
bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sessionlens.llm.common import INVERSE, ROOT, mixed, powers

WORDS = 1 << 20  # words that are worked on at once, one document at least
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def least_overlap(least: int) -> int:
    """Words that agree, lag after lag, in any run: the least over all periods."""
    return min(max(least, 3 * q) - q for q in range(1, least + 2))


def gram_hashes(sums: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((sums[at + k] - sums[at]) * powers(INVERSE, len(sums))[at])


def extended(codes: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The widest stretch around ``i`` in which each word equals the one ``lag`` places on."""
    start, step = i, 32
    while start:  # to the left
        low = max(0, start - step)
        other = codes[low:start] != codes[low + lag:start + lag]
        if other.any():
            start -= int(other[::-1].argmax())
            break
        start, step = low, step * 2
    end, step, last = i, 32, len(codes) - lag
    while end < last:  # to the right
        high = min(last, end + step)
        other = codes[end:high] != codes[end + lag:high + lag]
        if other.any():
            end += int(other.argmax())
            break
        end, step = high, step * 2
    return start, end


def seed_pairs(keys: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of equal keys at distances from ``low`` to below ``high``, and which positions have any equal one.

    ``at`` ascends.  Returns first positions, lags and the mask of positions.
    """
    order = np.argsort(keys, kind="stable")
    sorted_keys, places = keys[order], at[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = sorted_keys[1:] == sorted_keys[:-1]
    repeats = np.zeros(len(at), bool)
    repeats[order] = same[1:] | same[:-1]
    firsts, lags, live, step = [], [], np.flatnonzero(same[1:]), 1
    while len(live):  # the next, the second next ... equal occurrence while it is near enough
        lag = places[live + step] - places[live]
        near = lag < high
        live, lag = live[near], lag[near]
        wanted = lag >= low
        firsts.append(places[live[wanted]])
        lags.append(lag[wanted])
        step += 1
        live = live[live + step < len(at)]
        live = live[sorted_keys[live + step] == sorted_keys[live]]
    return (np.concatenate(firsts), np.concatenate(lags), repeats) if firsts else (at[:0], at[:0], repeats)


def find_in(codes: np.ndarray, documents: np.ndarray, least: int = 24) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of the texts that lie end to end in ``codes``.

    Words are numbers; a number of its own stands behind every text.
    ``documents``: the number of the text of each place.
    """
    k = k0 = least_overlap(least)
    if len(codes) < least:
        return []
    values = mixed(codes.astype(np.uint64) + np.uint64(1))
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(ROOT, len(codes))[:len(codes)], out=sums[1:])
    found: dict[tuple[int, int], int] = {}
    reached: dict[int, int] = {}
    at, low, high = np.arange(len(codes) - k + 1), 1, k0
    waiting = at[:0]
    while len(at):
        if k > k0:  # grams of a short period cannot be all that a run of this class has
            inside = np.zeros(len(codes), bool)
            for (start, end), period in found.items():
                if 4 * period <= k <= end - start:
                    inside[start:end - k + 1] = True
            at, waiting = at[~inside[at]], at[inside[at]]
        keys = gram_hashes(sums, at, k) ^ mixed(documents[at].astype(np.uint64))
        firsts, lags, repeats = seed_pairs(keys, at, low, high)
        order = np.lexsort((firsts, lags))
        firsts, lags = firsts[order], lags[order]
        new = np.ones(len(firsts), bool)  # a pair one place after another on its diagonal adds nothing
        new[1:] = (lags[1:] != lags[:-1]) | (firsts[1:] != firsts[:-1] + 1)
        for i, lag in zip(firsts[new].tolist(), lags[new].tolist()):
            if i < reached.get(lag, 0) or codes[i] != codes[i + lag]:
                continue
            start, end = extended(codes, i, lag)
            reached[lag] = end
            if end + lag - start >= max(least, 3 * lag):
                found.setdefault((start, end + lag), lag)
        at = np.sort(np.concatenate([at[repeats], waiting]))  # a longer gram may leave the short period
        low, high = high, 2 * high
        k = 2 * low
        at = at[at + k <= len(codes)]
    return sorted((start, end - start, period) for (start, end), period in found.items())


def analyse(texts: list[bytes], least: int) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Per text: number of words, runs, and the text without what repeats."""
    words = [t.split() for t in texts]  # space and the bytes 9 to 13 separate
    sizes = [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    encoded = pa.array(flat, pa.large_binary()).dictionary_encode()
    ends = np.cumsum(sizes)
    codes = np.insert(encoded.indices.to_numpy().astype(np.int64), ends, len(encoded.dictionary) + np.arange(len(texts)))
    starts = ends - sizes + np.arange(len(texts))
    documents = np.repeat(np.arange(len(texts)), np.array(sizes) + 1)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_in(codes, documents, least):
        text = int(documents[start])
        runs[text].append((start - int(starts[text]), length, period))
    kept = []
    for ws, own in zip(words, runs):
        if own:
            stays = np.ones(len(ws), bool)
            for start, length, period in own:
                stays[start + period:start + length] = False
            ws = [ws[i] for i in np.flatnonzero(stays)]
        kept.append(b" ".join(ws))
    return sizes, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs], kept


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24) -> DataFrame:
    """Per row: the key, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` holds the words that no run contains after its first period, joined by one space.
    """
    if least < 3:
        raise ValueError("a run has three words at least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= 6 * WORDS):
                    size += len(texts[last])
                    last += 1
                sizes, runs, kept = analyse(texts[first:last], least)
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], RUN.names))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sizes, pa.int64()), lists,
                                                  pa.array(kept, pa.binary()).cast(pa.string())], [key, "n_words", "runs", "collapsed"])
                first = last

    schema = StructType([docs.schema[key], StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return docs.select(key, text).mapInArrow(work, schema)
