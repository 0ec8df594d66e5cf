"""Token counts of byte-pair encodings by merging on a heap and a linked list.

A word starts as its bytes, the last one marked as the word's end.  Adjacent
pairs that have a merge rank lie on a heap; the lowest rank, leftmost first, is
popped and merged, the neighbours in the linked list form new pairs, and pairs
that no longer exist are skipped when popped.  The count is the number of
initial symbols minus the merges; identifiers are never written out.

Texts are prepared as the vocabulary file asks: NFC, white space runs to one
space, lower case letter by letter, then words by the pattern.  Special strings
are cut out first and count as one token each.  Words repeat, so each task
remembers a bounded number of counts.

Defined cases: null and empty texts have 0 tokens; a word of any length is one
heap, so a long text costs n log n.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

REMEMBERED = 400_000  # words per task


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + b - sum(p < b for p in plain)) for b in range(256)]


class MergeTable:
    """Ranks and results of the merges, and the symbols of bytes inside and at the end of a word."""

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        ids = model["vocab"]
        end = model["end_of_word_suffix"]
        steps = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(steps)}
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + end] for c in letters]
        self.special = [t["content"] for t in vocabulary["added_tokens"]]
        parts = vocabulary["pre_tokenizer"]["pretokenizers"]
        self.pattern = parts[0]["pattern"]["Regex"]

    def count(self, word: bytes) -> int:
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        n, merges = len(symbols), self.merges
        if n == 1:
            return 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            merge = merges.get((symbols[i], symbols[i + 1]))
            if merge:
                heap.append((merge[0], i, merge[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] is None:
                continue
            merge = merges.get((symbols[i], symbols[j]))
            if merge is None or merge[0] != rank:
                continue  # the pair has gone meanwhile
            symbols[i], symbols[j] = made, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                merge = merges.get((made, symbols[after[j]]))
                if merge:
                    heapq.heappush(heap, (merge[0], i, merge[1]))
            if before[i] >= 0:
                merge = merges.get((symbols[before[i]], made))
                if merge:
                    heapq.heappush(heap, (merge[0], before[i], merge[1]))
            left -= 1
        return left


class WordCounts(dict):
    """Counts of words seen, up to a bound."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.table.count(word.encode())
        if len(word) < 100:
            self[word] = n
        return n


def lower(text: str) -> str:
    """Letter by letter: the final sigma has no rule of its own."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            table = MergeTable(json.load(file))
        self.words = WordCounts(table)
        self.find = regex.compile(table.pattern).findall
        self.cut = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        self.special = table.special

    def __call__(self, text: str) -> int:
        total, parts = 0, [text]
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            total = len(parts) - 1
        for part in parts:
            part = lower(unicodedata.normalize("NFC", part))
            total += sum(map(self.words.__getitem__, self.find(part)))
        return total


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``n_tokens``.  ``path``: the vocabulary file, at the same place on every executor."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            counts = [counter(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], [key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    return docs.select(F.col(key), F.col(text), size.alias("n_bytes")).mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
