"""Byte-pair encoding and decoding with contiguous rank arrays.

Encoding holds, for one word, the parts between its boundaries and next to them
the rank of merging each part with the part behind it, both as plain arrays.
Round by round it scans for the lowest rank, deletes the boundary there and
refreshes the two ranks that changed.  Words are short, so a scan beats any
tree; a long word is the same array cut into blocks of ``BLOCK`` parts with the
lowest rank of each block beside it, so a round costs a scan of the block
minima and of one block.

Texts are prepared as the vocabulary file asks: special strings are cut out
first and become their own token, the rest is NFC, letter by letter lower case
and cut into words by the pattern.  Words repeat, so each task remembers a
bounded number of encoded words.  Decoding looks the tokens up and joins them
by one space, which is what a vocabulary without a decoder asks for.

Defined cases: null and empty texts encode to no identifiers; no (or null)
identifiers decode to the empty text; identifiers that the vocabulary does not
have are left out; all columns of the input stay, whatever their names, but for
one that has the name asked for the result, which is replaced; repeated rows
and keys are encoded each on its own; empty tables give empty tables.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sessionlens.llm.token_count import byte_letters, lower

BLOCK = 256  # parts of a word in one block
REMEMBERED = 300_000  # encoded words per task
LONGEST_REMEMBERED = 64  # letters of a word that is remembered
NEVER = 1 << 60  # the rank of parts that do not merge


class Vocabulary:
    """Ranks and products of the merges, symbols of bytes, tokens by identifier."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inside = [ids[c] for c in letters]
        self.final = [ids[c + end] for c in letters]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.pattern = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        known = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = [known.get(i) for i in range(max(known) + 1)]

    def encode_word(self, word: bytes) -> list[int]:
        """Identifiers of one word, merged lowest rank first, leftmost first among equal ranks."""
        parts = [self.inside[b] for b in word[:-1]] + [self.final[word[-1]]]
        find = self.ranks.get
        ranks = [find(pair, NEVER) for pair in zip(parts, parts[1:])] + [NEVER]
        blocks = [parts[i:i + BLOCK] for i in range(0, len(parts), BLOCK)]
        ranked = [ranks[i:i + BLOCK] for i in range(0, len(parts), BLOCK)]
        lowest = [min(r) for r in ranked]
        while (low := min(lowest)) != NEVER:
            at = lowest.index(low)
            own, mine = blocks[at], ranked[at]
            i = mine.index(low)
            own[i] = self.made[low]
            if i + 1 < len(own):  # the boundary behind part i goes
                del own[i + 1], mine[i + 1]
            else:
                del blocks[at + 1][0], ranked[at + 1][0]
                if blocks[at + 1]:
                    lowest[at + 1] = min(ranked[at + 1])
                else:
                    del blocks[at + 1], ranked[at + 1], lowest[at + 1]
            behind = own[i + 1] if i + 1 < len(own) else blocks[at + 1][0] if at + 1 < len(blocks) else None
            mine[i] = find((own[i], behind), NEVER)
            if i:
                mine[i - 1] = find((own[i - 1], own[i]), NEVER)
            elif at:
                ranked[at - 1][-1] = find((blocks[at - 1][-1], own[0]), NEVER)
                lowest[at - 1] = min(ranked[at - 1])
            lowest[at] = min(mine)
        return [part for block in blocks for part in block]


class Words(dict):
    """Encoded words as packed 32-bit identifiers, a bounded number of them."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.encode_word = vocabulary.encode_word

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.encode_word(word.encode()), np.int32).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


class Encoder:
    """Texts to packed identifiers."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = Words(self.vocabulary)
        self.find = regex.compile(self.vocabulary.pattern).findall
        special = self.vocabulary.special
        self.special = {text: np.array([i], np.int32).tobytes() for text, i in special.items()}
        longest_first = sorted(special, key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})").split if special else None

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut(text)  # plain and special parts take turns
        return b"".join(self.special[p] if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(lower(unicodedata.normalize("NFC", text)))))


def decode_lists(ids: pa.ListArray, tokens: list[str | None]) -> pa.Array:
    """One text per list: its tokens joined by one space."""
    offsets = ids.offsets.to_numpy()
    values = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
    known = np.array([t is not None for t in tokens] + [False])
    flat = values.fill_null(-1).to_numpy(zero_copy_only=False)
    have = known[np.where((flat >= 0) & (flat < len(tokens)), flat, len(tokens))]
    ends = np.concatenate([[0], np.cumsum(have)])[offsets - offsets[0]]
    words = pa.array(tokens, pa.large_string()).take(pa.array(flat[have]))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), words), pa.scalar(" ", pa.large_string())).cast(pa.string())


def _with(frame: DataFrame, name: str, kind) -> tuple[list[str], StructType]:
    """The columns that stay and the schema with the column ``name`` behind them."""
    stay = [f for f in frame.schema.fields if f.name.lower() != name.lower()]
    return [f.name for f in stay], StructType([*stay, StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the identifiers of ``text`` as an array column ``ids``, in reading order.

    ``path``: the vocabulary file, at the same place on every executor.
    """
    stay, schema = _with(docs, ids, ArrayType(IntegerType()))
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            packed = [encoder(t) if t else b"" for t in batch.column(place).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name in stay]
            yield pa.RecordBatch.from_arrays([*columns, lists], [*stay, ids])

    return docs.mapInArrow(work, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the text of the identifiers in ``ids`` as a column ``text``."""
    stay, schema = _with(frame, text, StringType())
    place = frame.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(path).tokens
        for batch in batches:
            texts = decode_lists(pc.fill_null(batch.column(place), pa.scalar([], pa.list_(pa.int32()))), tokens)
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name in stay]
            yield pa.RecordBatch.from_arrays([*columns, texts], [*stay, text])

    return frame.mapInArrow(work, schema)
