"""Byte-pair encoding against the tokenizer library, phrases and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sessionlens.llm import bpe, collocations, periodic_runs, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def make_texts() -> list:
    rng = random.Random(11)
    letters = "abcdefghijthe    \n\t'AÉñß'sll中文😀1234Σς\x00́İ‖!?"
    extra = ["<|endoftext|>", "<|startoftext|>", "the ", "'re", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.97 else rng.choice(extra) for _ in range(rng.randrange(120))) for _ in range(300)]
    return texts + [None, "", " \n", "a", "".join(rng.choice("abcdefthin") for _ in range(3000)), "x" * 700, texts[0], texts[0]]


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(VOCABULARY)
    rows = [(i % 50, t, "mine", "mine") for i, t in enumerate(make_texts())]
    docs = spark.createDataFrame(rows, "doc_id int, text string, decoded_text string, TOKENS string").repartition(3)
    got = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    assert len(got) == len(rows)
    for row in got:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want
        assert row.decoded == library.decode(want, skip_special_tokens=False)
        assert row.decoded_text == row.TOKENS == "mine"


def test_a_column_with_the_name_of_the_result_is_replaced_and_unknown_identifiers_are_left_out(spark):
    docs = spark.createDataFrame([(1, "the cat", "old"), (2, None, None)], "doc_id int, text string, IDS string")
    assert bpe.encode(docs, VOCABULARY).columns == ["doc_id", "text", "ids"]
    frame = spark.createDataFrame([(1, [320, -5, None, 10**6, 49407]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert [r.decoded for r in bpe.decode(frame, VOCABULARY).orderBy("doc_id").collect()] == ["a</w> <|endoftext|>", "", ""]
    none = bpe.decode(bpe.encode(docs.limit(0), VOCABULARY), VOCABULARY)
    assert none.collect() == [] and none.columns == ["doc_id", "text", "ids", "decoded"]


# --- phrases -----------------------------------------------------------------------------


def pieces_of(text: str | None) -> list[list[str]]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute_frequencies(rows, least: int, longest: int = 5) -> dict:
    counts = Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang if lang is not None else "und", " ".join(words[i:i + k])] += 1
    return {key: n for key, n in counts.items() if n >= least}


def make_phrases() -> list[tuple]:
    rng = random.Random(4)
    common = ["the", "of", "New", "york", "é", "\x1c", "a b"]
    rows = []
    for i in range(150):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 200))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    rows += [("en", None), ("en", ""), (None, " .,"), ("fr", "la " * 200), ("en", rows[0][1]), ("en", rows[0][1])] + [("de", rows[1][1])] * 40
    return rows


@pytest.mark.parametrize("shards, slots, least", [(4, 1 << 16, 20), (1, 2, 20), (3, 64, 7)])
def test_frequencies_are_exact_at_any_load_of_the_table(spark, shards, slots, least):
    rows = make_phrases()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = collocations.frequent_phrases(docs, least=least, shards=shards, slots=slots).where("k > 0").collect()
    assert Counter((r.lang, r.phrase) for r in got).most_common(1)[0][1] == 1
    assert {(r.lang, r.phrase): r.a for r in got} == brute_frequencies(rows, least)
    assert all(r.k == len(r.phrase.split(" ")) for r in got)


def test_long_texts_are_worked_on_in_parts(spark, monkeypatch):
    text = "".join(f"a b c{i % 3}{',' if i % 7 == 0 else ''} " for i in range(20_000))
    monkeypatch.setattr(collocations, "BLOCK", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array([text, None, "x"])], ["lang", "text"])
    parts = list(collocations.blocks_of(iter([batch])))
    assert len(parts) > 50
    assert sum(len(p.replace(b",", b" ").split()) for _, p in parts) == len(text.replace(",", " ").split()) + 1


def test_scores_are_exact_and_dominated_phrases_go(spark):
    rows = [("en", "", 0, 4 * 10**12), ("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12), ("en", "c", 1, 10**12), ("en", "a b", 2, 10**12 - 1),
            ("en", "b c", 2, 10**12 - 1), ("en", "a b c", 3, 10**12 - 1), ("en", "c a", 2, 5), ("en", "a c", 2, 5)]
    frequent = spark.createDataFrame(rows, "lang string, phrase string, k int, a bigint")
    got = [(r.phrase, r["rank"], r.l, r.r, r.score) for r in collocations.collocations(frequent).orderBy("rank").collect()]
    a = 10**12 - 1
    weakest = min((1000 * a * 4 * 10**12) // (3 * 10**12 * a), (1000 * a * 4 * 10**12) // (a * 10**12))
    low = (1000 * 5 * 4 * 10**12) // (3 * 10**12 * 10**12)
    assert got == [("a b c", 1, 3 * 10**12, a, weakest), ("a c", 2, 3 * 10**12, 10**12, low), ("c a", 3, 10**12, 3 * 10**12, low)]
    assert collocations.collocations(frequent, best=2).count() == 2


def test_no_rows_no_phrases(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(collocations.frequent_phrases(docs)).collect() == []
    with pytest.raises(ValueError):
        collocations.frequent_phrases(docs, slots=100)


# --- periodic runs -------------------------------------------------------------------------


def brute_runs(words: list[str], least: int = 24) -> list[tuple[int, int, int]]:
    n, out, seen = len(words), [], set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 3 * q) and (start, length) not in seen:
                seen.add((start, length))
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs) -> str:
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng: random.Random) -> list[str]:
    letters = rng.choice([["a"], ["a", "b"], ["a", "b", "c"], [f"w{i}" for i in range(30)]])
    if rng.random() < 0.3:
        return [rng.choice(letters) for _ in range(rng.randrange(300))]
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 43, 64, 100]))]
        if rng.random() < 0.4:
            unit = unit * rng.randrange(1, 5) + [rng.choice(letters)]
        out += (unit * 7)[:int(len(unit) * rng.random() * 6)] + ["x"] * (rng.random() < 0.3)
    return out * (rng.randrange(1, 5) if rng.random() < 0.5 else 1)


@pytest.mark.parametrize("least", [24, 24, 24, 3, 6, 10])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(40):
        texts = [repetitive(rng) for _ in range(4)]
        sizes, runs, kept = periodic_runs.analyse([" ".join(t).encode() for t in texts], least)
        assert sizes == [len(t) for t in texts]
        for words, own, rest in zip(texts, runs, kept):
            assert own == brute_runs(words, least)
            assert rest.decode() == collapse(words, own)


def test_a_long_period_whose_grams_all_recur_sooner():
    words = (["a"] * 20 + ["b"] + ["a"] * 21 + ["b"]) * 5
    assert (0, len(words), 43) in periodic_runs.analyse([" ".join(words).encode()], 24)[1][0]


def test_one_word_repeated_is_one_run_and_linear():
    sizes, runs, kept = periodic_runs.analyse([b"a " * 200_000, b"b " * 23, b""], 24)
    assert runs == [[(0, 200_000, 1)], [], []] and kept[0] == b"a" and sizes == [200_000, 23, 0]


def planted(doc_id: int | None, text: str | None) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["x", "é", f"w{rng.randrange(90)}", "z\x1cz"]) for _ in range(rng.randrange(200))), "mine") for i in range(300)]
    rows += [(i, "\t".join(repetitive(rng)), None) for i in range(300, 400)] + [(10, None, ""), (None, "a " * 40, ""), (None, None, None), (11, "", ""), (11, " \n", "")]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("runs", pa.string())])
    pq.write_table(pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema), tmp_path / "documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        words = planted(doc_id, text)
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapse(words, runs))))
    assert got == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 50


def test_no_rows_no_runs(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic_runs.find_runs(docs).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, least=2)
