"""The registered corpus queries on a small hard fixture, against DuckDB or brute force."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from sessionlens.llm import decontaminate, quality, queries, url_filter

TABLES = {
    "documents": pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("text", pa.string()), ("size", pa.string())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string())]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int64())]),
}
QUESTION = "A train leaves Springfield at 9 with 120 passengers and stops 4 times before it meets the other train near the river"


def make_documents() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += [texts[3]] * 25 + [passage + " " + " ".join(rng.choice(words) for _ in range(12)) + str(i) for i in range(20)]
    for i in range(30):  # near copies
        copy = list(base)
        copy[rng.randrange(120)] = f"new{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words) for _ in range(20_000)), "", None, "  \t\n ", "one", "one", "a b c d", "A B c d", "é" * 60, "ÀÉ é x", "x\x1cy z", "end " * 300]
    texts += [QUESTION.replace("Springfield", "Oakham").replace("9", "7") + ".", "The exam asks: " + QUESTION]
    sources = ["web", "web", "web", "books", "code", None]
    return [(i, sources[i % 6], ["en", "de", None][i % 3], t, "clash") for i, t in enumerate(texts, 1)]


def write(folder, documents, pages, benchmark, labels):
    for name, rows in (("documents", documents), ("pages", pages), ("benchmark", benchmark), ("labels", labels)):
        schema = TABLES[name]
        columns = list(zip(*rows)) or [[]] * len(schema)
        pq.write_table(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema), os.path.join(folder, f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    documents = make_documents()
    urls = ["http://example.org/en/12?x=/es/", "https://a.b.example.org/es/x", "http://EXAMPLE.com/fr/", "https://x.com/de/y#z", "notexample.org", None,
            "ftp://badexample.org/es/", "http://com/de/", "http://org", "x://y://example.org/es/", "http://example.org/es", "http://.org/", "://", ""]
    pages = [(i, u, h, "clash") for i, (u, h) in enumerate(((u, h) for u in urls for h in ("<p>same</p>", "", None, f"<p>{u}</p>", "é" * 9)), 1)]
    benchmark = [(1, QUESTION), (2, None), (3, ""), (4, "short"), (1, QUESTION)]
    return write(tmp_path_factory.mktemp("fixture"), documents, pages, benchmark, [(i, i % 2) for i in range(1, 130)] + [(1, None)])


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [], [])


def in_order(frame):
    def plain(v):
        if pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, folder, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    expected = db.sql(queries.ORACLE[name]).df()
    result = queries.QUERIES[name](spark, folder).toPandas()
    assert sorted(result.columns) == sorted(expected.columns)
    assert len(result)
    a, b = in_order(result), in_order(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == pytest.approx(q) if isinstance(p, float) and q is not None else p == q for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_mix_takes_whole_texts_near_the_targets(spark, folder):
    result = queries.op1_mixing(spark, folder).toPandas()
    assert result["size"].sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, _, t, _ in make_documents())
    assert (result.taken <= 3 * result["size"]).all()
    assert result.groupby("source", dropna=False).target.first().sum() == pytest.approx(result["size"].sum())
    again = queries.op1_mixing(spark, folder).toPandas()
    assert in_order(result) == in_order(again)


def test_shards_are_near_equal_and_slots_gapless(spark, folder):
    result = queries.op2_kd_sharding(spark, folder).toPandas()
    assert len(result) == len(make_documents())
    assert result.shard.between(0, 23).all()
    for _, rows in result.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


def test_repeats_equal_brute_force(spark, folder):
    documents = [(i, (t or "").encode()) for i, _, _, t, _ in make_documents()]
    first: dict[bytes, int] = {}
    for i, b in documents:
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], i)
    expected = {}
    for i, b in documents:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        expected[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    result = queries.op5_suffix_dedup(spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result} == expected
    assert any(n for _, n, _, _ in expected.values())


def test_scores_are_whole_and_repeatable(spark, folder):
    result = {r.doc_id: r for r in queries.op9_quality(spark, folder).collect()}
    assert len(result) == len(make_documents())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in result.values())
    by_text = {}
    for i, _, _, t, _ in make_documents():
        by_text.setdefault(t or "", set()).add(result[i].score)
    assert all(len(s) == 1 for s in by_text.values())


def test_token_counts_equal_the_library(spark, folder):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    expected = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, _, _, t, _ in make_documents()}
    assert {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, folder).collect()} == expected


def test_benchmark_questions_are_found(spark, folder):
    found = {r.doc_id: r for r in queries.op3_decontamination(spark, folder).collect()}
    last = len(make_documents())
    assert set(found) == {last - 1, last}
    assert found[last].exact and not found[last - 1].exact


def test_changed_questions_are_found_along_consistent_slots(spark, tmp_path):
    runner = "A runner covers 200 meters in 25 seconds and then rests for 3 minutes before the next lap begins"
    benchmark = [(1, runner), (2, "what is the boiling point"), (3, "one two 3"), (4, "Then 7 and 7 are asked of Paris and Rome in this question")]
    texts = [runner.replace("200 meters", "90 yards").replace("25", "12").replace("3", "8"),  # other numbers, another unit
             runner.replace("200", "25"),  # two values of the item become one
             "Then 8 and 9 are asked of Paris and Rome in this question",  # one value of the item becomes two
             "Then 9 and 9 are asked of Oslo and Bonn in this question", "He asked: what is the boiling point of 5 liters?",
             "nothing of this kind is in here", None, "one two 3", runner + ". " + runner.replace("200", "300")]
    folder = write(tmp_path, [(i, "web", "en", t, "clash") for i, t in enumerate(texts, 1)] + [(1, "web", "en", texts[0], "clash")], [], benchmark, [])
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    columns = ["doc_id", "item_id", "windows", "coverage", "exact"]
    rows = decontaminate.find_items(docs, items).select(columns).toPandas()
    assert {(r.doc_id, r.item_id) for r in rows.itertuples()} == {(1, 1), (2, 1), (4, 4), (5, 2), (9, 1)}
    assert {r.doc_id for r in rows.itertuples() if r.exact} == {5, 9}
    shuffled = decontaminate.find_items(docs, items, broadcast_most=0)
    assert in_order(shuffled.select(columns).toPandas()) == in_order(rows)
    assert {r.doc_id for r in decontaminate.without_items(docs, shuffled, broadcast_most=0).collect()} == {3, 6, 7, 8}
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    assert in_order(db.sql(queries.ORACLE["op3_decontamination"]).df()) == in_order(rows)


def test_windows_move_without_their_texts(spark):
    rows = spark.createDataFrame([(1, QUESTION)], "_row bigint, _text string")
    wanted = spark.createDataFrame([(8, 1)], "_width int, _hash bigint")
    for small in (True, False):
        plan = decontaminate.window_hits(rows, wanted, 8, small)._jdf.queryExecution().executedPlan().toString()
        moved = re.search(r"\[([^\]]*)\], false, \[_place", plan)  # what the rows of windows carry
        assert re.fullmatch(r"_row#\d+L", moved[1]), moved[1]


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, folder, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    near = corpus_pipeline.jaccard_stage(spark, docs, folder)
    assert near.columns == columns
    components = {r.component_id for r in queries.op6_ngram_jaccard(spark, folder).collect()}
    assert {r.doc_id for r in near.collect()} == components
    clean = corpus_pipeline.decontamination_stage(spark, docs, folder)
    assert clean.columns == columns and clean.count() == docs.count() - 2
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    scores = queries.op9_quality(spark, folder).where("predicted = 1")
    assert kept.columns == columns and kept.count() > 0 and scores.count() > 0
    mixed = corpus_pipeline.mixing_stage(spark, docs, folder)
    plan = {r.doc_id: r.copies for r in queries.op1_mixing(spark, folder).collect()}
    assert mixed.columns == columns and mixed.count() == sum(plan.values())
    placed = corpus_pipeline.sharding_stage(spark, docs, folder)
    assert placed.columns == [*columns, "shard"] and placed.count() == docs.count()
    assert corpus_pipeline.run(spark, folder).columns == [*columns, "shard"]
    assert corpus_pipeline.run(spark, empty).count() == 0


OWN = ["target", "copies", "source_size", "score", "predicted", "size", "_size", "_node", "_whole", "_i", "_r", "_row", "_h", "_t", "_d0", "a column"]


def test_pipeline_stages_leave_columns_of_any_name_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("size").withColumns(
        {c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in [*OWN, "shard"]})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns + (["_shard"] if name == "sharding" else []), name
        wrong = " or ".join(f"not `{c}` <=> concat('{c}:', doc_id)" for c in [*OWN, "shard"])
        assert out.count() > 0 and out.where(wrong).count() == 0, name


def test_stages_take_rows_without_ids_and_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.union(docs.where("doc_id <= 40")).union(docs.where("doc_id > 100").withColumn("doc_id", F.lit(None).cast("bigint")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        assert out.columns[:5] == docs.columns and 0 < out.count() <= 3 * odd.count(), name


def test_urls_are_judged_whatever_the_columns_are_called(spark):
    pages = spark.createDataFrame([(1, "http://example.org/es/x", "mine", "mine", "mine"), (2, None, "mine", "mine", "mine")],
                                  "page_id int, url string, _rule string, _verdict string, _url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert (rows[1].rule, rows[1].verdict, rows[2].rule, rows[2].verdict) == ("example.org/es/", "block", None, "allow")
    assert all(r["_rule"] == r["_verdict"] == r["_url"] == "mine" for r in rows.values())


def test_classifier_learns_what_marks_quality(spark):
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice((good if i % 2 else bad) if rng.random() < 0.5 else ["and", "so", "it"]) for _ in range(30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:400]], "doc_id bigint, quality bigint")
    held = quality.score(docs.where("doc_id >= 400"), quality.train(docs, labels)).collect()
    assert sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in held) >= 0.95 * len(held)  # 200 documents it has not seen
