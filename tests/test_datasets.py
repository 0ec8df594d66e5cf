"""Sources, sinks, validation, datasets, drift, evaluation, importance, reports, streaming."""

import csv
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import event, llm, record, sid, tool, turn
from sessionlens.operators import boosting, dataset, drift, evaluation, forest, importance, reports
from sessionlens.schema import FEATURES, FLAT_COLUMNS
from sessionlens.sources import readers, writers
from sessionlens.sources.validation import DatasetValidationError, revalidate, with_issues
from sessionlens.streaming.sessions import start_parquet, stream_diagnoses, stream_sessions


def messages(spark, *records):
    lines = spark.createDataFrame([(i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(records)], "row_id bigint, value string")
    return [r["issues"] for r in readers.parse_sessions(lines).orderBy("row_id").collect()]


def test_jsonl_issues_and_strict(spark, tmp_path):
    path = tmp_path / "data.jsonl"
    path.write_text(json.dumps(record(1)) + "\n\n{not-json}\n   \n" + json.dumps({"session_id": sid(2), "status": "weird"}) + "\n")
    loaded = readers.load_features(spark, str(path))
    assert loaded.rows.count() == 1
    assert [r["row_number"] for r in loaded.issues.orderBy("row_number").collect()] == [3, 5]
    with pytest.raises(DatasetValidationError, match="Row 3"):
        readers.load_features(spark, str(path), strict=True)
    with pytest.raises(ValueError, match="Unsupported dataset format"):
        readers.load_features(spark, str(tmp_path / "x.parquet"))


def test_row_numbers_survive_file_splits(spark, tmp_path):
    lines = [json.dumps(record(i)) if i % 7 else "{broken" for i in range(1, 2001)]
    (tmp_path / "big.ndjson").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        issues = readers.read_sessions(spark, str(tmp_path / "big.ndjson")).issues
        assert sorted(r["row_number"] for r in issues.collect()) == [i for i in range(1, 2001) if i % 7 == 0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_validation_rules(spark):
    got = messages(
        spark, record(1), record(1, transcript=None), record(1, transcript=[turn(1, "robot", "x")]),
        record(1, llm_calls=[{"call_id": "a"}]), record(1, tool_calls=[tool(1, status="anything")]),
        record(1, timeline=[event(1, "NOPE")]), {"status": "passed"}, record(1, ground_truth={"expected_severity": "huge"}),
        record(1, extracted_signals=[{"signal_name": "a", "value": 1, "source": "b", "confidence": 2}]), record(1, transcript=[None]),
        record(1, llm_calls=[llm(1, latency_ms="slow")]), "[1]", record(1, metadata={"transcript": None}))
    assert got[0] == got[4] == got[12] == []
    assert got[1] == ["list fields must not be null"]
    assert got[2] == ["transcript.speaker: unknown value"]
    assert got[3] == ["llm_calls.model_name: field required"]
    assert got[5] == ["timeline.event_type: unknown value"]
    assert got[6] == ["session_id: field required"]
    assert got[7] == ["ground_truth.expected_severity: unknown value"]
    assert got[8] == ["extracted_signals.confidence: must be between 0 and 1"]
    assert "transcript: entry must be an object" in got[9]
    assert got[10] == got[11] == ["Invalid JSON or field type"]


def test_uuid_is_canonical(sessions):
    s = sessions({"session_id": "{C66AB20D309251A48D78DAAC0B025D41}", "status": "passed"})
    assert s.first()["session_id"] == "c66ab20d-3092-51a4-8d78-daac0b025d41"


def test_round_trip_and_flat_file(spark, sessions, tmp_path):
    s = sessions(record(1, metadata={"interview_role": "Dev", "stages": ["a", "b"]}, candidate={"candidate_id": "c", "experience_years": 1.5},
                        timeline=[event(1, "TURN", 1), event(2, "TURN", 31)], llm_calls=[llm(1, latency_ms=5.5)],
                        metrics={"num_turns": 3, "total_tokens": 44}, ground_truth={"scenario_id": "llm_timeout", "expected_failure_type": "timeout"}),
                 record(2))
    writers.write_sessions(s, str(tmp_path / "j"))
    again = readers.read_sessions(spark, str(tmp_path / "j"))
    assert again.issues.count() == 0
    assert [r.asDict() for r in again.rows.drop("row_id", "metadata", "candidate").orderBy("session_id").collect()] == \
           [r.asDict() for r in s.drop("row_id", "metadata", "candidate").orderBy("session_id").collect()]
    flat = {r["session_id"]: r for r in dataset.flat_rows(s).collect()}
    assert tuple(flat[sid(1)].asDict()) == FLAT_COLUMNS
    assert flat[sid(1)]["interview_role"] == "Dev" and flat[sid(1)]["stages"] == "a;b" and flat[sid(1)]["duration_seconds"] == 30
    writers.write_flat_rows(s, str(tmp_path / "flat.csv"))
    loaded = readers.load_features(spark, str(tmp_path / "flat.csv")).rows.orderBy("session_id").collect()
    assert (loaded[0]["total_tokens"], loaded[0]["failure_category"], loaded[0]["root_cause"]) == (44.0, "llm_timeout", "timeout")
    assert loaded[1]["total_tokens"] is None and loaded[0]["retry_count"] is None


def test_writer_refuses_invalid_sessions(spark, sessions, tmp_path):
    bad = sessions(record(1)).withColumn("status", F.lit("weird"))
    assert revalidate(bad.drop("row_id")).count() == 1
    with pytest.raises(DatasetValidationError):
        writers.write_sessions(bad, str(tmp_path / "x"))


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_files_are_read_in_splits(spark, tmp_path, newline):
    """Equal cells and row numbers however a file is cut, also where one cell covers several splits."""
    pick = random.Random(7)
    cells = ["", "plain", 'say "hi"', "a,b", "two\nlines", '"\n"\n', "\n\n\n", "caf\u00e9", "x" * 300]
    expected = {}
    for name in ("one", "two"):
        rows = [[pick.choice(["", "s", f"s{i}"]), pick.choice(cells), pick.choice(cells)] for i in range(400)]
        rows[150][1] = "long\n" * 2000  # over several splits
        rows[399] = ["", "end\n", 'last "'] if name == "one" else rows[399]
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=newline)
            writer.writerow(["session_id", "note", "more"])
            for i, row in enumerate(rows):
                writer.writerow(row)
                if i % 50 == 0:
                    out.write(newline)
        expected[name] = rows
    size = sum((tmp_path / f"{n}.csv").stat().st_size for n in expected)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 24))
    try:
        loaded = readers.read_flat_rows(spark, str(tmp_path))
        assert loaded.rows.rdd.getNumPartitions() >= 24
        found = loaded.rows.orderBy("row_id").collect()
        issues = loaded.issues.collect()
        whole = readers.read_flat_rows(spark, str(tmp_path), split=False) if newline == "\n" else None
        if whole is not None:
            assert sorted(tuple(r)[:3] for r in whole.rows.collect()) == sorted(tuple(r)[:3] for r in found)
            assert sorted(map(tuple, whole.issues.collect())) == sorted(map(tuple, issues))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len({r["row_id"] for r in found}) == len(found)
    assert sorted(tuple(r)[:3] for r in found) == sorted(tuple(r) for rows in expected.values() for r in rows if r[0])
    wanted = sorted((i + 2, name) for name, rows in expected.items() for i, r in enumerate(rows) if not r[0])
    assert sorted((r["row_number"], r["file"].rsplit("/", 1)[1][:-4]) for r in issues) == wanted


def test_csv_errors(spark, tmp_path):
    def lines(name, text):
        (tmp_path / name).write_text(text)
        return readers.read_flat_rows(spark, str(tmp_path / name)).rows.collect()
    with pytest.raises(ValueError, match="ends inside a quoted cell"):
        lines("torn.csv", 'session_id,a\ns,"open\n')
    with pytest.raises(Exception, match="quote inside an unquoted cell"):
        lines("stray.csv", 'session_id,a\ns,5" and 6"\n')
    with pytest.raises(DatasetValidationError, match="twice"):
        lines("twice.csv", "session_id,a,A\ns,1,2\n")
    assert lines("header.csv", "session_id,a\n") == []
    assert [tuple(r)[:3] for r in lines("bom.csv", '\ufeffsession_id,a,b\ns,"x\n"\n')] == [("s", "x\n", "")]
    with pytest.raises(DatasetValidationError, match="header"):
        lines("empty.csv", "")
    (tmp_path / "pair").mkdir()
    (tmp_path / "pair" / "a.csv").write_text("session_id,a\ns,1\n")
    (tmp_path / "pair" / "b.csv").write_text("session_id,b\ns,1\n")
    with pytest.raises(Exception, match="another header"):
        readers.read_flat_rows(spark, str(tmp_path / "pair")).rows.collect()


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('session_id,duration_seconds,total_tokens,ground_truth_failure_type\na,12.5,"x\ny",timeout\n,1,2,\nb,, 7 ,\nc,nan,inf,unknown\n')
    loaded = readers.load_features(spark, str(path))
    rows = loaded.rows.orderBy("session_id").collect()
    assert [(r["interview_duration_seconds"], r["total_tokens"], r["root_cause"]) for r in rows] == [
        (12.5, None, "timeout"), (None, 7.0, None), (None, math.inf, "unknown")]
    assert [(r["row_number"], r["message"]) for r in loaded.issues.collect()] == [(3, "Missing session_id.")]
    (tmp_path / "no.csv").write_text("a,b\n1,2\n")
    with pytest.raises(DatasetValidationError, match="session_id column"):
        readers.read_flat_rows(spark, str(tmp_path / "no.csv"))
    stats = dataset.dataset_statistics(loaded.rows).first()
    assert stats["summary"] == f"CSV dataset with 3 sessions, 31 stable features, and {stats['missing_values']} missing values."
    assert stats["missing_values"] == 29 * 3 + 2 + 1
    assert dataset.most_missing(loaded.rows).count() == 15


def test_single_document_and_reports(spark, tmp_path):
    one, none, odd = (tmp_path / n for n in ("one.json", "none.json", "odd.json"))
    one.write_text(json.dumps(record(1), indent=2))
    none.write_text("  \n")
    odd.write_text("{]")
    assert readers.read_session_document(spark, str(one)).count() == 1
    with pytest.raises(ValueError, match="empty"):
        readers.read_session_document(spark, str(none))
    with pytest.raises(ValueError, match="not a valid session"):
        readers.read_session_document(spark, str(odd))
    (tmp_path / "r1.json").write_text(json.dumps({"model_name": "RF", "ranking": [{"feature_name": "a", "importance_score": 1.0, "normalized_score": 1.0, "rank": 1}]}))
    found = readers.read_reports(spark, [str(tmp_path / n) for n in ("r1.json", "odd.json", "one.json")])
    assert found.count() == 2
    valid = importance.valid_reports(readers.importance_reports(found)).collect()
    assert [(r["model_name"], r["ranking"][0]["rank"]) for r in valid] == [("RF", 1)]


def test_report_documents(spark, tmp_path):
    row = spark.createDataFrame([("m", 0.5)], "model_name string, macro_f1 double")
    writers.save_document(row, str(tmp_path / "a" / "best.json"))
    assert (tmp_path / "a" / "best.json").read_text() == '{\n  "macro_f1": 0.5,\n  "model_name": "m"\n}'
    writers.write_report({"best": row}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "best")).count() == 1
    assert writers.document_text(row.where("false")) is None


def test_labels_come_from_ground_truth_only(sessions):
    s = sessions(record(1, diagnosis={"root_cause": "timeout", "affected_component": "data", "severity": "low", "confidence": 0.5}),
                 record(2, ground_truth={"expected_failure_type": "unknown", "scenario_id": "x"}))
    rows = dataset.features_of_sessions(s).orderBy("session_id").collect()
    assert rows[0]["root_cause"] is None and (rows[1]["root_cause"], rows[1]["failure_category"]) == ("unknown", "x")
    balance = {r["label"]: r["sessions"] for r in dataset.class_balance(dataset.features_of_sessions(s)).collect()}
    assert balance == {"unlabeled": 1, "unknown": 1}


def test_derived_metrics_and_representatives(sessions):
    s = sessions(record(1, status="failed", transcript=[turn(1, "candidate", "a", tokens=3), turn(2, "candidate", "b")]),
                 record(2, llm_calls=[llm(1, status=None), llm(2, status="error")], timeline=[event(1, description="Retry attempt 2"), event(2, description="retry attempt")]))
    rows = {r["session_id"]: r for r in dataset.derived_metrics(s).collect()}
    assert rows[sid(1)]["num_errors"] == 1 and rows[sid(1)]["avg_turn_length"] == 1.5 and rows[sid(2)]["num_errors"] == 2
    assert {r["session_id"]: r["injected_retries"] for r in dataset.injected_retries(s).collect()} == {sid(1): 0, sid(2): 1}
    picked = {r["example"]: r["session_id"] for r in dataset.representatives(s).collect()}
    assert picked == {"healthy_session": sid(2), "mixed_failure": sid(2)}


# --- drift ----------------------------------------------------------------------------------


def pair(spark, rows):
    return spark.createDataFrame([(float(a) if a is not None else None, float(b), c, c, None) for a, b, c in rows],
                                 "latency double, tokens double, root_cause string, failure_category string, affected_component string")


BASE = [(1, 10, "success"), (2, 20, "success"), (3, 30, "timeout"), (4, 40, "timeout")]
NAMES = ("latency", "tokens")


def test_identical_data_does_not_drift(spark):
    rows = drift.feature_drift(pair(spark, BASE), pair(spark, BASE), NAMES).collect()
    assert all(r["jensen_shannon_divergence"] == pytest.approx(0) and not r["shifted"] for r in rows)
    assert all(r["percentage_change"] == 0 for r in drift.label_drift(pair(spark, BASE), pair(spark, BASE)).collect())


def test_shifted_feature_and_label_points(spark):
    import numpy as np
    now = [(100, 10, "timeout"), (110, 20, "timeout"), (120, 30, "timeout"), (130, 40, "timeout")]
    found = drift.feature_drift(pair(spark, BASE), pair(spark, now), NAMES)
    rows = {r["feature_name"]: r for r in found.collect()}
    assert rows["latency"]["shifted"] and not rows["tokens"]["shifted"]
    edges = np.linspace(1, 130, 11)
    p, q = (np.histogram(x, edges)[0] + 1e-12 for x in ([1, 2, 3, 4], [100, 110, 120, 130]))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    assert rows["latency"]["jensen_shannon_divergence"] == pytest.approx(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum())
    assert rows["latency"]["population_stability_index"] == pytest.approx(((q - p) * np.log(q / p)).sum())
    labels = {(r["label_group"], r["label"]): r["percentage_change"] for r in drift.label_drift(pair(spark, BASE), pair(spark, now)).collect()}
    assert labels[("root_cause", "success")] == -50 and labels[("affected_component", "unlabeled")] == 0
    assert drift.largest_shift(found).first()[0].startswith("latency (0.69)")
    assert drift.drift_summary(found).first()["shifted_feature_count"] == 1


def test_histogram_edges_agree_with_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    a, b = np.round(rng.gamma(2, 3, 700), 2), np.round(rng.gamma(3, 3, 500), 2)
    frame = [spark.createDataFrame([(float(x),) for x in v], "v double") for v in (a, b)]
    got = drift.feature_drift(*frame, ("v",)).first()
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 11)
    p, q = (np.histogram(x, edges)[0] + 1e-12 for x in (a, b))
    p, q = p / p.sum(), q / q.sum()
    assert got["population_stability_index"] == pytest.approx(((q - p) * np.log(q / p)).sum(), abs=1e-9)


def test_drift_of_empty_sides_and_mismatch(spark):
    empty = pair(spark, BASE).where("false")
    assert [(r["jensen_shannon_divergence"], r["shifted"], r["comparable"]) for r in drift.feature_drift(pair(spark, BASE), empty, NAMES).collect()] == [(1.0, True, False)] * 2
    assert [(r["jensen_shannon_divergence"], r["shifted"]) for r in drift.feature_drift(empty, empty, NAMES).collect()] == [(0.0, False)] * 2
    assert drift.largest_shift(drift.feature_drift(empty, empty, NAMES)).first()[0] == "None"
    with pytest.raises(drift.DriftError):
        drift.feature_drift(pair(spark, BASE), pair(spark, BASE).select("tokens", "latency"), NAMES)
    with pytest.raises(drift.DriftError):
        drift.feature_drift(pair(spark, BASE).select("latency"), pair(spark, BASE).select("latency"), NAMES)


# --- evaluation, importance, reports --------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(36):
        c = i % 3
        x = [float(c * 10 + (i * (j + 1)) % 4) for j in range(4)]
        rows.append((f"s{i:02d}", None if i == 5 else x[0], *x[1:], "abc"[c], "abc"[c], "abc"[c]))
    return spark.createDataFrame(rows, "session_id string, f0 double, f1 double, f2 double, f3 double, root_cause string, affected_component string, failure_category string")


F4 = ("f0", "f1", "f2", "f3")


def test_evaluation_of_three_models(spark, labelled):
    out = evaluation.evaluate(labelled, names=F4, models=("Logistic Regression", "Random Forest"))
    metrics = out["metrics"].orderBy("rank").collect()
    assert [m["model_name"] for m in metrics] == ["Logistic Regression", "Random Forest"] or metrics[0]["macro_f1"] > metrics[1]["macro_f1"]
    assert all(m["train_size"] + m["test_size"] == 36 and m["test_size"] == 9 for m in metrics)
    assert out["confusion"].count() == 2 * 9 and out["confusion"].agg(F.sum("n")).first()[0] == 18
    assert {r["label"] for r in out["averages"].collect()} == {"accuracy", "macro avg", "weighted avg"}
    assert out["best_model"].first()["label_kind"] == "failure_category"


def test_split_is_stratified_and_stable(labelled):
    def chosen(frame):
        return {r["session_id"] for r in evaluation.stratified_split(frame, "root_cause").where("test").collect()}
    first = chosen(labelled)
    assert len(first) == 9 and first == chosen(labelled.repartition(6))
    assert evaluation.test_quota({"a": 10, "b": 5, "c": 2}, 0.25) == {"a": 3, "b": 1, "c": 1}


def test_evaluation_checks(spark, labelled):
    with pytest.raises(evaluation.EvaluationError, match="label kind"):
        evaluation.class_counts(labelled, "nope")
    with pytest.raises(evaluation.EvaluationError, match="at least one"):
        evaluation.class_counts(labelled.where("false"), "root_cause")
    with pytest.raises(evaluation.EvaluationError, match="every feature row"):
        evaluation.class_counts(labelled.withColumn("root_cause", F.expr("nullif(root_cause, 'a')")), "root_cause")
    with pytest.raises(evaluation.EvaluationError, match="two label classes"):
        evaluation.class_counts(labelled.where("root_cause = 'a'"), "root_cause")
    with pytest.raises(evaluation.EvaluationError, match="two samples"):
        evaluation.class_counts(labelled.where("root_cause <> 'a' or session_id = 's00'"), "root_cause")
    with pytest.raises(evaluation.EvaluationError, match="test_size"):
        evaluation.class_counts(labelled, "root_cause", 1.0)


def test_importance_methods(spark, labelled):
    forest = evaluation.fit_model(labelled, "Random Forest", "root_cause", F4, "mean")
    linear = evaluation.fit_model(labelled, "Logistic Regression", "root_cause", F4, "mean")
    for fitted, method in ((forest, "auto"), (linear, "auto"), (linear, "permutation")):
        ranking = importance.rank_importance(importance.importance_scores(fitted, F4, method, labelled, "root_cause", repeats=3, spark=spark)).orderBy("rank").collect()
        assert sum(r["normalized_score"] for r in ranking) == pytest.approx(1) or all(r["importance_score"] == 0 for r in ranking)
        assert [r["rank"] for r in ranking] == [1, 2, 3, 4]
        assert [r["importance_score"] for r in ranking] == sorted((r["importance_score"] for r in ranking), reverse=True)
    with pytest.raises(importance.ImportanceError, match="does not support coefficient"):
        importance.importance_scores(forest, F4, "coefficient")
    with pytest.raises(importance.ImportanceError, match="does not match"):
        importance.importance_scores(forest, F4[:2])
    with pytest.raises(importance.ImportanceError, match="requires features"):
        importance.importance_scores(linear, F4, "permutation")
    with pytest.raises(importance.ImportanceError, match="no native"):
        importance.choose_method(object())


def test_permutation_against_plain_loop(spark, labelled):
    """Scores by hand from the stated orders; no window over rows, no second scoring, same for any partitioning."""
    linear = evaluation.fit_model(labelled, "Logistic Regression", "root_cause", F4, "mean")
    scores = importance.permutation_scores(linear, labelled, "root_cause", repeats=3, seed=5)
    found = {r["feature_name"]: r["importance_score"] for r in scores.collect()}
    again = importance.permutation_scores(linear, labelled.repartition(7), "root_cause", repeats=3, seed=5)
    assert {r["feature_name"]: r["importance_score"] for r in again.collect()} == pytest.approx(found)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan and plan.count("collect_list(struct(_k") == 1

    hashed = labelled.selectExpr("*", "xxhash64(5, session_id) k").selectExpr("*", "array(xxhash64(0, k), xxhash64(1, k), xxhash64(2, k)) h").toPandas()
    versions = [hashed.assign(version="base")]
    for r in range(3):
        order = sorted(range(len(hashed)), key=lambda i: hashed["h"][i][r])
        nearest = {order[i]: order[(i + 1) % len(order)] for i in range(len(order))}
        for f in F4:
            moved = [hashed[f][nearest[i]] for i in range(len(hashed))]
            versions.append(hashed.assign(version=f"{f}:{r}", **{f: moved}))
    rows = spark.createDataFrame(pd.concat(versions)[["version", "root_cause", *F4]])
    f1 = {}
    predicted = linear.predict(rows, "version", "root_cause").toPandas()
    for version, part in predicted.groupby("version"):
        total = 0.0
        for c in set(part.root_cause):
            hit = ((part.root_cause == c) & (part.predicted == c)).sum()
            support, given = (part.root_cause == c).sum(), (part.predicted == c).sum()
            total += 2 * hit / (support + given) * support / len(part)
        f1[version] = total
    for f in F4:
        assert found[f] == pytest.approx(abs(sum(f1["base"] - f1[f"{f}:{r}"] for r in range(3)) / 3), abs=1e-12)


def test_boosting_handles_three_classes(spark, labelled):
    small = boosting.SoftmaxBoosting(stages=3, depth=2)
    fitted = evaluation.fit_model(labelled, "Gradient Boosting", "root_cause", F4, estimator=small)
    assert importance.choose_method(fitted.model) == "native"
    scores = importance.importance_scores(fitted, F4, "native", spark=spark).collect()
    assert sum(r["importance_score"] for r in scores) == pytest.approx(1)
    assert fitted.predict(labelled, "session_id").where("predicted in ('a', 'b', 'c')").count() == 36


def grown_by_hand(x, label, k, stages, rate, depth, cuts):
    """The same model by recursion over row subsets, one tree after another."""
    bins = boosting.binned(x, cuts)
    scores = np.tile(np.log(np.bincount(label, minlength=k) / len(label)), (len(x), 1))

    def leaf(rows, r):
        weight = (np.abs(r[rows]) * (1 - np.abs(r[rows]))).sum()
        return rate * (k - 1) / k * r[rows].sum() / weight if weight else 0.0

    def grow(rows, level, r, out):
        best = (1e-10 * max(1, len(rows)), None)
        for f in range(x.shape[1]):
            for cut in range(len(cuts[f])):
                left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if level < depth and len(left) and len(right):
                    gain = len(left) * len(right) / len(rows) * (r[left].mean() - r[right].mean()) ** 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None:
            out[rows] = leaf(rows, r)
        else:
            grow(best[1][0], level + 1, r, out)
            grow(best[1][1], level + 1, r, out)

    for _ in range(stages):
        r = boosting.residuals(scores, label)
        steps = np.zeros_like(scores)
        for c in range(k):
            grow(np.arange(len(x)), 0, r[:, c], steps[:, c])
        scores = scores + steps
    return scores


@pytest.mark.parametrize("k", [2, 4])
def test_boosting_equals_a_plain_loop(spark, k):
    random = np.random.default_rng(7)
    x = random.normal(size=(240, 3)).round(2)
    x[:, 2] = 1.0  # a feature without a cut
    label = (np.digitize(x[:, 0] + 0.3 * x[:, 1] ** 2, [-0.4, 0.3, 0.9]) if k == 4 else (x[:, 0] * x[:, 1] > 0)).astype(int)
    frame = spark.createDataFrame([(Vectors.dense(row), float(c)) for row, c in zip(x, label)], ["features", "label"])
    model = boosting.SoftmaxBoosting(stages=12, depth=3).fit(frame.repartition(5))
    assert model.scores(x) == pytest.approx(grown_by_hand(x, label, k, 12, 0.1, 3, model.cuts), abs=1e-9)
    predicted = {tuple(r["features"]): r["prediction"] for r in model.transform(frame).collect()}
    right = np.mean([predicted[tuple(row)] == c for row, c in zip(x, label)])
    assert right > 0.9 and model.featureImportances.toArray()[2] == 0


def learnable(spark, n=1500, seed=5):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 4)).astype(np.float32).astype(float)
    label = ((x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)) % 3
    rows = [(Vectors.dense(row), float(c), i) for i, (row, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, ["features", "label", "id"]).selectExpr("features", "label", "xxhash64(id) row"), x, label


def test_forest_grows_deeper_than_any_cap(spark):
    # alternating classes along one feature need a comb: cut by cut, far beyond 30 levels where cuts are uneven
    n = 400
    x = np.array([1.5 ** -i for i in range(n)])
    frame = spark.createDataFrame([(Vectors.dense([v]), float(i % 2)) for i, v in enumerate(x)], ["features", "label"])
    nodes, _ = forest.grow(x[:100, None], np.arange(100) % 2, np.ones(100, int), 2, np.random.default_rng(1))
    end = forest.descend(tuple(nodes[c] for c in ("feature", "cut", "left", "right")), x[:100, None])
    assert (np.array(nodes["share"])[end].argmax(1) == np.arange(100) % 2).all() and len(nodes["feature"]) == 199
    model = forest.RandomForest(trees=5, seed=1).fit(frame)
    assert model.depth() > 30
    assert set(r["prediction"] for r in model.transform(frame).collect()) == {0.0, 1.0}


def test_forest_does_not_depend_on_partitions_and_learns(spark):
    frame, x, label = learnable(spark)
    first, again = (forest.RandomForest(trees=15, seed=3).fit(f) for f in (frame.repartition(1), frame.repartition(6)))
    def trees(m):
        return {(r["tree"], r["node"]): (r["feature"], r["cut"]) for r in m.subtrees.collect()}
    assert trees(first) == trees(again) and len(trees(first)) == 15
    rows = first.transform(frame).collect()
    assert np.mean([r["prediction"] == r["label"] for r in rows]) > 0.97
    shuffled = {r["row"]: r["prediction"] for r in first.transform(frame, broadcast_bytes=0).collect()}
    assert shuffled == {r["row"]: r["prediction"] for r in rows}
    weights = np.stack([forest.weights(np.arange(20_000) * 7919, t, 3) for t in range(5)])
    assert weights.mean() == pytest.approx(1, abs=0.02) and weights.var() == pytest.approx(1, abs=0.05)
    gains = first.featureImportances.toArray()
    assert gains.sum() == pytest.approx(1) and gains[:2].sum() > 0.8


def plain_tree(x, label, weight, classes, random):
    """Node by node, from the left: (feature, cut) and the shares of leaves."""
    d = x.shape[1]
    few = max(1, int(d ** 0.5))
    found, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        total = np.bincount(label[rows], weight[rows], classes)
        best = None
        if (total > 0).sum() > 1:
            order = random.permutation(d)
            for first in range(0, d, few):
                for place, f in enumerate(order[first:first + few]):
                    values = np.unique(x[rows, f][~np.isnan(x[rows, f])])
                    for low, high in zip(values, values[1:]):
                        side = x[rows, f] <= low
                        left = np.bincount(label[rows[side]], weight[rows[side]], classes)
                        right = total - left
                        gain = (left ** 2).sum() / left.sum() + (right ** 2).sum() / right.sum() - (total ** 2).sum() / total.sum()
                        key = (-gain, side.sum(), place)
                        if best is None or key < best[0]:
                            best = (key, int(f), low + (high - low) / 2)
                if best:
                    break
        if best is None:
            found.append(tuple(total / total.sum()))
        else:
            found.append(best[1:])
            below = x[rows, best[1]] <= best[2]
            todo += [rows[~below], rows[below]]
    return found


def test_trees_side_by_side_are_the_trees_grown_alone():
    random = np.random.default_rng(5)
    groups = []
    for g in range(24):
        n = int(random.integers(1, 60))
        x = np.round(random.normal(size=(n, 11)) * 2)
        x[:, 1:8] = np.minimum(np.abs(x[:, 1:8]), g % 2)  # features that often cannot part a node
        if g % 5 == 4:
            x[random.random(x.shape) < 0.1] = np.nan
        x = x[random.integers(0, n, n)]  # rows that are equal, with unequal labels
        groups.append((x, random.integers(0, 30 if g == 7 else 3, n), random.integers(1, 4, n)))
    grower = forest.Grower([(x.astype(np.float32), l, w) for x, l, w in groups], 30, [np.random.default_rng([1, g]) for g in range(24)])
    steps, best = [], grower._best
    grower._best = lambda who, *a: steps.append(len(who)) or best(who, *a)
    grower.run()
    splits = []
    for g, group in enumerate(groups):
        nodes, _ = grower.tree(g)
        found, todo = [], [0]
        while todo:
            i = todo.pop()
            leaf = nodes["feature"][i] < 0
            found.append(tuple(nodes["share"][i]) if leaf else (int(nodes["feature"][i]), float(nodes["cut"][i])))
            todo += [] if leaf else [nodes["right"][i], nodes["left"][i]]
        assert found == plain_tree(*group, 30, np.random.default_rng([1, g]))
        splits.append(len(found) // 2)
    assert len(steps) <= 3 * max(splits) < sum(splits)  # not a step for every node of every tree


def test_forest_splits_large_nodes_before_it_ships_them(spark):
    frame, x, label = learnable(spark)
    model = forest.RandomForest(trees=6, seed=3, task_rows=200).fit(frame.repartition(4))
    assert all(len(t.shipped) + len(t.share) >= 5 for t in model.tops)  # 1 500 rows in parts of 200
    rows = model.transform(frame).collect()
    assert np.mean([r["prediction"] == r["label"] for r in rows]) > 0.95
    shuffled = {r["row"]: r["prediction"] for r in model.transform(frame, broadcast_bytes=0).collect()}
    assert shuffled == {r["row"]: r["prediction"] for r in rows}


def test_a_stage_of_boosting_is_one_job_per_level(spark):
    frame = spark.createDataFrame([(Vectors.dense([float(i % 7), float(i % 3)]), float(i % 5)) for i in range(100)], ["features", "label"])
    tracker, group = spark.sparkContext.statusTracker(), "boosting-jobs"

    def jobs(stages):
        spark.sparkContext.setJobGroup(f"{group}-{stages}", "")
        boosting.SoftmaxBoosting(stages=stages, depth=2).fit(frame)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"{group}-{stages}"))

    few, more = jobs(2), jobs(4)
    assert more - few <= 2 * 2 * 2  # two stages of two levels; adaptive execution may run the shuffle as a job of its own


def test_confusion_observations_and_reports(spark):
    rows = [("m", "a", "a")] * 4 + [("m", "a", "b")] * 2 + [("m", "b", "a")] * 2 + [("m", "b", "b")] + [("m", "c", "c")] * 3
    matrix = evaluation.confusion(spark.createDataFrame(rows, "model_name string, actual string, predicted string"))
    seen = reports.confusion_observations(matrix).first()
    assert seen["most_confused"] == "Most confused classes: a predicted as b (2 sessions)."
    assert seen["best_class"] == "Best classified class: c (100% recall)." and seen["worst_class"] == "Lowest recall class: b (33% recall)."
    metrics = evaluation.rank_models(evaluation.model_metrics(evaluation.class_report(matrix))).withColumn("train_size", F.lit(36))
    assert reports.matrix_of(matrix, "m").count() == 9 and reports.model_options(metrics).first()[0] == "m"
    assert reports.comparison_table(metrics).first()["accuracy"] == pytest.approx(8 / 12)
    stats = spark.createDataFrame([(12, 31, 3, 0, "s")], "row_count long, feature_count long, failure_categories long, missing_values long, summary string")
    assert reports.dataset_card(stats, metrics).first()["split"] == "36/12 (75% / 25%)"
    shifts = spark.createDataFrame([(2,)], "shifted_feature_count long")
    counts = spark.createDataFrame([(5,)], "anomaly_count long")
    summary = reports.analytics_summary(stats, metrics, shifts, counts).first()
    assert (summary["best_model"], summary["accuracy"], summary["drift_status"], summary["anomalies"]) == ("m", "66.7%", "2 shifted features", "5")


def test_importance_tables(spark):
    scores = spark.createDataFrame([("b_latency", 3.0), ("a", 3.0), ("c", 4.0), ("d_Latency", 0.0)], "feature_name string, importance_score double")
    ranking = importance.rank_importance(scores)
    assert [r["feature_name"] for r in ranking.orderBy("rank").collect()] == ["c", "a", "b_latency", "d_Latency"]
    assert {r["feature_name"] for r in importance.importance_table(ranking, search="latency").collect()} == {"b_latency", "d_Latency"}
    s = importance.importance_summary(ranking, 2).first()
    assert (s["mean_importance"], s["median_importance"], s["top_features"], s["bottom_features"]) == (2.5, 3.0, ["c", "a"], ["d_Latency", "a"])
    lead = importance.leading_drivers(ranking).first()
    assert lead["drivers"] == ["c", "a", "b_latency"] and lead["share"] == 1.0


# --- streaming --------------------------------------------------------------------------------


def test_stream_gives_the_batch_diagnoses(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.jsonl").write_text("\n".join([json.dumps(record(i, llm_calls=[llm(1, status="error")])), "", "{bad"]))
    done = stream_diagnoses(stream_sessions(spark, str(folder), 1)).select("session_id", "diagnosis.root_cause", "confidence")
    start_parquet(done, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["session_id"] for r in rows) == [sid(i) for i in range(3)] and {r["root_cause"] for r in rows} == {"timeout"}


def test_with_issues_needs_no_action_on_valid_rows(sessions):
    assert with_issues(sessions(record(1))).first()["issues"] == []
    assert len(FEATURES) == 31


def test_bad_rows_are_never_broadcast(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text("".join('{"session_id": "%d"}\n' % i for i in range(50)) + "\n{}\n")
    issues = readers.read_sessions(spark, str(path)).issues
    assert [r["row_number"] for r in issues.orderBy("row_number").collect()] == [*range(1, 51), 52]
    plan = issues._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_a_subtree_is_copied_only_as_often_as_its_rows_need(spark):
    frame, x, label = learnable(spark)
    model = forest.RandomForest(trees=4, seed=3, task_rows=400).fit(frame.repartition(4))
    tops = [((t.feature, t.value, t.left, t.right), t.share) for t in model.tops]
    spread, copies = model._spread, []
    model._spread = lambda load: copies.append(spread(load).count()) or spread(load)
    rows = {r["row"]: r["prediction"] for r in model.transform(frame).collect()}
    for walk_rows in (1 << 15, 100):
        assert rows == {r["row"]: r["prediction"] for r in model._shuffled(frame, tops, walk_rows).collect()}
    shipped = sum(len(t.shipped) for t in model.tops)
    assert copies[0] == shipped and shipped < copies[1] <= len(x) * 4 / 100 + shipped  # not 64 of each
