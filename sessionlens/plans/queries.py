"""Registered queries: (spark, folder) -> DataFrame over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens.functions.stats import fit_preparation
from sessionlens.functions.text import token_estimate
from sessionlens.operators import (
    anomaly, clusters, dataset, diagnosis, drift, evaluation, importance, reports, rules, signals, similarity,
)
from sessionlens.operators.confidence import score_confidence
from sessionlens.plans import analytics, document_log, event_log
from sessionlens.plans.diagnose import diagnose, diagnose_signals
from sessionlens.schema import FEATURES
from sessionlens.session import cut_lineage, shared_path
from sessionlens.sources import readers, writers
from sessionlens.sources.readers import parse_sessions

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    return event_log.event_signals(event_log.read_events(spark, folder))


def _table(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once: queries of several jobs must not read the event log again for each."""
    return cut_lineage(_signals(spark, folder))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return document_log.document_sessions(document_log.read_documents(spark, folder))


def _six(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# --- signals ---------------------------------------------------------------------


def signals_long(spark, folder):
    return _signals(spark, folder).select("session_id", *FEATURES)


def signals_from_tables(spark, folder):
    log = event_log.telemetry(event_log.read_events(spark, folder))
    return signals.signals_long(signals.measures_of_tables(**event_log.tables_of(log), sessions=log))


def signals_nested(spark, folder):
    return signals.signals_nested(_documents(spark, folder)).select("session_id", *FEATURES)


def signals_stored(spark, folder):
    return dataset.features_of_sessions(_documents(spark, folder)).drop("row_id")


def signals_conversations(spark, folder):
    """Transcript signals of real dialogues; roles become speakers."""
    turns = table(spark, folder, "conversations").selectExpr(
        "concat('conv-', conv_id) session_id",
        "case role when 'user' then 'candidate' when 'assistant' then 'interviewer' else role end speaker",
        "cast(null as string) stage", "text", "cast(null as bigint) tokens")
    wide = signals.signals_long(signals.measures(turns, signals.turn_measures()))
    return wide.select("session_id", *FEATURES[1:4], *FEATURES[22:26], "empty_transcript")


def signal_rows(spark, folder):
    return signals.signal_rows(_signals(spark, folder))


def signals_pivoted(spark, folder):
    rows = signals.signal_rows(_signals(spark, folder)).where("value <> 0")
    return signals.signals_wide(rows)


# --- rules, evidence, similarity, confidence, diagnosis ------------------------------


def rule_results(spark, folder):
    return rules.rule_rows(rules.evaluate_rules(_signals(spark, folder)))


def evidence_records(spark, folder):
    return rules.evidence_rows(rules.build_evidence(rules.evaluate_rules(_signals(spark, folder))))


def _history(wide: DataFrame) -> DataFrame:
    return similarity.history_table(wide.where("baseline"), "nullif(root_cause, 'unknown')", rule_count="user_id % 4",
                                    dataset_version="'events'")


def similar_sessions(spark, folder):
    wide = _table(spark, folder)
    found = similarity.find_similar(wide.where("not baseline"), _history(wide), 5)
    return _six(similarity.matches(found), "similarity_score")


def similar_sessions_tiled(spark, folder):
    wide = _table(spark, folder)
    found = similarity.find_similar(wide.where("not baseline"), _history(wide), 5, plan="tiles")
    return _six(similarity.matches(found), "similarity_score")


def similar_embeddings(spark, folder):
    items = table(spark, folder, "embeddings").selectExpr(
        "vec_id", "cast(vec_id as string) session_id", "vec_id row_id", "cast(label as string) failure_type",
        "cast(null as string) summary", "transform(embedding, x -> cast(x as double)) raw")
    items = similarity.with_unit_vector(items, "raw").drop("raw")
    found = similarity.top_matches(items.select("vec_id", "vec"), items.drop("vec_id"), 4)
    return _six(similarity.matches(found, "vec_id").drop("summary"), "similarity_score")


def index_statistics(spark, folder):
    wide = _signals(spark, folder).where("baseline")
    stats = similarity.index_statistics(wide)
    rows = [(n, m, s) for n, (m, s) in zip(similarity.SIMILARITY_FEATURES, stats)]
    return _six(spark.createDataFrame(rows, "feature string, mean double, scale double"), "mean", "scale")


def confidence_scores(spark, folder):
    wide = _table(spark, folder)
    frame = rules.build_evidence(rules.evaluate_rules(wide.where("not baseline")))
    scored = score_confidence(similarity.find_similar(frame, _history(wide), 5))
    return _six(scored.select("session_id", "contributors.*", "confidence"), "rule_score", "evidence_completeness",
                "evidence_severity", "historical_similarity", "historical_failure_agreement", "confidence")


def _diagnosed(spark, folder) -> DataFrame:
    return diagnose_signals(_signals(spark, folder))


def diagnosed_sessions(spark, folder):
    d = _diagnosed(spark, folder)
    return _six(d.select("session_id", "diagnosis.root_cause", "diagnosis.affected_component", "diagnosis.severity",
                         "diagnosis.confidence", F.array_join("diagnosis.rules_triggered", ",").alias("rules_triggered"),
                         F.array_join("diagnosis.evidence", "|").alias("evidence"),
                         F.size("diagnosis.evidence").cast("bigint").alias("evidence_items"),
                         F.col("diagnosis.similar_sessions").isNull().alias("no_matches")), "confidence")


def reasoning_prompts(spark, folder):
    return _diagnosed(spark, folder).select("session_id", "reasoning_prompt", "confidence_text")


def cause_counts(spark, folder):
    return _six(diagnosis.cause_counts(_diagnosed(spark, folder)), "mean_confidence")


def diagnosed_documents(spark, folder):
    """The whole flow on nested sessions: every fourth document against the history of every second one."""
    docs = _documents(spark, folder)
    done = diagnose(docs.where("row_id % 4 = 1"), docs.where("row_id % 2 = 0"), 3)
    return done.selectExpr(
        "session_id", "diagnosis.root_cause root_cause", "diagnosis.affected_component affected_component", "diagnosis.severity severity",
        "round(diagnosis.confidence, 6) confidence", "array_join(diagnosis.similar_sessions, ',') similar_sessions",
        "array_join(transform(similar, m -> coalesce(m.failure_type, '-')), ',') failure_types",
        "round(similar[0].similarity_score, 6) best_score", "cast(size(signals) as bigint) signals")


def session_overview(spark, folder):
    return diagnosis.overview(_diagnosed(spark, folder))


def stage_counts(spark, folder):
    d = _diagnosed(spark, folder)
    return diagnosis.stage_counts(d.selectExpr("*", f"{signals.signal_list()} signals"))


def triggered_rules(spark, folder):
    return diagnosis.triggered_rules(_diagnosed(spark, folder))


def match_listing(spark, folder):
    wide = _table(spark, folder)
    return diagnosis.match_rows(similarity.find_similar(wide.where("not baseline"), _history(wide), 2))


def timeline_listing(spark, folder):
    return diagnosis.timeline_rows(_documents(spark, folder)).withColumn("time", F.unix_micros("time"))


# --- datasets and projections -----------------------------------------------------


def _flat_orders(spark, folder) -> DataFrame:
    """Orders as flat text rows, with cells that are blank or no number."""
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) session_id",
        "case when o_orderkey % 7 = 0 then ' ' when o_orderkey % 11 = 0 then 'nan'"
        " else cast(cast(o_totalprice as decimal(18, 2)) as string) end duration_seconds",
        "o_orderpriority num_turns", "cast(o_custkey as string) num_llm_calls",
        "case when o_custkey % 3 = 0 then '' else concat(' ', o_custkey % 100, ' ') end num_tool_calls",
        "case when o_orderkey % 5 = 0 then 'n/a' else '12.5' end avg_llm_latency_ms",
        "o_orderstatus total_tokens",
        "case o_orderstatus when 'F' then 'timeout' when 'O' then '' else 'unknown' end ground_truth_failure_type",
        "o_orderstatus ground_truth_component", "o_orderpriority ground_truth_scenario")


def flat_features(spark, folder):
    wide = dataset.features_of_flat_rows(_flat_orders(spark, folder))
    return wide.select("session_id", "interview_duration_seconds", "transcript_turn_count", "total_llm_calls",
                       "total_tool_calls", "average_llm_latency_ms", "total_tokens", "failed_llm_calls",
                       "root_cause", "affected_component", "failure_category", "source_format")


def dataset_statistics(spark, folder):
    return dataset.dataset_statistics(dataset.features_of_flat_rows(_flat_orders(spark, folder)))


def class_balance(spark, folder):
    return dataset.class_balance(dataset.features_of_flat_rows(_flat_orders(spark, folder)))


def missing_by_feature(spark, folder):
    return dataset.missing_by_feature(dataset.features_of_flat_rows(_flat_orders(spark, folder)))


def most_missing(spark, folder):
    return dataset.most_missing(dataset.features_of_flat_rows(_flat_orders(spark, folder)))


def dataset_card(spark, folder):
    wide = _signals(spark, folder).withColumn("source_format", F.lit("jsonl"))
    return reports.dataset_card(dataset.dataset_statistics(wide))


def flat_rows(spark, folder):
    return dataset.flat_rows(_documents(spark, folder))


def derived_metrics(spark, folder):
    return dataset.derived_metrics(_documents(spark, folder))


def injected_retries(spark, folder):
    return dataset.injected_retries(_documents(spark, folder))


def collection_totals(spark, folder):
    return dataset.collection_statistics(_documents(spark, folder))[0]


def collection_failures(spark, folder):
    return dataset.collection_statistics(_documents(spark, folder))[1]


def representatives(spark, folder):
    return dataset.representatives(_documents(spark, folder))


def token_estimates(spark, folder):
    return table(spark, folder, "documents").selectExpr("doc_id", f"{token_estimate('text')} tokens")


# --- validation ----------------------------------------------------------------------


def _whole_sessions(spark, folder) -> DataFrame:
    """Document sessions with all that the record contract asks for."""
    call = ("c.call_id call_id", "c.duration_ms duration_ms", "c.status status", "c.error_type error_type", "c.error_message error_message")
    pairs = lambda *names: ", ".join(f"'{n.split()[1]}', {n.split()[0]}" for n in names)
    return _documents(spark, folder).drop("diagnosis").selectExpr(
        "* except (session_id, llm_calls, tool_calls, extracted_signals)",
        "concat('00000000-0000-4000-8000-', lpad(cast(row_id as string), 12, '0')) session_id",
        f"transform(llm_calls, c -> named_struct('model_name', 'm', 'latency_ms', c.latency_ms, 'tokens_input', c.tokens_input,"
        f" 'tokens_output', c.tokens_output, {pairs(*call)})) llm_calls",
        f"transform(tool_calls, c -> named_struct('tool_name', 't', {pairs(*call)})) tool_calls",
        "transform(extracted_signals, x -> named_struct('signal_name', x.signal_name, 'value', x.value, 'source', 'table')) extracted_signals")


_OWN_NAME = "concat('doc-', cast(substr(session_id, 25) as bigint)) session_id"


def sessions_round_trip(spark, folder):
    """Sessions written as checked JSON lines and loaded again by suffix, strictly."""
    path = f"{shared_path(spark, 'sessions')}.jsonl"
    writers.write_sessions(_whole_sessions(spark, folder), path)
    return readers.load_features(spark, path, strict=True).rows.drop("row_id").selectExpr("* except (session_id)", _OWN_NAME)


def flat_round_trip(spark, folder):
    """Sessions written as flat CSV and loaded again by suffix, strictly."""
    path = f"{shared_path(spark, 'flat')}.csv"
    writers.write_flat_rows(_whole_sessions(spark, folder), path)
    return readers.load_features(spark, path, strict=True).rows.drop("row_id").selectExpr("* except (session_id)", _OWN_NAME)


def rejected_lines(spark, folder):
    """The same records written as lines and loaded: how often each row's message was met, and how many rows were kept."""
    path = f"{shared_path(spark, 'lines')}.jsonl"
    _session_lines(spark, folder).select("value").write.text(path)
    loaded = readers.read_sessions(spark, path)
    kept = loaded.rows.agg(F.count("*").alias("rows")).selectExpr("'valid' message", "rows")
    return loaded.issues.selectExpr("explode(split(message, '; ')) message").groupBy("message").agg(F.count("*").alias("rows")).unionByName(kept)


def _session_lines(spark, folder) -> DataFrame:
    """One JSON record per event, some of them breaking the contract."""
    k = "cast(regexp_extract(props, r'(\\d+)', 1) as bigint)"
    return table(spark, folder, "events").selectExpr("event_id", "event_type", "value", f"{k} k").selectExpr(
        "event_id",
        "concat('{\"session_id\":\"', case when k % 9 = 0 then concat('bad-', event_id)"
        " else concat(lpad(cast(event_id as string), 8, '0'), '-1111-4222-8333-444444444444') end,"
        " '\",', case when k % 7 = 0 then '' else concat('\"status\":\"', case when k % 5 = 0 then event_type else 'failed' end, '\",') end,"
        " '\"transcript\":', case when k % 13 = 0 then 'null' else concat('[{\"turn_id\":', event_id, ',\"speaker\":\"',"
        " case when k % 11 = 0 then 'robot' else 'candidate' end, '\"', case when k % 17 = 0 then '' else ',\"text\":\"hi\"' end, '}]') end,"
        " ',\"extracted_signals\":[{\"signal_name\":\"total_tokens\",\"source\":\"x\",\"value\":', cast(value as decimal(18, 2)),"
        " ',\"confidence\":', case when k % 19 = 0 then '1.5' else '0.5' end, '}]', case when k % 23 = 0 then '' else '}' end) value")


def validation_issues(spark, folder):
    checked = parse_sessions(_session_lines(spark, folder))
    return checked.selectExpr("event_id", "case when size(issues) = 0 then 'valid' else array_join(array_sort(issues), '; ') end issues")


def validation_counts(spark, folder):
    checked = parse_sessions(_session_lines(spark, folder))
    return checked.selectExpr("explode(issues) message").groupBy("message").agg(F.count("*").alias("rows"))


# --- drift ------------------------------------------------------------------------


def _drift(spark, folder) -> DataFrame:
    wide = _table(spark, folder)
    return drift.feature_drift(wide.where("baseline"), wide.where("not baseline"))


def feature_drift(spark, folder):
    return _six(drift.feature_bands(_drift(spark, folder)), "jensen_shannon_divergence", "population_stability_index")


def embedding_drift(spark, folder):
    """Drift of raw embedding coordinates between two label halves."""
    items = table(spark, folder, "embeddings")
    names = tuple(f"d{i:02d}" for i in range(64))
    wide = items.selectExpr("label", *(f"cast(embedding[{i}] as double) {n}" for i, n in enumerate(names)))
    result = drift.feature_drift(wide.where("label < 3"), wide.where("label >= 3"), names)
    return _six(result, "jensen_shannon_divergence", "population_stability_index")


def label_drift(spark, folder):
    wide = _signals(spark, folder)
    labels = drift.label_bands(drift.label_drift(wide.where("baseline"), wide.where("not baseline")))
    return _six(labels, "baseline_percentage", "current_percentage", "percentage_change")


def drift_summary(spark, folder):
    return _six(drift.drift_summary(_drift(spark, folder)), "largest_drift", "average_drift", "overall_drift_score")


def largest_shift(spark, folder):
    return drift.largest_shift(_drift(spark, folder))


# --- evaluation -------------------------------------------------------------------


def _predictions(spark, folder) -> DataFrame:
    """Three given predictors of the root cause of event-log sessions."""
    d = _diagnosed(spark, folder)
    return d.selectExpr("session_id", "root_cause actual", "diagnosis.root_cause cause", "failed_tool_calls f", "user_id u").selectExpr(
        "session_id", "actual", "inline(array(named_struct('model_name', 'rules', 'predicted', cause),"
        " named_struct('model_name', 'constant', 'predicted', 'timeout'),"
        " named_struct('model_name', 'mixed', 'predicted', case when f > 0 then actual when u % 7 = 0 then 'hallucination' else cause end)))")


def confusion_matrix(spark, folder):
    return evaluation.confusion(_predictions(spark, folder))


def class_report(spark, folder):
    report = evaluation.class_report(evaluation.confusion(_predictions(spark, folder)))
    return _six(report, "precision", "recall", "f1_score")


def report_averages(spark, folder):
    report = evaluation.class_report(evaluation.confusion(_predictions(spark, folder)))
    return _six(evaluation.report_averages(report), "precision", "recall", "f1_score")


def model_metrics(spark, folder):
    report = evaluation.class_report(evaluation.confusion(_predictions(spark, folder)))
    return _six(evaluation.rank_models(evaluation.model_metrics(report)), *evaluation.METRICS)


def _ranked_metrics(spark, folder) -> DataFrame:
    report = evaluation.class_report(evaluation.confusion(_predictions(spark, folder)))
    return evaluation.rank_models(evaluation.model_metrics(report))


def model_comparison(spark, folder):
    return _six(reports.comparison_table(_ranked_metrics(spark, folder)), *(m for m in evaluation.METRICS if m != "f1_score"))


def model_names(spark, folder):
    return reports.model_options(_ranked_metrics(spark, folder))


def best_model(spark, folder):
    best = evaluation.best_model(_ranked_metrics(spark, folder).drop("rank"), FEATURES, "root_cause")
    return _six(best.withColumn("feature_names", F.array_join("feature_names", ",")), "macro_f1")


def model_matrix(spark, folder):
    return reports.matrix_of(evaluation.confusion(_predictions(spark, folder)), "mixed")


def confusion_observations(spark, folder):
    return reports.confusion_observations(evaluation.confusion(_predictions(spark, folder)))


def document_quality_metrics(spark, folder):
    """Binary evaluation: labelled quality against a length rule, per language."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").selectExpr(
        "lang model_name", "cast(quality as string) actual", "cast(cast(n_chars > 800 as int) as string) predicted")
    report = evaluation.class_report(evaluation.confusion(docs))
    return _six(evaluation.model_metrics(report), *evaluation.METRICS)


def holdout_sizes(spark, folder):
    split = evaluation.stratified_split(_table(spark, folder), "failure_category")
    return split.groupBy("failure_category").agg(F.count_if("test").alias("test_rows"), F.count("*").alias("n_rows"))


def feature_preparation(spark, folder):
    wide = dataset.features_of_flat_rows(_flat_orders(spark, folder))
    p = fit_preparation(wide, FEATURES)
    rows = [(c, p.fill[c], p.mean[c], p.scale[c]) for c in p.columns]
    return _six(spark.createDataFrame(rows, "feature string, fill double, mean double, scale double"), "fill", "mean", "scale")


def scaled_features(spark, folder):
    wide = _table(spark, folder)
    return _six(fit_preparation(wide, FEATURES).scaled(wide, "session_id"), *FEATURES)


def evaluate_models(spark, folder):
    return evaluation.evaluate(_table(spark, folder))["metrics"]


def _importance_model(spark, folder, name):
    wide = _table(spark, folder)
    return evaluation.fit_model(wide, name, "root_cause", impute="mean"), wide


def importance_native(spark, folder):
    fitted, _ = _importance_model(spark, folder, "Random Forest")
    return importance.rank_importance(importance.importance_scores(fitted, FEATURES, "native", spark=spark))


def importance_coefficient(spark, folder):
    fitted, _ = _importance_model(spark, folder, "Logistic Regression")
    return importance.rank_importance(importance.importance_scores(fitted, FEATURES, "coefficient", spark=spark))


def importance_permutation(spark, folder):
    fitted, wide = _importance_model(spark, folder, "Logistic Regression")
    return importance.rank_importance(importance.importance_scores(fitted, FEATURES, "permutation", wide, "root_cause"))


def _given_scores(spark, folder) -> DataFrame:
    """A score per feature that SQL can state too: its mean, cut to hundredths."""
    return signals.signal_rows(_signals(spark, folder)).groupBy(F.col("signal_name").alias("feature_name")).agg(
        F.round(F.avg("value"), 2).alias("importance_score"))


def importance_ranking(spark, folder):
    return _six(importance.rank_importance(_given_scores(spark, folder)), "importance_score", "normalized_score")


def importance_summary(spark, folder):
    s = importance.importance_summary(importance.rank_importance(_given_scores(spark, folder)))
    s = s.withColumns({n: F.array_join(n, ",") for n in ("top_features", "bottom_features")})
    return _six(s, "mean_importance", "median_importance", "standard_deviation")


def importance_table(spark, folder):
    return importance.importance_table(importance.rank_importance(_given_scores(spark, folder)), search="LATENCY")


def leading_drivers(spark, folder):
    d = importance.leading_drivers(importance.rank_importance(_given_scores(spark, folder)))
    return _six(d.withColumn("drivers", F.array_join("drivers", ",")), "share")


def stored_importance(spark, folder):
    """A ranking as a report document: written to the shared folder, read back, checked and listed."""
    ranking = importance.rank_importance(_given_scores(spark, folder))
    item = F.struct("feature_name", "importance_score", "normalized_score", F.col("rank").cast("bigint").alias("rank"))
    report = ranking.agg(F.sort_array(F.collect_list(item)).alias("ranking")).withColumn("model_name", F.lit("given"))  # 31 features
    place = shared_path(spark, "reports")
    writers.save_document(report, f"{place}/given.json")
    writers.save_document(report.withColumn("model_name", F.lit("")), f"{place}/nameless.json")
    found = importance.valid_reports(readers.importance_reports(readers.read_reports(spark, place)))
    return _six(found.selectExpr("inline(ranking)"), "importance_score", "normalized_score")


# --- anomalies -------------------------------------------------------------------


def anomaly_report(spark, folder):
    return anomaly.analyze_anomalies(_table(spark, folder))


def _vectors(wide: DataFrame) -> DataFrame:
    ready = fit_preparation(wide, FEATURES).scaled(wide, "session_id")
    return ready.select("session_id", F.col("session_id").alias("ord"), F.array(*(F.col(c) + 0.0 for c in FEATURES)).alias("vec"))


def dbscan_sessions(spark, folder):
    return clusters.dbscan(_vectors(_table(spark, folder)), eps=2.5).select("session_id", "cluster_id")


def dbscan_defaults(spark, folder):
    return clusters.dbscan(_vectors(_table(spark, folder))).select("session_id", "cluster_id")


def dbscan_embeddings(spark, folder):
    items = table(spark, folder, "embeddings").selectExpr(
        "vec_id", "vec_id ord", "transform(embedding, x -> cast(x as double)) vec")
    return clusters.dbscan(items, eps=1.15, min_samples=4).select("vec_id", "cluster_id")


def cluster_statistics(spark, folder):
    return anomaly.cluster_statistics(_clustered(spark, folder))


def _clustered(spark, folder) -> DataFrame:
    """Records with a flag that SQL can state too: the longest tenth of sessions."""
    from sessionlens.functions.stats import exact_quantile
    wide = _table(spark, folder)
    limit = exact_quantile(wide, "interview_duration_seconds", 0.9)
    joined = clusters.dbscan(_vectors(wide), eps=2.5).join(wide.select("session_id", "interview_duration_seconds"), "session_id")
    return anomaly.finish_records(joined.withColumn("anomaly_score", F.col("interview_duration_seconds"))
                                  .withColumn("is_anomaly", F.col("anomaly_score") > F.lit(limit)))


def unknown_failures(spark, folder):
    return _clustered(spark, folder)


def anomaly_totals(spark, folder):
    return anomaly.anomaly_totals(_clustered(spark, folder))


def analytics_run(spark, folder):
    wide = _table(spark, folder)
    return analytics.run_analytics(wide.where("not baseline"), wide.where("baseline"))["summary"]


def _in_utc(query: Query) -> Query:
    """Week limits and printed dates are UTC, whatever the session was started with."""
    @wraps(query)
    def run(spark, folder):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)
    return run


QUERIES: dict[str, Query] = {f.__name__: _in_utc(f) for f in (
    signals_long, signals_from_tables, signals_nested, signals_stored, signals_conversations, signal_rows,
    signals_pivoted, rule_results, evidence_records, similar_sessions, similar_sessions_tiled, similar_embeddings,
    index_statistics, confidence_scores, diagnosed_sessions, diagnosed_documents, reasoning_prompts, cause_counts, session_overview,
    stage_counts, triggered_rules, match_listing, timeline_listing, flat_features, dataset_statistics, class_balance,
    missing_by_feature, most_missing, dataset_card, flat_rows, derived_metrics, injected_retries, collection_totals,
    collection_failures, representatives, token_estimates, validation_issues, validation_counts, sessions_round_trip,
    flat_round_trip, rejected_lines, feature_drift,
    embedding_drift, label_drift, drift_summary, largest_shift, confusion_matrix, class_report, report_averages,
    model_metrics, model_comparison, model_names, best_model, model_matrix, confusion_observations, document_quality_metrics, holdout_sizes, feature_preparation,
    scaled_features, evaluate_models, importance_native, importance_coefficient, importance_permutation,
    importance_ranking, importance_summary, importance_table, leading_drivers, stored_importance, anomaly_report, dbscan_sessions,
    dbscan_defaults, dbscan_embeddings, cluster_statistics, unknown_failures, anomaly_totals, analytics_run,
)}
