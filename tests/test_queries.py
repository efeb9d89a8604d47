"""Queries against their SQL on the smallest tables."""

import numbers
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SOME = ["trend_direction", "lifecycle_transitions", "escalation_rank", "weekly_anomalies", "batch_fixed", "exact_dups", "trust_scores", "emotion_scores", "precision_recall", "vocab_emerging", "stream_weekly", "bound_scan", "labelled_features", "results_attached", "saved_run", "anomaly_insights", "feature_spikes", "action_records", "brief_texts", "lifecycle_runs", "feature_precision_recall", "preprocess_fixture", "quality_flags", "emotion_signals", "sarcasm_decisions", "bot_totals", "csv_ranges", "json_ranges", "stream_lifecycle", "lifecycle_stage", "dup_components", "tfidf_edges", "text_campaigns", "burst_campaigns", "emotion_urgency_ids", "rank_agreement", "kappa_agreement", "language_bayes", "language_accuracy", "phrase_neighbours", "phrase_values", "text_descrambled", "lexicon_terms", "kept_responses", "validated_extractions", "bot_unverified", "bot_scores"]


def oracle(sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con.sql(sql).df()


def table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{float(v):.4f}" if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    assert table(entry.queries()[name](spark, DIR).toPandas()) == table(oracle(entry.oracle_sql()[name]))


def test_every_sql_has_a_query():
    assert not entry.oracle_sql().keys() - entry.queries().keys()
