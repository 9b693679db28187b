"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from geolith.llm import decontamination, licenses, lm, media_ts, ngram_join, pii, quality, secret_scan, sentencepiece_codec
from geolith.llm.queries import model_path

LONG = "word soup of many plain words " * 4000
ROWS = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "same text twice over here now"), (5, "same text twice over here now"), (None, "no id at all in this row"), (6, "ünïcode — 漢字 😀 text")]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["id", "row", "score", "words", "cid", "n", "spans", "lang", "source", "root", "gram", "rep", "held_out"]
    return df.select("doc_id", *[F.lit(c).alias(c) for c in clash], "text")


def fitted():
    import numpy as np

    return quality.fit(np.zeros((0, quality.N_FEATURES), np.float32), np.zeros(0, int), np.zeros(0))


OPERATORS = {
    "licenses": licenses.scan,
    "secrets": secret_scan.scan,
    "sentencepiece": lambda df: sentencepiece_codec.encode_digests(df, model_path()),
    "encode": lambda df: sentencepiece_codec.encode(df, model_path()),
    "quality": lambda df: quality.score(df, fitted()),
    "pii": pii.scan,
    "lm": lm.score,
    "media": media_ts.stream_digests,
    "ngrams": ngram_join.join,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_kept(spark, name):
    got = OPERATORS[name](table(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) if r["doc_id"] is None else (False, r["doc_id"]) for r in got if r["doc_id"] is not None) == [(False, k) for k in (1, 2, 3, 4, 5, 5, 6)]
    assert sum(r["doc_id"] is None for r in got) == 1
    twice = [r.asDict() for r in got if r["doc_id"] == 5]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("run", ["a", "7", ".", "a.", "7.", "7 ", "1.1..", "AKIA", "0f", "@", "+1", "-", "x7 ", "=", "\n", "eyJhbGciOiJub25lIn0."])
def test_long_runs_take_time_in_proportion(run):
    import time

    text = (run * (1 << 20))[: 1 << 20]
    for find in (secret_scan.find, pii.base_spans):
        start = time.process_time()
        find(text)
        assert time.process_time() - start < 4
    start = time.process_time()
    assert sum(1 for _ in pii._NODE.finditer(text)) <= 1 << 20
    assert time.process_time() - start < 4


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


def test_filters_keep_columns(spark):
    df = table(spark)
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for out in (quality.kept(df, fitted()), pii.redact(df), decontamination.decontaminated(df, bench)):
        assert out.schema == df.schema and out.count() == len(ROWS)
    assert decontamination.contaminated(df, bench).count() == 0
    assert decontamination.contaminated(table(spark, []), bench).count() == 0
    kept = ngram_join.deduplicated(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
