"""The pipeline against a plain version: one document at a time, all pairs, no joins."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from geolith.llm import decontamination, pii, quality
from geolith.llm.batches import text_buffer
from geolith.llm.queries import model_path
from geolith.llm.words import NOT_ALNUM, words
from tests.llm.test_models import plain_components

SF = "/root/testdata/sf0.001"


def hashes(text):
    return words(*text_buffer(pa.array([text], pa.string())), NOT_ALNUM).hashes


def plain(docs, model, items):
    """ids of the texts that are left, by document."""
    import sentencepiece

    score = lambda t: quality.scores(model, *quality.passages(*text_buffer(pa.array([t], pa.string()))), 1)[0][0]
    docs = {k: t for k, t in docs.items() if score(t) >= quality.THRESHOLD}
    found = plain_components(docs, 5, 80)
    docs = {k: t for k, t in docs.items() if found[k][1] == k}

    def holds(text):
        w = hashes(text)
        for item in items:
            v = hashes(item)
            if len(v) and not (len(v) < decontamination.SHORT_WORDS and len(w) > 2 * len(v)) and decontamination.align(v, w).score >= decontamination.SCORE * 2 * len(v):
                return True
        return False

    docs = {k: t for k, t in docs.items() if not holds(t)}
    weights = pii.trained()
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    return {k: library.encode(pii.redacted(t, pii.find(t, weights)[1])) for k, t in docs.items()}


def test_pipeline_matches_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet")
    items = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    want = plain(dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())), model, items)
    assert got == want and 0 < len(want) < t.num_rows


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "no id here", "en", "b", 10), (3, "word " * 30_000, None, None, 150_000)]])
def test_stages_keep_columns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "lang AS rep", "source AS cid", "n_chars AS bucket")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert out.count() <= len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert last.count() == len(rows) and "ids" in last.columns
    words_left = [r["text"] for r in corpus_pipeline.redact_personal_data(spark, df, SF).collect() if r["text"]]
    assert all(not re.search("@", t) for t in words_left)
