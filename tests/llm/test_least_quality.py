"""What the fitted models reach on held-out rows of the given tables, at the least."""

import os

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from triage.llm import language_id, quality, toxicity  # noqa: E402

HERE = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="without the given tables")


def held_out(spark, scores, column, table, label):
    own = spark.read.parquet(f"{HERE}/{table}.parquet").select("doc_id", label).where(f"{label} is not null")
    return [(r[column], r[label]) for r in scores.where("held_out").join(own, "doc_id").select(column, label).collect()]


def area(rows):
    score, label = (np.array(c) for c in zip(*rows))
    zero = np.sort(score[label == 0])
    one = score[label == 1]
    return float(((np.searchsorted(zero, one, "left") + np.searchsorted(zero, one, "right")) / 2).mean() / len(zero))


def test_languages(spark):
    rows = held_out(spark, language_id.predict_languages(spark.read.parquet(f"{HERE}/documents.parquet")), "lang_pred", "documents", "lang")
    assert np.mean([a == b for a, b in rows if a != "und"]) >= 0.98


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{HERE}/{t}.parquet") for t in ("documents", "labels"))
    rows = held_out(spark, quality.quality_scores(docs, labels), "score", "labels", "quality")
    assert area(rows) >= 0.94
    assert np.mean([s >= quality.THRESHOLD for s, y in rows if y == 1]) >= 0.98


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{HERE}/{t}.parquet") for t in ("documents", "labels"))
    assert area(held_out(spark, toxicity.toxicity_scores(docs, labels), "score", "labels", "toxic")) >= 0.96
