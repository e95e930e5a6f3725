"""Operator 8, a quality classifier on supervised subword embeddings.

Words, pairs of neighbouring words and runs of three characters are hashed to learned vectors. A document is the mean of the vectors of all its
features; a softmax over two classes follows. Vectors and output are trained together by stochastic
gradient descent in numpy on a bounded sample. Since both steps are linear up to the softmax, a
feature's share in the difference of the two outputs is one number, and scoring sums these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C
from triage.llm.features import PART, labelled_sample, words_and_grams

BITS = 17
DIM = 8
SAMPLE, EPOCHS, RATE = 2000, 6, 4.0
#: Distinct features of a document that the fit takes, drawn evenly from all of a longer one's: with SAMPLE it bounds what the driver holds (some 250 MB). Scores take all.
FITTED = 8192
THRESHOLD = 0.3


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document as its distinct buckets, FITTED at most, and how often it has each."""
    for whole in batches:
        for batch in C.slices(whole, "text", PART):
            bucket, text = words_and_grams(*C.text_buffer(batch.column("text")), BITS)
            pairs, n = np.unique(text * (1 << BITS) + bucket, return_counts=True)
            cut = np.searchsorted(pairs >> BITS, np.arange(len(batch) + 1))
            at = (pairs & ((1 << BITS) - 1)).astype("<u4")
            rows = []
            for a, b in zip(cut[:-1], cut[1:]):
                own = np.arange(a, b) if b - a <= FITTED else np.sort(np.random.default_rng(int(b - a)).choice(np.arange(a, b), FITTED, replace=False))
                rows.append((at[own].tobytes(), n[own].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "label", "at", "n"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> tuple[np.ndarray, float]:
    """(a number for each bucket, intercept) from (label, buckets, counts) of documents; the rarer class weighs more, by the root of its rarity."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    labels = np.array([r[0] for r in rows], dtype=np.int64)
    balance = np.sqrt(len(rows) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))) if len(rows) else np.ones(2)
    done, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            y, at, n = rows[i]
            if not len(at):
                continue
            share = (n / n.sum()).astype(np.float32)
            mean = share @ vectors[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / total) * float(balance[y])
            back = out @ p
            out -= 0.1 * step * np.outer(mean, p)
            bias -= 0.02 * step * p
            vectors[at] -= step * np.outer(share * len(at) ** 0.5, back)
            done += 1
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for whole in batches:
            for batch in C.slices(whole, "text", PART):
                bucket, text = words_and_grams(*C.text_buffer(batch.column("text")), BITS)
                n = np.bincount(text, minlength=len(batch))
                logit = np.bincount(text, weights=table[bucket], minlength=len(batch)) / np.maximum(n, 1) + bias
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=[*keep, "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per document.

    Learns from labelled documents whose crc32(id) mod 5 isn't 0. A null or empty text has the score of
    the intercept. Null ids are documents like any other, outside the sample; repeated rows are scored
    alike. Labels other than 0 and 1 are ignored; of two labels of one id the larger counts; without
    labels scores say nothing. Extra columns are ignored; no documents, no rows.
    """
    sample = labelled_sample(docs, labels, "quality", 5, 0, SAMPLE)
    got = sample.mapInArrow(_counts, "doc_id long, label int, at binary, n binary").toArrow().sort_by("doc_id")
    rows = [(y, np.frombuffer(a, "<u4"), np.frombuffer(n, "<u4")) for y, a, n in zip(*(got.column(c).to_pylist() for c in ("label", "at", "n")))]
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(C.id_crc32("doc_id"), F.lit(5)) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
