"""Operator 3, a counterfactual-regularised toxicity classifier.

Features are the presence of words and word beginnings in the whole text, hashed; those that the
labels set apart most are kept. The model is logistic. Each labelled text that names a group is
written again with another group's name in its place, and the loss adds a penalty on the square of
the change of its score, which keeps group names from carrying weight of their own. The names are a
parameter; ``Model.swapped`` tells how many labelled texts had one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C
from triage.llm.features import PART, labelled_sample, words_and_prefixes

BITS = 20
#: Labelled documents of each class that the model is fitted on, and features it keeps.
SAMPLE, FEATURES = 6000, 1024
#: Least deviations by which a kept feature's share in the classes must differ, and weight of the penalty.
LEAST_Z, PENALTY, RIDGE = 4.0, 20.0, 1e-3
#: Sampled documents that must have a feature.
LEAST_TEXTS = 5
THRESHOLD = 0.7
# Group names, each row of one kind in one language; a name is swapped for the next in its row.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("immigré", "réfugié", "étranger"),
    ("immigrés", "réfugiés", "étrangers"),
    ("homosexuels", "lesbiennes", "hétérosexuels"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "atheist", "katholik"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("schwule", "lesben", "heterosexuelle"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("inmigrante", "refugiado", "extranjero"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("homosexuales", "lesbianas", "heterosexuales"),
)
Terms = tuple[tuple[str, ...], ...]


def swapper(terms: Terms = IDENTITY_TERMS):
    """A function that swaps every group name of a text for the next of its kind, or gives None if the text names no group. A name in several rows has the first row's."""
    follows: dict[str, str] = {}
    for row in terms:
        for i, t in enumerate(row):
            follows.setdefault(t.lower(), row[(i + 1) % len(row)])
    names = re.compile(r"\b(" + "|".join(map(re.escape, sorted(follows, key=len, reverse=True))) + r")\b", re.IGNORECASE) if follows else None

    def counterfactual(text: str) -> str | None:
        swapped, n = names.subn(lambda m: follows[m[0].lower()], text) if names else (text, 0)
        return swapped if n else None

    return counterfactual


class Model(NamedTuple):
    """Buckets kept, a weight for each and the intercept; how many labelled texts the penalty saw, of how many."""

    kept: np.ndarray
    weights: np.ndarray
    swapped: int
    sampled: int


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each class a bucket occurs; one row of two arrays for each task."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    for whole in batches:
        for batch in C.slices(whole, "text", PART):
            bucket, text = words_and_prefixes(*C.text_buffer(batch.column("text")), BITS)
            label = np.asarray(batch.column("label"))
            pairs = np.unique(text * (1 << BITS) + bucket)
            for c in (0, 1):
                own = pairs[label[pairs >> BITS] == c] & ((1 << BITS) - 1)
                counts[c] += np.bincount(own, minlength=1 << BITS).astype(np.int32)
    some = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "clean", "toxic"])


def _rows(kept, terms: Terms) -> object:
    """Each labelled document as positions in the kept features, itself and with its group names swapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counterfactual = swapper(terms)
        place = np.full(1 << BITS, -1, dtype=np.int64)
        place[kept.value] = np.arange(len(kept.value))

        def found(column: pa.Array) -> list[np.ndarray]:
            bucket, text = words_and_prefixes(*C.text_buffer(column), BITS)
            at = place[bucket]
            pairs = np.unique(text[at >= 0] * len(kept.value) + at[at >= 0]) if len(kept.value) else np.zeros(0, np.int64)
            own, n = pairs // max(len(kept.value), 1), len(column)
            cut = np.searchsorted(own, np.arange(n + 1))
            return [pairs[a:b] - r * len(kept.value) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]

        for whole in batches:
            for batch in C.slices(whole, "text", PART):
                texts = batch.column("text").to_pylist()
                swapped = [counterfactual(t) for t in texts]
                plain, other = found(batch.column("text")), found(pa.array([s or "" for s in swapped], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array([s is not None for s in swapped]), C.list_column(plain), C.list_column(other)], names=["label", "swapped", "plain", "other"])

    return run


def fit(label: np.ndarray, x: np.ndarray, swap: np.ndarray, other: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> np.ndarray:
    """Weights, the intercept last. ``x``: presence; ``other``: presence in the swapped texts of the rows ``swap``."""
    n, d = x.shape
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    share = label.mean() if n else 0.0
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(n)
    score = lambda z: 1 / (1 + np.exp(-np.clip(z @ w[:d].astype(np.float32) + w[d], -30, 30)))
    for t in range(1, steps + 1):
        p = score(x)
        e = balance * (p - label) / max(n, 1)
        g = np.concatenate([x.T @ e.astype(np.float32) + RIDGE * w[:d], [e.sum()]])
        if len(swap):  # of penalty * mean((p - q) ** 2)
            own, q = p[swap], score(other)
            change = 2 * penalty / len(swap) * (own - q)
            up, down = change * own * (1 - own), change * q * (1 - q)
            g += np.concatenate([x[swap].T @ up.astype(np.float32) - other.T @ down.astype(np.float32), [(up - down).sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(sample: DataFrame, penalty: float = PENALTY, terms: Terms = IDENTITY_TERMS) -> Model:
    """The model from ``text, label`` rows of a bounded sample."""
    spark = sample.sparkSession
    seen = sample.mapInArrow(_presence, "bucket long, clean int, toxic int").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_TEXTS).toArrow()
    bucket, clean, toxic = (np.asarray(seen.column(i).combine_chunks()) if seen.num_rows else np.zeros(0, np.int64) for i in range(3))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    share = (clean + toxic) / (n0 + n1)
    z = np.abs(toxic / n1 - clean / n0) / np.sqrt(np.maximum(share * (1 - share) * (1 / n0 + 1 / n1), 1e-12))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    kept = np.sort(bucket[best[z[best] >= LEAST_Z]])
    rows = sample.mapInArrow(_rows(spark.sparkContext.broadcast(kept), terms), "label int, swapped boolean, plain array<long>, other array<long>").toArrow().to_pylist()
    x, y = np.zeros((len(rows), len(kept)), dtype=np.float32), np.zeros((len(rows), len(kept)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["plain"]] = 1
        y[i, r["other"]] = 1
    swap = np.array([i for i, r in enumerate(rows) if r["swapped"]], dtype=np.int64)
    weights = fit(np.array([r["label"] for r in rows], dtype=np.float64), x, swap, y[swap], penalty)
    return Model(kept, weights, len(swap), len(rows))


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weights = model.value[:2]
        table = np.zeros(1 << BITS)
        table[kept] = weights[:-1]
        for whole in batches:
            for batch in C.slices(whole, "text", PART):
                bucket, text = words_and_prefixes(*C.text_buffer(batch.column("text")), BITS)
                used = table[bucket] != 0
                pairs = np.unique(text[used] * (1 << BITS) + bucket[used])
                logit = np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=len(batch)) + weights[-1]
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(score)], names=[*keep, "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row by a model."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(C.id_crc32("doc_id"), F.lit(3)) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, terms: Terms = IDENTITY_TERMS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per document.

    Learns from labelled documents whose crc32(id) mod 3 isn't 1. A null or empty text has no features
    and the score of the intercept. Null ids are documents like any other, outside the sample; repeated
    rows are scored alike. Labels other than 0 and 1 are ignored; of two labels of one id the larger
    counts; without labels every score is 0.5. Extra columns are ignored; no documents, no rows.
    """
    return scores(docs, train(labelled_sample(docs, labels, "toxic", 3, 1, SAMPLE), terms=terms))


def _clean(model) -> object:
    score = _score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string())], names=["text"])
            got = [x.column("score") for x in score(iter([only]))]
            if got:
                yield batch.filter(pa.array(np.concatenate([np.asarray(g) for g in got]) < THRESHOLD))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, terms: Terms = IDENTITY_TERMS) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't call toxic, with all their columns.

    Texts that are null or empty stay unless the intercept alone reaches the threshold; rows without an id
    and repeated rows are kept or dropped by their texts. Without labels all rows stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "toxic", 3, 1, SAMPLE), terms=terms))
    return docs.mapInArrow(_clean(model), docs.schema)
