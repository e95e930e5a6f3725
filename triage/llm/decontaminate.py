"""Operator 9, benchmark decontamination by winnowing.

A text's fingerprints are the minima of the hashes of its runs of ``GRAM`` words over sliding windows
of ``WINDOW`` runs, so two texts that share ``GRAM + WINDOW - 1`` = 10 consecutive words share one.
Fingerprints of documents and benchmark items are joined. A document's hits are extended in the
document alone: every run of ten words whose fingerprint was met is looked up among the items' runs, and
the words of those found count as hit. Items of fewer than ten words are found through the hash of the
whole item, taken at every position of a document. Texts of documents without a met fingerprint are read
once and never moved; items travel as ids and hashes.

Spark chooses the joins by the sizes it knows: the benchmark's fingerprints are broadcast only below
``spark.sql.autoBroadcastJoinThreshold``, else both sides are shuffled by fingerprint, where a
fingerprint that most documents have is split by AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1


def minima(runs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The minimum of every window of ``window`` consecutive values; of all values if there are fewer."""
    if len(runs) <= window:
        return runs.min(keepdims=True) if len(runs) else runs
    low, width = runs, 1
    while width < window:  # doubling, then one overlap
        step = min(width, window - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return low


def short_runs(words: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    return [C.grams(words, k) for k in lengths]


def fingerprints(words: np.ndarray, lengths: tuple[int, ...] = ()) -> np.ndarray:
    """Distinct fingerprints of one text; ``lengths``: of short items, whose runs count as well."""
    parts = short_runs(words, lengths)
    if len(words) >= SPAN:
        parts.append(minima(C.grams(words, GRAM)))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _columns(batch: pa.RecordBatch, row: np.ndarray, names: tuple[str, ...]) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(row)) for c in names]


def _document_prints(lengths: tuple[int, ...]) -> object:
    """(doc_id, text_key, text) -> a row for each fingerprint, and one with ``n_words`` and any value in its place for each document. ``lengths``: of all short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "text"):
                words, begin = C.word_hashes(*C.text_buffer(batch.column("text")), C.LETTERS)
                n = np.diff(begin).astype(np.int64)
                parts = [fingerprints(words[a:b], lengths) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                own = np.arange(len(n))
                row = np.concatenate([own, np.repeat(own, [len(p) for p in parts])])
                with np.errstate(over="ignore"):  # spread, so that no task has all of them
                    spread = C.mix(np.asarray(batch.column("text_key")).view(np.uint64) + own.astype(np.uint64))
                fp = np.concatenate([spread, *parts])
                yield pa.RecordBatch.from_arrays([*_columns(batch, row, ("doc_id", "text_key")), pa.array(np.where(np.arange(len(row)) < len(n), n[row], 0), mask=np.arange(len(row)) >= len(n)), pa.array(fp.view(np.int64))], names=["doc_id", "text_key", "n_words", "fp"])

    return run


def _item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> its runs of ten words, or of all its words, each with the fingerprint under which it is found: (item_id, fp, k, run)."""
    for whole in batches:
        for batch in C.slices(whole, "text"):
            words, begin = C.word_hashes(*C.text_buffer(batch.column("text")), C.LETTERS)
            row, fp, k, run = [], [], [], []
            for r, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                if b > a:
                    own = C.grams(words[a:b], min(SPAN, b - a))
                    row.append(np.full(len(own), r))
                    fp.append(minima(C.grams(words[a:b], GRAM)) if b - a >= SPAN else own)
                    k.append(np.full(len(own), min(SPAN, b - a)))
                    run.append(own)
            row, fp, k, run = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, fp, k, run))
            yield pa.RecordBatch.from_arrays([*_columns(batch, row, ("item_id",)), pa.array(fp.view(np.int64)), pa.array(k, pa.int32()), pa.array(run.view(np.int64))], names=["item_id", "fp", "k", "run"])


def _document_runs(lengths: tuple[int, ...]) -> object:
    """(doc_id, text_key, text, met array<long>) -> the runs around the fingerprints that were met: (doc_id, text_key, pos, k, run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "text"):
                words, begin = C.word_hashes(*C.text_buffer(batch.column("text")), C.LETTERS)
                met = batch.column("met")
                out: list[tuple] = []
                for r, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                    known = np.asarray(met[r].values).view(np.uint64)
                    for k in {*lengths, SPAN}:
                        if b - a < k:
                            continue
                        runs = C.grams(words[a:b], k)
                        pos = np.flatnonzero(np.isin(runs if k < SPAN else minima(C.grams(words[a:b], GRAM)), known))
                        out.append((np.full(len(pos), r), pos, np.full(len(pos), k), runs[pos]))
                row, pos, k, runs = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64) for _ in range(4))
                yield pa.RecordBatch.from_arrays([*_columns(batch, row, ("doc_id", "text_key")), pa.array(pos, pa.int64()), pa.array(k, pa.int32()), pa.array(runs.view(np.int64))], names=["doc_id", "text_key", "pos", "k", "run"])

    return run


def _short_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[int] = set()
    for whole in batches:
        for batch in C.slices(whole, "text"):
            _, begin = C.word_hashes(*C.text_buffer(batch.column("text")), C.LETTERS)
            found |= {int(n) for n in np.diff(begin) if 0 < n < SPAN}
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["n"])


def covered(runs: Column) -> Column:
    """How many positions lie in any of the runs (pos, k) of a sorted array."""
    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["k"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["pos"]), zero)).alias("n"))

    return F.aggregate(runs, F.struct(zero.alias("end"), zero.alias("n")), step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``benchmark`` has ``item_id, text``. Null and wordless texts have no words and aren't hit; wordless
    items, and items without an id, occur nowhere. Rows that repeat an item id are one item with all
    their windows. Rows of documents that share id and text get equal
    rows, null ids included. Extra columns are ignored. Empty tables: no rows, or no hits.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    lengths = tuple(sorted({r[0] for r in items.mapInArrow(_short_lengths, "n long").distinct().collect()}))  # 9 at most
    keyed = own.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    runs = C.written(items.mapInArrow(_item_runs, f"item_id {kind}, fp long, k int, run long").distinct(), "item-runs")
    prints = keyed.mapInArrow(_document_prints(lengths), "doc_id long, text_key long, n_words long, fp long")
    prints = C.written(prints.join(runs.select("fp", F.lit(True).alias("met")).distinct(), "fp", "left").where("met or n_words is not null"), "prints")

    key = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    met = prints.where("n_words is null").groupBy("doc_id", "text_key").agg(F.collect_set("fp").alias("met"))  # of a document its own fingerprints
    which = C.written(met.select("doc_id", "text_key"), "met")  # as a table, so that Spark knows its size before it moves any text
    texts = keyed.alias("d").join(which.alias("m"), key("d", "m"), "left_semi")
    hit = texts.alias("d").join(met.alias("m"), key("d", "m")).select("d.doc_id", "d.text_key", "d.text", "m.met")
    found = C.written(hit.mapInArrow(_document_runs(lengths), "doc_id long, text_key long, pos long, k int, run long").distinct(), "document-runs")
    spans = found.join(runs.select("k", "run").distinct(), ["k", "run"], "left_semi").groupBy("doc_id", "text_key").agg(covered(F.array_sort(F.collect_list(F.struct("pos", "k")))).alias("n_hit"))
    names = found.select("doc_id", "text_key", "k", "run").distinct().join(runs.select("item_id", "k", "run").distinct(), ["k", "run"]).select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
    names = names.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = spans.alias("s").join(names.alias("n"), key("s", "n")).select("s.doc_id", "s.text_key", "n_hit", "items")
    out = prints.where("n_words is not null").alias("p").join(both.alias("b"), key("p", "b"), "left")
    none = F.array().cast("array<string>")
    out = out.select(
        "p.doc_id", "p.text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
    return out if with_key else out.drop("text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of any item."""
    hit = contamination(docs, benchmark, id_col, text_col, with_key=True).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__key"))
    return docs.join(C.written(hit, "hit"), same, "left_anti")
