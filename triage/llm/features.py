"""Hashed word and subword features of whole texts, and bounded samples of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

#: Bytes of text for which the arrays of a task are made at a time.
PART = 1 << 21


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, cap: int) -> DataFrame:
    """``doc_id, text, label`` of about ``cap`` labelled documents of each class outside the held-out fold.

    Rows are taken by a hash of the id, so the sample is the same on every run and doesn't depend on
    partitions; where a class has fewer rows, all are taken. The id list that is broadcast has 2 * cap rows or so.
    """
    fold = F.pmod(C.id_crc32("doc_id"), F.lit(folds))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold != left_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    limit = F.when(F.col("label") == 1, C.draw_limit(cap, sizes.get(1, 0))).otherwise(F.lit(C.draw_limit(cap, sizes.get(0, 0))))
    chosen = known.where(C.draw("doc_id", F.lit(7)) < limit)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of rows that share an id, one
    return C.written(one.select("doc_id", "text", "label"), "sample")


def _rolling(raw: np.ndarray, seed: int, fold: bool, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as they count, whether each lies in a word, running sums for hashes of any stretch)."""
    data = C._LOWER[raw] if fold else raw
    C._Powers.reach(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(C._random_table(seed)[data] * C._Powers.up[: len(raw)], dtype=np.uint64)])
    return data, inside[C._LOWER[raw]], sums


def _stretch(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix((sums[end] - sums[begin]) * C._Powers.down[begin] + np.uint64(seed))


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every word."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    stop = offsets[1:][np.diff(offsets) > 0] - 1
    last[stop] = inside[stop]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1 if n else begin


def words_and_prefixes(raw: np.ndarray, offsets: np.ndarray, bits: int, prefixes: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word in lower case and of its beginnings of so many bytes."""
    _, inside, sums = _rolling(raw, 41, True, C.LETTERS)
    begin, end, text = word_bounds(inside, offsets)
    mask = np.uint64((1 << bits) - 1)
    buckets, texts = [_stretch(sums, begin, end, 0) & mask], [text]
    for k in prefixes:
        long = end - begin > k
        buckets.append(_stretch(sums, begin[long], begin[long] + k, k) & mask)
        texts.append(text[long])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(texts)


def words_and_grams(raw: np.ndarray, offsets: np.ndarray, bits: int, within: tuple[int, ...] = (), across: tuple[int, ...] = (3,), pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word as written and every pair of neighbouring words, of all runs of ``within`` characters within a word and its borders, and of all runs of ``across`` characters."""
    _, inside, sums = _rolling(raw, 43, False, C.BLANKS)
    begin, end, text = word_bounds(inside, offsets)
    mask = np.uint64((1 << bits) - 1)
    words = _stretch(sums, begin, end, 0)
    buckets, texts = [words & mask], [text]
    if pairs and len(words) > 1:
        same = text[1:] == text[:-1]
        with np.errstate(over="ignore"):
            both = C.mix(words[:-1] * np.uint64(C._SPREAD[0]) + words[1:])
        buckets.append(both[same] & mask)
        texts.append(text[1:][same])
    run = np.concatenate([[0], np.cumsum(~inside)])
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
    edge = np.append(first, len(raw))
    for k in sorted({*within, *across}):
        if len(first) < k:
            continue
        at, stop = first[: len(first) - k + 1], edge[k:]
        if k not in across:
            ok = run[edge[k - 1 : -1]] == run[edge[1 : len(at) + 1]]  # no blank but at either border
            at, stop = at[ok], stop[ok]
        of = np.searchsorted(offsets, at, side="right") - 1
        same = offsets[of + 1] >= stop
        buckets.append(_stretch(sums, at[same], stop[same], k) & mask)
        texts.append(of[same])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(texts)
