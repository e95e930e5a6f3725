"""Operator 4, nearest neighbours by an inverted multi-index.

Vectors are cut into halves and each half is quantised with a codebook of its own; a pair of centroids
is a cell. A query takes the cells in the order of the summed distances of its halves to the two
centroids, by a heap with the next cell of each first centroid, until it has met enough vectors.
Distances are negated inner products, so the walk follows the measure of the search. All vectors of the
cells visited are ranked by the exact inner product of the original vectors.

How many vectors are enough is measured: for ``PROBES`` of the queries the true neighbours are found by
comparing them with every vector, and the walk goes on as far as it takes to meet ``RECALL`` of those. On
vectors with clusters that is a small share of all, on noise a large one. Centroids grow with the root of
the number of vectors, so that cells stay small, up to ``MOST_CENTROIDS`` of a half, which bounds the
table of cells that is broadcast.

A vector goes to one block, made of vectors of neighbouring first centroids; a query goes to the blocks
that hold cells it visits. There vectors lie by cell, and a cell is multiplied with the queries whose walk visits it alone. Codebooks are trained on a bounded sample, every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triage.llm import common as C

TOP = 20
SAMPLE = 20_000
#: Vectors of a cell, about, while the codebooks still grow; bounds of the centroids of a half.
PER_CELL, LEAST_CENTROIDS, MOST_CENTROIDS = 4, 16, 1024
#: Queries whose true neighbours are looked for, and the share of these that the walk has to meet.
PROBES, RECALL = 256, 0.95
#: Vectors of a block: a 64th of all within these bounds. Products worked out at a time.
LEAST_BLOCK, MOST_BLOCK, PRODUCTS = 4096, 100_000, 4_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """k centroids by Lloyd's rounds from distinct rows; an empty one stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centre = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, centre)
        n = np.bincount(near, minlength=len(centre))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(centre)) for j in range(x.shape[1])], axis=1)
        centre[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(axis=1)[None, :] - 2 * (x @ centre.T), axis=1)


def distances(q: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query's halves to the centroids of the two codebooks; summed alike everywhere, so that they can be compared."""
    half = one.shape[1]
    return -(q[:, None, :half] * one[None]).sum(axis=2), -(q[:, None, half:] * two[None]).sum(axis=2)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> tuple[float, list[int]]:
    """Cells in the order of ``first[i] + second[j]`` until ``wanted`` vectors are met; ``held[i, j]``: vectors of a cell.

    Returns the distance of the last cell and the first centroids visited.
    """
    order = np.argsort(second, kind="stable")
    rows, steps = held[:, order].tolist(), second[order].tolist()
    base = first.tolist()
    heap = [(b + steps[0], i) for i, b in enumerate(base)]
    heapq.heapify(heap)
    place, met, last, end = [0] * len(base), 0, float("-inf"), len(steps)
    while heap and met < wanted:
        last, i = heap[0]
        at = place[i]
        met += rows[i][at]
        place[i] = at = at + 1
        if at < end:
            heapq.heapreplace(heap, (base[i] + steps[at], i))
        else:
            heapq.heappop(heap)
    return last, [i for i, n in enumerate(place) if n]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assign(books, dim: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        half = dim // 2
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            i, j = nearest(x[:, :half], one), nearest(x[:, half:], two)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["vec_id", "embedding", "i", "j"])

    return run


def _true(probes, dim: int) -> object:
    """The best TOP of a task's vectors for each probe: (probe, vec_id, score, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = probes.value
        best = [np.zeros((0, 4)) for _ in ids]  # score, i, j, place of the id in kept
        kept: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]
        for batch in batches:
            x, own = _matrix(batch.column("embedding"), dim), np.asarray(batch.column("vec_id"))
            cell = np.stack([np.asarray(batch.column("i")), np.asarray(batch.column("j"))], axis=1)
            score = queries @ x.T
            score[ids[:, None] == own[None, :]] = -np.inf
            take = np.argpartition(-score, min(TOP, len(x)) - 1, axis=1)[:, :TOP] if len(x) else np.zeros((len(ids), 0), np.int64)
            for p in range(len(ids)):
                at = take[p][np.isfinite(score[p, take[p]])]
                both = np.concatenate([best[p][:, 0], score[p, at]])
                top = np.argsort(-both, kind="stable")[:TOP]
                best[p] = np.concatenate([best[p], np.column_stack([score[p, at], cell[at], np.zeros(len(at))])])[top]
                kept[p] = np.concatenate([kept[p], own[at]])[top]
        probe = np.repeat(np.arange(len(ids)), [len(k) for k in kept])
        rows = np.concatenate(best) if len(best) else np.zeros((0, 4))
        yield pa.RecordBatch.from_arrays(
            [pa.array(probe, pa.int32()), pa.array(np.concatenate(kept) if kept else [], pa.int64()), pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32))], names=["probe", "vec_id", "score", "i", "j"]
        )

    return run


def enough(queries: np.ndarray, probe: np.ndarray, cells: np.ndarray, books: tuple[np.ndarray, np.ndarray], held: np.ndarray, recall: float = RECALL) -> int:
    """How many vectors the walk has to meet so that it visits the cells of ``recall`` of the true neighbours (``probe``, ``cells``: one row each)."""
    met = []
    for p in np.unique(probe).tolist():
        first, second = (d[0] for d in distances(queries[p : p + 1], *books))
        far = (first[:, None] + second[None, :]).ravel()
        order = np.argsort(far)
        before = np.cumsum(held.ravel()[order])
        own = cells[probe == p]
        met.append(before[np.searchsorted(far[order], first[own[:, 0]] + second[own[:, 1]], side="right") - 1])
    return int(np.quantile(np.concatenate(met), recall, method="higher")) if met else int(held.sum())


def _visit(plan, dim: int, wanted: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, held, begin, blocks = plan.value
        for batch in batches:
            reach, seen = [], []
            for q in _matrix(batch.column("embedding"), dim):
                first, second = distances(q[None], one, two)
                far, rows = walk(first[0], second[0], held, wanted)
                reach.append(far)
                seen.append(sorted({b for i in rows for b in range(begin[i], begin[i] + blocks[i])}))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(reach, pa.float64()), pa.array(seen, pa.list_(pa.int32()))], names=["id", "vector", "reach", "blocks"])

    return run


def best(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(ids, exact scores) of the best ``top`` rows. Scores are summed alike for all rows, so equal vectors tie; ties go to smaller ids."""
    if len(ids) > top:
        edge = np.partition(rough, len(ids) - top)[len(ids) - top]
        pick = np.flatnonzero(rough >= edge - 1e-9 * max(1.0, abs(edge)))
        ids, vectors = ids[pick], vectors[pick]
    exact = (vectors * query).sum(axis=1)
    order = np.lexsort((ids, -exact))[:top]
    return ids[order], exact[order]


def cell_products(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, first: np.ndarray, second: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, int]:
    """(products, how many were worked out) of queries and vectors, which lie by cell: those of a query with the vectors of cells on its walk; -inf for all others."""
    rough, done = np.full((len(q), len(v)), -np.inf), 0
    cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(v)]):
        asks = np.flatnonzero(first[:, i[a]] + second[:, j[a]] <= reach)
        if len(asks):
            rough[asks, a:b] = q[asks] @ v[a:b].T
            done += len(asks) * (b - a)
    return rough, done


def _rank(books, dim: int) -> object:
    """Rows sorted by (block, reach) with a block's vectors, whose reach is null, first -> the best of what each query visits there."""

    def ranked(ids: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, asked: np.ndarray, q: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
        found = []
        for a in range(0, len(q), step := max(1, PRODUCTS // max(len(v), 1))):
            part = q[a : a + step]
            rough, _ = cell_products(part, v, i, j, *distances(part, *books.value), reach[a : a + step])
            for k in range(len(part)):
                seen = np.flatnonzero((rough[k] > -np.inf) & (ids != asked[a + k]))
                got, score = best(part[k], ids[seen], v[seen], rough[k][seen])
                found.append((np.full(len(got), asked[a + k]), got, score))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found]), t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["query_id", "vec_id", "score"])

    def by_cell(parts: list) -> list[np.ndarray]:
        columns = [np.concatenate(p) for p in zip(*parts)]
        order = np.lexsort((columns[3], columns[2]))
        return [c[order] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, own = None, [], None
        for batch in batches:
            at = np.asarray(batch.column("block"))
            asks = batch.column("reach").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if at[a] != block:
                    block, parts, own = at[a], [], None
                column = lambda c: np.asarray(rows.column(c))
                if not asks[a]:
                    parts.append((column("id"), _matrix(rows.column("vector"), dim), column("i"), column("j")))
                elif parts:
                    own = by_cell(parts) if own is None else own
                    yield ranked(*own, column("id"), _matrix(rows.column("vector"), dim), column("reach"))

    return run


def nearest_neighbours(vectors: DataFrame, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every`` the TOP other rows met with the largest inner product.

    Vectors that are null or zero, hold a null or a non-finite number, or have a null id, take no part.
    Of vectors of unlike lengths, the shorter counts as filled up with zeros. Rows that share an id are
    candidates of their own but not of that id's query, which the first of them by value stands for.
    Ties go to the smaller id. Extra columns are ignored. Fewer candidates than TOP: all that are met. No
    vectors, no rows.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    own = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    n, least, longest = own.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = longest + longest % 2
    if least < dim:
        own = own.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("embedding"))))
    sample = own.where(C.draw("vec_id", F.lit(11)) < C.draw_limit(SAMPLE, n)).orderBy("vec_id").limit(2 * SAMPLE).select("embedding").toArrow()
    x = _matrix(sample.column(0).combine_chunks(), dim)
    centroids = min(MOST_CENTROIDS, max(LEAST_CENTROIDS, int((n / PER_CELL) ** 0.5)))
    books = kmeans(x[:, : dim // 2], centroids), kmeans(x[:, dim // 2 :], centroids)
    shared = spark.sparkContext.broadcast(books)
    index = C.written(own.mapInArrow(_assign(shared, dim), "vec_id long, embedding array<double>, i int, j int"), "cells")
    held = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    cells = index.groupBy("i", "j").count().toArrow()  # MOST_CENTROIDS squared at most
    held[np.asarray(cells.column(0).combine_chunks()), np.asarray(cells.column(1).combine_chunks())] = np.asarray(cells.column(2).combine_chunks())

    queries = C.written(own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    probes = queries.orderBy(C.draw("vec_id", F.lit(13)), "vec_id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = np.asarray(probes.column(0).combine_chunks()), _matrix(probes.column(1).combine_chunks(), dim)
    true = index.mapInArrow(_true(spark.sparkContext.broadcast(asked), dim), "probe int, vec_id long, score double, i int, j int")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= TOP).select("probe", "i", "j").toArrow()
    probe, i, j = (np.asarray(true.column(c).combine_chunks()) for c in range(3)) if true.num_rows else (np.zeros(0, np.int64) for _ in range(3))
    wanted = enough(asked[1], probe, np.stack([i, j], axis=1), books, held)

    room = max(LEAST_BLOCK, min(MOST_BLOCK, n // 64))
    groups = max(1, min(len(books[0]), -(-n // room)))
    group = np.arange(len(books[0])) * groups // len(books[0])
    rows = np.bincount(group, weights=held.sum(axis=1), minlength=groups)
    blocks = np.maximum(1, np.ceil(rows / room)).astype(np.int64)
    begin = np.cumsum(blocks) - blocks
    plan = spark.sparkContext.broadcast((*books, held, begin[group].tolist(), blocks[group].tolist()))
    visits = queries.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id").mapInArrow(_visit(plan, dim, wanted), "id long, vector array<double>, reach double, blocks array<int>")
    per = lambda values: F.element_at(F.lit(values[group].tolist()), F.col("i") + 1)
    none = lambda t: F.lit(None).cast(t)
    left = index.withColumn("row", F.monotonically_increasing_id()).select((per(begin) + F.col("row") % per(blocks)).cast("int").alias("block"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "i", "j", none("double").alias("reach"))
    right = visits.select(F.explode("blocks").alias("block"), "id", "vector", none("int").alias("i"), none("int").alias("j"), "reach")
    both = left.unionByName(right).repartition("block").sortWithinPartitions(F.asc("block"), F.asc_nulls_first("reach"))
    found = both.mapInArrow(_rank(shared, dim), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")
