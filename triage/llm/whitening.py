"""Operator 13, whitening of embeddings with a covariance made of tiles.

Entries become whole numbers, so sums are exact. The covariance of d dimensions is made of tiles, pairs of blocks of
``TILE`` dimensions. Tasks cut their rows into row-blocks of ``ROWS`` rows and each of these into
column blocks, centred before they are multiplied. The column blocks are dealt by row-block, so that the two blocks of a
tile key meet; each row-block's pairs are multiplied, added up by tile within the task, and then over all tasks by tile
and place in it. What comes to the driver is the d x d matrix, whose eigenvectors every task gets back:
both follow the dimensions, not the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm import common as C

TILE, ROWS = 64, 2048
#: Entries beyond this have no exact whole number 64 times as large beside 2^53.
WIDEST = float(1 << 46)
#: Components of less than this share of the largest variance have no direction of their own.
LEAST = 1e-12


def sound_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x array<long>``: vectors without null or non-finite entries as floor(64 c) + 1000000."""
    e = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WIDEST))
    x = F.transform(e, lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long"))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def totals(rows: DataFrame, column: str, dim: int) -> tuple[int, list, list, list]:
    """Rows, and the sum, least and greatest value of each dimension; ``dim`` values each."""
    each = rows.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("a"), F.max("v").alias("b"))
    got = {r["k"]: r for r in each.collect()}  # a row a dimension
    return (got[0]["n"] if got else 0), *([got[k][c] for k in range(dim)] if got else [] for c in "sab")


def _column_blocks(column: str, mean: np.ndarray, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each column block of each row-block: its name, the block's number, the centred values row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                d = _matrix(batch.slice(begin, ROWS).column(column), len(mean)) - mean
                parts = [np.ascontiguousarray(d[:, a : a + tile]) for a in range(0, len(mean), tile)]
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int64()), pa.array([k] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["task", "row_block", "block", "data"])
                k += 1

    return run


def _products(sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sum over a task's row-blocks of the products of each tile key's two blocks: ``i, j, values``. Rows come by row-block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        own: tuple | None = None
        blocks: dict[int, np.ndarray] = {}

        def multiply() -> None:
            for i in blocks:
                for j in blocks:
                    if i <= j:
                        product = blocks[i].T @ blocks[j]
                        sums[i, j] = sums[i, j] + product if (i, j) in sums else product
            blocks.clear()

        for batch in batches:
            for task, k, block, data in zip(*(batch.column(c).to_pylist() for c in ("task", "row_block", "block", "data"))):
                if (task, k) != own:
                    multiply()
                    own = task, k
                blocks[block] = np.frombuffer(data, dtype=np.float64).reshape(-1, sizes[block])
        multiply()
        for (i, j), product in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([product.ravel()], pa.list_(pa.float64()))], names=["i", "j", "values"])

    return run


def tiled_covariance(rows: DataFrame, column: str, n: int, mean: np.ndarray, tile: int = TILE) -> np.ndarray:
    """The covariance, divisor ``n``, of a column of number arrays of one length about ``mean``."""
    dim = len(mean)
    sizes = [min(tile, dim - a) for a in range(0, dim, tile)]
    blocks = rows.select(column).mapInArrow(_column_blocks(column, mean, tile), "task long, row_block long, block int, data binary")
    dealt = blocks.repartition("task", "row_block").sortWithinPartitions("task", "row_block") if len(sizes) > 1 else blocks  # a single block has all of its row-block
    partial = dealt.mapInArrow(_products(sizes), "i int, j int, values array<double>")
    summed = partial.select("i", "j", F.posexplode("values").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    got = summed.toArrow()  # dim squared values
    out = np.zeros((dim, dim))
    i, j, at, v = (np.asarray(got.column(c).combine_chunks()) for c in range(4))
    width = np.array(sizes, dtype=np.int64)[j]
    r, c = i * tile + at // width, j * tile + at % width
    out[r, c] = v
    out[c, r] = v
    return out / n


def _project(mean: np.ndarray, basis: np.ndarray, n: int, sums: list[int], wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(sums, dtype=object if wide else np.int64)
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                x = _matrix(part.column("x"), len(mean))
                apart = (x.astype(object) if wide else x) * n - whole
                deviation = [v if v < 1 << 63 else None for v in (apart * apart).sum(axis=1).tolist()]
                z = (x - mean) @ basis
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * basis.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "z"])

    return run


def whiten(vectors: DataFrame, components: int = 32, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """(``vec_id, deviation, z array<double>``, what was measured): every sound vector on the first ``components`` unit eigenvectors, over the root of their variances.

    Measured: ``n``, ``sums``, ``covariance``, ``eigenvalues``, ``components`` (a column each), ``explained``, ``identity_error``.
    Vectors that are null or hold a null, a non-finite or an unusably large entry (2^46) take no part; of unlike lengths, those of the most frequent
    length (of equally frequent ones the longest) do. Null and repeated ids are rows like any other. Components whose variance is nothing beside the
    largest have no direction and are left out: of a single vector, or of equal ones, no component is left. ``deviation`` is null where it goes beyond
    a long. Extra columns are ignored. No vectors, no rows.
    """
    spark: SparkSession = vectors.sparkSession
    rows = C.written(sound_vectors(vectors, id_col, vector_col), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    none = spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, z array<double>")
    if not dim:
        return none, {"n": lengths[0]["count"] if lengths else 0, "explained": [], "identity_error": None}
    rows = rows.where(F.size("x") == dim)
    n, sums, least, most = totals(rows, "x", dim)
    mean = np.array([s / n for s in sums])
    covariance = tiled_covariance(rows, "x", n, mean, tile)
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST * max(values.max(), 0.0)]
    measured = {"n": n, "sums": sums, "covariance": covariance, "eigenvalues": values[order], "components": basis[:, order], "explained": (values[order] / np.trace(covariance)).tolist() if len(order) else [], "identity_error": None}
    if not len(order):
        return none, measured
    wide = sum(max((n * a - s) ** 2, (n * b - s) ** 2) for s, a, b in zip(sums, least, most)) >= 1 << 63
    schema = none.schema.simpleString()[len("struct<") : -1]
    out = C.written(rows.mapInArrow(_project(mean, basis[:, order] / np.sqrt(values[order]), n, sums, wide), schema), "whitened")
    middle = np.array(totals(out, "z", len(order))[1]) / n
    measured["identity_error"] = float(np.abs(tiled_covariance(out, "z", n, middle, tile) - np.eye(len(order))).max())
    return out, measured


def whitened_components(vectors: DataFrame, components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: ``whiten`` with a row for each vector and component, from 1."""
    out, m = whiten(vectors, components)
    explained = F.array(*map(F.lit, m["explained"])) if m["explained"] else F.array().cast("array<double>")
    each = out.select("vec_id", F.posexplode("z").alias("at", "whitened"), "deviation")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(m["n"]).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(m["identity_error"]).cast("double").alias("identity_error"))
