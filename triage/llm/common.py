"""What the training-data operators share: the shared folder, written tables, hashing of whole texts.

Spark hands texts to Python tasks as Arrow batches. The helpers here read the UTF-8 buffer of such
a batch with numpy, so that no Python object is made for a word. Memory follows ``SEGMENT`` bytes
at a time, not the length of a text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.sources.shared import shared_dir

SEGMENT = 1 << 20
M64 = 0xFFFFFFFFFFFFFFFF


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and outlives lost executors.

    The folder is removed with the rest of ``spark.checkpoint.dir``; nothing else refers to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/triage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc32(column: str | Column) -> Column:
    """crc32 of an id written as text (null: of the empty text), which the folds of the contracts use."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def draw(*columns: str | Column) -> Column:
    """A hash of the columns in [0, 2^63), to be held against ``draw_limit``."""
    return F.xxhash64(*columns).bitwiseAND((1 << 63) - 1)


def draw_limit(wanted: int, rows: int) -> int:
    """Rows whose ``draw`` lies below this are about ``wanted`` of ``rows``; all rows if there are no more. Stays above 0 up to 2^63 rows for each one wanted."""
    return (1 << 63) - 1 if rows <= wanted else (wanted << 63) // rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = 0x9E6C63D0876A9A47 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words between blanks: anything but space and the five control blanks.
BLANKS = np.ones(256, dtype=bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, a-z and everything beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, SEGMENT + 4096)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64)]))
                cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _UNBASE, dtype=np.uint64)]))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if n else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and where each text's words begin (n + 1 values).

    A-Z count as a-z; ``inside`` says which bytes belong to words. Works ``SEGMENT`` bytes at a time;
    a segment ends at a byte outside words or at the end of a text.
    """
    values = np.where(inside, _random_table(17), np.uint64(0))[_LOWER]  # by raw byte; the blank bytes add nothing
    member = inside[_LOWER]
    size, out, where, pos = len(raw), [], [], 0
    while pos < size:
        end = min(size, pos + SEGMENT)
        while end < size and member[raw[end]] and member[raw[end - 1]]:  # to the end of a word
            step = raw[end : end + 4096]
            stop = np.flatnonzero(~member[step])
            end += int(stop[0]) if len(stop) else len(step)
        piece = raw[pos:end]
        word = member[piece]
        first = word.copy()
        first[1:] &= ~word[:-1]
        at = offsets[np.searchsorted(offsets, pos) : np.searchsorted(offsets, end)] - pos  # texts that begin here
        first[at] = word[at]
        starts = np.flatnonzero(first)
        if len(starts):
            _Powers.reach(len(piece))
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(values[piece] * _Powers.up[: len(piece)], starts) * _Powers.down[starts]
                out.append(mix(sums))
            where.append(starts + pos)
        pos = end
    hashes = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    begin = np.searchsorted(np.concatenate(where) if where else np.zeros(0, dtype=np.int64), offsets)
    return hashes, begin


_SPREAD = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one array (they may cross texts; the caller leaves those out)."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        acc = np.full(n, k * 0x2545F4914F6CDD1D & M64, dtype=np.uint64)
        for i in range(k):
            acc = mix(acc + words[i : i + n] * np.uint64(_SPREAD[i % 5])) if i % 5 == 4 else acc * np.uint64(3) + words[i : i + n] * np.uint64(_SPREAD[i % 5])
        return mix(acc)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; of all its words if it has fewer."""
    words, begin = word_hashes(raw, offsets)
    runs = grams(words, k)
    sets = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            sets.append(grams(words[a:b], b - a))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """The batch in parts of about ``most`` bytes of text, at least one row each: bounds the arrays made from it."""
    col = batch.column(column)
    sizes = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64) if len(col) else np.zeros(0, np.int64)
    total, begin = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > begin and total + s > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield batch.slice(begin)


def list_column(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), type=kind))
