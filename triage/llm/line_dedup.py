"""Operator 6, line dedup by an exact set-similarity join.

A line's tokens are its distinct runs of five words (a shorter line is one token). A line goes if an
earlier line, by document id and line number, has a Jaccard similarity of 0.8 or more with it.

1. All tokens of the table are counted in a table of ``COUNTERS`` counters, which tasks fill and Spark adds
   up. Its logarithm, a list of bytes, is broadcast: tokens are ordered by the class of their
   counter and then by their hashes, so that rare ones come first, the same way for all lines.
2. Lines that are repeated very often are settled by an aggregate: all but the first go.
3. Every other line names the tokens of its prefix (one more than it may miss). Lines that share one
   meet in the bucket of the earliest of them, so that copies make one bucket and not one a token.
   A large bucket is split into blocks, each joined within itself and with the bucket's first line. Lines
   for which that finds no earlier match, few in a group of near copies, are then held against all
   other blocks.
4. Within a bucket, tokens are ordered by their rarity there; prefix, length and positional filters
   leave few pairs, whose sets are intersected. The first earlier match of a line ends its search.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C
from triage.llm.ngram_join import similar

K = 5
PERCENT = 80
#: Lines of fewer words stay; with 1, only those without a word.
LEAST_WORDS = 1
#: Repeats from which a line counts as frequent; MOST bounds their list, which is broadcast.
HOT_LINE, MOST = 50, 1 << 20
#: Counters of tokens and ranges that they are added up in; a counter's class is 0 up to BUSY and up to the mean of all, then grows with its logarithm.
COUNTERS, RANGES, BUSY = 1 << 20, 64, 64
BLOCK_LINES = 1000
#: Buckets of so few lines are compared pair by pair.
SMALL = 6


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all lines of all texts; for each line its text and its number there."""
    breaks = np.flatnonzero(raw == 0x0A) + 1
    cuts = np.unique(np.concatenate([offsets, breaks]))
    begin = np.searchsorted(cuts, offsets)  # of each text
    # a text that ends in a line break has an empty last line, and an empty text one empty line: neither has tokens
    row = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    return cuts, row, np.arange(len(cuts) - 1) - begin[row]


def line_sets(raw: np.ndarray, cuts: np.ndarray, least: int = LEAST_WORDS, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, line of each, words of each line): tokens distinct within a line, in the order of their classes and hashes."""
    words, begin = C.word_hashes(raw, cuts)
    count = np.diff(begin)
    line = np.repeat(np.arange(len(count)), count)
    runs = C.grams(words, K)
    full = np.flatnonzero(np.arange(len(runs)) + K <= begin[1:][line[: len(runs)]]) if len(runs) else np.zeros(0, np.int64)
    tokens, where = [runs[full]], [line[full]]
    for n in range(least, K):
        short = np.flatnonzero(count == n)
        if len(short):
            tokens.append(C.grams(words, n)[begin[:-1][short]])
            where.append(short)
    tok, at = np.concatenate(tokens), np.concatenate(where)
    order = np.argsort(_by_line(tok, at, classes))
    tok, at = tok[order], at[order]
    new = np.ones(len(tok), dtype=bool)
    new[1:] = (tok[1:] != tok[:-1]) | (at[1:] != at[:-1])
    return tok[new], at[new], count


def counter(tok: np.ndarray) -> np.ndarray:
    return (tok >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _by_line(tok: np.ndarray, at: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """One sort key of line, class of the token's counter (under 64), and the leading bits of its hash: the same order of tokens whatever the number of lines."""
    wide = np.uint64(int(at.max()).bit_length() + 1 if len(at) else 1)
    key = at.astype(np.uint64) << (np.uint64(64) - wide)
    rest = tok >> (wide + np.uint64(6))
    return key | rest if classes is None else key | (classes[counter(tok)].astype(np.uint64) << (np.uint64(58) - wide)) | rest


def classes_of(counts: np.ndarray) -> np.ndarray:
    """The class of each counter."""
    floor = max(BUSY, int(counts.sum()) // COUNTERS)
    return np.where(counts > floor, 1 + np.floor(np.log2(np.maximum(counts, 1) / floor)), 0).clip(0, 63).astype(np.uint8)


def _signatures(tok: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.bincount(at, minlength=n)
    begin = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        one = np.concatenate([[np.uint64(0)], np.cumsum(tok, dtype=np.uint64)])
        two = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(tok ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return size, one[begin[1:]] - one[begin[:-1]], two[begin[1:]] - two[begin[:-1]]


_DIGEST = "doc_id long, line long, n long, sig1 long, sig2 long, counts binary"


def _digest(least: int) -> object:
    """Lines with tokens as (doc_id, line, n, sig1, sig2); texts as (doc_id, -2, lines, 0, 0); at the end of a task its counters, by ranges, as (null, -1, range, salt, 0, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = [f.split()[0] for f in _DIGEST.split(", ")], np.zeros(COUNTERS, dtype=np.int64)
        for whole in batches:
            for batch in C.slices(whole, "text"):
                raw, offsets = C.text_buffer(batch.column("text"))
                cuts, row, number = lines_of(raw, offsets)
                tok, at, _ = line_sets(raw, cuts, least)
                counts += np.bincount(counter(tok), minlength=COUNTERS)
                size, one, two = _signatures(tok, at, len(row))
                ids = batch.column("doc_id")
                has = np.flatnonzero(size)
                total = np.where(batch.column("text").is_valid().to_numpy(zero_copy_only=False), np.bincount(np.searchsorted(offsets, np.flatnonzero(raw == 0x0A), side="right") - 1, minlength=len(batch)) + 1, 0)
                t = np.zeros(len(batch), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.take(pa.array(row[has])), ids]),
                        pa.array(np.concatenate([number[has], t - 2]), pa.int64()),
                        pa.array(np.concatenate([size[has], total]).astype(np.int64)),
                        pa.array(np.concatenate([one[has].view(np.int64), t])),
                        pa.array(np.concatenate([two[has].view(np.int64), t])),
                        pa.nulls(len(has) + len(batch), pa.binary()),
                    ],
                    names=names,
                )
        if counts.any():
            salt, own = TaskContext.get().partitionId() % RANGES, counts.reshape(RANGES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(RANGES, pa.int64()), pa.array([-1] * RANGES), pa.array(range(RANGES)), pa.array([salt] * RANGES), pa.array([0] * RANGES), pa.array([_packed(c) for c in own], pa.binary())], names=names)

    return run


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * (COUNTERS // RANGES), "zstd", asbytes=True), "<i8")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, salt) -> one for each with the sums of their counts."""
    key, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([_packed(total)], pa.binary())], names=["range", "salt", "counts"])
    for batch in batches:
        for r, s, data in zip(*(batch.column(c).to_pylist() for c in ("range", "salt", "counts"))):
            if key != (r, s):
                if key:
                    yield row()
                key, total = (r, s), np.zeros(COUNTERS // RANGES, dtype=np.int64)
            total = total + _unpacked(data)
    if key:
        yield row()


def count_tokens(parts: DataFrame) -> np.ndarray:
    """The counters of all tasks (``range, salt, counts``) added up, first by range and salt, then by range, so that no task adds up those of all tasks."""
    add = lambda df: df.repartition("range", "salt").sortWithinPartitions("range", "salt").mapInArrow(_add, "range long, salt long, counts binary")
    out = np.zeros((RANGES, COUNTERS // RANGES), dtype=np.int64)
    for r in add(add(parts).withColumn("salt", F.lit(0).cast("long"))).collect():  # RANGES rows
        out[r["range"]] = _unpacked(r["counts"])
    return out.ravel()


def _isin(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def _keys(hot, least: int) -> object:
    """Prefix tokens of all lines but later copies of very frequent ones: (token, doc_id, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, sigs, first = hot.value
        for whole in batches:
            for batch in C.slices(whole, "text"):
                raw, offsets = C.text_buffer(batch.column("text"))
                cuts, row, number = lines_of(raw, offsets)
                tok, at, _ = line_sets(raw, cuts, least, classes)
                size, one, two = _signatures(tok, at, len(row))
                doc = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)[row]
                known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[row]
                both = C.mix(one ^ C.mix(two + size.astype(np.uint64)))
                often = _isin(sigs, both)
                if often.any():
                    own = first[np.searchsorted(sigs, both[often])]
                    often[often] = (own[:, 0] != doc[often]) | (own[:, 1] != number[often])
                keep = known & ~often
                begin = np.cumsum(size) - size
                prefix = size - (PERCENT * size + 99) // 100 + 1
                pick = keep[at] & (np.arange(len(tok)) - begin[at] < prefix[at])
                at = at[pick]
                yield pa.RecordBatch.from_arrays([pa.array(tok[pick].view(np.int64)), pa.array(doc[at]), pa.array(number[at])], names=["token", "doc_id", "line"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, doc_id, line) -> (pivot_doc, pivot_line, doc_id, line) for tokens of two lines or more."""
    last, seen = None, None  # the last row; the first line of its token
    for batch in batches:
        tok, doc, line = (np.asarray(batch.column(c)) for c in ("token", "doc_id", "line"))
        if not len(tok):
            continue
        start = np.ones(len(tok), dtype=bool)
        start[1:] = tok[1:] != tok[:-1]
        start[0] = last is None or last != tok[0]
        head = np.maximum.accumulate(np.where(start, np.arange(len(tok)), -1))
        pd_, pl_ = doc[np.maximum(head, 0)], line[np.maximum(head, 0)]
        if seen is not None:
            pd_, pl_ = np.where(head < 0, seen[0], pd_), np.where(head < 0, seen[1], pl_)
        follow = ~start & ((pd_ != doc) | (pl_ != line))
        at = np.flatnonzero(follow)
        lead = at[np.unique(head[at], return_index=True)[1]]  # pivots go along, once for a token
        rows = np.concatenate([np.stack([pd_[at], pl_[at], doc[at], line[at]], axis=1), np.stack([pd_[lead], pl_[lead], pd_[lead], pl_[lead]], axis=1)])
        rows = np.unique(rows, axis=0) if len(rows) else rows
        last, seen = tok[-1], (pd_[-1], pl_[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i]), pa.int64()) for i in range(4)], names=["pivot_doc", "pivot_line", "doc_id", "line"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places array<struct<line, pivot_doc, pivot_line, bi, bj, asked>>) -> a row for each place with the line's text."""
    for batch in batches:
        out: dict[str, list] = defaultdict(list)
        for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
            lines = text.split("\n") if text else []
            for p in places:
                if p["line"] < len(lines):
                    for c in ("pivot_doc", "pivot_line", "bi", "bj", "asked", "line"):
                        out[c].append(p[c])
                    out["doc_id"].append(doc)
                    out["text"].append(lines[p["line"]])
        names = ["pivot_doc", "pivot_line", "bi", "bj", "asked", "doc_id", "line", "text"]
        kinds = {"text": pa.string(), "bi": pa.int32(), "bj": pa.int32(), "asked": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.int64())) for c in names], names=names)


def later_matches(order: list[tuple[int, int]], sets: list[np.ndarray], asked: set[tuple[int, int]] | None = None, percent: int = PERCENT) -> set[tuple[int, int]]:
    """Which lines of a bucket have an earlier one with the wanted similarity; ``asked``: of these only."""
    if len(sets) <= SMALL:
        by = sorted(range(len(sets)), key=order.__getitem__)
        return {order[y] for k, y in enumerate(by) if (asked is None or order[y] in asked) and any(order[x] != order[y] and similar(sets[x], sets[y], percent) for x in by[:k])}
    rank = Counter(t for s in sets for t in s.tolist())
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    gone: set[tuple[int, int]] = set()
    for y in sorted(range(len(sets)), key=order.__getitem__):
        own, n = sorted(sets[y].tolist(), key=lambda t: (rank[t], t)), len(sets[y])
        prefix, tried = own[: n - (percent * n + 99) // 100 + 1], set()
        for j, t in enumerate(prefix if asked is None or order[y] in asked else ()):
            for x, i in index[t]:
                m = len(sets[x])
                if x in tried or order[x] == order[y]:
                    continue
                tried.add(x)  # t is the first token in common, so min(m - i, n - j) bounds what they share
                if 100 * min(m, n) < percent * max(m, n) or (100 + percent) * min(m - i, n - j) < percent * (m + n):
                    continue
                if similar(sets[x], sets[y], percent):
                    gone.add(order[y])
                    break
            if order[y] in gone:
                break
        for j, t in enumerate(prefix):
            index[t].append((y, j))
    return gone


_FOUND = "doc_id long, line long, pivot_doc long, pivot_line long"


def _bucket_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (pivot, bi, bj) -> lines with an earlier match; of the blocks of a large bucket (bj = -1) also, with the pivot's place, the lines without one."""

    def answer(key: tuple, order: list[tuple[int, int]], asked: set[tuple[int, int]], sets: list[np.ndarray]) -> list[tuple]:
        gone = later_matches(order, sets, None if key[3] < 0 else asked)
        rest = set(order) - gone - {key[:2]} if key[3] == -1 else ()
        return [(*x, None, None) for x in gone] + [(*x, *key[:2]) for x in rest]

    last, order, asked, sets, out = None, [], set(), [], []
    for whole in batches:
        for batch in C.slices(whole, "text"):
            got = C.shingle_sets(*C.text_buffer(batch.column("text")), K)
            keys = zip(*(batch.column(c).to_pylist() for c in ("pivot_doc", "pivot_line", "bi", "bj")))
            for key, doc, line, ask, s in zip(keys, *(batch.column(c).to_pylist() for c in ("doc_id", "line", "asked")), got):
                if key != last:
                    out += answer(last, order, asked, sets) if last else []
                    last, order, asked, sets = key, [], set(), []
                order.append((doc, line))
                sets.append(s)
                if ask:
                    asked.add((doc, line))
    out += answer(last, order, asked, sets) if last else []
    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], names=[f.split()[0] for f in _FOUND.split(", ")])


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, line)`` of every line to remove, lines counted from 0; and ``(doc_id, n_lines)`` of every document.

    Lines of documents without an id are neither removed nor matched. Rows that share an id count as one
    document delivered again: a line number removed in one goes in all. Lines of under ``least_words`` words stay.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = C.written(own.mapInArrow(_digest(least_words), _DIGEST), "lines")
    classes = classes_of(count_tokens(digest.where("line = -1").select(F.col("n").alias("range"), F.col("sig1").alias("salt"), "counts")))
    lines = digest.where("line >= 0 and doc_id is not null")
    copies = C.written(lines.groupBy("sig1", "sig2", "n").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "line")).alias("first")).where(F.col("copies") > HOT_LINE), "copies")
    most = max(HOT_LINE, (lines.count() // MOST))
    hot_lines = copies.where(F.col("copies") > most).select("sig1", "sig2", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line")).toArrow()
    a, b, n, d, k = (np.asarray(hot_lines.column(i).combine_chunks()) if hot_lines.num_rows else np.zeros(0, np.int64) for i in range(5))
    with np.errstate(over="ignore"):
        sig = C.mix(a.view(np.uint64) ^ C.mix(b.view(np.uint64) + n.astype(np.uint64)))
    by = np.argsort(sig)
    hot = spark.sparkContext.broadcast((classes, sig[by], np.stack([d, k], axis=1)[by]))

    repeats = copies.where(F.col("copies") > most)
    often = lines.join(F.broadcast(repeats), ["sig1", "sig2", "n"]).where("doc_id <> first.doc_id or line <> first.line").select("doc_id", "line")

    keys = own.where("doc_id is not null").mapInArrow(_keys(hot, least_words), "token long, doc_id long, line long")
    met = keys.repartition("token").sortWithinPartitions("token", "doc_id", "line").mapInArrow(_meet, "pivot_doc long, pivot_line long, doc_id long, line long")
    members = C.written(met.distinct(), "members")
    pivot = ["pivot_doc", "pivot_line"]
    blocks = F.ceil(F.count("*") / BLOCK_LINES).cast("int")
    large = C.written(members.groupBy(*pivot).agg(blocks.alias("blocks")).where("blocks > 1"), "large")  # a table, so that Spark knows how few they are
    dealt = members.join(large, pivot, "left").withColumn("bi", F.pmod(F.xxhash64("doc_id", "line"), F.coalesce("blocks", F.lit(1))).cast("int"))
    first = (F.col("doc_id") == F.col("pivot_doc")) & (F.col("line") == F.col("pivot_line")) & F.col("blocks").isNotNull()
    every = F.when(first, F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array("bi"))
    places = dealt.withColumn("bi", F.explode(every)).withColumns({"bj": F.when(F.col("blocks").isNull(), -2).otherwise(-1), "asked": F.lit(True)})

    def join(places: DataFrame) -> DataFrame:
        by_doc = places.select("doc_id", F.struct("line", *pivot, "bi", "bj", "asked").alias("place")).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
        texts = by_doc.hint("merge").join(own, "doc_id").select("doc_id", "text", "places").mapInArrow(_texts, "pivot_doc long, pivot_line long, bi int, bj int, asked boolean, doc_id long, line long, text string")
        return texts.repartition(*pivot, "bi", "bj").sortWithinPartitions(*pivot, "bi", "bj").mapInArrow(_bucket_join, _FOUND)

    found = C.written(join(places), "found")
    rest = found.where("pivot_doc is not null").join(found.where("pivot_doc is null").select("doc_id", "line").distinct(), ["doc_id", "line"], "left_anti").distinct()
    gone = [often, found.where("pivot_doc is null").select("doc_id", "line")]
    if rest.limit(1).count():
        chunks = rest.groupBy(*pivot).agg(F.ceil(F.count("*") / BLOCK_LINES).cast("int").alias("chunks"))
        pairs = large.join(chunks, pivot)
        asked = rest.join(pairs, pivot).select(*pivot, "doc_id", "line", F.pmod(F.xxhash64("doc_id", "line", F.lit(1)), F.col("chunks")).cast("int").alias("bi"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bj"), F.lit(True).alias("asked"))
        others = dealt.drop("blocks").withColumnRenamed("bi", "bj").join(pairs, pivot).select(*pivot, "doc_id", "line", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("bi"), "bj", F.lit(False).alias("asked"))
        gone.append(join(C.written(asked.unionByName(others), "rest")).select("doc_id", "line"))
    removed = gone[0]
    for more in gone[1:]:
        removed = removed.union(more)
    removed = C.written(removed.distinct(), "removed")
    counts = digest.where("line = -2").select("doc_id", F.col("n").alias("n_lines"))
    return removed, counts


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed_lines`` (numbers from 0, in order), one row per document; a null text has no lines."""
    removed, counts = removed_lines(docs, id_col, text_col)
    by_doc = removed.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    out = counts.join(by_doc, "doc_id", "left").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with all its columns and the remaining lines of each text; documents that lose all their lines go."""
    removed, _ = removed_lines(docs, id_col, text_col, least_words)
    by_doc = removed.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__gone"))
    text = F.col(f"`{text_col}`")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i.cast("long")))
    joined = docs.join(by_doc.hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col("__id"), "left").withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    joined = joined.where("__gone is null or size(__kept) > 0")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), text).otherwise(F.array_join("__kept", "\n"))).select(*docs.columns)
