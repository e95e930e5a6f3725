"""Operator 2, language-model scores from a log-frequency Bloom filter.

1. Texts become slices of token hashes, written once to the shared folder.
2. Each slice sends its distinct words and word pairs, with their counts in training texts, cut by the
   leading bits of their hashes. Whoever has such a block sums its counts, quantises them to levels and
   puts an n-gram of level q into the block's filter as the items 1 to q. From there on only the
   filter is asked: a level is found by probing for 1, 2, ... until one is missing.
3. While the filter and the words' counts can't have more than ``BROADCAST`` bytes, by what the slices say of themselves, all blocks are broadcast, packed
   as they are probed, and slices probe them where they are. Beyond, the slices' n-grams are already with their blocks, which
   probe for them and send levels back. The filter grows with the corpus either way, holds every
   n-gram, and scores are the same.

P(w | v) = a F(v w) / D(v) + (1 - a) P(w). F is the least count of the pair's level; D(v) the most of v's
level with room for what false positives add: all V words together bring about V * f pairs after any v
that were never seen, f the chance that the probes of level 1 are all set. There are the more of them the
more blocks there are, so V * f stays small. a grows with the count of v. P(w) is the middle of w's level
(0.5 more) over the sum for all words and one that is unknown. The sum over w stays under one.

The base score takes exact counts, which the owner of a word's block knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

BASE = 2.0**0.5
#: Probes for level 1, to which the bits of a block's number are added, and for each further level.
FIRST, FURTHER = 12, 4
#: Bits that probes of one n-gram spread over.
SUB_BITS = 1 << 16
#: Tokens for each block of n-grams; most bytes that are broadcast; bytes of text in a slice.
PER_BLOCK, BROADCAST, SLICE = 3_000_000, 64 << 20, 4 << 20
#: Added to a word's count before pairs after it count as much as words.
PRIOR = 300.0
END = np.uint64(0x1D8E4E27C47D124F)
START = np.uint64(0x9F3A5C6B7D2E8141)

_FLOOR = np.unique(np.ceil(BASE ** np.arange(124) - 1e-9))  # least count of level j + 1
LEVELS = len(_FLOOR)
_TOP = np.concatenate([_FLOOR[1:] - 1, [np.inf]])  # most
_MIDDLE = np.concatenate([[0.0], np.sqrt(_FLOOR[:-1] * _TOP[:-1]), [_FLOOR[-1]]])


def level(count: np.ndarray) -> np.ndarray:
    """The quantised count: how many levels' least counts it reaches."""
    return np.searchsorted(_FLOOR, count, side="right")


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end after each text; where each text begins (n + 1 values)."""
    words, begin = C.word_hashes(raw, offsets)
    n = len(offsets) - 1
    out = np.empty(len(words) + n, dtype=np.uint64)
    text = np.repeat(np.arange(n), np.diff(begin))
    out[np.arange(len(words)) + text] = words
    begin = begin + np.arange(n + 1)
    out[begin[1:] - 1] = END
    return out, begin


def pairs(tok: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[begin[:-1]] = START
    with np.errstate(over="ignore"):
        return C.mix(before * np.uint64(0x9E3779B97F4A7C15) + tok)


# --- the filter -----------------------------------------------------------------------------------


class LogFrequencyFilter:
    """The filter of one block, n-grams whose hashes share ``lead`` leading bits. Half its bits are set."""

    def __init__(self, lead: int, set_bits: int, packed: np.ndarray | None = None):
        size = int(set_bits / np.log(2)) + 1
        self.lead, self.first, self.set_bits = lead, FIRST + lead, set_bits
        self.width = min(SUB_BITS, 1 << max(6, (size - 1).bit_length()))
        self.subs = -(-size // self.width)
        self.packed = packed
        self.flags = np.zeros(self.subs * self.width, dtype=bool) if packed is None else None

    def _held(self, place: np.ndarray) -> np.ndarray:
        """Whether the bits at these places are set."""
        if self.packed is None:
            return self.flags[place]
        return (self.packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)

    @classmethod
    def of(cls, lead: int, hashes: np.ndarray, levels: np.ndarray) -> LogFrequencyFilter:
        found = cls(lead, int((levels > 0).sum()) * (FIRST + lead) + int(np.maximum(levels - 1, 0).sum()) * FURTHER)
        live, j = np.flatnonzero(levels > 0), 1
        while len(live):
            at, a, step = found._start(hashes[live], j)
            for _ in range(found.first if j == 1 else FURTHER):
                found.flags[at + (a & np.uint64(found.width - 1)).astype(np.int64)] = True
                a += step
            j += 1
            live = live[levels[live] >= j]
        return found

    def _start(self, hashes: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            sub = ((hashes << np.uint64(self.lead)) >> np.uint64(32)) * np.uint64(self.subs) >> np.uint64(32)
            h = C.mix(hashes + np.uint64(j) * np.uint64(0xA24BAED4963EE407))
        return sub.astype(np.int64) * self.width, h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it isn't held: probes for 1, 2, ... up to the first that is missing."""
        found, live, j = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes)), 1
        while len(live) and j <= LEVELS:
            at, a, step = self._start(hashes[live], j)
            for _ in range(self.first if j == 1 else FURTHER):
                held = self._held(at + (a & np.uint64(self.width - 1)).astype(np.int64))
                live, at, a, step = live[held], at[held], a[held], step[held]
                a = a + step
            found[live] = j
            j += 1
        return found

    def chances(self) -> tuple[float, float]:
        """How likely the probes of level 1, and of a further level, are all set for an n-gram that was never put in."""
        fill = self.flags.reshape(self.subs, self.width).mean(axis=1)
        return float((fill**self.first).mean()), float((fill**FURTHER).mean())


class Probabilities:
    """What scoring knows besides levels; every number is a sum over all blocks."""

    def __init__(self, texts: int, by_level: np.ndarray, chances: tuple[float, float]):
        """``by_level``: training words of each level; ``chances``: means over all blocks of pairs."""
        steps = np.diff(_FLOOR[:12], prepend=0.0)
        up = chances[1] ** np.arange(12)
        false = int(by_level.sum()) * chances[0] * float((steps * up).sum())
        #: Room for pairs never seen, four deviations included, and for counts a level too high.
        self.false = false + 4 * false**0.5 + 4
        self.high = 1 + max(float((np.diff(_FLOOR[q : q + 12]) * up[1:12]).sum() / _FLOOR[q]) for q in range(20))
        self.prior = PRIOR
        self.texts, self.mass = max(texts, 1), self.high * float((by_level * _MIDDLE).sum()) + 0.5 * (int(by_level.sum()) + 1)

    def of(self, word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """P from the levels of a word, of the one before it (-1: the start of a text), and of the pair."""
        top = np.where(before < 0, float(self.texts), _TOP[np.maximum(before, 1) - 1])
        top = np.minimum(top, 1e18)
        share = np.where(before == 0, 0.0, top / (top + self.false + self.prior))
        seen = np.where(pair > 0, _FLOOR[np.maximum(pair, 1) - 1] / (self.high * top + self.false), 0.0)
        return share * np.minimum(seen, 1.0) + (1 - share) * (_MIDDLE[word] + 0.5) / self.mass


# --- the Spark job --------------------------------------------------------------------------------

_SLICES = "slice long, doc_id array<long>, held array<boolean>, n long, begin binary, token binary, at binary"


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> a row a slice: its documents, where each begins, the distinct tokens, and which of them stands where."""
    part, k = TaskContext.get().partitionId(), 0
    for whole in batches:
        for batch in C.slices(whole, "text", SLICE):
            tok, begin = tokens(*C.text_buffer(batch.column("text")))
            distinct, at = np.unique(tok, return_inverse=True)
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | k]),
                    one(batch.column("doc_id")),
                    one(batch.column("held_out")),
                    pa.array([len(tok)]),
                    pa.array([begin.astype("<i8").tobytes()], pa.binary()),
                    pa.array([distinct.tobytes()], pa.binary()),
                    pa.array([pa.compress(at.astype("<u4").tobytes(), "zstd", asbytes=True)], pa.binary()),
                ],
                names=["slice", "doc_id", "held", "n", "begin", "token", "at"],
            )
            k += 1


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(slice, doc_id, held, begin, distinct tokens, which stands where) of each row."""
    for batch in batches:
        for r in range(len(batch)):
            row = {c: batch.column(c)[r] for c in ("slice", "doc_id", "held", "n", "begin", "token", "at")}
            yield (
                row["slice"].as_py(), row["doc_id"].values, np.asarray(row["held"].values.to_numpy(zero_copy_only=False), dtype=bool), np.frombuffer(row["begin"].as_py(), "<i8"),
                np.frombuffer(row["token"].as_py(), "<u8"), np.frombuffer(pa.decompress(row["at"].as_py(), 4 * row["n"].as_py(), "zstd", asbytes=True), "<u4"),
            )


def _gaps(hashes: np.ndarray) -> bytes:
    """Sorted hashes as gaps, byte by byte: the leading bytes are all zero and compress away."""
    return np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _ungapped(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64)


_PARTS = "block int, kind int, slice long, hashes binary, at binary, n binary"


def _parts(lead: int, learnt_only: bool) -> object:
    """Distinct words (kind 1) and pairs (kind 2) of each slice, cut by leading bits; counts in training texts where they aren't 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, held, begin, token, at in _opened(batches):
            learn = np.repeat(~held, np.diff(begin))
            pair, back = np.unique(pairs(token[at], begin), return_inverse=True)
            rows = []
            for kind, hashes, where in ((1, token, at), (2, pair, back)):
                n = np.bincount(where[learn], minlength=len(hashes))
                if learnt_only:
                    hashes, n = hashes[n > 0], n[n > 0]
                block = hashes >> np.uint64(64 - lead)
                first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
                for x, y in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
                    other = np.flatnonzero(n[x:y] != 1)
                    rows.append((int(block[x]), kind, number, _gaps(hashes[x:y]), other.astype("<u4").tobytes(), n[x:y][other].astype("<u4").tobytes()))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "kind", "slice", "hashes", "at", "n"])

    return run


_ANSWERS = "slice long, kind int, block int, a binary, b binary, set_bits long, total long, by_level array<long>, chance double, further double"


def _answers(lead: int, broadcast: bool) -> object:
    """Rows sorted by (block, kind) -> what each slice asked: levels ``a`` and, of words, counts ``b``; one row without a slice for each
    block, with its sums and, if the filter is to be broadcast, the bits ``a`` and the words and counts ``b``."""

    def answer(block: int, kind: int, parts: list) -> pa.RecordBatch:
        asked = [_ungapped(p[1]) for p in parts]
        n = [np.ones(len(h), dtype=np.int64) for h in asked]
        for c, p in zip(n, parts):
            c[np.frombuffer(p[2], "<u4")] = np.frombuffer(p[3], "<u4")
        seen, back = np.unique(np.concatenate(asked), return_inverse=True)
        order = np.argsort(back, kind="stable")
        count = np.add.reduceat(np.concatenate(n)[order], np.searchsorted(back[order], np.arange(len(seen))))
        known = count > 0
        bloom = LogFrequencyFilter.of(lead, seen[known], level(count[known]))
        chance, further = bloom.chances()
        by_level = np.bincount(level(count[known]), minlength=LEVELS + 1).tolist()
        bits = np.packbits(bloom.flags).tobytes() if broadcast else None
        words = seen[known].tobytes() + count[known].astype("<i8").tobytes() if broadcast and kind == 1 else None
        rows = [(None, kind, block, bits, words, bloom.set_bits, int(count.sum()), by_level, chance, further)]
        if not broadcast:
            q, at = bloom.levels(seen).astype(np.uint8), 0
            for p, h in zip(parts, asked):
                own = back[at : at + len(h)]
                at += len(h)
                rows.append((p[0], kind, block, q[own].tobytes(), count[own].astype("<i8").tobytes() if kind == 1 else None, None, None, None, None, None))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _ANSWERS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            for block, kind, *part in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "slice", "hashes", "at", "n"))):
                if (block, kind) != last:
                    if parts:
                        yield answer(*last, parts)
                    last, parts = (block, kind), []
                parts.append(part)
        if parts:
            yield answer(*last, parts)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(doc_id: pa.Array, held: np.ndarray, begin: np.ndarray, at: np.ndarray, count: np.ndarray, q1: np.ndarray, q2: np.ndarray, model: Probabilities, whole: float) -> pa.RecordBatch:
    """``count``, ``q1``: of the slice's distinct tokens; ``at``: which stands where; ``q2``: of the pair that ends there."""
    n = np.diff(begin)
    text = np.repeat(np.arange(len(n)), n)
    word = q1[at]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[begin[:-1]] = -1
    logp = np.log10(model.of(word, before, q2))
    base = np.log10((count + 0.5) / whole)[at]
    total = lambda x: np.bincount(text, weights=x, minlength=len(n))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(held), pa.array(n.astype(np.int64)), pa.array(total(count[at] > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(logp))], names=[f.split()[0] for f in _SCORES.split(", ")])


def _score_here(shared, lead: int) -> object:
    """Slices -> scores by the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, whole, filters, words, counts = shared.value
        blooms = {key: LogFrequencyFilter(lead, set_bits, np.frombuffer(bits, np.uint8)) for key, (set_bits, bits) in filters.items()}

        def levels(kind: int, hashes: np.ndarray) -> np.ndarray:
            found, block = np.zeros(len(hashes), dtype=np.int64), (hashes >> np.uint64(64 - lead)).astype(np.int64)
            for b in np.unique(block).tolist():
                if (b, kind) in blooms:
                    found[block == b] = blooms[(b, kind)].levels(hashes[block == b])
            return found

        for _, doc_id, held, begin, token, at in _opened(batches):
            place = np.minimum(np.searchsorted(words, token), max(len(words) - 1, 0))
            count = np.where(words[place] == token, counts[place], 0) if len(words) else np.zeros(len(token), np.int64)
            pair, back = np.unique(pairs(token[at], begin), return_inverse=True)
            yield _scored(doc_id, held, begin, at, count, levels(1, token), levels(2, pair)[back], model, whole)

    return run


def _score_answered(shared) -> object:
    """Rows sorted by (slice, kind, block), each slice's own first -> scores."""

    def scores(own: tuple, parts: list) -> pa.RecordBatch:
        model, whole = shared.value
        _, doc_id, held, begin, token, at = own
        joined = lambda kind, k, t: np.frombuffer(b"".join(p[k] for p in parts if p[0] == kind), t)
        _, back = np.unique(pairs(token[at], begin), return_inverse=True)
        return _scored(doc_id, held, begin, at, joined(1, 2, "<i8"), joined(1, 1, np.uint8).astype(np.int64), joined(2, 1, np.uint8)[back].astype(np.int64), model, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for r, kind in enumerate(kinds):
                if kind == 0:
                    if own is not None:
                        yield scores(own, parts)
                    own, parts = next(_opened(iter([batch.slice(r, 1)]))), []
                else:
                    parts.append((kind, batch.column("a")[r].as_py(), batch.column("b")[r].as_py()))
        if own is not None:
            yield scores(own, parts)

    return run


def most_bytes(size: int, words: float, lead: int) -> float:
    """The most that the filter and the words' counts can take: ``size`` tokens, each the end of a pair, and ``words``, the sum of the distinct tokens of all slices."""
    bits = (FIRST + lead) / np.log(2)  # an n-gram that is there twice has less than two that are there once
    return (size + words) * bits / 8 + words * 16


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per document.

    Learns from documents whose crc32(id) mod 5 isn't 1. A null text is an empty one, a single end. Null
    ids and repeated rows are documents like any other. Without training texts every word is unknown.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.pmod(C.id_crc32("doc_id"), F.lit(5)) == 1
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held)
    slices = C.written(own.mapInArrow(_slice, _SLICES), "tokens")
    size, words, texts = slices.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("token") / 8), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()
    lead = max(4, int(size // PER_BLOCK).bit_length())
    few = most_bytes(size, words, lead) <= BROADCAST
    parts = slices.mapInArrow(_parts(lead, few), _PARTS)
    answers = C.written(parts.repartition("block", "kind").sortWithinPartitions("block", "kind").mapInArrow(_answers(lead, few), _ANSWERS), "answers")

    sums = answers.where("slice is null")
    by_level = np.zeros(LEVELS + 1, dtype=np.int64)
    for r in sums.where("kind = 1").select(F.posexplode("by_level")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        by_level[r["pos"]] = r["n"]
    total = sums.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    chances = sums.where("kind = 2").agg(F.coalesce(F.avg("chance"), F.lit(0.0)), F.coalesce(F.avg("further"), F.lit(0.0))).first()
    model, whole = Probabilities(texts, by_level, tuple(chances)), total + 0.5 * (int(by_level.sum()) + 1)
    if few:
        got = sums.collect()  # BROADCAST bytes at most
        lists = sorted((r["block"], r["b"]) for r in got if r["kind"] == 1)
        split = [(np.frombuffer(b, "<u8", len(b) // 16), np.frombuffer(b, "<i8", len(b) // 16, len(b) // 2)) for _, b in lists]
        words, counts = (np.concatenate(x) if split else np.zeros(0, np.int64) for x in (zip(*split) if split else ((), ())))
        filters = {(r["block"], r["kind"]): (r["set_bits"], bytes(r["a"])) for r in got}
        out = slices.mapInArrow(_score_here(spark.sparkContext.broadcast((model, whole, filters, words, counts)), lead), _SCORES)
    else:
        none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
        mine = slices.select("slice", F.lit(0).alias("kind"), F.lit(0).alias("block"), "doc_id", "held", "n", "begin", "token", "at", *none(("a", "binary"), ("b", "binary")))
        back = answers.where("slice is not null").select("slice", "kind", "block", *none(("doc_id", "array<long>"), ("held", "array<boolean>"), ("n", "long"), ("begin", "binary"), ("token", "binary"), ("at", "binary")), "a", "b")
        order = ("slice", "kind", "block")
        out = mine.unionByName(back).repartition("slice").sortWithinPartitions(*order).mapInArrow(_score_answered(spark.sparkContext.broadcast((model, whole))), _SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
