"""Operator 1, mixture-controlled packing by deficit round-robin over source queues.

A source's queue is the stream of its documents' tokens. Sequences of 4096 tokens (``WINDOW``) are filled
one after the other: each queue is credited its share of a sequence, sends whole tokens of its credit,
and carries the rest to the next. A queue that runs dry sends what it has; the queues that are left
share the room. Only the last sequence is padded.

Round-robin needs no loop over windows. The tokens of a window are dealt down a binary tree over the
queues: of the first t tokens of a node, its left half has floor(t * left / both) and its right half the
rest. Both grow with t, so what a queue has sent after ``w`` windows never shrinks, however small its
share, and is within a token a level of the tree of its target; the place of any token follows from its
position in its queue alone. Partitions carry deficits by their place in the queues: one small table
says how many tokens of each source the partitions before hold. Documents are tokenised once; their ids
stay in a table in the shared folder.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triage.llm import common as C
from triage.llm.tokens import worker_tokenizer

SEQUENCE = 4096
WINDOW = SEQUENCE
END_ID = 2
#: Queues up to which the whole plan goes to all workers; of more, each row is joined with its own queue's.
MOST_SOURCES = 2000


class Queue:
    """Where the tokens of one queue go. ``phases``: (first window, None or the way down the tree to the queue, tokens sent before, tokens before the queue's in a single window)."""

    def __init__(self, window: int, phases: list[tuple], total: int):
        self.window, self.phases, self.total = window, phases, total
        self.starts = [p[2] for p in phases]

    @staticmethod
    def dealt(way: list[tuple[int, int, bool]], t: int) -> tuple[int, int]:
        """Of the first ``t`` tokens of all queues, those of the queues before and those of this one."""
        before = 0
        for part, whole, right in way:
            left = t * part // whole
            if right:
                before += left
                t -= left
            else:
                t = left
        return before, t

    def _window(self, way: list[tuple[int, int, bool]], x: int) -> int:
        """The window that holds token ``x`` of a phase: as many have sent no more than x tokens, and one more has."""
        sent = lambda w: self.dealt(way, w * self.window)[1]
        part, both, right = way[-1] if way else (1, 1, False)
        share, whole = both - part if right else part, way[0][1] if way else 1
        w, step = x * whole // (share * self.window), 1
        while w and sent(w) > x:
            w, step = max(0, w - step), 2 * step
        high, step = w + 1, 1
        while sent(high) <= x:
            w, high, step = high, high + step, 2 * step
        while high - w > 1:
            mid = (w + high) // 2
            w, high = (mid, high) if sent(mid) <= x else (w, mid)
        return w

    def place(self, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, sequence, offset) of each piece of the tokens [start, start + length), in order."""
        end, m = start + length, self.window
        while start < end:
            k = bisect_right(self.starts, start) - 1
            first, way, base, inside = self.phases[k]
            limit = self.starts[k + 1] if k + 1 < len(self.phases) else self.total
            x = start - base
            if way is None:
                at, stop = first * m + inside + x, limit
            else:
                w = self._window(way, x)
                (low, gone), (high, sent) = self.dealt(way, w * m), self.dealt(way, (w + 1) * m)
                at = (first + w) * m + high - low + x - gone
                stop = min(limit, base + sent)
            n = min(end, stop) - start
            start += n
            while n:
                take = min(n, SEQUENCE - at % SEQUENCE)
                yield take, at // SEQUENCE, at % SEQUENCE
                at, n = at + take, n - take


class Mixture:
    """Where the tokens of each queue go. ``totals``: tokens by queue; ``weights``: target shares in any unit."""

    def __init__(self, totals: Mapping[str, int], weights: Mapping[str, int] | None = None, window: int = WINDOW):
        self.window = window
        self.names = sorted(totals)
        self.index = {s: i for i, s in enumerate(self.names)}
        left = [totals[s] for s in self.names]
        target = [totals[s] if weights is None else weights.get(s, 0) for s in self.names]
        #: (first window, None or the sums of shares before each queue, tokens of each queue sent before, tokens before each queue in a single window)
        self.phases: list[tuple] = []
        sent, at = [0] * len(left), 0
        while any(left):
            share = [target[i] if left[i] else 0 for i in range(len(left))]
            if not any(share):
                share = [1 if n else 0 for n in left]
            before = [0, *accumulate(share)]
            whole, live = before[-1], [i for i, x in enumerate(share) if x]
            # the most windows in which no queue runs dry: what a queue sends grows with them
            steps, over = 0, 1 + min((left[i] + len(left).bit_length() + 1) * whole // (share[i] * window) for i in live)
            give = [0] * len(left)
            while over - steps > 1:
                mid = (steps + over) // 2
                trial = self._dealt(before, mid * window)
                if all(trial[i] <= left[i] for i in live):
                    steps, give = mid, trial
                else:
                    over = mid
            if steps:
                self.phases.append((at, before, list(sent), None))
            else:
                steps, give = 1, self._last_of_a_queue(left, share)
                self.phases.append((at, None, list(sent), [0, *accumulate(give)]))
            at += steps
            sent = [a + b for a, b in zip(sent, give)]
            left = [a - b for a, b in zip(left, give)]
        self.totals = sent
        self.queues: dict[str, Queue] = {}

    @staticmethod
    def _dealt(before: list[int], t: int) -> list[int]:
        """Of the first ``t`` tokens, those of each queue."""
        out, open_ = [0] * (len(before) - 1), [(0, len(before) - 1, t)]
        while open_:
            low, high, t = open_.pop()
            if high - low == 1:
                out[low] = t
            elif t:
                mid = (low + high) // 2
                part = t * (before[mid] - before[low]) // (before[high] - before[low])
                open_ += [(low, mid, part), (mid, high, t - part)]
        return out

    @staticmethod
    def _way(before: list[int], i: int) -> list[tuple[int, int, bool]]:
        way, low, high = [], 0, len(before) - 1
        while high - low > 1:
            mid = (low + high) // 2
            way.append((before[mid] - before[low], before[high] - before[low], i >= mid))
            low, high = (mid, high) if i >= mid else (low, mid)
        return way

    def queue(self, source: str) -> Queue:
        if source not in self.queues:
            i = self.index[source]
            # phases in which the queue sends nothing hold no token of it
            ends = [p[2][i] for p in self.phases[1:]] + [self.totals[i]]
            own = [(at, None if before is None else self._way(before, i), sent[i], None if inside is None else inside[i]) for (at, before, sent, inside), end in zip(self.phases, ends) if end > sent[i]]
            self.queues[source] = Queue(self.window, own, self.totals[i])
        return self.queues[source]

    def _last_of_a_queue(self, left: list[int], share: list[int]) -> list[int]:
        """One window in which a queue runs dry: it sends the rest, the others share the room by their targets."""
        give, room = [0] * len(left), self.window
        while room:
            live = [i for i in range(len(left)) if left[i] > give[i] and share[i]] or [i for i in range(len(left)) if left[i] > give[i]]
            if not live:
                break
            whole, done, free = sum(share[i] or 1 for i in live), 0, room
            for i in live:
                more = free * (done + (share[i] or 1)) // whole - free * done // whole
                done += share[i] or 1
                more = min(more, left[i] - give[i])
                give[i] += more
                room -= more
        return give

    def place(self, source: str, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, sequence, offset) of each piece of the tokens [start, start + length) of a queue, in order."""
        return self.queue(source).place(start, length)


_IDS = "doc_id long, source string, chunk int, chunk_start long, doc_tokens long, ids binary"
_PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _tokenise(path: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chunk, sent = worker_tokenizer(path, END_ID), TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in C.slices(whole, "text"):
                ids, begin = model(*C.text_buffer(batch.column("text")))
                sizes, sources, starts = np.diff(begin), batch.column("source").to_pylist(), []
                for s, n in zip(sources, sizes.tolist()):
                    starts.append(sent.get(s, 0))
                    sent[s] = starts[-1] + n
                wide = ids.astype("<u2" if model.model.get_vocab_size() <= 1 << 16 else "<u4")
                flat, at = wide.tobytes(), begin * wide.itemsize
                rows = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([chunk] * len(rows), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "source", "chunk", "chunk_start", "doc_tokens", "ids"])

    return run


def _pieces(plan, with_ids: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = None if plan is None else plan.value
        for whole in batches:
            for k in range(0, len(whole), 1000):
                batch = whole.slice(k, 1000)
                own_queues = [pickle.loads(q) for q in batch.column("queue").to_pylist()] if mixture is None else []
                out: dict[str, list] = {c: [] for c in ("row", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")}
                for r, (source, base, start, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "base", "chunk_start", "doc_tokens", "ids")))):
                    queue = own_queues[r] if mixture is None else mixture.queue(source)
                    wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                    done = 0
                    for size, sequence, offset in queue.place(base + start, n):
                        part = wide[4 * done : 4 * (done + size)]
                        for c, v in zip(out, (r, done, size, zlib.crc32(part), sequence, offset, part if with_ids else None)):
                            out[c].append(v)
                        done += size
                row = pa.array(out.pop("row"), pa.int64())
                own = {c: batch.column(c).take(row) for c in ("doc_id", "source", "doc_tokens")} | {c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()}
                names = [f.split()[0] for f in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([own[c] for c in names], names=names)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    weights: Mapping[str, int] | None = None,
    *,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces ``doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` (32-bit, little-endian).

    ``weights``: target shares by source, as whole numbers in any unit; sources not named come last. None:
    each source's share of all tokens, so that every window has the mixture of the whole table.
    A null or empty text is the end id alone. A null source is a queue of its own. Null and repeated ids
    and repeated rows are documents like any other; documents of a source are queued in the order
    of the table. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    queue = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("source"), F.col(text_col).cast("string").alias("text"))
    ids = C.written(own.mapInArrow(_tokenise(tokenizer_path), _IDS), "ids")
    held = ids.groupBy("chunk", "source").agg(F.sum("doc_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    bases = C.written(bases, "bases")
    totals = dict(bases.groupBy("source").agg(F.sum("tokens").cast("long")).collect())
    mixture = Mixture(totals, None if weights is None else {f"={s}": n for s, n in weights.items()})
    own_base = bases.select("chunk", "source", "base")
    if few := len(totals) <= MOST_SOURCES:
        plan = spark.sparkContext.broadcast(mixture)
    else:
        queues = C.written(spark.createDataFrame([(s, bytearray(pickle.dumps(mixture.queue(s)))) for s in mixture.names], "source string, queue binary"), "queues")
        own_base = own_base.join(queues, "source")
    placed = ids.join(own_base, ["chunk", "source"]).mapInArrow(_pieces(plan if few else None, with_ids), _PIECES)
    return placed.withColumn("source", F.when(F.col("source") != "null", F.expr("substring(source, 2)")))
