"""Operator 10, n-gram Jaccard join: signature trees over buckets of documents that share a rare shingle.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes). Equal sets are one vertex
   from here on, so exact copies never make pairs.
2. Each set names a few of its shingles, in the order of their hashes, as keys. Two sets with a
   similarity of 0.8 share one of them: with up to 115 shingles by the prefix rule, beyond that because
   each of the first ``KEYS`` shingles of the union lies in both sets with probability 0.8 or more,
   so that no shared key has a probability under 1e-12, below that of a hash collision. With ``exact``
   the prefix rule holds for all sets, at the price of a fifth of a set's shingles as its keys.
   Shingles of very many sets (licence text and the like) are counted over all sets and come last.
3. All sets that share a key meet in the bucket of the smallest id that has the key. Copies of one text
   share nearly all keys, so they make one bucket and not one for each key. A large bucket is split
   into blocks, each joined within itself and with the bucket's first set. Sets that a block doesn't
   connect with the first one, few where a bucket is a group of near copies, then meet all other blocks.
4. In each bucket a signature tree is built: nodes hold the OR of their sets' bitmaps, the range of
   their sizes and the largest number of shingles that share a bit. Two nodes are descended into only
   if their largest possible overlap can reach the threshold and they aren't known to be connected.
   At the leaves the sets themselves are intersected, so every link is exact.
5. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage.llm import common as C
from triage.llm.components import components

K = 5
PERCENT = 80
KEYS, ZONE = 24, 48
#: Sets of so many shingles have a prefix of KEYS at most, and keep all of them for the choice of keys.
WHOLE = 115
#: A key of more sets than this is passed over; MOST_HOT bounds the list of such keys, which is broadcast.
LEAST_HOT, MOST_HOT = 200, 1 << 20
#: Bounds of a block of a bucket: sets, and shingles in all.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
LEAF, FAN = 16, 8


# --- the signature tree -------------------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the Jaccard similarity of two sorted distinct arrays reaches the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """Nodes of level 0 are sets, of level 1 leaves with LEAF sets, above that FAN nodes each."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, part: list[int] | None = None):
        """``part``: a label for each set; sets of one label are known to be connected."""
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.percent, self.order, self.sets = percent, order, [sets[i] for i in order]
        sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        width = 256
        while width < min(2 * int(sizes.max()), 8192):
            width *= 2
        bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
        for row, s in zip(bits, self.sets):
            at = np.unique(s & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        extra = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels) == 1 or len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), LEAF if len(self.levels) == 1 else FAN)
            b, low, high, x = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(x, at)))
        self.part = np.arange(len(sets)) if part is None else np.unique([part[i] for i in order], return_inverse=True)[1]  # component of each set so far
        self.found: list[tuple[int, int]] = []

    def span(self, level: int, node: int) -> tuple[int, int]:
        width = 1 if level == 0 else LEAF * FAN ** (level - 1)
        return node * width, min(len(self.sets), (node + 1) * width)

    def may_match(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all nodes of ``a`` against all of ``b``: whether any of their sets can match; the bound of their overlap."""
        bits, low, high, extra = self.levels[level]
        most = np.bitwise_count(bits[a][:, None, :] & bits[b][None, :, :]).sum(axis=2, dtype=np.int64)
        most += np.minimum(extra[a][:, None], extra[b][None, :])
        most = np.minimum(most, np.minimum(high[a][:, None], high[b][None, :]))
        p = self.percent
        ok = (100 * high[b][None, :] >= p * low[a][:, None]) & (100 * high[a][:, None] >= p * low[b][None, :])
        return ok & ((100 + p) * most >= p * (low[a][:, None] + low[b][None, :])), most

    def links(self) -> list[tuple[int, int]]:
        """Links (i, j) by position in the given list, enough to connect every component; each was verified."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            (i0, i1), (j0, j1) = self.span(level, i), self.span(level, j)
            one = self.part[i0]
            if (self.part[i0:i1] == one).all() and (self.part[j0:j1] == one).all():
                continue
            wide = LEAF if level == 1 else FAN
            n = len(self.levels[level - 1][0])
            a = np.arange(i * wide, min((i + 1) * wide, n))
            b = a if i == j else np.arange(j * wide, min((j + 1) * wide, n))
            ok, most = self.may_match(level - 1, a, b)
            if i == j:
                ok &= np.triu(np.ones_like(ok), 1 if level == 1 else 0)
            if level == 1:
                ok &= self.part[a][:, None] != self.part[b][None, :]
            x, y = np.nonzero(ok)
            if level > 1:
                # nodes with themselves come off the stack first: they connect most sets early
                pairs = sorted(zip(a[x].tolist(), b[y].tolist()), key=lambda q: -abs(q[0] - q[1]))
                stack += [(level - 1, p, q) for p, q in pairs]
                continue
            for k in np.argsort(-most[x, y], kind="stable").tolist():
                p, q = int(a[x[k]]), int(b[y[k]])
                if self.part[p] != self.part[q] and similar(self.sets[p], self.sets[q], self.percent):
                    self.part[self.part == self.part[q]] = self.part[p]
                    self.found.append((self.order[p], self.order[q]))
        return self.found


def bucket_links(ids: list[int], sets: list[np.ndarray], known: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the sets of one bucket as (larger id, smaller id), enough to connect its components. ``known``: a label for each set, alike for those known to be connected; sets of one id are."""
    rows = [k for k, s in enumerate(sets) if len(s)]
    label = ids if known is None else known
    if len({label[k] for k in rows}) < 2:
        return []
    found = SignatureTree([sets[k] for k in rows], percent, [label[k] for k in rows]).links()
    return [(max(ids[rows[i]], ids[rows[j]]), min(ids[rows[i]], ids[rows[j]])) for i, j in found if ids[rows[i]] != ids[rows[j]]]


def apart(ids: list[int], links: list[tuple[int, int]], pivot: int) -> list[int]:
    """The ids that the links don't connect with the pivot."""
    near: dict[int, list[int]] = {}
    for u, v in links:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    seen, stack = {pivot}, [pivot]
    while stack:
        for x in near.get(stack.pop(), []):
            if x not in seen:
                seen.add(x)
                stack.append(x)
    return sorted(set(ids) - seen)


# --- the Spark job ------------------------------------------------------------------------------

_DIGEST = "doc_id long, n_shingles long, sig1 long, sig2 long, zone array<long>"


def _digest(exact: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "text"):
                sets = C.shingle_sets(*C.text_buffer(batch.column("text")), K)
                with np.errstate(over="ignore"):
                    one = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                    two = np.array([C.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), C.list_column([s if exact or len(s) <= WHOLE else s[:ZONE] for s in sets])],
                    names=["doc_id", "n_shingles", "sig1", "sig2", "zone"],
                )

    return run


def _keys(hot, exact: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value
        for batch in batches:
            zone = batch.column("zone")
            tokens = zone.flatten().to_numpy(zero_copy_only=False)
            count = np.asarray(pc.list_value_length(zone)).astype(np.int64)
            if not len(tokens):
                continue
            row = np.repeat(np.arange(len(count)), count)
            at = np.searchsorted(frequent, tokens)
            is_hot = np.zeros(len(tokens), dtype=bool)
            if len(frequent):
                is_hot = frequent[np.minimum(at, len(frequent) - 1)] == tokens
            begin = np.cumsum(count) - count
            rare = np.cumsum(~is_hot)
            before = np.concatenate([[0], rare])[begin]
            n = np.asarray(batch.column("n_shingles")).astype(np.int64)
            want = n - (PERCENT * n + 99) // 100 + 1  # the prefix rule: one more than may be missed
            want = want if exact else np.minimum(KEYS, want)
            have = np.concatenate([[0], rare])[begin + count] - before
            passes = (have >= want) & (10 * (count - have) <= 3 * count)
            place = np.where(is_hot, have[row] + np.arange(len(tokens)) + 1 - begin[row] - (rare - before[row]), rare - before[row])  # frequent ones last
            pick = np.where((count == n)[row], place <= want[row], ~passes[row] | (~is_hot & (place <= want[row])))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[pick]), pa.array(np.asarray(batch.column("rep")).astype(np.int64)[row[pick]]), pa.array(n[row[pick]])], names=["token", "doc", "n"])

    return run


_LINKS = "u long, v long, pivot long"


def _bucket_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (pivot, bi, bj) -> links (u, v); of the blocks of a large bucket (bj = -1) also the ids that aren't connected with its
    pivot, as (u, null, pivot). ``linked``: known to be connected with the pivot. Holds one bucket at a time, whose size is bounded by its blocks."""

    def answer(key: tuple, ids: list[int], linked: list[bool], sets: list[np.ndarray]) -> list[tuple]:
        links = bucket_links(ids, sets, [key[0] if x else i for i, x in zip(ids, linked)])
        rest = [(i, None, key[0]) for i in apart(ids, links, key[0])] if key[2] == -1 else []
        return [(u, v, None) for u, v in links] + rest

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["u", "v", "pivot"])

    last, ids, linked, sets, out = None, [], [], [], []
    for whole in batches:
        for batch in C.slices(whole, "text"):
            got = C.shingle_sets(*C.text_buffer(batch.column("text")), K)
            keys = zip(*(batch.column(c).to_pylist() for c in ("pivot", "bi", "bj")))
            for key, doc, near, s in zip(keys, batch.column("doc").to_pylist(), batch.column("linked").to_pylist(), got):
                if key != last:
                    out += answer(last, ids, linked, sets) if last else []
                    last, ids, linked, sets = key, [], [], []
                ids.append(doc)
                linked.append(near)
                sets.append(s)
            if out:
                yield batch_of(out)
                out = []
    yield batch_of(out + (answer(last, ids, linked, sets) if last else []))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Null or wordless texts have no shingles and are linked with nothing. A row whose id is null has its
    set size and a null component; it links nothing. Rows that share an id are one vertex. Ties can't
    occur: the component is the smallest id. Extra columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = C.written(own.mapInArrow(_digest(exact), _DIGEST), "shingles")
    sets = digest.where("doc_id is not null and n_shingles > 0").groupBy("sig1", "sig2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("zone").alias("zone"))
    sets = C.written(sets, "sets")

    named = sets.agg(F.sum(F.size("zone"))).first()[0] or 0
    limit = max(LEAST_HOT, named // MOST_HOT)
    frequent = sets.select(F.explode("zone").alias("token")).groupBy("token").count().where(F.col("count") > limit).select("token").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(frequent.column(0).to_numpy()) if frequent.num_rows else np.zeros(0, np.int64))

    keys = C.written(sets.select("rep", "n_shingles", "zone").mapInArrow(_keys(hot, exact), "token long, doc long, n long"), "keys")
    pivots = keys.groupBy("token").agg(F.min("doc").alias("pivot"), F.count("*").alias("m")).where("m > 1").select("token", "pivot")
    members = C.written(keys.join(pivots, "token").select("pivot", "doc", "n").distinct(), "members")
    sizes = members.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    large = C.written(sizes.select("pivot", blocks.alias("blocks")).where("blocks > 1"), "large")  # a table, so that Spark knows how few they are
    dealt = members.join(large, "pivot", "left").withColumn("bi", F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1))).cast("int"))
    every = F.when((F.col("doc") == F.col("pivot")) & F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array("bi"))
    tasks = dealt.withColumn("bi", F.explode(every)).select("pivot", "doc", "bi", F.when(F.col("blocks").isNull(), -2).otherwise(-1).alias("bj"), F.lit(False).alias("linked"))
    texts = own.select(F.col("doc_id").alias("doc"), "text")

    def join(tasks: DataFrame) -> DataFrame:
        return tasks.join(texts, "doc").repartition("pivot", "bi", "bj").sortWithinPartitions("pivot", "bi", "bj").mapInArrow(_bucket_join, _LINKS)

    # most texts are in no bucket, but too many are for a broadcast at any size worth the name
    links = C.written(join(tasks.hint("merge")), "bucket-links")
    rest = links.where("v is null").select("pivot", F.col("u").alias("doc")).distinct()
    links = links.where("v is not null").select("u", "v")
    if rest.limit(1).count():
        chunks = rest.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("chunks"))
        own_chunk = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("chunks")).cast("int")
        pairs = large.join(chunks, "pivot")
        left = rest.join(pairs, "pivot").select("pivot", "doc", own_chunk.alias("bi"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("bj"), F.lit(False).alias("linked"))
        right = dealt.drop("blocks").withColumnRenamed("bi", "bj").join(pairs, "pivot").join(rest.withColumn("rest", F.lit(True)), ["pivot", "doc"], "left")
        right = right.select("pivot", "doc", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("bi"), "bj", F.col("rest").isNull().alias("linked"))
        links = links.union(join(C.written(left.unionByName(right), "rest")).where("v is not null").select("u", "v"))
    roots = components(links)
    named_sets = sets.drop("zone").join(roots, F.col("rep") == F.col("u"), "left").select("sig1", "sig2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    out = digest.drop("zone").join(named_sets, ["sig1", "sig2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, one for each id and text (of rows alike in both the first by their values); rows without an id stay."""
    found = C.written(ngram_jaccard_components(docs, id_col, text_col), "components")
    key = F.col(f"`{id_col}`").cast("long")
    others = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(others, key == F.col("__id"), "left_anti")
    again = C.written(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__id")), "again")
    if again.limit(1).count():
        first = Window.partitionBy(id_col, text_col).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        once = kept.join(again, key == F.col("__id"), "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)
        kept = kept.join(again, key == F.col("__id"), "left_anti").unionByName(once)
    return kept
