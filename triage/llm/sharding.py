"""Operator 7, sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Rows are numbered 0 to N - 1 in the order of (bucket, id, size, checksum), which depends on
the rows alone. The bucket is a hash of all three, so ids of one stride, or null ones, fill no bucket more than others. A keyed Feistel network permutes the least rectangle a x b that holds N numbers; a
number that leaves [0, N) is sent on until it comes back (cycle walking), so the result is a
permutation of [0, N). Place p of the shuffle is slot p div 40 of shard p mod 40: shard sizes differ
by one row at most, and both are computable from the row number and N.

Rows that agree in id, size and checksum can't be told apart and are numbered as one group: they are
counted before the shuffle and spread out again afterwards, so no group of copies is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.llm import common as C

BUCKETS = 4093
ROUNDS = 6
PRIME = 2147483647
#: Rows of one group that a task numbers at a time.
RUN = 100_000


def round_keys(seed: int) -> list[int]:
    """ROUNDS keys below PRIME by a multiplicative generator."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(ROUNDS):
        x = x * 48271 % PRIME
        keys.append(x)
    return keys


def rectangle(n: int) -> tuple[int, int]:
    """The least a >= b with a * b >= n, a the rounded-up square root of n."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    while a > 1 and (a - 1) * (a - 1) >= n:
        a -= 1
    return a, max(1, -(-n // a))


def _div(x: Column, n: int) -> Column:
    """Whole division of longs, without a detour over doubles."""
    return F.call_function("div", x.cast("long"), F.lit(n).cast("long"))


def _scramble(x: Column, key: Column) -> Column:
    """A value below PRIME from a number and a key; all intermediate values stay under 2^63."""
    y = (x + key) % F.lit(PRIME) * F.lit(48271) % F.lit(PRIME)
    y = F.transform(F.array(y), lambda v: v.bitwiseXOR(F.shiftright(v, 13)) % F.lit(PRIME) * F.lit(69621) % F.lit(PRIME))[0]
    return F.transform(F.array(y), lambda v: v.bitwiseXOR(F.shiftright(v, 11)))[0]


def feistel(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """The permutation of [0, a * b): (u, v) = (x div b, x mod b), changed in turn by a function of the other."""
    start = F.struct(_div(x, b).alias("u"), (x % F.lit(b)).cast("long").alias("v"))

    def step(s: Column, k: Column) -> Column:
        first = F.struct(((s["u"] + _scramble(s["v"], k["key"])) % F.lit(a)).cast("long").alias("u"), s["v"].alias("v"))
        second = F.struct(s["u"].alias("u"), ((s["v"] + _scramble(s["u"], k["key"])) % F.lit(b)).cast("long").alias("v"))
        return F.when(k["even"], first).otherwise(second)

    rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("even")) for i, k in enumerate(keys)])
    return F.aggregate(rounds, start, step, lambda s: s["u"] * F.lit(b) + s["v"])


def walk(x: Column, n: int, a: int, b: int, keys: list[int], steps: int) -> Column:
    """``feistel`` applied until the number is below n, ``steps`` times at most."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x.cast("long"), lambda acc, i: F.when((i > 1) & (acc < F.lit(n)), acc).otherwise(feistel(acc, a, b, keys)))


def walk_steps(spark, n: int, a: int, b: int, keys: list[int]) -> int:
    """How many steps bring every number of [0, n) back: one more than the longest way of a number outside."""
    steps = 1
    while a * b > n and spark.range(n, a * b).where(walk(F.col("id"), n, a, b, keys, steps) >= n).limit(1).count():
        steps *= 2
    return steps + 1


def bucket() -> Column:
    """Of a row's id (null: -1), size and checksum: crc32 of them as text, modulo ``BUCKETS``."""
    told = F.concat_ws("/", F.coalesce("doc_id", F.lit(-1)).cast("string"), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    return F.pmod(F.crc32(told.cast("binary")), F.lit(BUCKETS))


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per document; law ``rows``.

    ``size``: UTF-8 bytes of the text (null: none) plus 16. Equal texts aren't kept together under this
    law, which makes all shards equal in rows. Null ids come first and are rows like any other, as are
    repeated ids and repeated rows. Extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    groups = C.written(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "groups")
    groups = groups.withColumn("bucket", bucket())
    held = groups.groupBy("bucket").agg(F.sum("copies").alias("rows"))  # BUCKETS rows at most
    base = held.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("base"))
    n = held.agg(F.sum("rows")).first()[0] or 0
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")).limit(0)
    a, b = rectangle(n)
    keys = round_keys(seed)
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    first = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    numbered = groups.withColumn("first", first).join(F.broadcast(base), "bucket").withColumn("first", F.col("first") + F.col("base"))
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    number = F.explode(F.sequence(F.col("first") + F.col("run"), F.col("first") + F.least(F.col("run") + RUN, F.col("copies")) - 1))
    placed = runs.withColumn("number", number).withColumn("place", walk(F.col("number"), n, a, b, keys, walk_steps(spark, n, a, b, keys)))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        _div(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
