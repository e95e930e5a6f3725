"""Operator 12, a Merkle manifest of a dataset: a tree of digests for each group, and one over the groups.

A row's leaf is the digest of its fields. Leaves of a group have numbers in the order of the ids; a level is
a window over (group, number div ``RUN``), whose ordered list of the whole frame gives both the parent's
preimage and every node's siblings; the parents, once each, are the next level. So no group is gathered: a window
holds ``RUN`` nodes. The way back from the roots to the leaves hands every node the siblings on its
path, a join a level. Levels get ``RUN`` times smaller each, so both ways together move about three times the nodes.

Numbers in a group come from a range partitioning by (group, id, leaf): each partition's rows of a group are
counted, and the counts of the partitions before give where its numbers begin. Rows that agree in all three are the same leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.llm import common as C

RUN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return digest(F.concat(*map(field, columns)))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``number``, from 0 in each group in the order given (nulls first), and ``size``, the rows of the group.

    A large group is spread over many tasks; what is gathered by group is a row a partition that holds some of it.
    """
    place = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    sorted_ = rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_row", F.monotonically_increasing_id())
    held = C.written(sorted_.withColumn("_part", F.shiftright("_row", 33)), "numbered")
    counts = held.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*group)
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    counts = counts.select(*own, F.col("_part").alias("_p"), (before - F.col("_first")).alias("_base"), F.sum("_n").over(whole).alias("size"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    return held.join(counts, same).select(*rows.columns, (F.col("_row") + F.col("_base")).alias("number"), "size")


def trees(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(roots, levels) of ``leaves`` (``tree, number, size, hash``): ``tree, hash, height`` of what remains of each, and of each level
    ``tree, number, before, after``: the digests of a node's siblings on either side, joined. Every level is written, so a lost executor costs one of them."""
    levels, nodes, most = [], leaves.select("tree", "number", "size", "hash"), leaves.agg(F.max("size")).first()[0] or 1
    root = lambda: nodes.where("size = 1").select("tree", "hash", F.lit(len(levels)).alias("height"))
    roots = [root()]
    while most > 1:
        most = -(-most // RUN)
        run = Window.partitionBy("tree", "parent").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = nodes.where("size > 1").withColumn("parent", F.call_function("div", F.col("number"), F.lit(RUN).cast("long")))
        at = (F.col("number") % RUN).cast("int")
        listed = own.withColumn("all", F.collect_list("hash").over(run))
        side = lambda a, n: F.concat_ws("", F.slice("all", a, n))
        level = C.written(listed.select("tree", "number", "parent", "size", side(F.lit(1), at).alias("before"), side(at + 2, F.lit(RUN)).alias("after"), F.when(at == 0, digest(F.concat_ws("", "all"))).alias("up")), "level")
        levels.append(level.select("tree", "number", "before", "after"))
        up = level.where("up is not null")  # each parent once, from its first node
        nodes = up.select("tree", F.col("parent").alias("number"), F.call_function("div", F.col("size") + (RUN - 1), F.lit(RUN).cast("long")).alias("size"), F.col("up").alias("hash"))
        roots.append(root())
    return C.written(reduce(DataFrame.unionByName, roots), "roots"), levels


_STEP = "array<struct<before:string,after:string>>"


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, number, path``: for every node of the lowest level the siblings on its way up, its own first, then those of
    ``above`` (``tree, height, path``, a written table), the way on from the tree's root. A tree of one node has the way from above alone."""
    tops = lambda k: above.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("number"), "path")
    held = tops(len(levels))
    for k in reversed(range(len(levels))):
        own = levels[k].withColumn("parent", F.call_function("div", F.col("number"), F.lit(RUN).cast("long")))
        up = held.select("tree", F.col("number").alias("parent"), F.col("path").alias("_path"))
        got = own.join(up, ["tree", "parent"]).select("tree", "number", F.concat(F.array(F.struct("before", "after")), "_path").alias("path"))
        held = got.unionByName(tops(k))
    return held


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified``, one row per row of ``docs``.

    ``path``: array of (before, after), the joined digests of the siblings at each level. ``tampered``: the text to verify in place
    of ``text``; None: the text itself. Nulls are fields like any other; a null ``source`` is a group of its own, the first one. Within a group,
    null ids come first, rows of one id follow by their leaves; rows with the same leaf have proofs of their own. Extra columns are no part of a leaf.
    An empty table gives no rows. One group: the root is its subroot. One row: both are its leaf, and the proof is the digest of an empty text.
    """
    changed = F.col(text_col) if tampered is None else tampered
    with_text = lambda t: leaf_digest(*[t if f == text_col else F.col(f) for f in fields])
    other = F.when(~changed.eqNullSafe(F.col(text_col)), with_text(changed))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(group).cast("string").alias("source"), with_text(F.col(text_col)).alias("leaf"), other.alias("other"))
    leaves = numbered(C.written(rows, "rows"), ["source"], ["doc_id", "leaf", "other"])  # written: the texts are read once, though a range partitioning reads its input twice
    leaves = C.written(leaves.withColumn("tree", field(F.col("source"))), "leaves")
    subroots, levels = trees(leaves.select("tree", "number", "size", F.col("leaf").alias("hash")))
    names = leaves.where("number = 0").select("tree", "source")
    subroots = C.written(numbered(subroots.join(names, "tree").withColumn("all", F.lit(0)), ["all"], ["source"]), "subroots")
    roots, upper = trees(subroots.select(F.lit("").alias("tree"), "number", "size", "hash"))
    start = roots.select("tree", "height", F.array().cast(_STEP).alias("path"))
    onward = paths(upper, start).join(subroots.select("number", F.col("tree").alias("_tree"), F.col("hash").alias("subroot"), "height"), "number")
    root = roots.first()  # one row, or none of an empty table
    onward = C.written(onward.select(F.col("_tree").alias("tree"), "height", "path", "subroot"), "onward")
    way = paths(levels, onward)
    out = leaves.join(way, ["tree", "number"]).join(onward.select("tree", "subroot"), "tree").withColumn("root", F.lit(root["hash"] if root else None).cast("string"))
    joined = F.aggregate("path", F.lit(""), lambda a, s: F.concat(a, s["before"], s["after"]))
    out = out.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "path", digest(joined).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` with half of the rows tampered with: those of an even
    crc32 of the decimal id lose the line breaks of their text. A null id has no decimal form and isn't tampered with."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, tampered).drop("path")
