"""Failure locations: candidates of a test ordered by their distance from it in the call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.functions import text as T
from triage.operators.paths import set_distance
from triage.sources.shared import written


GRAM = 3


def _grams(c: Column) -> Column:
    """The runs of ``GRAM`` characters of a text; all of a shorter one."""
    n = F.greatest(F.length(c) - (GRAM - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(GRAM))))


def candidate_file_path(candidate: Column, strict: bool = False) -> Column:
    file = T.candidate_file(candidate)
    return file if strict else F.replace(file, F.lit(">"), F.lit("/"))


def candidate_nodes(candidates: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """``project, file, node_id``: for each distinct candidate's file the nodes whose id holds it.

    A file with an ending meets the nodes with the same last path segment. Any other text is looked up in an index of
    the ids by runs of ``GRAM`` characters: it meets the nodes of its rarest run, and the whole text is then compared. A text without a node for one of its
    runs is in none. Shorter texts meet the runs that hold them. Each distinct file is looked up once, however many tests name it.
    """
    files = candidates.select("project", candidate_file_path(F.col("candidate"), strict).alias("file")).where("file <> ''").distinct().withColumn("_base", F.substring_index("file", "/", -1))
    files = files.withColumn("_exact", F.col("_base").rlike(r"\.(py|java|cs|vb)$"))
    own = nodes.select("project", "node_id").distinct()
    node_file = F.replace(T.file_from_func_id(F.col("node_id")), F.lit("\\"), F.lit("/"))
    named = files.where("_exact").join(own.withColumn("_base", F.substring_index(node_file, "/", -1)), ["project", "_base"])
    postings = own.select("project", "node_id", F.explode(_grams(F.col("node_id"))).alias("gram"))
    keys = files.where("not _exact").select("project", "file", F.explode(_grams(F.col("file"))).alias("gram"))
    long = keys.where(F.length("gram") == GRAM)
    counts = postings.join(long.select("project", "gram").distinct(), ["project", "gram"], "left_semi").groupBy("project", "gram").agg(F.count("*").alias("n"))
    rarest = long.join(counts, ["project", "gram"], "left").groupBy("project", "file").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0).cast("long")), "gram")).alias("gram"))
    looked_up = rarest.join(postings, ["project", "gram"])
    short = keys.where(F.length("gram") < GRAM).select("project", "file", F.length("file").alias("k"))
    # a short text is a part of some runs: the distinct runs of all ids are few beside the ids
    parts = postings.select("project", "gram").distinct().select("project", "gram", F.explode(F.array_distinct(F.array(*[F.substring("gram", i, F.lit(k)) for i, k in ((1, 1), (2, 1), (3, 1), (1, 2), (2, 2))]))).alias("file"))
    brief = parts.join(short.select("project", "file").distinct(), ["project", "file"]).join(postings, ["project", "gram"])
    out = [x.select("project", "file", "node_id") for x in (named, looked_up, brief)]
    return out[0].unionByName(out[1]).unionByName(out[2]).where(F.contains("node_id", "file")).distinct()


def _ranked(candidates: DataFrame, best: DataFrame, strict: bool) -> DataFrame:
    """``best``: project, test_id, file, dist."""
    key = candidates.withColumn("file", candidate_file_path(F.col("candidate"), strict))
    keys = ["project", "test_id", "idx", "candidate"]
    out = key.join(best, ["project", "test_id", "file"], "left").select(*keys, *[c for c in candidates.columns if c not in keys], "dist")
    order = Window.partitionBy("project", "test_id").orderBy(F.coalesce(F.col("dist").cast("double"), F.lit(float("inf"))), "idx")
    return out.withColumn("rank", F.row_number().over(order))


def rank_candidates(candidates: DataFrame, distances: DataFrame, held: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Adds ``dist`` and ``rank``: by the least hop distance of a node whose id holds the candidate's file, then by position.

    ``candidates``: project, test_id, idx, candidate. ``distances``: project, seed, node_id, dist, of the tests
    alone. ``held``: ``candidate_nodes``, whose nodes are all that ``distances`` has to have; None: of the nodes in ``distances``. ``strict`` compares chains
    with ``>`` as they are, which match no path of more than one segment; else ``>`` stands for ``/``.
    """
    held = candidate_nodes(candidates, distances, strict) if held is None else held
    near = distances.select("project", F.col("seed").alias("test_id"), "node_id", "dist")
    best = near.join(held, ["project", "node_id"]).groupBy("project", "test_id", "file").agg(F.min("dist").alias("dist"))
    return _ranked(candidates, best, strict)


def rank_in_graph(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int | None = None, key: str = "node_id", strict: bool = False) -> DataFrame:
    """``rank_candidates`` by the distances in a graph, of which only those of tests to files that their candidates name are worked out.

    Ways are the same from either end, so hops are from whichever are fewer: from the tests, or from the files, each the set of
    the nodes that hold it, however many. ``edges`` have the column ``key`` of ``nodes`` as ends.
    """
    held = written(candidate_nodes(candidates, nodes, strict), "held")
    file = candidate_file_path(F.col("candidate"), strict)
    asked = written(candidates.select("project", "test_id", file.alias("file")).distinct().join(held.select("project", "file").distinct(), ["project", "file"], "left_semi"), "asked")
    files, tests = (asked.select("project", c).distinct().count() for c in ("file", "test_id"))
    if files <= tests:
        dist = set_distance(edges, held.select("project", F.col("file").alias("name"), "node_id"), asked.select("project", F.col("file").alias("name"), F.col("test_id").alias("node_id")), depth, nodes, key)
        best = dist.select("project", F.col("node_id").alias("test_id"), F.col("name").alias("file"), "dist")
    else:
        pairs = written(asked.join(held, ["project", "file"]), "pairs")
        dist = set_distance(edges, asked.select("project", F.col("test_id").alias("name"), F.col("test_id").alias("node_id")), pairs.select("project", F.col("test_id").alias("name"), "node_id"), depth, nodes, key)
        best = dist.withColumnRenamed("name", "test_id").join(pairs, ["project", "test_id", "node_id"]).groupBy("project", "test_id", "file").agg(F.min("dist").alias("dist"))
    return _ranked(candidates, best, strict)
