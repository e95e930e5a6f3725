"""Test outcomes on graph nodes: matching records to nodes, the last record wins, merging with an older state.

``results``: project, run_id, file, ord, name, status, message. ``nodes``: project, node_id, is_test,
node_ord and more. A name that ends a node's id is an equal join on the last ``::`` token, never a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions import text as T


def suffix_index(nodes: DataFrame) -> DataFrame:
    """``project, token, node_id``: for each last token the first node by ``node_ord`` that has it."""
    own = nodes.where(F.col("node_id").contains("::"))
    return own.groupBy("project", T.last_token(F.col("node_id")).alias("token")).agg(F.min_by("node_id", F.struct("node_ord", "node_id")).alias("node_id"))


def match_results(results: DataFrame, nodes: DataFrame, lang: str) -> DataFrame:
    """``results`` with a name, and ``node_id``: by whole id, id without parameters, last token, last token without; null if none.

    Names are resolved once each, however many runs report them.
    """
    named = results.where(F.coalesce(T.strip(F.col("name")), F.lit("")) != "")
    names = named.select("project", "name").distinct().withColumn("_id", F.explode(F.array(T.normalize_test_name(F.col("name"), lang))))  # explode: later columns take the value, not the expression
    token = T.last_token(F.col("_id"))
    names = names.withColumn("_token", token).withColumn("_bare", T.strip_param_suffix(F.col("_token")))
    bare_id = F.concat(F.substring(F.col("_id"), F.lit(1), F.length("_id") - F.length("_token")), "_bare")
    asked = F.array(*[F.struct(F.lit(by).alias("by"), c.alias("key")) for by, c in ((False, F.col("_id")), (False, bare_id), (True, F.col("_token")), (True, F.col("_bare")))])
    keys = names.select("project", "name", F.posexplode(asked).alias("pos", "a")).select("project", "name", "pos", "a.by", "a.key").where("key <> ''")
    known = nodes.select("project", F.lit(False).alias("by"), F.col("node_id").alias("key"), "node_id").unionByName(suffix_index(nodes).select("project", F.lit(True).alias("by"), F.col("token").alias("key"), "node_id"))
    # Files of Parquet are so much smaller than the ids in them that Spark would send all nodes to every task
    hit = keys.join(known.hint("merge"), ["project", "by", "key"])
    resolved = hit.groupBy("project", "name").agg(F.min(F.struct("pos", "node_id")).alias("_first")).select("project", "name", "_first.node_id")
    return named.join(resolved, ["project", "name"], "left")


def last_status(matched: DataFrame) -> DataFrame:
    """``project, run_id, node_id, status, error_message``: the last record's status, the last message that isn't blank.

    Records are ordered by ``place`` (kind of file, file, place in it) where there is one, else by (file, ord) or ord.
    Aggregates that combine before the shuffle: a node with most records is no bottleneck.
    """
    order = F.col("place") if "place" in matched.columns else F.struct("file", "ord") if "file" in matched.columns else F.col("ord")
    said = F.when(F.coalesce("message", F.lit("")) != "", order)
    hit = matched.where("node_id is not null")
    out = hit.groupBy("project", "run_id", "node_id").agg(F.max_by("status", order).alias("status"), F.max_by("message", said).alias("error_message"))
    return out.withColumn("error_message", T.strip_ansi(F.col("error_message")))


def node_status(results: DataFrame, nodes: DataFrame, lang: str, locations: bool = True) -> DataFrame:
    """Every test node in every run, and every other node with a record: status ``not_executed`` without one; where the error points to, if ``locations``.

    A message that many nodes have is searched for locations once.
    """
    got = last_status(match_results(results, nodes, lang))
    runs = F.broadcast(results.select("project", "run_id").distinct())  # a row a run; a shuffle by project would put all its tests into one task
    tests = nodes.where("is_test").select("project", "node_id").join(runs, "project")
    out = tests.join(got, ["project", "run_id", "node_id"], "full_outer").withColumn("status", F.coalesce("status", F.lit("not_executed")))
    if not locations:
        return out
    said = out.where("error_message is not null").select(F.col("error_message").alias("_said")).distinct().withColumn("_place", T.locate(F.col("_said")))
    out = out.join(said, F.col("error_message") == F.col("_said"), "left").drop("_said")
    return out.withColumns({"heuristic_locations": F.col("_place.heuristic"), "raw_locations": F.col("_place.raw_paths")}).drop("_place")


def unmatched_results(results: DataFrame, nodes: DataFrame, lang: str) -> DataFrame:
    return match_results(results, nodes, lang).where("node_id is null").select("project", "run_id", "ord", "name")


def upsert_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newer status where there is one, else the old; keyed by project and node_id."""
    a = old.select("project", "node_id", F.col("status").alias("_old"), F.col("error_message").alias("_old_error"))
    b = new.select("project", "node_id", F.col("status").alias("_new"), F.col("error_message").alias("_new_error"))
    both = a.join(b, ["project", "node_id"], "full_outer")
    return both.select("project", "node_id", F.coalesce("_new", "_old").alias("status"), F.coalesce("_new_error", "_old_error").alias("error_message"))
