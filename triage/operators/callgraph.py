"""From call sites and declarations to edges and external nodes, by equal joins on name tokens.

``calls``: project, call_id, caller, caller_type, chain array<string>, argc, hint, kind, ns, file, ord.
``nodes``: as elsewhere, with ``parameters`` (argument count). Calls resolve against all declarations,
whatever their order. A token that very many calls share is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.functions import text as T
from triage.sources.shared import written

# Callees that make no external node in Python.
PYTHON_IGNORED_CALLEES = (
    "len", "str", "dict", "object", "print", "isinstance", "TypeError", "KeyError", "ValueError", "Exception", "parametrize", "xfail", "raises", "fixture", "skip",
    "getLogger", "info", "debug", "critical", "level", "remove", "replace", "add", "add_marker", "json", "get", "Iterator", "build", "datetime", "items",
    "assert_called_once", "assert_called_with", "patch", "spy", "configure",
)
# What marks a test in Java and in C#.
JAVA_TEST_ANNOTATIONS = (
    "Test", "ParameterizedTest", "RepeatedTest", "org.junit.Test", "org.junit.jupiter.api.Test", "org.junit.jupiter.params.ParameterizedTest",
    "org.junit.jupiter.api.RepeatedTest", "org.junit.jupiter.api.TestFactory", "org.testng.annotations.Test",
)
CSHARP_TEST_ATTRIBUTES = ("Fact", "Theory", "Test", "TestCase", "TestCaseSource", "ParameterizedTest", "TestFixture", "TestMethod", "DataTestMethod", "TestClass", "Ignore")


def python_tests(functions: DataFrame) -> DataFrame:
    """A file with a ``test_*`` function at its top or in a class makes all its functions tests. ``functions``: project, file, name, depth, ..."""
    marked = F.col("name").startswith("test_") & (F.col("depth") <= 1)
    return functions.withColumn("is_test", F.max(marked).over(Window.partitionBy("project", "file")))


def java_is_test(annotations: Column) -> Column:
    return F.coalesce(F.arrays_overlap(annotations, F.array(*map(F.lit, JAVA_TEST_ANNOTATIONS))), F.lit(False))


def csharp_is_test(attributes: Column, type_attributes: Column, name: Column) -> Column:
    known = F.array(*map(F.lit, CSHARP_TEST_ATTRIBUTES))
    return F.coalesce(F.arrays_overlap(attributes, known), F.lit(False)) | F.coalesce(F.arrays_overlap(type_attributes, known), F.lit(False)) | F.lower(name).rlike("^(test|should_|when_)")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge a pair: its first call, with that call's origin."""
    origin = [F.min_by("origin", "edge_ord").alias("origin")] if "origin" in edges.columns else []
    return edges.groupBy("project", "src", "dst").agg(F.min("edge_ord").alias("edge_ord"), *origin)


def _two(c: Column) -> Column:
    """The last two ``::`` tokens of an id."""
    return F.substring_index(c, "::", -2)


#: Where a call to something outside the project comes from.
ORIGIN = "struct<language:string,package_or_module:string,namespace:string,kind:string,symbol:string,qualifier:string,file:string>"


def _has(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with null columns for the names that it lacks."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def _origin(language: str, package: Column, namespace: Column, kind: Column, symbol: Column, qualifier: Column) -> Column:
    return F.struct(F.lit(language).alias("language"), package.alias("package_or_module"), namespace.alias("namespace"), kind.alias("kind"), symbol.alias("symbol"), qualifier.alias("qualifier"), F.col("file").alias("file")).cast(ORIGIN)


def external_nodes(uses: DataFrame) -> DataFrame:
    """``project, node_id, node_ord, type, lang, origins`` from uses (project, node_id, origin, ord, n): each distinct origin with its count, most first."""
    key = ["project", "node_id"]
    counted = uses.groupBy(*key, "origin").agg(F.sum("n").alias("count"), F.min("ord").alias("o"))
    by = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("_n"), F.col("origin"))))
    got = counted.groupBy(*key).agg(F.min("o").alias("node_ord"), F.min("origin.language").alias("lang"), F.transform(by, lambda x: x["origin"].withField("count", -x["_n"])).alias("origins"))
    return got.select(*key, "node_ord", F.lit("external").alias("type"), "lang", "origins")


def _kinds(calls: DataFrame, *alike: str) -> DataFrame:
    """Calls that resolve alike are one row, with the first ``ord`` and their number ``n``: what is joined is bounded by distinct calls of a caller."""
    return calls.groupBy("project", "caller", *alike).agg(F.min("ord").alias("ord"), F.count("*").alias("n")).withColumn("kind_id", F.xxhash64("caller", *alike)).withColumn("kind_id", F.struct("caller", "kind_id"))


def resolve_python(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with origin, external nodes). All functions named ``hint::method`` or ``Class::method``; only if there are none, all named ``method``."""
    inner = nodes.where("type in ('function', 'test')").select("project", "node_id", T.last_token(F.col("node_id")).alias("method"), _two(F.col("node_id")).alias("pair"))
    own = _kinds(_has(calls, "file", "module"), "chain", "hint", "file", "module").withColumn("method", F.try_element_at("chain", F.lit(-1))).where("method is not null")
    by_class = F.concat_ws("::", F.try_element_at("chain", F.lit(-2)), "method")
    pairs = F.array_distinct(F.array(F.when(F.col("hint").isNotNull(), F.concat_ws("::", "hint", "method")).otherwise(by_class), by_class))
    first = own.where(F.size("chain") >= 2).select("*", F.explode(pairs).alias("pair")).join(inner.select("project", "pair", "node_id"), ["project", "pair"])
    rest = own.join(first.select("project", "kind_id").distinct(), ["project", "kind_id"], "left_anti")
    got = rest.join(inner.select("project", "method", "node_id"), ["project", "method"], "left")
    edge = lambda df: df.where("node_id <> caller").select("project", F.col("caller").alias("src"), F.col("node_id").alias("dst"), F.col("ord").alias("edge_ord"), F.lit(None).cast(ORIGIN).alias("origin"))
    left = got.where(F.col("node_id").isNull() & ~F.col("method").isin(*PYTHON_IGNORED_CALLEES))
    left = left.withColumn("origin", _origin("python", F.col("module"), F.lit(None), F.lit("call"), F.array_join("chain", "."), F.try_element_at("chain", F.lit(-2))))
    outer = left.select("project", F.col("caller").alias("src"), F.col("method").alias("dst"), F.col("ord").alias("edge_ord"), "origin")
    return distinct_edges(edge(first).unionByName(edge(got)).unionByName(outer)), external_nodes(left.select("project", F.col("method").alias("node_id"), "origin", "ord", "n"))


def resolve_java(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with origin, external nodes). The first function named like the call, else ``external::name``."""
    inner = nodes.where("type in ('function', 'test')").groupBy("project", T.last_token(F.col("node_id")).alias("method")).agg(F.min_by("node_id", F.struct("node_ord", "node_id")).alias("hit"))
    own = _kinds(_has(calls, "file", "ns"), "chain", "ns", "file").withColumn("method", F.try_element_at("chain", F.lit(-1))).where("method is not null")
    got = own.join(inner, ["project", "method"], "left")
    origin = F.when(F.col("hit").isNull(), _origin("java", F.col("ns"), F.lit(None), F.lit("call"), F.col("method"), F.try_element_at("chain", F.lit(-2))))
    edges = got.select("project", F.col("caller").alias("src"), F.coalesce("hit", F.concat(F.lit("external::"), "method")).alias("dst"), F.col("ord").alias("edge_ord"), origin.alias("origin"), "n")
    ext = external_nodes(edges.where("origin is not null").select("project", F.col("dst").alias("node_id"), "origin", F.col("edge_ord").alias("ord"), "n"))
    return distinct_edges(edges.where("src <> dst")), ext


def resolve_csharp(calls: DataFrame, nodes: DataFrame, projects: DataFrame | None = None, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with origin, external nodes): calls by the tiers of ``csharp_matches``, new objects by what is named like their type.

    What matches nothing is ``project::n`` or ``nuget::n`` if a reference (project, name) is called so, else ``external::name/argc``.
    """
    own = _kinds(calls, "name", "type_name", "ns", "argc", "kind", "file").where("name is not null")
    what = own.select("project", "name", "type_name", "ns", "argc", "kind").distinct()
    alike = F.to_json(F.struct("name", "type_name", "ns", "argc", "kind"))
    inner = nodes.where("type in ('function', 'test')")
    met = csharp_matches(what.where("kind <> 'new'").withColumn("call_id", alike), inner).select("project", "call_id", "node_id")
    made = what.where("kind = 'new'").withColumn("call_id", alike).join(inner.select("project", "name", "node_id"), ["project", "name"]).select("project", "call_id", "node_id")
    found = written(met.unionByName(made).distinct(), "csharp-matches")
    got = own.withColumn("call_id", alike).join(found, ["project", "call_id"], "left")
    refs = None
    for prefix, df in (("project::", projects), ("nuget::", packages)):
        if df is not None:
            own_refs = df.select("project", "name", F.concat(F.lit(prefix), "name").alias("ref"), F.lit(prefix == "nuget::").alias("later"))
            refs = own_refs if refs is None else refs.unionByName(own_refs)
    left = got.where("node_id is null")
    if refs is not None:
        left = left.join(refs.groupBy("project", "name").agg(F.min_by("ref", "later").alias("ref")), ["project", "name"], "left")
    outside = F.concat(F.lit("external::"), "name", F.lit("/"), F.col("argc").cast("string"))
    left = left.withColumn("dst", F.coalesce("ref", outside) if refs is not None else outside).withColumn("origin", _origin("csharp", F.lit(None), F.col("ns"), F.col("kind"), F.col("name"), F.col("type_name")))
    inside = got.where("node_id is not null").select("project", F.col("caller").alias("src"), F.col("node_id").alias("dst"), F.col("ord").alias("edge_ord"), F.lit(None).cast(ORIGIN).alias("origin"))
    edges = inside.unionByName(left.select("project", F.col("caller").alias("src"), "dst", F.col("ord").alias("edge_ord"), "origin"))
    return distinct_edges(edges.where("src <> dst")), external_nodes(left.select("project", F.col("dst").alias("node_id"), "origin", "ord", "n"))


def build_graph(sources: DataFrame, projects: DataFrame | None = None, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, functions) of all projects and languages of a ``sources`` table, every file parsed once.

    Calls resolve within their project and language. ``projects``, ``packages``: of ``read_csproj_refs``.
    """
    from triage.operators import extract

    parsed = written(extract.parse_sources(sources), "parsed")
    functions, calls = extract.extract_functions(parsed), extract.extract_calls(parsed)
    inner = written(extract.extract_nodes(functions), "nodes")
    edges = nodes = None
    for lang, resolve in (("python", resolve_python), ("java", resolve_java), ("csharp", lambda c, n: resolve_csharp(c, n, projects, packages))):
        e, x = resolve(calls.where(F.col("lang") == lang), inner.where(F.col("lang") == lang))
        edges, nodes = (e, x) if edges is None else (edges.unionByName(e), nodes.unionByName(x))
    nodes = inner.unionByName(nodes.withColumn("is_test", F.lit(False)), allowMissingColumns=True)
    return written(nodes, "nodes"), written(edges, "edges"), functions


#: What a call and a declaration must have in common, tier by tier; ``n``: arguments.
_TIERS = (("ns", "type_name", "name", "n"), ("type_name", "name", "n"), ("name", "n"), ("ns", "type_name", "name"), ("type_name", "name"), ("name",))


def _tiered(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls that have a declaration, with ``tier``, the first that has any, and ``_nodes``, how many; declarations).

    Each tier's declarations are counted by what they must have in common with a call before calls meet
    them, so a name that many of both share makes no row a pair.
    """
    own = calls.withColumnRenamed("argc", "n")
    decls = nodes.select("project", "node_id", "name", "type_name", "ns", F.col("parameters").alias("n")).distinct()
    for i, keys in enumerate(_TIERS, 1):
        own = own.join(decls.groupBy("project", *keys).agg(F.countDistinct("node_id").alias(f"_n{i}")), ["project", *keys], "left")
    first = [F.when(F.col(f"_n{i}").isNotNull(), i) for i in range(1, len(_TIERS) + 1)]
    own = own.withColumns({"tier": F.coalesce(*first), "_nodes": F.coalesce(*[F.col(f"_n{i}") for i in range(1, len(_TIERS) + 1)])})
    return own.where("tier is not null").drop(*[f"_n{i}" for i in range(1, len(_TIERS) + 1)]), decls


def csharp_matches(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``project, call_id, node_id, tier`` of all declarations in the first tier that has any: (namespace, type, name, argument
    count), (type, name, count), (name, count), then the same three without the count.

    ``calls``: name, type_name, ns, argc. ``nodes``: name, type_name, ns, parameters. A call is joined by the keys of its tier alone.
    """
    own, decls = _tiered(calls.select("project", "call_id", "name", "type_name", "ns", "argc"), nodes)
    own, out = written(own, "tiers"), None
    for i, keys in enumerate(_TIERS, 1):
        got = own.where(F.col("tier") == i).select("project", "call_id", "tier", *keys).join(decls.select("project", "node_id", *keys), ["project", *keys]).select("project", "call_id", "node_id", "tier").distinct()
        out = got if out is None else out.unionByName(got)
    return out


def csharp_tier_counts(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``project, tier, calls, edges, targets``: distinct calls, (call, declaration) pairs and declarations of ``csharp_matches`` by tier.

    Calls alike in name, type, namespace and argument count resolve alike, so each such kind is resolved
    once and weighed by its calls; pairs are counted, not made. A ``call_id`` names one call site.
    """
    alike = ["name", "type_name", "ns", "argc"]
    own, decls = _tiered(calls.groupBy("project", *alike).agg(F.countDistinct("call_id").alias("_calls")), nodes)
    own = written(own, "tiers")
    sums = own.groupBy("project", "tier").agg(F.sum("_calls").alias("calls"), F.sum(F.col("_calls") * F.col("_nodes")).alias("edges"))
    hit = None
    for i, keys in enumerate(_TIERS, 1):
        met = decls.join(own.where(F.col("tier") == i).select("project", *keys).distinct(), ["project", *keys], "left_semi").groupBy("project").agg(F.countDistinct("node_id").alias("targets")).withColumn("tier", F.lit(i))
        hit = met if hit is None else hit.unionByName(met)
    return sums.join(hit, ["project", "tier"])


def origin_counts(uses: DataFrame) -> DataFrame:
    """``project, node_id, origins``: each external's (file, namespace, kind, symbol) with counts, most first; one struct a distinct origin."""
    key = ["project", "node_id", "file", "namespace", "kind", "symbol"]
    n = uses.groupBy(*key).agg(F.count("*").alias("count"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("_n"), "file", "namespace", "kind", "symbol")))
    return n.groupBy("project", "node_id").agg(F.transform(ranked, lambda x: F.struct(x["file"], x["namespace"], x["kind"], x["symbol"], (-x["_n"]).alias("count"))).alias("origins"))
