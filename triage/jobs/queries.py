"""Registered queries over the library's own operators, with the SQL they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage.functions import text as T
from triage.jobs.adapters import _FILES, WITH, tables
from triage.operators import callgraph as C
from triage.operators import extract as X
from triage.operators import hotspots as H
from triage.operators import locate as L
from triage.operators import paths as P
from triage.operators import report as R
from triage.operators import summary as S
from triage.operators import tagging as G
from triage.sources import results as I
from triage.sources.result_source import opened
from triage.sources.shared import shared_dir, written
from triage.streaming import status as St

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{WITH}{sql}"
        return f

    return register


# --- SQL that several oracles share ---------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ANSI = r"'(?:\x1B|#x1B)\[[0-9;]*[A-Za-z]'"
_TIDY = r"regexp_replace(regexp_replace(case when contains(path, '/') then path else replace(path, '.', '/') end, '/+', '/', 'g'), '^/|/$', '', 'g')"

#: raw -> path and the parts after it.
_SPLIT = """
, raws as (select distinct name as raw, replace(name, chr(92), '/') as s from results), cut as (
  select raw, case when contains(s, '::') then string_split(s, '::')[1] when contains(s, '#') then string_split(s, '#')[1]
      when contains(s, '.') then regexp_extract(s, '^(.*)\\.[^.]*$', 1) else s end as path,
    case when contains(s, '::') then string_split(s, '::')[2:] when contains(s, '#') then [string_split(s, '#')[2]]
      when contains(s, '.') then [regexp_extract(s, '\\.([^.]*)$', 1)] else []::varchar[] end as parts from raws)"""
_PYTHON = _SPLIT + f"""
, named as (select raw, array_to_string(list_prepend(case when ends_with({_TIDY}, '.py') then {_TIDY} else {_TIDY} || '.py' end, parts), '::') as id from cut)"""
_BARE = r"regexp_replace({}, '(?:\[[^\]]*\]|\([^\)]*\))+$', '')"
_MATCH = _PYTHON + f"""
, tokens as (select node_ord, node_id, string_split(node_id, '::')[-1] as token from nodes), idx as (select token, arg_min(node_id, node_ord) as node_id from tokens group by token)
, keyed as (select r.*, n.id, string_split(n.id, '::')[-1] as token from results r join named n on n.raw = r.name)
, matched as (select k.project, k.run_id, k.ord, k.name, k.status, k.message, coalesce(a.node_id, b.node_id, c.node_id, d.node_id) as node_id from keyed k
  left join nodes a on a.node_id = k.id
  left join nodes b on b.node_id = left(k.id, length(k.id) - length(k.token)) || {_BARE.format('k.token')}
  left join idx c on c.token = k.token left join idx d on d.token = {_BARE.format('k.token')})
, last as (select project, run_id, node_id, arg_max(status, ord) as status, regexp_replace(arg_max(message, ord) filter (where message <> ''), {_ANSI}, '', 'g') as error_message
  from matched where node_id is not null group by all)
, runs as (select distinct run_id from results)
, status as (select coalesce(t.run_id, l.run_id) as run_id, coalesce(t.node_id, l.node_id) as node_id, coalesce(l.status, 'not_executed') as status, l.error_message
  from (select run_id, node_id from nodes cross join runs where is_test) t full join last l on l.run_id = t.run_id and l.node_id = t.node_id)"""
_FAILED = _MATCH + ", failed as (select distinct s.node_id as test_id from status s join nodes n on n.node_id = s.node_id and n.is_test where s.status = 'failed')"

_SHOWN = r"""
, inner_idx as (select string_split(node_id, '::')[-1] as token, arg_min(node_id, node_ord) as node_id from nodes where type <> 'external' group by 1)
, attr as (select n.node_id, coalesce(i.node_id, n.node_id) as shown from nodes n left join inner_idx i on n.type = 'external'
    and i.token = regexp_replace(regexp_replace(n.node_id, '^(?:external|project|nuget)::', ''), '/\d+$', ''))
, step as (select a.node_id, a.shown, m.is_test, not contains('/' || lower(m.file), '/venv/') as keep from attr a join nodes m on m.node_id = a.shown)"""


#: Partial paths that the SQL keeps of a test at each hop, best bound and then least ids first. Far more than the five that are asked for.
_KEPT = 100


def _walk(down: bool, x: str = "") -> str:
    """The best paths by the same bound, hop by hop: all paths of a graph in which every node has some sixty neighbours can't be listed. ``x`` ends the names, so that one text can hold both directions."""
    a, b = ("src", "dst") if down else ("dst", "src")
    bounds = "".join(
        f", b{h}{x} as materialized (select g.node_id, greatest(0, coalesce(max(t.gain + p.b), 0)) as b from gains g left join edges e on e.{a} = g.node_id left join gains t on t.node_id = e.{b} left join b{h - 1}{x} p on p.node_id = e.{b} group by 1)\n"
        for h in range(1, 6)
    )
    hops = "".join(
        f""", l{j}{x} as materialized (select w.test_id, list_append(w.path, e.{b}) as path, case when g.keep then list_append(w.shown, g.shown) else w.shown end as shown, w.score + g.gain as score
  from l{j - 1}{x} w join edges e on e.{a} = w.path[-1] join gains g on g.node_id = e.{b} join b{6 - j}{x} p on p.node_id = e.{b} where not list_contains(w.path, e.{b})
  qualify row_number() over (partition by w.test_id order by w.score + g.gain + p.b desc, case when g.keep then list_append(w.shown, g.shown) else w.shown end, list_append(w.path, e.{b})) <= {_KEPT})
"""
        for j in range(1, 7)
    )
    return f"""
, {"" if x else "gains as materialized (select *, case when not keep then 0 when is_test then 1 else 1001 end as gain from step), "}b0{x} as (select node_id, 0 as b from gains){bounds}, l0{x} as (select f.test_id, [f.test_id] as path, case when g.keep then [g.shown] else []::varchar[] end as shown, g.gain as score from failed f join gains g on g.node_id = f.test_id)
{hops}, uniq{x} as (select distinct test_id, shown, score from ({" union all ".join(f"select * from l{j}{x}" for j in range(1, 7))}) where len(shown) >= {2 if down else 1})
, top5{x} as (select *, row_number() over (partition by test_id order by score desc, shown) as path_rank from uniq{x} qualify path_rank <= 5)
, best{x} as (select test_id, path_rank, {"shown" if down else "list_reverse(shown) as shown"}, array_to_string({"shown" if down else "list_reverse(shown)"}, '>') as steps, score // 1000 as non_test, len(shown) as len from top5{x})"""


def _reach(depth: int) -> str:
    """``near``: the hops from each failed test to each node it reaches, in the better of both directions."""
    out = ", r0 as materialized (select test_id as seed, test_id as node_id from failed)"
    for way, a, b in (("f", "src", "dst"), ("g", "dst", "src")):
        out += f", {way}0 as (select * from r0)"
        for d in range(1, depth + 1):
            seen = " union all ".join(f"select seed, node_id from {way}{k}" for k in range(d))
            out += f"\n, {way}{d} as materialized (select distinct w.seed, e.{b} as node_id from {way}{d - 1} w join edges e on e.{a} = w.node_id anti join ({seen}) s on s.seed = w.seed and s.node_id = e.{b})"
    every = " union all ".join(f"select seed, node_id, {d} as dist from {way}{d}" for way in "fg" for d in range(depth + 1))
    return f"{out}\n, near as (select seed, node_id, min(dist) as dist from ({every}) group by 1, 2)"


def _status(spark: SparkSession, sf_dir: str, *names: str, locations: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables named, and the status of nodes; locations of errors are worked out only where they are asked for."""
    t = tables(spark, sf_dir, "results", *names)
    return t, G.node_status(t["results"], t["nodes"], "python", locations)


def _failed(t: dict[str, DataFrame], status: DataFrame) -> DataFrame:
    tests = t["nodes"].where("is_test").select("project", "node_id")
    return status.where("status = 'failed'").join(tests, ["project", "node_id"], "left_semi").select("project", "run_id", F.col("node_id").alias("test_id"))


def _failed_tests(t: dict[str, DataFrame], status: DataFrame) -> DataFrame:
    return written(_failed(t, status).select("project", "test_id").distinct(), "failed")


# --- text -----------------------------------------------------------------------------------------


def _names(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = tables(spark, sf_dir, "results")["results"].select("name").distinct()
        return r.select("name", T.normalize_test_name(F.col("name"), lang).alias("id"))

    run.__name__ = f"normalize_names_{lang}"
    return run


query(_PYTHON + " select raw as name, id from named")(_names("python"))
_OWNER = """
, seg as (select raw, path, parts, list_filter(string_split(regexp_replace(replace(path, '.', '/'), '/+', '/', 'g'), '/'), lambda x: x <> '') as segs from cut)
, core as (select raw, parts, list_filter(segs, lambda x: lower(x) not in ('src', 'main', 'test', 'tests', 'java', 'csharp', 'bin', 'obj', 'build', 'target')) as core, segs,
   case when ends_with(lower(path), '.java') or ends_with(lower(path), '.cs') then regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') end as stem from seg)
, owned as (select raw, parts, coalesce(nullif(stem, ''), core[-1], segs[-1], 'Unknown') as owner from core)"""
for _lang, _ext in (("java", ".java"), ("csharp", ".cs")):
    query(_SPLIT + _OWNER + f" select raw as name, case when len(parts) > 0 then array_to_string(list_concat([owner || '{_ext}', owner], parts), '::') else owner || '{_ext}' end as id from owned")(_names(_lang))


@query(rf" select ord, regexp_replace({_STRIP.format('message')}, {_ANSI}, '', 'g') as message from results")
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "results")["results"].select("ord", T.clean_text(F.col("message")).alias("message"))


@query(r""" select distinct name, regexp_replace(name, '(?:\[[^\]]*\]|\([^\)]*\))+$', '') as bare,
 regexp_replace(regexp_replace(name, '(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})$', ''), '^\s+|\s+$', '', 'g') as once from results""")
def strip_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return tables(spark, sf_dir, "results")["results"].select("name", T.strip_param_suffix(n).alias("bare"), T.strip_params(n).alias("once")).distinct()


# --- tagging and counts ---------------------------------------------------------------------------


@query(_MATCH + """ select 'p' as project, s.run_id, count(*) as total_tests, count(*) filter (where s.status in ('passed', 'failed', 'skipped')) as executed_tests,
  count(*) filter (where s.status = 'passed') as passed_tests, count(*) filter (where s.status = 'failed') as failed_tests, count(*) filter (where s.status = 'skipped') as skipped_tests,
  count(*) filter (where s.status not in ('passed', 'failed', 'skipped')) as untagged_tests
from status s join nodes n on n.node_id = s.node_id and n.is_test group by s.run_id""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, status = _status(spark, sf_dir)
    return S.run_summary(status, t["nodes"])


@query(_MATCH + """ select 'p' as project, s.run_id, s.node_id as name, n.file, n.start_line as line, coalesce(s.error_message, '') as error, '' as doc
from status s join nodes n on n.node_id = s.node_id and n.is_test where s.status = 'failed'""")
def failed_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, status = _status(spark, sf_dir)
    return S.failed_detail(status, t["nodes"])


@query(_MATCH + " select project, run_id, ord, name from matched where node_id is null")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "results")
    return G.unmatched_results(t["results"], t["nodes"], "python")


@query(_MATCH + """, half as (select run_id <= '2024-01-15' as old, node_id, status, error_message, run_id from status where status <> 'not_executed')
, a as (select node_id, arg_max(status, run_id) as status, arg_max(error_message, run_id) as error_message from half where old group by 1)
, b as (select node_id, arg_max(status, run_id) as status, arg_max(error_message, run_id) as error_message from half where not old group by 1)
select 'p' as project, coalesce(a.node_id, b.node_id) as node_id, coalesce(b.status, a.status) as status, coalesce(b.error_message, a.error_message) as error_message from a full join b on a.node_id = b.node_id""")
def upsert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "results")
    got = G.last_status(G.match_results(t["results"], t["nodes"], "python"))
    side = lambda c: got.where(c).groupBy("project", "node_id").agg(F.max_by("status", "run_id").alias("status"), F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("run_id"))).alias("error_message"))
    return G.upsert_status(side("run_id <= '2024-01-15'"), side("run_id > '2024-01-15'"))


# --- graph ----------------------------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    t, status = _status(spark, sf_dir, "calls")
    return P.critical_paths(t["nodes"], t["calls"], _failed_tests(t, status), direction, key="node_ord").select("project", "test_id", "path_rank", F.array_join("steps", ">").alias("steps"), "non_test", "len")


_BEST = " select 'p' as project, test_id, path_rank::int as path_rank, steps, non_test::int as non_test, len::int as len from best"


@query(_FAILED + _SHOWN + _walk(False) + _BEST)
def critical_paths_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, "upstream")


@query(_FAILED + _SHOWN + _walk(True) + _BEST)
def critical_paths_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, "downstream")


_SIZE = ", size as (select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges)"
_K = "least(12, greatest(3, 3 + floor(9 * least(1.0, ln(1 + nodes) / ln(1201)))))"
_ALPHA = "(0.55::double + 0.30::double * least(1.0::double, edges / nodes::double / 8.0::double))"


def _hot(kind: str) -> str:
    return _FAILED + _SHOWN + _walk(True) + _SIZE + f"""
, each as (select test_id, path_rank, unnest(shown) as node, unnest(range(len(shown))) as pos from best)
, ends as (select e.test_id, e.path_rank, arg_max(n.node_id, e.pos) as fn, arg_max(n.file, e.pos) as file from each e join nodes n on n.node_id = e.node and not n.is_test and n.type <> 'external' group by 1, 2)
, u as (select test_id, count(distinct fn) as u from ends group by 1)
, freq as (select test_id, {kind} as key, count(*) as freq from ends group by 1, 2)
, r as (select *, row_number() over (partition by test_id order by freq desc, key) as rank from freq)
select 'p' as project, r.test_id, key, freq, rank::int as rank from r join u using (test_id), size where rank <= least({_K}, greatest(3, round_even({_ALPHA} * u, 0)))"""


def _hotspots(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    t, status = _status(spark, sf_dir, "calls")
    down = P.critical_paths(t["nodes"], t["calls"], _failed_tests(t, status), "downstream", key="node_ord")
    return H.hotspots(down, t["nodes"], P.graph_size(t["nodes"], t["calls"])).where(F.col("kind") == kind).drop("kind")


@query(_hot("fn"))
def hotspot_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hotspots(spark, sf_dir, "function")


@query(_hot("file"))
def hotspot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hotspots(spark, sf_dir, "file")


@query(_SIZE + f" select 'p' as project, nodes, edges, edges / nodes as avg_out, ({_K})::int as base_k, {_ALPHA} as alpha from size")
def base_k_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "calls")
    return P.graph_size(t["nodes"], t["calls"]).withColumns({"base_k": H.base_k(F.col("nodes")), "alpha": H.alpha(F.col("nodes"), F.col("edges"))})


@query(_FAILED + _reach(8) + " select 'p' as project, seed, node_id, dist::int as dist from near")
def graph_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, status = _status(spark, sf_dir, "calls")
    return P.graph_distance(t["calls"], _failed_tests(t, status).withColumnRenamed("test_id", "seed"), depth=8, nodes=t["nodes"], key="node_ord")


# --- locations, calls, reports ----------------------------------------------------------------------

_PLACES = (
    "\n, told as (select distinct ord, regexp_replace(message, " + _ANSI + ", '', 'g') as m from results where message <> '')\n"
    + ", found as (" + " union all ".join(
        f"select ord, {i} as p, unnest(range(len(regexp_extract_all(m, '{p}', 1)))) as k, unnest(regexp_extract_all(m, '{p}', 1)) as path, unnest(regexp_extract_all(m, '{p}', 2))::int as line from told" for i, p in enumerate(T.LOCATION_PATTERNS)
    ) + ")\n"
    + r""", chained as (select ord, p, k, regexp_replace(path, '^\s+|\s+$', '', 'g') as path, line,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(path, '^\s+|\s+$', '', 'g'), chr(92), '>'), '/', '>'), '::', '>'), '>+', '>', 'g'), '^\s*>|>\s*$', '', 'g'), '^\s+|\s+$', '', 'g'), '^[A-Za-z]:>', ''), '^\s+|\s+$', '', 'g') as c from found)
, pcut as (select *, list_filter(string_split(c, '>'), lambda x: x <> '') as s from chained)
, anchored as (select *, list_filter(list_transform(range(len(s)), lambda i: case when s[i + 1] in ('tests', 'src', 'source', 'app', 'lib') then i end), lambda i: i is not null)[1] as a from pcut)
, short as (select ord, p, k, path || ':' || line as raw, case when a is null then c else array_to_string(s[a + 1:], '>') end || '>' || line as chain from anchored)
, h as (select ord, chain, row_number() over (partition by ord, array_to_string(string_split(chain, '>')[-4:], '>') order by p, k) as n, p, k from short where chain not like '>%')
, r as (select ord, raw, row_number() over (partition by ord, raw order by p, k) as n, p, k from short)
, hs as (select ord, string_agg(chain, '|' order by p, k) as heuristic from h where n = 1 group by 1), rs as (select ord, string_agg(raw, '|' order by p, k) as raw_paths from r where n = 1 group by 1)"""
)


@query(_PLACES + " select t.ord, coalesce(heuristic, '') as heuristic, coalesce(raw_paths, '') as raw_paths from told t left join hs using (ord) left join rs using (ord)")
def error_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables(spark, sf_dir, "results")["results"].where("message <> ''")
    place = T.locate(T.strip_ansi(F.col("message")))
    return r.select("ord", F.array_join(place["heuristic"], "|").alias("heuristic"), F.array_join(place["raw_paths"], "|").alias("raw_paths"))


@query(_FAILED + _reach(6) + """
, cands as (select test_id, unnest([0, 1, 2, 3, 4]) as idx, unnest(['src>promo>red_widget.py>12', 'src>' || string_split(string_split(test_id, '::')[1], '/')[2] || '>' || string_split(string_split(test_id, '::')[1], '/')[3] || '>7', 'small>nowhere.py>3', 'rush>' || regexp_replace(string_split(test_id, '::')[2], '#', '') || '>5', string_split(string_split(test_id, '::')[1], '/')[2] || '>' || substr(string_split(string_split(test_id, '::')[1], '/')[3], 1, 7)]) as candidate from failed)
, best as (select c.test_id, c.idx, min(n.dist) as dist from cands c join near n on n.seed = c.test_id and contains(n.node_id, replace(regexp_replace(c.candidate, '>\\d+$', ''), '>', '/')) group by 1, 2)
select 'p' as project, c.test_id, c.idx::int as idx, c.candidate, b.dist::int as dist, row_number() over (partition by c.test_id order by b.dist nulls last, c.idx)::int as rank from cands c left join best b using (test_id, idx)""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates with a file ending, and two without: one that no node has, and the beginning of a path."""
    t, status = _status(spark, sf_dir, "calls")
    failed = _failed_tests(t, status)
    file = T.candidate_file(T.chain_plain(F.substring_index("test_id", "::", 1)))
    part = lambda n: F.try_element_at(F.split(F.substring_index("test_id", "::", 1), "/"), F.lit(n))
    brand = F.try_element_at(F.split("test_id", "::"), F.lit(2))
    named = F.array(F.lit("src>promo>red_widget.py>12"), F.concat(file, F.lit(">7")), F.lit("small>nowhere.py>3"), F.concat(F.lit("rush>"), F.replace(brand, F.lit("#"), F.lit("")), F.lit(">5")), F.concat(part(2), F.lit(">"), F.substring(part(3), 1, 7)))
    cands = written(failed.select("project", "test_id", F.posexplode(named).alias("idx", "candidate")), "candidates")
    return L.rank_in_graph(cands, t["nodes"], t["calls"], 6, "node_ord")


_DECLS = ", decls as (select 'p' as project, concat('d', p_partkey) as node_id, split_part(p_name, ' ', 2) as name, split_part(p_name, ' ', 1) as type_name, p_brand as ns, (p_size % 4)::int as parameters from part where p_type <> 'PROMO')"
_SITES = ", sites as (select 'p' as project, concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) as call_id, split_part(p_name, ' ', 2) as name, case when l_suppkey % 3 = 0 then null else split_part(p_name, ' ', 1) end as type_name, case when l_linenumber % 2 = 0 then p_brand else 'none' end as ns, (l_linenumber % 5)::int as argc, concat('src/c', l_suppkey % 10, '.cs') as file from lineitem join part on p_partkey = l_partkey)"


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables(spark, sf_dir)
    decls = spark.sql("select 'p' as project, concat('d', p_partkey) as node_id, split_part(p_name, ' ', 2) as name, split_part(p_name, ' ', 1) as type_name, p_brand as ns, cast(p_size % 4 as int) as parameters from part where p_type <> 'PROMO'")
    sites = spark.sql("select 'p' as project, concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) as call_id, split_part(p_name, ' ', 2) as name, case when l_suppkey % 3 = 0 then null else split_part(p_name, ' ', 1) end as type_name, case when l_linenumber % 2 = 0 then p_brand else 'none' end as ns, cast(l_linenumber % 5 as int) as argc, concat('src/c', l_suppkey % 10, '.cs') as file from lineitem join part on p_partkey = l_partkey")
    return decls, sites


@query(_DECLS + _SITES + """, m as (select s.call_id, d.node_id, case when s.type_name = d.type_name and s.ns = d.ns then 1 when s.type_name = d.type_name then 2 else 3 end + case when s.argc = d.parameters then 0 else 3 end as tier from sites s join decls d on s.name = d.name)
, b as (select call_id, min(tier) as tier from m group by 1), w as (select distinct m.call_id, m.tier, m.node_id from m join b using (call_id, tier))
select tier::int as tier, count(distinct call_id) as calls, count(*) as edges, count(distinct node_id) as targets from w group by 1""")
def call_resolution_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls, sites = _calls(spark, sf_dir)
    return C.csharp_tier_counts(sites, decls).drop("project")


@query(_SITES + """, n as (select 'external::' || name || '/' || argc as node_id, file, ns, name, count(*) as c from sites group by all)
select node_id, string_agg(file || ' ' || ns || ' ' || name || ' ' || c, '|' order by c desc, file, ns, name) as origins from n group by 1""")
def external_origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sites = _calls(spark, sf_dir)
    uses = sites.select("project", F.concat(F.lit("external::"), "name", F.lit("/"), F.col("argc").cast("string")).alias("node_id"), "file", F.col("ns").alias("namespace"), F.lit("method").alias("kind"), F.col("name").alias("symbol"))
    text = F.array_join(F.transform("origins", lambda o: F.concat_ws(" ", o["file"], o["namespace"], o["symbol"], o["count"].cast("string"))), "|")
    return C.origin_counts(uses).select("node_id", text.alias("origins"))


_ALIAS = " ".join(f"when '{a}' then '{b}'" for a, b in T.FAILURE_ALIASES.items())
_NORM = "case string_split(trim({0}), '.')[-1] " + _ALIAS + " else string_split(trim({0}), '.')[-1] end"
_TYPED = f", typed as (select *, coalesce(nullif({_NORM.format('failure_type')}, ''), {_NORM.format(chr(34) + 'head' + chr(34))}) as kind from (select *, string_split(error, ':')[1] as head from analysis))"


@query(_TYPED + " select project, run_id, coalesce(nullif(kind, ''), 'Other') as type, count(*) as count from typed group by all")
def failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.failure_types(tables(spark, sf_dir, "analysis")["analysis"])


@query(_TYPED + """, sev as (select *, coalesce(nullif(kind, ''), 'Other') as g, case when lower(trim(severity)) in ('low', 'medium', 'high') then lower(trim(severity)) else 'medium' end as risk from typed)
, f as (select run_id, g, count(*) as n from sev group by 1, 2), t as (select run_id, count(*) as t from sev group by 1)
select 'p' as project, run_id, ord, test_name, risk, round(greatest(0::double, least(1::double, n / t::double + case risk when 'low' then 0.05::double when 'medium' then 0.10::double else 0.20::double end
   + concat('0x', substr(md5(test_name || '::' || kind), 1, 8))::ubigint / 4294967295.0::double * 0.02::double)) * 100, 2) as probability,
  case risk when 'low' then 30.0::double when 'medium' then 65.0::double else 90.0::double end as impact, greatest(8, least(22, 8 + 2 * path_len))::int as r
from sev join f using (run_id, g) join t using (run_id)""")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.risk_scores(tables(spark, sf_dir, "analysis")["analysis"])


_A = {k: v.replace("'", "''") for k, v in R.ADVICE.items()}


@query(f""", o as (select *, {_NORM.format('failure_type')} as kind from analysis), f as (select run_id, kind, count(*) as n from o where kind <> '' group by 1, 2)
select 'p' as project, run_id, ord, string_split(test_name, '::')[-1] as title, case when trim(bullet) <> '' then trim(bullet) else concat_ws('|',
  case when kind in ('AssertionError', 'DataMismatch') then '{_A['contract']}' when kind in ('AttributeError', 'NullPointerException', 'Configuration') then '{_A['boundary']}' when kind in ('Timeout', 'Network') then '{_A['timing']}' when kind = 'Mocking' then '{_A['mocking']}' else '{_A['other']}' end,
  case lower(trim(severity)) when 'high' then '{_A['high']}' when 'medium' then '{_A['medium']}' else '{_A['low']}' end, case when n >= 2 then '{_A['again']}' end) end as detail
from o left join f using (run_id, kind)""")
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables(spark, sf_dir, "analysis")["analysis"].withColumn("insight_bullets", F.array("bullet"))
    return R.insights(a).withColumn("detail", F.array_join("detail", "|"))


def _module_function(c: str) -> Column:
    n = lambda m: (F.col(c) % m).cast("string")
    return F.concat(F.lit("src/mod_"), n(5), F.lit(".py::T::f"), n(40))


def _module_functions(spark: SparkSession) -> DataFrame:
    """The functions that orders name; the line of every other one isn't known."""
    line = F.when(F.col("o_orderkey") % 40 < 20, (F.col("o_orderkey") % 40 + 1).cast("int"))
    return spark.table("orders").select(F.lit("p").alias("project"), _module_function("o_orderkey").alias("key"), line.alias("line")).distinct()


def _locus(functions, suspects):
    none = F.array().cast("array<string>")
    return F.struct(none.alias("files"), F.coalesce(functions, none).alias("functions"), suspects.cast("array<string>").alias("suspects"))


@query(""", locus as (select *, concat('src/mod_', ord % 5, '.py::T::f', ord % 40) as f1, concat('src/mod_', ord % 3, '.py::g') as f2 from analysis)
, fn as (select distinct concat('src/mod_', o_orderkey % 5, '.py::T::f', o_orderkey % 40) as key, case when o_orderkey % 40 < 20 then (o_orderkey % 40 + 1)::int end as line from orders)
, l as (select x.*, 'src/mod_' || (ord % 5) || '.py' || case when a.line is null then '' else '>' || a.line end as l1, 'src/mod_' || (ord % 3) || '.py' as l2 from locus x left join fn a on a.key = x.f1)
select 'p' as project, run_id, ord, case when l1 = l2 then l1 else l1 || '|' || l2 end as locations from l""")
def locus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables(spark, sf_dir, "analysis")["analysis"]
    fns = _module_functions(spark)
    a = a.withColumn("locus", _locus(F.array(_module_function("ord"), F.concat(F.lit("src/mod_"), (F.col("ord") % 3).cast("string"), F.lit(".py::g"))), F.array()))
    return R.locus_locations(a, fns).withColumn("locations", F.array_join("locations", "|"))


@query(_MATCH + """ select 'p' as project, s.run_id, concat('Total: ', count(*), ' | Passed: ', count(*) filter (where s.status = 'passed'), ' | Failed: ', count(*) filter (where s.status = 'failed'), ' | Skipped: ', count(*) filter (where s.status = 'skipped'),
  case when count(*) filter (where s.status = 'failed') > 0 then chr(10) || 'Failures:' || chr(10) || string_agg('  - ' || s.node_id || ': ' || coalesce(nullif(s.error_message, ''), '<no message>'), chr(10) order by s.node_id) filter (where s.status = 'failed') else '' end) as text
from status s join nodes n on n.node_id = s.node_id and n.is_test group by s.run_id""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, status = _status(spark, sf_dir)
    status = written(status, "status")
    return R.prompt_summary(S.run_summary(status, t["nodes"]), S.failed_detail(status, t["nodes"]))


#: Functions of parts: some under a node's own file, some under an ending of its path or a longer path, some under another path with the same file name; decoys beside them.
FUNCTIONS = """
select 'p' as project, f.file, f.key, f.line, concat('about ', f.key) as docstring, concat('def ', f.key, chr(10), '  return ', f.file) as code from (
  select file, concat(p_brand, '::f', p_partkey) as key, 10 as line from n where p_partkey % 5 in (0, 1)
  union all select substr(file, 5), concat('f', p_partkey), 20 from n where p_partkey % 5 in (1, 2)
  union all select concat('deep/', file), concat('Other::f', p_partkey), 30 from n where p_partkey % 5 in (2, 3)
  union all select concat('x/', upper(base)), concat(p_brand, '::f', p_partkey), 40 from n where p_partkey % 5 in (3, 4) and p_partkey % 2 = 0
  union all select concat('z/', base), concat('f', p_partkey), 50 from n
  union all select concat('z/y/', base), concat('Far::f', p_partkey), 60 from n where p_partkey % 3 = 0) f
"""
_PARTS = "select p_partkey, p_brand, n.file, concat(replace(p_name, ' ', '_'), '.py') as base from part join nodes n on n.node_ord = p_partkey where not n.is_test and p_partkey % 17 <> 0"
_CRITICAL = """, n as (""" + _PARTS + "), fn as (" + FUNCTIONS + """), cand as (
  select o.node_id, f.*, case when f.file = o.file then 1 when ends_with(o.file, '/' || f.file) or ends_with(f.file, '/' || o.file) then 2 else 3 end as w,
    case when f.key = o.brand || '::' || o.method then 1 when ends_with(f.key, '::' || o.method) then 2 else 3 end as t
  from (select node_id, file, string_split(node_id, '::')[-1] as method, string_split(node_id, '::')[-2] as brand from nodes where not is_test) o
  join fn f on lower(string_split(f.file, '/')[-1]) = lower(string_split(o.file, '/')[-1]) and string_split(f.key, '::')[-1] = o.method)
, found as (select * from cand qualify row_number() over (partition by node_id order by w, t, line, key, file) = 1)"""


def _functions(spark: SparkSession) -> DataFrame:
    """``FUNCTIONS`` over the views of ``tables``."""
    return spark.sql(f"with n as ({_PARTS}) {FUNCTIONS.replace('chr(', 'char(')}")


@query(_CRITICAL + " select 'p' as project, node_id, file, key, line, docstring, code from found")
def critical_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    paths = t["nodes"].groupBy("project", (F.col("node_ord") % 50).alias("k")).agg(F.collect_list("node_id").alias("steps"))
    none = spark.createDataFrame([], "project string, kind string, key string")
    return R.critical_functions(paths, none, t["nodes"], _functions(spark))


_BOTH = _FAILED + _SHOWN + _walk(True) + _walk(False, "_up")
_PROMPTS = _BOTH + f""", fails as (select s.run_id, s.node_id as test_id, n.file, n.start_line, nullif(s.error_message, '') as error from status s join nodes n on n.node_id = s.node_id and n.is_test where s.status = 'failed')
, sides as (select test_id, 'Upstream:' || chr(10) || string_agg('  • ' || array_to_string(shown, ' → '), chr(10) order by path_rank) as up, null::varchar as down from best_up group by 1
  union all select test_id, null::varchar, 'Downstream:' || chr(10) || string_agg('  • ' || array_to_string(shown, ' → '), chr(10) order by path_rank) from best group by 1)
, bodies as (select test_id, concat_ws(chr(10), max(up), max(down)) as body from sides group by 1)
, told as (select run_id, string_agg(concat_ws(chr(10), 'Test: ' || test_id, 'Error: ' || error, body), chr(10) order by test_id) as paths from fails join bodies using (test_id) group by 1)"""


def _hotspot_sql() -> str:
    """``hot``: the ranked hotspots of each test, both kinds."""
    return _SIZE + f""", each as (select test_id, path_rank, unnest(shown) as node, unnest(range(len(shown))) as pos from best)
, ends as (select e.test_id, e.path_rank, arg_max(n.node_id, e.pos) as fn, arg_max(n.file, e.pos) as file from each e join nodes n on n.node_id = e.node and not n.is_test and n.type <> 'external' group by 1, 2)
, u as (select test_id, count(distinct fn) as u from ends group by 1)
, freq as (select test_id, 'function' as kind, fn as key, count(*) as freq from ends group by all union all select test_id, 'file', file, count(*) from ends group by all)
, hot as (select r.* from (select *, row_number() over (partition by test_id, kind order by freq desc, key) as rank from freq) r join u using (test_id), size where rank <= least({_K}, greatest(3, round_even({_ALPHA} * u, 0))))"""


def _run_parts(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tables, status, failed tests of runs, best paths of both directions, hotspots)."""
    t, status = _status(spark, sf_dir, "calls")
    status = written(status, "status")
    failed = written(_failed(t, status), "failed")
    tests = failed.select("project", "test_id").distinct()
    down = written(P.critical_paths(t["nodes"], t["calls"], tests, "downstream", key="node_ord"), "down")
    both = down.unionByName(P.critical_paths(t["nodes"], t["calls"], tests, "upstream", key="node_ord"))
    return t, status, failed, written(both, "paths"), H.hotspots(down, t["nodes"], P.graph_size(t["nodes"], t["calls"]))


@query(_PROMPTS + _hotspot_sql() + _CRITICAL + """
, tops as (select test_id, coalesce(string_agg(key, ', ' order by rank) filter (where kind = 'function' and rank <= 5), '') as fns, coalesce(string_agg(key, ', ' order by rank) filter (where kind = 'file' and rank <= 5), '') as files from hot group by 1)
, hots as (select run_id, string_agg('- ' || test_id || chr(10) || '  functions: ' || fns || chr(10) || '  files: ' || files, chr(10) order by test_id) as hotspots from fails join tops using (test_id) group by 1)
, used as (select distinct f.run_id, unnest(b.shown) as node_id from fails f join (select test_id, shown from best union all select test_id, shown from best_up) b using (test_id))
, snips as (select run_id, string_agg(node_id || ' (line ' || line || '):' || chr(10) || docstring || chr(10) || '    ' || replace(code, chr(10), chr(10) || '    '), chr(10) order by node_id) as snippets from used join found using (node_id) group by 1)
, heads as (select s.run_id, concat('Total: ', count(*), ' | Passed: ', count(*) filter (where s.status = 'passed'), ' | Failed: ', count(*) filter (where s.status = 'failed'), ' | Skipped: ', count(*) filter (where s.status = 'skipped'),
  case when count(*) filter (where s.status = 'failed') > 0 then chr(10) || 'Failures:' || chr(10) || string_agg('  - ' || s.node_id || ': ' || coalesce(nullif(s.error_message, ''), '<no message>'), chr(10) order by s.node_id) filter (where s.status = 'failed') else '' end) as head
  from status s join nodes n on n.node_id = s.node_id and n.is_test group by s.run_id)
select 'p' as project, run_id, concat_ws(chr(10) || chr(10), 'Explain.', head, 'CRITICAL PATHS:' || chr(10) || paths, 'HOTSPOTS:' || chr(10) || hotspots, 'FUNCTIONS:' || chr(10) || snippets, 'EXAMPLES:' || chr(10) || 'INPUT:' || chr(10) || 'in' || chr(10) || 'OUTPUT:' || chr(10) || 'out') as text
from heads left join told using (run_id) left join hots using (run_id) left join snips using (run_id)""")
def full_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prompt of each run: counts, failures, paths, hotspots, functions and an example."""
    t, status, failed, paths, hot = _run_parts(spark, sf_dir)
    detail = written(S.failed_detail(status, t["nodes"]), "detail")
    own = paths.join(failed.hint("merge"), ["project", "test_id"]).select("project", "run_id", "test_id", "direction", "path_rank", "steps")
    found = R.critical_functions(paths.select("project", "steps"), hot.select("project", "kind", "key"), t["nodes"], _functions(spark))
    fn = own.select("project", "run_id", F.explode("steps").alias("node_id")).distinct().join(found, ["project", "node_id"])
    example = spark.createDataFrame([("p", "python", 1, "in", "out")], "project string, lang string, ord long, input string, output string")
    return R.run_prompts(S.run_summary(status, t["nodes"]), detail, own, hot.join(failed.hint("merge"), ["project", "test_id"]), fn, example, "Explain.")


@query(_PROMPTS + _hotspot_sql() + """
, lists as (select test_id, string_agg(key, ',' order by rank) filter (where kind = 'function') as fns, string_agg(key, ',' order by rank) filter (where kind = 'file') as files from hot group by 1)
, ways as (select test_id, (select string_agg(steps, '|' order by path_rank) from best_up b where b.test_id = f.test_id) as up, (select string_agg(steps, '|' order by path_rank) from best b where b.test_id = f.test_id) as down from failed f)
select 'p' as project, run_id, nodes, edges, (select count(*) from status s join nodes n on n.node_id = s.node_id and n.is_test where s.run_id = f.run_id) as total, count(*) as failed_tests,
  string_agg(test_id || ' ' || file || ' ' || start_line || ' ' || coalesce(error, ''), ';' order by test_id) as failures, string_agg(test_id || ' ' || coalesce(error, '') || ' ' || coalesce(up, '') || ' ' || coalesce(down, ''), ';' order by test_id) as paths,
  string_agg(test_id || ' ' || fns || ' ' || files, ';' order by test_id) filter (where fns is not null) as hotspots
from fails f join ways using (test_id) left join lists using (test_id), size group by run_id, nodes, edges""")
def structured_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured prompt of each run with a failure, its parts read from the pages of the JSON document."""
    t, status, failed, paths, hot = _run_parts(spark, sf_dir)
    failed = failed.hint("merge")
    enriched = P.enriched_steps(paths, t["nodes"], status, failed, t["calls"])
    docs = R.structured_prompt(S.run_summary(status, t["nodes"]), S.failed_detail(status, t["nodes"]), enriched, hot.join(failed, ["project", "test_id"]), P.graph_size(t["nodes"], t["calls"]))
    way = "array<array<struct<node:string>>>"
    d = F.from_json("document", f"graph struct<nodes:long,edges:long>, summary struct<total_tests:long,failed_tests:long,failed_detail:array<struct<name:string,file:string,line:int,error:string>>>, critical_paths array<struct<test_id:string,error:string,upstream:{way},downstream:{way}>>, hotspots array<struct<test_id:string,functions:array<string>,files:array<string>>>")
    steps = lambda c: F.coalesce(F.array_join(F.transform(c, lambda p: F.array_join(F.transform(p, lambda s: s["node"]), ">")), "|"), F.lit(""))
    texts = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<string>"))
    parts = {
        "failures": texts("d.summary.failed_detail", lambda x: F.concat_ws(" ", x["name"], x["file"], x["line"].cast("string"), x["error"])),
        "paths": texts("d.critical_paths", lambda x: F.concat_ws(" ", x["test_id"], F.coalesce(x["error"], F.lit("")), steps(x["upstream"]), steps(x["downstream"]))),
        "hotspots": texts("d.hotspots", lambda x: F.concat_ws(" ", x["test_id"], F.array_join(x["functions"], ","), F.array_join(x["files"], ","))),
    }
    keys = ["project", "run_id", "nodes", "edges", "total", "failed_tests"]
    got = docs.select("project", "run_id", "page", d.alias("d"))
    lists = got.select("project", "run_id", "d.graph.nodes", "d.graph.edges", F.col("d.summary.total_tests").alias("total"), "d.summary.failed_tests", "page", F.arrays_zip(*[x.alias(c) for c, x in parts.items()]).alias("rows"))
    each = lists.select(*keys, "page", F.posexplode_outer("rows").alias("pos", "row")).select(*keys, "page", "pos", *[F.col("row").getField(c).alias(c) for c in parts])
    return R.joined_texts(each, keys, list(parts), ["page", "pos"], ";").where("failed_tests > 0")  # here, since pages would be parsed once more for it


# --- documents and round trips -----------------------------------------------------------------------


@query(""", c as (select doc_id, coalesce(text, '') as t from documents) select doc_id, len(regexp_extract_all(t, 'th'))::int as total, len(regexp_extract_all(t, 'The'))::int as failed,
 (len(regexp_extract_all(t, 'th')) - len(regexp_extract_all(t, 'The')))::int as passed from c""".replace("'th'", "'test_'").replace("'The'", "'FAIL'"))
def console_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir)
    got = T.console_counts(F.col("text"))
    return spark.table("documents").select("doc_id", got["total"].alias("total"), got["failed"].alias("failed"), got["passed"].alias("passed"))


@query(""" select doc_id, array_to_string(case when len(l) > 10 then list_append(l[1:10], '    ...') else l end, chr(10)) as code from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.table("documents").select("doc_id", T.snippet(F.col("text")).alias("code"))


@query(""" select lang, doc_id as ord, n_chars from (select *, row_number() over (partition by lang order by doc_id) as n from documents where trim(coalesce(text, '')) <> '') where n <= 3""")
def first_n_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir)
    d = spark.table("documents").select("lang", F.col("doc_id").alias("ord"), F.col("text").alias("input"), F.col("text").alias("output"), "n_chars")
    return I.first_examples(d, 3).select("lang", "ord", "n_chars")


_TRIP = " select run_id as file, (row_number() over (partition by run_id order by ord) - 1)::bigint as ord, name, status, trim(regexp_replace(message, " + _ANSI + ", '', 'g'), ' ' || chr(10)) as message from results"


#: Records of a result file.
_PER_FILE = 500


def _in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's records in order, as arrays of a file each (``file``, ``part``, ``rows``): a bounded number of records in each."""
    r = tables(spark, sf_dir, "results")["results"].withColumn("part", F.floor(F.col("ord") / _PER_FILE))
    return r.groupBy(F.col("run_id").alias("file"), "part").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "status", "message"))).alias("rows"))


def _joined(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records of the files of a run (``file`` as run and part) with their place in the run."""
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a file
    own = parts.withColumns({"part": F.substring_index("file", "/", -1).cast("long"), "file": F.substring_index("file", "/", 1)})
    return own.join(base, ["file", "part"]).withColumn("ord", F.col("ord") + F.col("base")).drop("part", "base")


@query(_TRIP)
def pytest_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(_in_files(spark, sf_dir), "files")
    items = F.transform("rows", lambda x: F.struct(x["name"].alias("nodeid"), x["status"].alias("outcome"), x["message"].alias("longrepr")))
    texts = files.select(F.concat("file", F.lit("/"), F.col("part").cast("string")).alias("file"), F.try_parse_json(F.to_json(F.struct(items.alias("tests")))).alias("v"))
    return _joined(I.json_records(texts, "pytest").drop("dialect"), files.select("file", "part", F.size("rows").alias("n"))).select("file", "ord", "name", "status", "message")


@query(_TRIP.replace("name, status", "concat('T::', name) as name, status").replace("trim(regexp_replace(message, " + _ANSI + ", '', 'g'), ' ' || chr(10)) as message", "case when status = 'failed' then regexp_extract(message, 'AssertionError: [0-9.]*') else '' end as message"))
def junit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(_in_files(spark, sf_dir), "files")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    case = lambda x: F.concat(F.lit('<testcase classname="T" name="'), esc(x["name"]), F.lit('">'), F.when(x["status"] == "failed", F.concat(F.lit('<failure message="'), esc(F.regexp_extract(x["message"], "AssertionError: [0-9.]*", 0)), F.lit('"/>'))).when(x["status"] == "skipped", "<skipped/>").otherwise(""), F.lit("</testcase>"))
    cases = files.select(F.concat("file", F.lit("/"), F.col("part").cast("string")).alias("file"), F.posexplode(F.transform("rows", case)).alias("ord", "x"))
    got = cases.select("file", F.col("ord").cast("long").alias("ord"), F.from_xml("x", I.JUNIT, {"rowTag": "testcase"}).alias("r")).select("file", "ord", "r.*")
    return _joined(got.select("file", "ord", *I.junit_fields()), files.select("file", "part", F.size("rows").alias("n"))).select("file", "ord", "name", "status", "message")


@query(""" select 'p' as project, run_id, case when ord % 2 = 0 then 'junit' else 'pytest' end as dialect, case when ord % 2 = 0 then concat('T::', name) else name end as name, status,
  case when ord % 2 = 1 then trim(regexp_replace(message, """ + _ANSI + """, '', 'g'), ' ' || chr(10)) when status = 'failed' then regexp_extract(message, 'AssertionError: [0-9.]*') else '' end as message from results""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JUnit and JSON files of many runs, and read by one call."""
    r = tables(spark, sf_dir, "results")["results"]
    top = f"{shared_dir(spark)}/triage/result-files-{uuid.uuid4().hex}"
    failure = F.when(F.col("status") == "failed", F.struct(F.regexp_extract("message", "AssertionError: [0-9.]*", 0).alias("_message")))
    cases = r.where("ord % 2 = 0").select("project", "run_id", F.lit("T").alias("_classname"), F.col("name").alias("_name"), failure.alias("failure"), F.when(F.col("status") == "skipped", "").alias("skipped"))
    cases.write.format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").option("maxRecordsPerFile", _PER_FILE).partitionBy("project", "run_id").save(top)
    lists = r.where("ord % 2 = 1").groupBy("project", "run_id", F.floor(F.col("ord") / _PER_FILE)).agg(F.collect_list(F.struct("name", "status", "message")).alias("tests"))
    lists.select("project", "run_id", "tests").write.mode("append").option("maxRecordsPerFile", 1).partitionBy("project", "run_id").json(top)
    return I.load_results(spark, top)[0].select("project", "run_id", "dialect", "name", "status", "message")


#: Records of a run are dealt to files by their number, so many of them at most in each.
_RUN_PART = 5000
#: Every so many records one is broken; of files of no known kind every fourth as a whole.
_BROKEN, _BROKEN_FILE = 97, 4


def _put(files: DataFrame, top: str) -> None:
    """Writes ``path, content`` as files below ``top``; a task that runs again writes the same ones."""

    def write(rows) -> None:
        store, inner, _ = opened(top)
        for r in rows:
            path = f"{inner}/{r['path']}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(r["content"].encode())

    files.select("path", "content").foreachPartition(write)


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _written_records(r: DataFrame) -> DataFrame:
    """``record`` (and for TRX ``defined``) of each row, spelt in the dialect ``kind``; every so many one that can't be read."""
    name, said, broken = _escaped(F.col("name")), F.when(F.col("status") == "failed", F.regexp_extract("message", "AssertionError: [0-9.]*", 0)).otherwise(""), F.col("ord") % _BROKEN == 0
    word = lambda *w: F.when(F.col("status") == "failed", w[0]).when(F.col("status") == "skipped", w[1]).otherwise(w[2])
    failure = F.when(F.col("status") == "failed", F.concat(F.lit("<failure><message>"), said, F.lit("</message></failure>"))).otherwise("")
    lit = F.lit
    spelt = {
        "junit": (F.concat(lit('<testcase name="'), name, lit('">'), F.when(F.col("status") == "failed", F.concat(lit('<failure message="'), said, lit('"/>'))).when(F.col("status") == "skipped", "<skipped/>").otherwise(""), lit("</testcase>")), '<testcase name="a & b"/>'),
        "nunit": (F.concat(lit('<test-case fullname="'), name, lit('" result="'), word("Failed", "Skipped", "Passed"), lit('">'), failure, lit("</test-case>")), '<test-case fullname="a & b" result="Passed"/>'),
        "xunit": (F.concat(lit('<test name="'), name, lit('" type="A" method="m" result="'), word("Fail", "Skip", "Pass"), lit('">'), failure, lit("</test>")), '<test name="x" type="A" result="Pass"><failure></test>'),
        "trx": (F.concat(lit('<t:UnitTestResult testId="'), F.col("ord").cast("string"), lit('" testName="other" outcome="'), word("Failed", "NotExecuted", "Passed"), lit('"><t:Output><t:ErrorInfo><t:Message>'), said, lit("</t:Message></t:ErrorInfo></t:Output></t:UnitTestResult>")), '<t:UnitTestResult testId="1" outcome="a & b"/>'),
        "pytest": (F.to_json(F.struct(F.col("name").alias("nodeid"), F.col("status").alias("outcome"), said.alias("longrepr"))), "17"),
        "json": (F.to_json(F.struct("name", "status", said.alias("message"))), '"text"'),
        "universal": (F.concat(lit('<thing name="'), name, lit('" status="'), F.col("status"), lit('"><message>'), said, lit("</message></thing>")), None),
    }
    record = F.lit(None).cast("string")
    for kind, (good, bad) in spelt.items():
        record = F.when(F.col("kind") == kind, F.when(broken, bad).otherwise(good) if bad else good).otherwise(record)
    defined = F.concat(lit('<t:UnitTest id="'), F.col("ord").cast("string"), lit('"><t:TestMethod className="NS" name="'), name, lit('"/></t:UnitTest>'))
    return r.withColumns({"record": record, "defined": F.when(F.col("kind") == "trx", defined).otherwise("")})


#: What stands before and after the records of a file, by dialect, what joins them, and the file's ending.
_FRAMES = {
    "junit": ("<testsuites><testsuite>", "</testsuite></testsuites>", "", "xml"), "nunit": ("<test-run><test-suite>", "</test-suite></test-run>", "", "xml"), "xunit": ("<assemblies><assembly><collection>", "</collection></assembly></assemblies>", "", "xml"),
    "trx": ("</t:TestDefinitions><t:Results>", "</t:Results></t:TestRun>", "", "trx"), "pytest": ('{"tests": [', "]}", ", ", "json"), "json": ("[", "]", ", ", "json"), "universal": ("<r>", "</r>", "", "xml"),
}


def _spelt_files(r: DataFrame) -> DataFrame:
    """``path, content`` of files of a run and dialect; ``r``: records with their ``kind``."""
    rows = _written_records(r.withColumn("part", F.floor(F.col("ord") / _RUN_PART)))
    each = rows.groupBy("project", "run_id", "kind", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "record", "defined"))).alias("rows"))
    frame = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in _FRAMES.items() for x in (k, v[i])]), F.col("kind"))
    texts = lambda c, by: F.array_join(F.transform("rows", lambda x: x[c]), by)
    before = F.when(F.col("kind") == "trx", F.concat(F.lit('<t:TestRun xmlns:t="urn:t"><t:TestDefinitions>'), texts("defined", ""))).otherwise("")
    inner = F.when(frame(2) == "", texts("record", "")).otherwise(texts("record", ", "))
    after = F.when((F.col("kind") == "universal") & (F.col("part") % _BROKEN_FILE == 1), "<open></r>").otherwise(frame(1))
    path = F.concat_ws("/", "project", "run_id", F.concat(F.col("kind"), F.lit("-"), F.lpad(F.col("part").cast("string"), 6, "0"), F.lit("."), frame(3)))
    return each.select("kind", path.alias("path"), F.concat(before, frame(0), inner, after).alias("content"))


_KINDS = ("junit", "nunit", "xunit", "trx", "pytest", "json", "universal")
_KIND_SQL = "case ord % 7 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS)) + " end"


@query(f""", k as (select *, {_KIND_SQL} as kind, ord // {_RUN_PART} as part, case when status = 'failed' then regexp_extract(message, 'AssertionError: [0-9.]*') else '' end as said from results)
, lost as (select *, kind = 'universal' and part % {_BROKEN_FILE} = 1 as whole, kind <> 'universal' and ord % {_BROKEN} = 0 as one from k)
select project, run_id, kind as dialect, case kind when 'trx' then 'NS.' || name else name end as name, status, said as message from lost where not whole and not one
union all select project, run_id, 'reject', '', '', '' from lost where one
union all select distinct on (run_id, part) project, run_id, 'reject', '', '', '' from lost where whole""")
def dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records spelt as files of all seven dialects, broken ones among them, and read by one call (generic JSON, which is pytest's in a mixed folder, by its own reader)."""
    r = tables(spark, sf_dir, "results")["results"].withColumn("kind", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("ord") % 7 + 1).cast("int")))
    top = f"{shared_dir(spark)}/triage/dialects-{uuid.uuid4().hex}"
    files = _spelt_files(r)
    _put(files.withColumn("path", F.concat(F.when(F.col("kind") == "json", "generic/").otherwise("mixed/"), "path")), top)
    results, rejects = I.load_results(spark, f"{top}/mixed")
    generic = written(I.result_rows(spark, f"{top}/generic", "json"), "generic")
    lost = lambda df, at: df.select(I.folder(I.relative(F.col("file"), at), 1).alias("project"), I.folder(I.relative(F.col("file"), at), 2).alias("run_id"), F.lit("reject").alias("dialect"), *[F.lit("").alias(c) for c in ("name", "status", "message")])
    own = ["project", "run_id", "dialect", "name", "status", "message"]
    good = results.select(*own).unionByName(I.located_records(generic, f"{top}/generic").select(*own))
    return good.unionByName(lost(rejects, f"{top}/mixed")).unionByName(lost(generic.where("reason is not null"), f"{top}/generic"))


@query(_MATCH + f""", told as (select node_id, status, case when status = 'failed' then regexp_extract(message, 'AssertionError: [0-9.]*') else '' end as said, run_id || lpad(ord::varchar, 12, '0') as place
  from matched where node_id is not null and ord % {_BROKEN} <> 0)
select 'p' as project, node_id, arg_max(status, place) as status, arg_max(said, place) filter (where said <> '') as error_message from told group by node_id""")
def streamed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a stream of JUnit files in several batches: first those of every other day, then, from where the stream had ended, the days between, which are late."""
    t = tables(spark, sf_dir, "results")
    top = f"{shared_dir(spark)}/triage/stream-{uuid.uuid4().hex}"
    files = written(_spelt_files(t["results"].withColumn("kind", F.lit("junit"))), "files")
    odd = F.substring_index(F.substring_index("path", "/", 2), "-", -1).cast("int") % 2
    per_batch = max(1, files.count() // 4)
    for part in (0, 1):
        _put(files.where(odd == part), f"{top}/in")
        St.stream_result_files(spark, f"{top}/in", t["nodes"], "python", f"{top}/state", f"{top}/checkpoint", per_batch, time=F.to_timestamp("run_id")).awaitTermination()
    return St.current(spark, f"{top}/state").select("project", "node_id", "status", "error_message")


@query(""", recs as (select run_id as file, case ord % 4 when 0 then 'junit' when 1 then 'xunit' when 2 then 'pytest' else 'universal' end as dialect, case when ord % 5 = 0 then '' else name end as name from results)
, c as (select file, dialect, count(*) filter (where name <> '') as n, case dialect when 'xunit' then 5 when 'pytest' then 10 when 'universal' then 99 else 100 end as p from recs group by 1, 2)
select file, dialect from (select *, row_number() over (partition by file order by n desc, p) as k from c) where k = 1""")
def choose_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables(spark, sf_dir, "results")["results"]
    kind = F.when(F.col("ord") % 4 == 0, "junit").when(F.col("ord") % 4 == 1, "xunit").when(F.col("ord") % 4 == 2, "pytest").otherwise("universal")
    return I.choose_dialect(r.select(F.col("run_id").alias("file"), kind.alias("dialect"), F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("name")).alias("name")))


# --- sources, reports ---------------------------------------------------------------------------------

_SOURCES = f", fs as ({_FILES}), known as (select k, g from fs)" + """
, ids as (select k, g, concat('p', g % 3) as project, py, next_py, concat('src/m', g, '.py::', py) as p_id, concat('pkg', g % 4, '.src/C', g, '.java::C', g, '::f', k) as j_id, concat('N', g % 4, '::src/B', g, '.cs::B', g, '::f', k) as c_id from fs)
, calls as (select a.*, b.p_id as p_to, b.j_id as j_to, b.c_id as c_to from ids a left join ids b on b.k = a.k + 1 and b.project = a.project)"""


@query(_SOURCES + """ select distinct project, unnest([p_id, p_id, j_id, j_id, c_id, c_id]) as src,
  unnest([coalesce(p_to, next_py), 'helper' || k % 5, coalesce(j_to, 'external::f' || (k + 1)), 'external::out' || k % 5, coalesce(c_to, 'external::f' || (k + 1) || '/1'), 'external::Far' || k % 5 || '/2']) as dst from calls""")
def source_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.build_graph(tables(spark, sf_dir, "sources")["sources"])[1].select("project", "src", "dst")


@query(_SOURCES + """, place as (select *, row_number() over (partition by g order by k) as n, max(case when k % 40 = 7 then 1 else 0 end) over (partition by g) = 1 as tested from ids)
select project, unnest([p_id, j_id, c_id]) as node_id, unnest(['python', 'java', 'csharp']) as lang, unnest([(n * 4 - 3)::int, (n + 2)::int, (n + 2)::int]) as start_line, unnest([tested, k % 4 = 0, k % 4 = 0]) as is_test, 1 as parameters from place""")
def source_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = C.build_graph(tables(spark, sf_dir, "sources")["sources"])[0]
    return nodes.where("type <> 'external'").select("project", "node_id", "lang", "start_line", "is_test", "parameters")


def _sliced(lang: str) -> tuple[str, str]:
    """SQL of a part's method, in many lines with strings and branches full of braces: (text, where its signature and its end are after its first line, as SQL)."""
    if lang == "java":
        lines = ["'  @Test'", "concat('  void f', k, '(int a) {')", "'    String s = \"\"\"'", "'      { \"x\": \"}\" // no \"'", "'      \"\"\";'", "concat('    char c = ''{''; f', k + 1, '(a); /* } */')", "'  }'"]
    else:
        lines = [
            "'  [Fact]'", "concat('  public int f', k, '(int a)')", "'  {'", "'#if NEVER'", "'    if (a > 0) {'", "'#else'", "'    if (a > 1) {'", "'#endif'", "concat('      var s = $\"{Far', k % 5, '(a, \"}\")} {{ }}\" + $$\"\"\"{ {{a}} \"\"\" + @\"c:{\"\"\";')",
            "'      int Local(int b) { return b; }'", "'      return Local(a);'", "'    }'", "'    return 0;'", "'  }'",
        ]
    end = len(lines)
    after = "" if lang == "java" else " || chr(10) || concat('  public int P', k, ' { get { return Get(1); } }')"
    return " || chr(10) || ".join(lines) + after + " || chr(10)", str(end)


_SLICED = {lang: _sliced(lang) for lang in ("java", "csharp")}
#: Lines of a part's method and what follows it.
_HEIGHT = {"java": 7, "csharp": 15}


def _slice_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir)
    one = lambda lang, file, head, tail: f"select concat('p', g % 3) as project, concat('src/{file}', g, '.{ {'java': 'java', 'csharp': 'cs'}[lang] }') as file, '{lang}' as lang, concat({head}, array_join(transform(array_sort(collect_list(struct(k, t))), x -> x.t), ''), '{tail}') as text from (select k, g, {_SLICED[lang][0].replace('chr(10)', 'char(10)')} as t from ({_FILES})) group by g"
    return spark.sql(one("java", "C", "'package pkg;\\nclass C', g, ' {{\\n'".replace("{{", "{"), "}\\n") + " union all " + one("csharp", "B", "'namespace N {\\nclass B', g, ' {\\n'", "} }\\n"))


_SLICES = f""", fs as ({_FILES}), placed as (select k, g, row_number() over (partition by g order by k) - 1 as n from fs)
, j as (select concat('p', g % 3) as project, 'java' as lang, concat('pkg.src/C', g, '.java::C', g, '::f', k) as node_id, 3 + n * {_HEIGHT['java']} as first, {_SLICED['java'][1]} as height, {_SLICED['java'][0]} as t from placed)
, c as (select concat('p', g % 3), 'csharp', concat('N::src/B', g, '.cs::B', g, '::f', k), 3 + n * {_HEIGHT['csharp']}, {_SLICED['csharp'][1]}, {_SLICED['csharp'][0]} from placed)
select project, lang, node_id, (first + 1)::int as line, (first + height - 1)::int as end_line, 1 as parameters, trim(array_to_string(string_split(t, chr(10))[1:height], chr(10)), ' ') as code from (select * from j union all select * from c)"""


@query(_SLICES)
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of many lines, with text blocks, raw, verbatim and interpolated strings, branches of the preprocessor, local functions and properties."""
    return X.extract_functions(_slice_sources(spark, sf_dir)).select("project", "lang", "node_id", "line", "end_line", "parameters", "code")


@query(_SLICES.replace("select project, lang, node_id, (first", "select lang, node_id, (first").replace(" as code from", " as code from"))
def source_slices_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, from SQL."""
    X.register_table_function(spark)
    _slice_sources(spark, sf_dir).createOrReplaceTempView("slice_sources")
    return spark.sql("select lang, node_id, line, end_line, parameters, code from functions_of(table(select file, lang, text from slice_sources) partition by file)")


@query(_SLICES.split("select project, lang")[0] + """ select project, src, dst from (select project, node_id as src, unnest(case lang when 'java' then ['f' || (k + 1)] else ['Far' || k % 5, 'Local'] end) as dst from (
  select project, lang, node_id, regexp_extract(node_id, 'f(\\d+)$', 1)::bigint as k from (select * from j union all select * from c)))""")
def slice_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What these methods call: holes of strings count, accessors of properties don't."""
    return X.extract_calls(_slice_sources(spark, sf_dir)).select("project", F.col("caller").alias("src"), F.col("name").alias("dst")).distinct()


@query(_SOURCES + """, used as (select project, 'helper' || k % 5 as node_id from ids union all select project, 'external::out' || k % 5 from ids union all select project, 'external::Far' || k % 5 || '/2' from ids
  union all select project, next_py from calls where p_to is null union all select project, 'external::f' || (k + 1) from calls where j_to is null union all select project, 'external::f' || (k + 1) || '/1' from calls where c_to is null)
select project, node_id, count(*) as uses from used group by all""")
def outside_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External nodes with how often they are called, from the counts of their origins."""
    nodes = C.build_graph(tables(spark, sf_dir, "sources")["sources"])[0].where("type = 'external'")
    return nodes.select("project", "node_id", F.aggregate("origins", F.lit(0).cast("long"), lambda n, o: n + o["count"]).alias("uses"))


@query(""", f as (select concat('p', p_partkey % 7) as project, p_partkey % 11 as e from part)
, g as (select project, bool_or(e in (0, 1, 2)) as py, bool_or(e in (3, 4)) as ja, bool_or(e = 5) as cs from f group by 1)
select project, array_to_string(list_filter([case when py then 'python' end, case when ja then 'java' end, case when cs then 'csharp' end], lambda x: x is not null), ',') as languages,
  case when py then 'python' when ja then 'java' when cs then 'csharp' end as language, case when cs then 'csharp' when ja then 'java' when py then 'python' end as extractor from g""")
def project_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir)
    e = F.col("p_partkey") % 11
    end = F.when(e < 3, ".py").when(e < 5, ".java").when(e == 5, ".cs").otherwise(".md")
    files = spark.table("part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 7).cast("string")).alias("project"), F.concat(F.lit("src/a"), F.col("p_partkey").cast("string"), end).alias("file"))
    return X.project_languages(files).withColumn("languages", F.array_join("languages", ","))


@query(_MATCH + """ select 'p' as project, s.run_id, count(*) filter (where s.status = 'passed') as passed, count(*) filter (where s.status = 'failed') as failed, count(*) filter (where s.status = 'skipped') as skipped, count(*) as total
from status s join nodes n on n.node_id = s.node_id and n.is_test group by s.run_id""")
def tests_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, status = _status(spark, sf_dir)
    return S.tests_overview(S.run_summary(status, t["nodes"]))


@query(_FAILED + _SHOWN + _walk(True) + """, each as (select test_id, path_rank, unnest(shown) as node, unnest(range(len(shown))) as pos from best)
, fr as (select s.run_id, s.node_id as test_id from status s join nodes n on n.node_id = s.node_id and n.is_test where s.status = 'failed')
select 'p' as project, r.run_id, e.test_id, e.path_rank::int as path_rank, string_agg(e.node || '|' || n.type || '|' || n.start_line || '|' || coalesce(s.status, 'not_executed') || '|' || case when n.type = 'external' then e.node else '' end, '>' order by pos) as steps
from each e join fr r using (test_id) join nodes n on n.node_id = e.node left join status s on s.run_id = r.run_id and s.node_id = e.node group by all""")
def enriched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, status = _status(spark, sf_dir, "calls")
    status = written(status, "status")
    failed = _failed(t, status)
    got = P.enriched_steps(P.critical_paths(t["nodes"], t["calls"], failed, "downstream", key="node_ord"), t["nodes"], status, failed, t["calls"])
    step = lambda s: F.concat_ws("|", s["node"], s["type"], s["line"].cast("string"), s["status"], F.coalesce(s["external_key"], F.lit("")))
    return got.select("project", "run_id", "test_id", "path_rank", F.array_join(F.transform("steps", step), ">").alias("steps"))


_ITEMS = """, items as (select *, '2024-01-' || lpad((ord % 30 + 1)::varchar, 2, '0') as day, concat('src/mod_', ord % 5, '.py::T::f', ord % 40) as f1, 'src/mod_' || ord % 5 || '.py' || case when ord % 40 < 20 then '>' || (ord % 40 + 1) else '' end as l1 from analysis)"""


def _items(spark: SparkSession, sf_dir: str, *names: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Analysis items dealt over the days of the runs; some with a function as their locus, some with a suspect."""
    t = tables(spark, sf_dir, "analysis", *names)
    none = F.array().cast("array<string>")
    a = t["analysis"].withColumn("run_id", F.concat(F.lit("2024-01-"), F.lpad((F.col("ord") % 30 + 1).cast("string"), 2, "0")))
    locus = _locus(F.when(F.col("ord") % 3 == 0, F.array(_module_function("ord"))), F.when(F.col("ord") % 5 == 0, F.array(F.concat(F.lit("pkg/s"), (F.col("ord") % 7).cast("string"), F.lit(".py")))).otherwise(none))
    return t, a.withColumns({"locus": locus, "heuristic_locations": none, "root_cause": F.lit(""), "suggested_fixes": none, "insight_bullets": F.array("bullet")})


@query(_MATCH + _PLACES + _ITEMS + """, lastm as (select run_id, node_id, max(ord) filter (where message <> '') as mo from matched where node_id is not null group by 1, 2)
, nodeh as (select run_id, node_id, heuristic from lastm join hs on hs.ord = mo)
select 'p' as project, i.day as run_id, i.ord, coalesce(case when i.ord % 3 = 0 then l1 else replace(n.heuristic, '|', ', ') end, case when i.ord % 5 = 0 then 'pkg>s' || i.ord % 7 || '.py' end, '') as location,
  ((i.ord % 5 = 0)::int + (i.ord % 3 = 0)::int)::int as suspects from items i left join idx x on x.token = string_split(i.test_name, '::')[-1] left join nodeh n on n.run_id = i.day and n.node_id = x.node_id""")
def failures_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, items = _items(spark, sf_dir, "results")
    status = written(G.node_status(t["results"], t["nodes"], "python"), "status")
    return R.located_failures(items, _module_functions(spark), t["nodes"], status).select("project", "run_id", "ord", "location", F.size("llm").alias("suspects"))


@query(_MATCH + _TYPED.replace("from analysis)", "from (select *, '2024-01-' || lpad((ord % 30 + 1)::varchar, 2, '0') as day from analysis))") + """, c as (select day, coalesce(nullif(kind, ''), 'Other') as type, count(*) as n from typed group by 1, 2)
, s as (select s.run_id, count(*) as total, count(*) filter (where s.status = 'failed') as failed from status s join nodes n on n.node_id = s.node_id and n.is_test group by s.run_id)
select 'p' as project, s.run_id, s.total, s.failed, coalesce(sum(n), 0)::bigint as items, string_agg(type || ' ' || n, ', ' order by n desc, type) as types from s left join c on c.day = s.run_id group by 2, 3, 4""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a run's document, and what they say."""
    t, items = _items(spark, sf_dir, "results")
    status = G.node_status(t["results"], t["nodes"], "python", locations=False)
    docs = R.report(S.run_summary(status, t["nodes"]), R.insights(items), R.risk_scores(items), R.failures_table(items, _module_functions(spark)), S.failure_types(items))
    got = docs.select("project", "run_id", "page", F.from_json("document", "metrics struct<total:long,failed:long>, insights array<struct<title:string>>, risks array<struct<r:int>>, failures array<struct<title:string>>, types array<struct<type:string,count:long>>").alias("d"))
    alike = F.bool_and((F.size("d.insights") == F.size("d.risks")) & (F.size("d.risks") == F.size("d.failures")))
    types = F.when(F.size("d.types") > 0, F.struct("page", F.array_join(F.transform("d.types", lambda x: F.concat(x["type"], F.lit(" "), x["count"].cast("string"))), ", ").alias("t")))
    each = got.groupBy("project", "run_id").agg(
        F.max("d.metrics.total").alias("total"), F.max("d.metrics.failed").alias("failed"), F.when(alike, F.sum(F.size("d.risks"))).cast("long").alias("items"),
        F.array_join(F.transform(F.array_sort(F.collect_list(types)), lambda x: x["t"]), ", ").alias("types"),
    )
    return each.withColumn("types", F.nullif("types", F.lit("")))


@query(_TYPED + """, c as (select run_id, coalesce(nullif(kind, ''), 'Other') as type, count(*) as n from typed group by 1, 2)
select 'p' as project, run_id, type, n as count, (row_number() over (partition by run_id order by n desc, type))::int as position from c""")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.type_histogram(S.failure_types(tables(spark, sf_dir, "analysis")["analysis"]))


@query(""" select 'p' as project, run_id, ord, string_split(test_name, '::')[-1] as label, (row_number() over (partition by run_id order by string_split(test_name, '::')[-1], test_name, ord))::int as position from analysis""")
def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bubbles(R.risk_scores(tables(spark, sf_dir, "analysis")["analysis"])).select("project", "run_id", "ord", "label", "position")


# --- what models answer, what projects refer to, files and runs without the usual parts -----------------


@query(""", a as (select doc_id, translate(coalesce(text, ''), '{}', '()') as prose, unnest(range(doc_id % 3 + 1)) as ord from documents where doc_id % 5 <> 0)
select 'p' as project, doc_id::varchar as run_id, ord, 't' || ord as test_name, 'want {' || ord || '}' as error, md5(prose) as cause, len(prose)::bigint as length from a""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of answers that stand alone or within whole documents, whose text is their root cause, too; of every fifth answer nothing can be read."""
    tables(spark, sf_dir)
    prose = F.translate(F.coalesce("text", F.lit("")), "{}", "()")
    item = lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("test_name"), F.concat(F.lit("want {"), i.cast("string"), F.lit("}")).alias("error"), prose.alias("root_cause"))
    answer = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.col("doc_id") % 3), item).alias("analysis")))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(prose, F.lit('{"analysis": [}'), prose)).when(F.col("doc_id") % 7 == 1, answer).otherwise(F.concat(prose, F.lit(" } "), answer, F.lit(" { "), prose))
    found = I.read_analysis(spark.table("documents").select(F.lit("p").alias("project"), F.col("doc_id").cast("string").alias("run_id"), text.alias("text")))
    return found.select("project", "run_id", "ord", "test_name", "error", F.md5(F.col("root_cause").cast("binary")).alias("cause"), F.length("root_cause").cast("long").alias("length"))


@query(f""", fs as ({_FILES}) select distinct 'p' || g % 3 as project, 'project' as kind, 'Lib' || k % 13 as name from fs union all select distinct 'p' || g % 3, 'package', 'Pkg.N' || k % 17 from fs""")
def project_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects and packages that C# project files name, with paths of either kind of slash."""
    tables(spark, sf_dir)
    slash = F.when(F.col("k") % 2 == 0, "\\").otherwise("/")
    lib = F.concat(F.lit("Lib"), (F.col("k") % 13).cast("string"))
    refs = F.concat(F.lit('<ProjectReference Include="'), F.concat_ws("", F.lit(".."), slash, lib, slash, lib), F.lit('.csproj" /><PackageReference Include="Pkg.N'), (F.col("k") % 17).cast("string"), F.lit('" Version="1.0" />'))
    each = spark.sql(_FILES).withColumn("refs", refs).groupBy("g").agg(F.array_join(F.array_sort(F.collect_list("refs")), "\n").alias("refs"))
    files = each.select(F.concat(F.lit("p"), (F.col("g") % 3).cast("string"), F.lit("/src/B"), F.col("g").cast("string"), F.lit(".csproj")).alias("path"), F.concat(F.lit("<Project><ItemGroup>\n"), "refs", F.lit("\n</ItemGroup></Project>")).alias("content"))
    top = f"{shared_dir(spark)}/triage/projects-{uuid.uuid4().hex}"
    _put(files, top)
    projects, packages = I.read_csproj_refs(spark, top)
    return projects.withColumn("kind", F.lit("project")).unionByName(packages.withColumn("kind", F.lit("package"))).select("project", "kind", "name")


@query(f""", fs as ({_FILES}) select distinct 'p' || g % 3 as project, 'src/m' || g || '.py' as file from fs where g % 4 = 1""")
def source_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be parsed, among the others of all three languages."""
    sources = tables(spark, sf_dir, "sources")["sources"]
    number = F.regexp_extract("file", r"(\d+)\.py$", 1)
    return X.rejects(sources.withColumn("text", F.when((number != "") & (number.try_cast("long") % 4 == 1), F.concat("text", F.lit("def (\n"))).otherwise(F.col("text"))))


@query(""", ext as (select node_id as external from nodes where type = 'external')
, sides as (select x.external, n.file, 1 as side, min(e.edge_ord) as o from ext x join edges e on e.dst = x.external join nodes n on n.node_id = e.src group by 1, 2
  union all select x.external, n.file, 2, min(e.edge_ord) from ext x join edges e on e.src = x.external join nodes n on n.node_id = e.dst group by 1, 2)
, firsts as (select external, file, row_number() over (partition by external order by o, file) as n from (select *, min(side) over (partition by external) as best from sides) where side = best qualify n <= 5)
select 'p' as project, x.external, coalesce(string_agg(f.file, '|' order by f.n), '') as callers from ext x left join firsts f using (external) group by 2""")
def external_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files that call an external node, else that it calls."""
    t = tables(spark, sf_dir, "calls")
    return P.external_origins(t["nodes"], t["calls"], key="node_ord").withColumn("callers", F.array_join("callers", "|"))


@query(_MATCH + """ select 'p' as project, s.run_id, s.node_id as title, 'unit' as type, coalesce(s.error_message, '') as message, n.file, n.file as location
from status s join nodes n on n.node_id = s.node_id and n.is_test where s.status = 'failed'""")
def failures_without_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of failures of runs that no model has seen."""
    t, status = _status(spark, sf_dir)
    return R.failures_from_detail(S.failed_detail(status, t["nodes"])).select("project", "run_id", "title", "type", "message", "file", "location")
