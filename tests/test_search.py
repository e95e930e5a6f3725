"""Branch and bound, packed distances and the index of substrings against plain search on random graphs."""

import itertools
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from triage.operators import locate as L
from triage.operators import paths as P
from triage.sources import shared

NODES = "project string, node_id string, type string, file string, is_test boolean, start_line int, node_ord long"
EDGES = "project string, src string, dst string, edge_ord long"
PAIR = "project string, {} string"


def random_graph(seed, n, degree, foreign=0.2, outer=0.15, tests=0.25):
    rng = random.Random(seed)
    nodes = []
    for i in range(n):
        kind = "external" if rng.random() < outer else "function"
        name = f"external::f{rng.randrange(n)}/1" if kind == "external" and rng.random() < 0.7 else f"m{i % 5}.py::f{i}"
        nodes.append((name, kind, ("lib/site-packages/" if rng.random() < foreign else "src/") + f"{i}.py", rng.random() < tests))
    nodes = list({x[0]: x for x in nodes}.values())
    ids = [x[0] for x in nodes]
    edges = sorted({(a, rng.choice(ids)) for a in ids for _ in range(rng.randint(0, 2 * degree))})
    return nodes, [e for e in edges if e[0] != e[1]]


def plain_best(nodes, edges, start, down, cutoff, most):
    """Every simple path, then the best: (steps, non-tests)."""
    meta = {x[0]: x for x in nodes}
    inner = {}
    for x in nodes:
        if x[1] != "external" and "::" in x[0]:
            inner.setdefault(x[0].split("::")[-1], x[0])
    shown = {x[0]: inner.get(x[0].removeprefix("external::").rsplit("/", 1)[0], x[0]) if x[1] == "external" else x[0] for x in nodes}
    next_of = {}
    for a, b in edges:
        next_of.setdefault(a if down else b, []).append(b if down else a)
    found, stack = set(), [(start,)]
    while stack:
        path = stack.pop()
        if len(path) > 1:
            steps = tuple(shown[p] for p in path if "site-packages" not in meta[shown[p]][2])
            if len(steps) >= (2 if down else 1):
                found.add((-sum(not meta[s][3] for s in steps), -len(steps), steps))
        if len(path) <= cutoff:
            stack.extend((*path, b) for b in next_of.get(path[-1], []) if b not in path)
    return [(list(s) if down else list(s[::-1]), -n) for n, _, s in sorted(found)[:most]]


@pytest.mark.parametrize(("seed", "n", "degree", "cutoff", "most"), [(1, 14, 2, 4, 3), (2, 20, 4, 4, 5), (3, 30, 6, 3, 5), (4, 12, 5, 5, 2)])
def test_best_paths_are_those_of_all_paths(spark, seed, n, degree, cutoff, most):
    nodes, edges = random_graph(seed, n, degree)
    table = spark.createDataFrame([("p", i, t, f, x, 1, k) for k, (i, t, f, x) in enumerate(nodes)], NODES)
    calls = spark.createDataFrame([("p", a, b, k) for k, (a, b) in enumerate(edges)], EDGES)
    tests = [x[0] for x in nodes if x[3] and x[1] != "external"]
    failed = spark.createDataFrame([("p", t) for t in tests], PAIR.format("test_id"))
    for direction in ("downstream", "upstream"):
        opened = []
        got = {}
        for r in P.critical_paths(table, calls, failed, direction, cutoff, most, opened=opened).orderBy("path_rank").collect():
            got.setdefault(r["test_id"], []).append((r["steps"], r["non_test"]))
        want = {t: plain_best(nodes, edges, t, direction == "downstream", cutoff, most) for t in tests}
        assert got == {t: w for t, w in want.items() if w}
        assert sum(opened) > 0


def test_rows_of_a_round_follow_the_tests_not_the_paths(spark):
    """Forty nodes, each with a way to all others: 2.8 billion simple paths of six hops from the test."""
    ids = [f"n{i:02}.py::f" for i in range(40)]
    table = spark.createDataFrame([("p", x, "function", x, x == ids[7], 1, k) for k, x in enumerate(ids)], NODES)
    calls = spark.createDataFrame([("p", a, b, 0) for a, b in itertools.permutations(ids, 2)], EDGES)
    opened = []
    got = P.critical_paths(table, calls, spark.createDataFrame([("p", ids[7])], PAIR.format("test_id")), "downstream", opened=opened).orderBy("path_rank").collect()
    others = [x for x in ids if x != ids[7]]
    want = list(itertools.islice(itertools.permutations(others, 6), 5))
    assert [tuple(r["steps"]) for r in got] == [(ids[7], *w) for w in want]
    assert max(opened) <= 5 * 13 and len(opened) <= 14


def plain_distances(edges, seed):
    best = {seed: 0}
    for a, b in (0, 1), (1, 0):
        near, queue = {seed: 0}, deque([seed])
        while queue:
            x = queue.popleft()
            for e in edges:
                if e[a] == x and e[b] not in near:
                    near[e[b]] = near[x] + 1
                    queue.append(e[b])
        for x, d in near.items():
            best[x] = min(best.get(x, d), d)
    return best


@pytest.mark.parametrize("depth", [None, 2])
def test_distances_from_more_seeds_than_a_word_has_bits(spark, depth):
    _, edges = random_graph(7, 150, 1)
    seeds = sorted({e[0] for e in edges})[:100] + ["alone"]
    calls = spark.createDataFrame([("p", a, b, 0) for a, b in edges] + [("q", "x", "y", 0)], EDGES)
    asked = spark.createDataFrame([("p", s) for s in seeds] + [("q", "y"), ("p", seeds[0])], PAIR.format("seed")).repartition(3)
    want = {("p", s, x, d) for s in seeds for x, d in plain_distances(edges, s).items() if depth is None or d <= depth} | {("q", "y", "y", 0), ("q", "y", "x", 1)}
    got = [(r["project"], r["seed"], r["node_id"], r["dist"]) for r in P.graph_distance(calls, asked, depth).collect()]
    assert len(got) == len(want) and set(got) == want
    some = spark.createDataFrame([("p", edges[0][1]), ("q", "x")], PAIR.format("node_id"))
    near = {(r["project"], r["seed"], r["node_id"], r["dist"]) for r in P.graph_distance(calls, asked, depth, some).collect()}
    assert near == {w for w in want if (w[0], w[2]) in {("p", edges[0][1]), ("q", "x")}}


def test_candidates_meet_the_nodes_that_hold_them(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    ids = sorted({"/".join(word() for _ in range(rng.randint(1, 3))) + f".py::{word()}" for _ in range(120)})
    asked = [*[">".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)], "a", "ab", "b>c", "zzz", "", *[f"{word()}.py>3" for _ in range(20)], ids[0].split("::")[0].replace("/", ">") + ">12", None]
    nodes = spark.createDataFrame([("p", i) for i in ids] + [("q", ids[0])], PAIR.format("node_id"))
    candidates = spark.createDataFrame([("p", "t", k, c) for k, c in enumerate(asked)], "project string, test_id string, idx int, candidate string")
    got = {(r["project"], r["file"], r["node_id"]) for r in L.candidate_nodes(candidates, nodes).collect()}
    want = set()
    for c in asked:
        parts = (c or "").split(">")
        file = "/".join(parts[:-1] if len(parts) > 1 and parts[-1].isdigit() else parts)
        exact = file.endswith(".py")
        want |= {("p", file, i) for i in ids if file and file in i and (not exact or i.split("::")[0].split("/")[-1] == file.split("/")[-1])}
    assert got == want and any(not f.endswith(".py") for _, f, _ in got)


def test_blocks_of_seeds_stay_within_unconnected_parts(spark, monkeypatch):
    """Eight stars of 64 nodes, whose names take turns; a block holds 64 seeds, so eight blocks in all have to walk about a star each."""
    monkeypatch.setattr(P, "_LANES", 1)
    monkeypatch.setattr(P, "_FEW", 0, raising=False)
    rows, write = [], P.written

    def counted(df, name):
        out = write(df, name)
        if name == "reach":
            rows.append(out.count())
        return out

    monkeypatch.setattr(P, "written", counted)
    name = lambda star, k: f"n{k:02}.py::f{star}"
    calls = spark.createDataFrame([("p", *pair, 0) for r in range(8) for k in range(1, 64) for pair in itertools.permutations((name(r, 0), name(r, k)))], EDGES)
    seeds = spark.createDataFrame([("p", name(r, k)) for r in range(8) for k in range(64)], PAIR.format("seed"))
    got = {(r["seed"], r["node_id"]): r["dist"] for r in P.graph_distance(calls, seeds).collect()}
    assert got == {(name(r, a), name(r, b)): 0 if a == b else 1 if 0 in (a, b) else 2 for r in range(8) for a in range(64) for b in range(64)}
    assert max(rows) <= 2 * 3 * 512  # both ways; 2 * 8 * 512 if each block reached every star


def test_a_round_moves_paths_to_calls_not_calls_to_paths(spark, monkeypatch):
    plans, write = [], P.written_and_counted

    def seen(df, name):
        if name == "made":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(P, "written_and_counted", seen)
    monkeypatch.setattr(shared, "BUCKET", 30, raising=False)  # more than one bucket
    nodes = spark.createDataFrame([("p", f"n{k}.py::f", "function", f"n{k}.py", k == 0, 1, k) for k in range(12)], NODES)
    calls = spark.createDataFrame([("p", f"n{a}.py::f", f"n{b}.py::f", 0) for a, b in itertools.permutations(range(12), 2)] * 2, EDGES)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.critical_paths(nodes, calls, spark.createDataFrame([("p", "n0.py::f")], PAIR.format("test_id")), "downstream", cutoff=2).orderBy("path_rank").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    others = sorted(f"n{k}.py::f" for k in range(1, 12))
    assert [tuple(r["steps"]) for r in got] == [("n0.py::f", *w) for w in itertools.islice(itertools.permutations(others, 2), 5)]
    assert plans and [len(re.findall(r"Exchange hashpartitioning\(_from", p)) for p in plans] == [1] * len(plans), plans[0][:6000]
    # the least ways on are chosen below what deals rows by test: a tree's inner nodes come later
    assert all(p.index("Exchange hashpartitioning(test") < p.index("Window [row_number() windowspecdefinition(_from") for p in plans)


def test_a_hop_moves_bits_to_calls_and_names_come_before_pairs(spark, monkeypatch):
    """Calls stay in their buckets in all hops, and what goes to the names of seeds is a row for 64 of them."""
    plans, write = [], P.written

    def seen(df, name):
        if name == "reach":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(P, "written", seen)
    monkeypatch.setattr(shared, "BUCKET", 30)  # more than one bucket
    _, edges = random_graph(3, 60, 2)
    calls = spark.createDataFrame([("p", a, b, 0) for a, b in edges], EDGES)
    asked = sorted({e[0] for e in edges})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = P.graph_distance(calls, spark.createDataFrame([("p", s) for s in asked], PAIR.format("seed")))
        got = {(r["seed"], r["node_id"]): r["dist"] for r in near.collect()}
        last = near._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(s, x): d for s in asked for x, d in plain_distances(edges, s).items()}
    for p in plans[1:]:
        assert len(re.findall(r"Exchange hashpartitioning\(place", p)) == 1 and "Bucketed: true" in p, p[:6000]
    assert last.index("Generate explode(filter") < last.index("Join Inner, ((block")  # a tree's inner nodes come later
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.mark.parametrize("many", [True, False])
def test_candidates_are_ranked_by_the_pairs_asked_for(spark, monkeypatch, many):
    """The same ranks as by all distances, whether there are fewer files than tests or more; edges name nodes by a number."""
    monkeypatch.setattr(P, "_LANES", 1)
    monkeypatch.setattr(P, "_FEW", 0)
    sizes, reached = [], P._reached

    def counted(*args):
        sizes.append(args[1].select("name").distinct().count())
        return reached(*args)

    monkeypatch.setattr(P, "_reached", counted)
    nodes, edges = random_graph(11, 120, 1)
    order = {n[0]: k for k, n in enumerate(nodes)}
    table = spark.createDataFrame([("p", n, k) for n, k in order.items()], "project string, node_id string, node_ord long")
    numbers = spark.createDataFrame([("p", order[a], order[b]) for a, b in edges], "project string, src long, dst long")
    texts = spark.createDataFrame([("p", a, b, 0) for a, b in edges], EDGES)
    ids, rng = sorted(order), random.Random(2)
    tests = rng.sample(ids, 100 if many else 4)
    files = [i.split("::")[0].replace("/", ">") for i in rng.sample(ids, 3 if many else 40)] + ["nowhere.py"]
    rows = [("p", t, k, f"{f}>{k + 1}") for t in tests for k, f in enumerate(rng.sample(files, 4 if many else 30))]
    c = spark.createDataFrame(rows, "project string, test_id string, idx int, candidate string")
    near = P.graph_distance(texts, c.select("project", F.col("test_id").alias("seed")).distinct(), 3)
    want = L.rank_candidates(c, near, L.candidate_nodes(c, table))
    got = L.rank_in_graph(c, table, numbers, 3, "node_ord")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert any(r["dist"] is not None for r in got.collect()) and sizes[-1] <= 4
