"""Registered queries over all rows of their tables, against plain Python on small tables."""

from collections import Counter, defaultdict

import pytest

from triage.jobs import queries as Q


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Tables without any order key that 50 divides or part key that 9 divides; one name on most calls."""
    to = str(tmp_path_factory.mktemp("shop"))
    parts = [(k, f"{'red blue'.split()[k % 2]} {'bolt nut'.split()[k % 5 == 0]}", f"B{k % 3}", "PROMO" if k % 7 == 0 else "SMALL", k % 6) for k in range(1, 60) if k % 9]
    items = [(o, parts[(o * 5 + n * 3) % len(parts)][0], (o + n) % 4, n) for o in range(1, 80) if o % 50 for n in range(1, 5)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{to}/part.parquet")
    spark.createDataFrame([*items, items[0]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{to}/lineitem.parquet")
    for other in ("events", "orders", "documents", "conversations"):
        spark.range(1).write.parquet(f"{to}/{other}.parquet")
    by_key = {p[0]: p for p in parts}
    sites = []
    for o, part, supplier, n in [*items, items[0]]:
        _, name, brand, _, _ = by_key[part]
        kind, name = name.split()
        sites.append((f"{o}/{n}/{part}/{supplier}", name, None if supplier % 3 == 0 else kind, brand if n % 2 == 0 else "none", n % 5, f"src/c{supplier % 10}.cs"))
    decls = [(f"d{k}", *reversed(name.split()), brand, size % 4) for k, name, brand, kind, size in parts if kind != "PROMO"]
    return to, sites, decls


def test_all_call_sites_are_resolved(spark, shop):
    to, sites, decls = shop
    edges = set()
    for call, name, kind, ns, argc, _ in sites:
        tiers = defaultdict(set)
        for node, other, of, space, parameters in decls:
            if name == other:
                tiers[(1 if kind == of and ns == space else 2 if kind == of else 3) + (0 if argc == parameters else 3)].add(node)
        if tiers:
            edges |= {(min(tiers), call, node) for node in tiers[min(tiers)]}
    want = {t: (len({c for u, c, _ in edges if u == t}), sum(u == t for u, _, _ in edges), len({n for u, _, n in edges if u == t})) for t in {e[0] for e in edges}}
    got = Q.call_resolution_tiers(spark, to)
    assert got.columns == ["tier", "calls", "edges", "targets"]
    assert {r["tier"]: (r["calls"], r["edges"], r["targets"]) for r in got.collect()} == want and len(want) > 3


def test_all_call_sites_count_as_origins(spark, shop):
    to, sites, _ = shop
    count = Counter((f"external::{name}/{argc}", file, ns, name) for _, name, _, ns, argc, file in sites)
    want = defaultdict(list)
    for (node, file, ns, name), n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        want[node].append(f"{file} {ns} {name} {n}")
    assert {r["node_id"]: r["origins"].split("|") for r in Q.external_origin_counts(spark, to).collect()} == want
