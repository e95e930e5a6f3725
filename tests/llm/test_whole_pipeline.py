"""The pipeline and its stages on all rows and lines of their tables."""

import itertools
import random
import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from triage.llm import line_dedup, packing  # noqa: E402


@pytest.mark.parametrize("hot", [2, 50])
def test_pipeline_removes_repeated_lines_of_any_words(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINE", hot)
    whole = "one two three four five six seven"
    rows = [(1, f"Read more\n{whole}\n\nEnd"), (2, f"{whole}\nread  MORE\nEND"), (3, "new line here\n\nend"), (4, "Read more"), (5, "read less\nmore read"), (6, "\n")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 3: "new line here\n", 5: rows[4][1], 6: "\n"}


def test_every_sequence_has_the_mixture():
    totals = {f"s{i:02}": 20_000 + 997 * i for i in range(20)}
    whole, mixture, room = sum(totals.values()), packing.Mixture(totals), Counter()
    for s, n in totals.items():
        for size, q, _ in mixture.place(s, 0, n):
            room[(q, s)] += size
    for q in range(whole // 4096):
        assert sum(room[(q, s)] for s in totals) == 4096
        assert all(abs(room[(q, s)] - 4096 * n / whole) < 3 for s, n in totals.items())


@pytest.mark.parametrize("weights", [None, {"a": 2, "e": 2}, {"a": 1000, "b": 1, "d": 3}])
def test_rare_queues_between_others_lose_no_place(weights):
    totals = {"a": 90_000, "b": 5, "c": 90_001, "d": 1, "e": 70_000, "f": 7}
    mixture, seen = packing.Mixture(totals, weights), []
    for s, n in totals.items():
        for x in range(0, n, 501):
            for size, q, o in mixture.place(s, x, min(501, n - x)):
                seen += range(q * 4096 + o, q * 4096 + o + size)
    assert sorted(seen) == list(range(sum(totals.values())))


def test_more_sources_than_the_broadcast_plan_has(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * (i % 40 + 1), f"s{i % 37}") for i in range(400)], "doc_id long, text string, source string").coalesce(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    few = Counter(tuple(r) for r in packing.pack(docs, path, with_ids=False).collect())
    monkeypatch.setattr(packing, "MOST_SOURCES", 5)
    assert Counter(tuple(r) for r in packing.pack(docs, path, with_ids=False).collect()) == few


BLANK, WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(words, k=5):
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)]) if words else frozenset()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def without_repeated_lines(docs):
    lines = [((i, k), x, runs(re.findall(BLANK, lower(x)))) for i, t in docs for k, x in enumerate((t or "").split("\n")) if t is not None]
    gone = {a for a, _, s in lines for b, _, u in lines if b < a and alike(s, u)}
    out = {}
    for i, t in docs:
        left = None if t is None else [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if left is None or left:
            out[i] = None if left is None else "\n".join(left)
    return out


def one_of_each_group(docs):
    sets = {i: runs(re.findall(BLANK, lower(t))) for i, t in docs.items()}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if alike(sets[a], sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if r == old else r for i, r in root.items()}
    return {i: t for i, t in docs.items() if root[i] == i}


def without_benchmark(docs, items):
    windows = [runs(re.findall(WORD, lower(t)), 10) for t in items]
    words = lambda t: re.findall(WORD, lower(t))
    hit = lambda w, g: any(tuple(w[j : j + len(g)]) == g for j in range(len(w) - len(g) + 1))
    return {i: t for i, t in docs.items() if not any(hit(words(t), g) for ws in windows for g in ws)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic texts, near and exact copies, repeated lines, benchmark passages, null and empty texts, and a column of a clashing name."""
    r, to = random.Random(3), str(tmp_path_factory.mktemp("corpus"))
    vocabulary = ["".join(r.choice("abcdefghijklmn") for _ in range(r.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [prose(25), prose(6), "", None]
    rows = [(i, prose(40) + (" vile idiot" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(300 + i, rows[1][1] + f" x{i}") for i in range(5)] + [(310, rows[2][1]), (311, rows[3][1].upper())]
    shared = prose(14)
    rows += [(320 + i, f"{prose(20)}\n{shared}\n{prose(11)}") for i in range(4)]
    rows += [(330, f"{prose(8)} {items[0]} {prose(8)}"), (331, f"{prose(9)} {' '.join(items[0].split()[4:15]).upper()} {prose(9)}"), (332, f"{prose(9)} {items[1]} {prose(3)}")]
    rows += [(350 + i, rows[i][1].replace(' ', '\n' if i % 2 else ' \n', 20).replace('\n', ' ', 19)) for i in (5, 6)]  # the same words in other lines
    rows += [(340, None), (341, ""), (342, " \n\t"), (343, "word " * 9000), (344, shared)]
    docs = [(i, t, "en", f"s{i % 3}", len(t or ""), "a column", i) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, pivot string, row int").repartition(4).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in rows[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to, rows, items


def test_pipeline_equals_plain_python_stage_by_stage(spark, corpus):
    to, rows, items = corpus
    docs, steps = spark.read.parquet(f"{to}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, to)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert len(steps[-1]) == docs.count()
    toxic, lines, group, clean = steps
    assert toxic == {i: t for i, t in rows if "vile" not in (t or "")}
    assert lines == without_repeated_lines(sorted(toxic.items()))
    assert group == one_of_each_group(lines) and len(group) < len(lines)
    assert clean == without_benchmark(group, items) and len(clean) == len(group) - 3
    assert {r["n_chars"] for r in docs.where("text is not null").collect()} == {len(t) for t in clean.values() if t is not None}
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    held = Counter()
    for r in corpus_pipeline.run(spark, to).collect():
        held[r["doc_id"]] += r["length"]
    assert held == want


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    to, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{to}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_order_of_tokens_is_the_same_in_all_slices():
    """Prefixes of lines in different parts of the table agree only if their tokens are ordered alike."""
    import numpy as np

    r = np.random.default_rng(1)
    tok = r.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    classes = r.integers(0, 4, line_dedup.COUNTERS).astype(np.uint8)
    orders = [np.argsort(line_dedup._by_line(tok, np.full(len(tok), line), classes)).tolist() for line in (0, 5, 1000, 70_000, 3_000_000)]
    assert all(o == orders[0] for o in orders) and (np.diff(classes[line_dedup.counter(tok[orders[0]])].astype(int)) >= 0).all()
