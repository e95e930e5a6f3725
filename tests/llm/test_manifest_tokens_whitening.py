"""SentencePiece ids, Merkle manifests and whitening against the library, plain Python and numpy, on small tables with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from triage.llm import merkle, sentencepiece_bpe, whitening  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ENCODER = sentencepiece_bpe.Encoder(MODEL)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, tree string, number int, path string, z int, x string"
rng = random.Random(9)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def make(spark, rows):
    """rows: doc_id, text, lang, source, n_chars; the other columns clash with names of the operators."""
    return spark.createDataFrame([(*r, "i", "d", "t", 1, "p", 2, "x") for r in rows], DOCS).repartition(4)


# --- SentencePiece -----------------------------------------------------------------------------------


def wanted(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def got(texts, encoder=ENCODER):
    return [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode(texts)]


def odd_texts():
    pieces = list(ENCODER.piece)
    mixed = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    signs = ["".join(rng.choice("abcder st ▁▁\n\t.,'ABé中漢ﬁ\u0000😀019") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return ["", " ", "   ", " " * 400, "▁▁a▁", "a\r\n\tb", "x" * 3000, "ab" * 5000, "<s> </s> <0x41> <unk>", "\U0010fffd", "é", *mixed, *signs]


def test_ids_are_those_of_the_library_for_words_at_once_and_texts_alone():
    texts = odd_texts()
    assert got(texts) == [wanted(t) for t in texts]
    whole = sentencepiece_bpe.Encoder(MODEL)
    whole.cut = None  # as for a vocabulary whose tokens go over the start of words
    assert got(texts[:200], whole) == [wanted(t) for t in texts[:200]]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_by_the_library(text):
    assert got([text]) == [wanted(text)]


def test_two_tokens_fit_only_if_merging_gives_them_again():
    token = {t: i for i, t in enumerate(ENCODER.text)}
    assert not ENCODER.compatible(token["h"], token["e"])  # "he" is a piece
    assert ENCODER.compatible(-1, token["he"])
    longest_first = ENCODER.encode(["▁" * 7])  # equal scores: the leftmost pair goes first
    assert np.frombuffer(longest_first[0], dtype="<u4").tolist() == wanted("▁" * 7)


def test_a_full_memory_forgets_and_gives_the_same(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KEPT", 40)
    monkeypatch.setattr(sentencepiece_bpe, "PAIRS", 50)
    small = sentencepiece_bpe.Encoder(MODEL)
    texts = [" ".join("".join(rng.choice("aeioprst") for _ in range(5)) for _ in range(60)) for _ in range(30)]
    for i in range(0, 30, 3):
        assert got(texts[i : i + 3], small) == [wanted(t) for t in texts[i : i + 3]]
    assert len(small.words) <= 400


def test_table_of_ids_and_digests(spark):
    long_text = " ".join(rng.choice(["token", "ization", "Ünïcode", "数据", "x1y2"]) for _ in range(40_000))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([None, "", "one two", "one two", long_text, "a\nb", "z" * 200_000])] + [(None, "no id", None, None, None), (2, "one two", "en", "s", 1)]
    docs = make(spark, rows)
    ids = sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids), r.decoded) for r in sentencepiece_bpe.encode(docs, MODEL).collect())
    assert ids == sorted((i is not None, i or 0, wanted(t), LIBRARY.decode(wanted(t))) for i, t, *_ in rows)
    packed = lambda t: hashlib.sha256(np.array(wanted(t), dtype="<u4").tobytes()).hexdigest()
    digests = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_bpe.digests(docs, MODEL).collect())
    assert digests == sorted((i is not None, i or 0, len(wanted(t)), packed(t), sha(LIBRARY.decode(wanted(t)))) for i, t, *_ in rows)
    assert sentencepiece_bpe.digests(make(spark, []), MODEL).count() == 0


# --- Merkle manifests ----------------------------------------------------------------------------------


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: levels_of([leaf(r, r[1]) for r in groups[s]]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = way(trees[s], i) + way(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for a, b in steps:
                h = sha(a + h + b)
            out.append((leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return sorted(out)


def collected(df):
    return sorted((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def some_rows(n, sources):
    text = lambda i: [None, "", "a\nb", "plain", f"line {i}\n\nÜ {i}", "x" * 5000][i % 6]
    return [(i, text(i), [None, "en"][i % 2], sources[i % len(sources)], None if i % 5 == 0 else i) for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, ["s"]), (2, ["s"]), (4, [None]), (40, ["s"]), (61, [None, "", "b", "B", "ä", "b", "b", "b"]), (28, [f"own {i}" for i in range(28)])])
def test_manifest_is_that_of_plain_python(spark, n, sources):
    rows = some_rows(n, sources)
    assert collected(merkle.verified_manifest(make(spark, rows))) == plain_manifest(rows)


def test_manifest_with_null_and_repeated_ids_and_rows(spark):
    rows = some_rows(30, ["a", "b"])
    rows = [*rows, rows[4], rows[4], (None, "x\ny", "en", "a", 1), (None, "x\ny", "en", "a", 1), (None, None, None, "a", None), (7, "another text of id 7", "en", "b", 3)]
    assert collected(merkle.verified_manifest(make(spark, rows))) == plain_manifest(rows)


def test_manifest_of_no_rows_and_what_tampering_changes(spark):
    assert merkle.verified_manifest(make(spark, [])).count() == 0
    rows = some_rows(50, ["a", "b", "c"])
    assert all(r.verified for r in merkle.manifest(make(spark, rows)).collect())
    told = {r.doc_id: r.verified for r in merkle.verified_manifest(make(spark, rows)).collect()}
    assert told == {r[0]: not (zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[1] or "")) for r in rows}


def test_numbers_follow_the_order_over_many_partitions(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 > 0 then 'hot' when id % 30 = 0 then null else concat('g', id % 9) end as g", "(id * 7919) % 3001 as k")
    out = merkle.numbered(rows.repartition(7), ["g"], ["k"]).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: r.k)
        assert [r.number for r in own] == list(range(len(own))) and {r.size for r in own} == {len(own)}


# --- whitening -----------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, component string, z double").repartition(5)


def check_whitening(spark, rows, components=32, tile=64):
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in sound], dtype=np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    covariance = (x - total / n).T @ (x - total / n) / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    z = (x - total / n) @ basis / np.sqrt(np.maximum(values, 1e-300))
    out, m = whitening.whiten(vectors(spark, rows), components, tile)
    assert np.allclose(m["covariance"], covariance, rtol=1e-12, atol=1e-9)
    k = min(components, x.shape[1])
    assert np.allclose(m["explained"], values[:k] / np.trace(covariance), rtol=1e-9)
    assert m["identity_error"] < 1e-8
    got = out.collect()
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.deviation) for r in got) == sorted((i is not None, i or 0, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))) for (i, _), row in zip(sound, x))
    by = {r.deviation: np.array(r.z) for r in got}
    own = np.stack([by[sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))] for row in x])
    sign = np.sign((own * z[:, :k]).sum(axis=0))
    assert np.abs(own * sign - z[:, :k]).max() < 1e-6
    return out


@pytest.mark.parametrize("tile", [64, 7, 1])
def test_whitening_is_that_of_numpy_for_every_tile(spark, tile):
    numbers = np.random.default_rng(3)
    rows = [(i, [float(c) for c in numbers.normal(size=20) * np.linspace(3, 0.2, 20)]) for i in range(150)]
    odd = [(500, None), (501, [None, *rows[0][1][1:]]), (502, [float("nan"), *rows[0][1][1:]]), (503, [float("-inf"), *rows[0][1][1:]]), (None, rows[7][1]), (9, rows[8][1]), rows[10]]
    check_whitening(spark, rows + odd, components=12, tile=tile)


def test_rows_of_components(spark):
    numbers = np.random.default_rng(4)
    rows = [(i, [float(c) for c in numbers.normal(size=5)]) for i in range(60)]
    got = whitening.whitened_components(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, k) for i in range(60) for k in range(1, 6)]
    assert {r.n for r in got} == {60} and {r.identity_error for r in got} == {max(r.identity_error for r in got)} and got[0].identity_error < 1e-9
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12


def test_whitening_without_a_direction(spark):
    assert whitening.whitened_components(vectors(spark, [])).count() == 0
    assert whitening.whitened_components(vectors(spark, [(1, None), (2, [None])])).count() == 0
    assert whitening.whitened_components(vectors(spark, [(1, [])])).count() == 0
    assert whitening.whitened_components(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened_components(vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    flat = whitening.whitened_components(vectors(spark, [(i, [float(i), 2.0]) for i in range(9)])).collect()  # one dimension is constant
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    unlike = whitening.whitened_components(vectors(spark, [*[(i, [float(i), float(i * i)]) for i in range(9)], (20, [1.0]), (21, [3e38, 1.0])])).collect()
    assert {r.vec_id for r in unlike} == set(range(9))


def test_wide_deviations_are_exact_or_null(spark):
    rows = [(i, [float(i * 2**33), float(i)]) for i in range(50)]
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(r[k] for r in x) for k in (0, 1)]
    true = {i: sum((50 * c - s) ** 2 for c, s in zip(r, sums)) for i, r in enumerate(x)}
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0].collect()}
    assert got == {i: d if d < 2**63 else None for i, d in true.items()}
