"""Tables that are awkward in one way each: clashing columns, one very long text, no rows to learn from, ids of one stride, buckets of thousands of unlike members."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from triage.llm import decontaminate, language_id, line_dedup, lm_score, multi_index, ngram_join, quality, sharding, toxicity  # noqa: E402

OUTPUTS = ("score", "predicted", "held_out", "lang_pred", "rejected", "label", "toxic", "quality", "features", "id", "rank", "query_id", "cell", "bucket", "n")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in OUTPUTS})


def rows_of(df):
    return sorted(str(r.asDict()) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = {lang: [a + b for a in heads for b in tails] for lang, heads, tails in (("en", "th sh wh st".split(), "e at is ing ould".split()), ("de", "sch ge ver un".split(), "en ung heit lich er".split()))}
    out = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        out.append((i, " ".join([*r.choices(words[lang], k=40), *(["vile", "scum"] if i % 3 == 0 else [])]), lang, f"s{i % 3}"))
    return spark.createDataFrame([*out, (900, None, None, None), (901, "", "en", "s1")], "doc_id long, text string, lang string, source string").repartition(3)


def test_columns_named_as_results(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    for f in (toxicity.toxicity_scores, quality.quality_scores):
        assert rows_of(f(clashing(docs), labels)) == rows_of(f(docs, labels))
    assert rows_of(language_id.predict_languages(clashing(docs))) == rows_of(language_id.predict_languages(docs))
    assert rows_of(lm_score.lm_scores(clashing(docs))) == rows_of(lm_score.lm_scores(docs))
    r = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    assert rows_of(multi_index.nearest_neighbours(clashing(vectors))) == rows_of(multi_index.nearest_neighbours(vectors))


def test_one_very_long_text(spark, docs):
    r = random.Random(2)
    long = " ".join(r.choices(["the", "that", "should", "wing", "stating"], k=600_000))
    passage = " ".join(f"item{i}" for i in range(30))
    big = docs.unionByName(spark.createDataFrame([(1000, f"{long} {passage} {long}", "en", "s1")], docs.schema))
    got = {x["doc_id"]: x for x in language_id.predict_languages(big).collect()}
    assert len(got) == 123 and got[1000]["lang_pred"] == "en" and got[900]["lang_pred"] == "und"
    benchmark = spark.createDataFrame([(7, passage)], "item_id long, text string")
    hit = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"]) for x in decontaminate.contamination(big, benchmark).collect()}
    assert hit[1000] == (1_200_030, 30, 1) and sum(h[1] for h in hit.values()) == 30


def test_scores_without_rows_to_learn_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:10]
    got = lm_score.lm_scores(spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")).collect()
    assert len(got) == 10 and all((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 4, 0, 0) for r in got)
    assert all(np.isfinite(r["score"]) for r in got)


def test_ids_of_one_stride_fill_many_buckets(spark):
    """Ids that are multiples of the number of buckets, and null ids with different texts."""
    ids = spark.range(3000).select((F.col("id") * sharding.BUCKETS).alias("doc_id"), F.lit("t").alias("text"))
    nulls = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    own = ids.union(nulls)
    filled = own.select("doc_id", F.length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")).groupBy(sharding.bucket()).count()
    assert filled.count() > 2500 and filled.agg(F.max("count")).first()[0] < 20
    sizes = [r["n"] for r in sharding.assign_shards(own).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).where("last = n - 1").select("n").collect()]
    assert sizes == [150] * 40


def test_five_thousand_unlike_lines_of_the_same_phrases(spark):
    """Every prefix token of a line is frequent, so the lines share large buckets; only those of the same phrases in the same order are alike."""
    r = random.Random(3)
    phrases = [" ".join(f"p{k}w{j}" for j in range(8)) for k in range(30)]
    picks = [tuple(r.sample(range(30), 4)) for _ in range(5000)]
    first, gone = {}, set()
    for i, p in enumerate(picks):
        if first.setdefault(p, i) != i:
            gone.add((i // 100, i % 100))
    rows = [(d, "\n".join(" ".join(phrases[k] for k in p) for p in picks[100 * d : 100 * d + 100])) for d in range(50)]
    got = {(x["doc_id"], int(k)) for x in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for k in x["removed_lines"].split(",") if k}
    assert got == gone and gone


def test_a_bucket_of_unlike_texts_beyond_a_block(spark):
    """1,300 texts that have one half in common, and copies of twenty of them with a word more."""
    r = random.Random(4)
    common = " ".join(f"c{i}" for i in range(40))
    texts = [common + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(45)) for _ in range(1300)]
    assert len(texts) > 2 * ngram_join.BLOCK_SETS
    rows = [*enumerate(texts), *((2000 + i, texts[60 * i] + " more") for i in range(20))]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).collect()}
    assert got == {**{i: i for i in range(1300)}, **{2000 + i: 60 * i for i in range(20)}}
