"""Operator 5, language identification by compression.

Each language's dictionary is plain text of its training documents. A text is cut into pieces, each
piece is compressed by zstandard with every dictionary, and the language with the fewest bytes in all
is chosen. A narrow margin between the best two marks the answer as rejected.

A dictionary is a bounded sample: about ``SAMPLE`` distinct texts drawn by their hashes (copies count once),
of long ones ``PARTS`` stretches at hashed places. All dictionaries together have ``TOTAL`` bytes at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

#: Bytes of a dictionary; texts it is made from, about; bytes of a piece; level of compression.
DICTIONARY, SAMPLE, PIECE, LEVEL = 256 << 10, 400, 16 << 10, 6
#: Stretches taken of a long text; bytes of all dictionaries, which many languages share.
PARTS, TOTAL = 1, 64 << 20
#: Share of the best size by which the second must be larger, else the answer is rejected.
MARGIN = 0.01
UNKNOWN = "und"


def stretches(text: Column, share: Column) -> Column:
    """The text if it has ``share`` characters at most, else PARTS stretches of it, one at a hashed place of each equal part."""
    size, part = F.length(text), F.greatest(F.floor(share / PARTS), F.lit(1)).cast("int")

    def one(j: Column) -> Column:
        place = F.pmod(F.xxhash64(text, j), F.lit(1 << 20)) / float(1 << 20)
        return F.substring(text, F.floor((j + place) * (size - part) / PARTS).cast("int") + 1, part)

    return F.when(size <= share, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), one), "\n"))


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary text by language from ``lang, text`` rows: about SAMPLE distinct texts by their hashes, each to its fair share."""
    known = docs.where("lang is not null and length(text) > 0").select("lang", F.xxhash64("text").alias("hash"), F.lower("text").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not sizes:
        return {}
    room = min(DICTIONARY, max(1, TOTAL // len(sizes)))
    by_lang = lambda f: F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, f(n))]), F.col("lang"))
    share = by_lang(lambda n: max(min(512, room), room // max(1, min(n, SAMPLE))))
    chosen = known.where(C.draw("hash") < by_lang(lambda n: C.draw_limit(SAMPLE, n))).select("lang", "hash", stretches(F.col("text"), share).alias("text"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.groupBy("lang", "hash").agg(F.min("text").alias("text")).collect():  # about SAMPLE rows a language, DICTIONARY bytes in all
        parts.setdefault(r["lang"], []).append((r["hash"], r["text"]))
    return {lang: b"\n".join(t.encode() for _, t in sorted(rows))[:room] for lang, rows in sorted(parts.items())}


def _compressors(dictionaries: dict[str, bytes]) -> dict:
    import zstandard

    found = {}
    for lang, data in dictionaries.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        found[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False)
    return found


def sizes(text: str, compressors: dict) -> np.ndarray:
    raw = text.lower().encode()
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in compressors.values()], dtype=np.int64)


def choose(size: np.ndarray) -> tuple[int, float, bool]:
    """(place of the smallest, score, rejected); ties go to the first. Score: share of the best under weights that halve with each 1/200 of its size."""
    best = int(size.argmin())
    excess = (size - size[best]) / max(int(size[best]), 1)
    second = float(np.delete(excess, best).min()) if len(size) > 1 else 1.0
    return best, float(1 / np.exp2(-200 * excess).sum()), second < MARGIN


def _predict(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model.value)
        langs = list(compressors)
        for batch in batches:
            lang, score, rejected = [], [], []
            for text in batch.column("text").to_pylist():
                got = choose(sizes(text, compressors)) if langs and text and any(map(str.isalpha, text)) else None
                lang.append(UNKNOWN if got is None else langs[got[0]])
                score.append(0.0 if got is None else got[1])
                rejected.append(got is None or got[2])
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return run


def predict_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, one row per document.

    Learns from documents with a language whose crc32(id) mod 5 isn't 0. A text that is null or has no
    letter is ``und`` with score 0. Null ids and repeated rows are documents like any other; an equal
    size goes to the language that sorts first; with no language to learn all are ``und``. Extra columns
    are ignored; no documents, no rows.
    """
    held = F.pmod(C.id_crc32("doc_id"), F.lit(5)) == 0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(own.where(~F.col("held_out"))))
    return own.drop("lang").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
