"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers

from triage.llm import decontaminate, language_id, line_dedup, lm_score, merkle, multi_index, ngram_join, packing, quality, sentencepiece_bpe, sharding, toxicity, whitening
from triage.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {
    "op2_lm_score": lambda spark, sf_dir: lm_score.lm_scores(table(spark, sf_dir, "documents")),
    "op3_toxicity": lambda spark, sf_dir: toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_multi_index": lambda spark, sf_dir: multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings")),
    "op5_language_id": lambda spark, sf_dir: language_id.predict_languages(table(spark, sf_dir, "documents")),
    "op8_quality": lambda spark, sf_dir: quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_line_dedup": lambda spark, sf_dir: line_dedup.line_report(table(spark, sf_dir, "documents")),
    "op7_feistel_shards": lambda spark, sf_dir: sharding.assign_shards(table(spark, sf_dir, "documents")),
    "op1_mixture_packing": lambda spark, sf_dir: packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False).drop("ids"),
    "op9_decontaminate": lambda spark, sf_dir: decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op10_ngram_join": lambda spark, sf_dir: ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents")),
    "op11_sentencepiece": lambda spark, sf_dir: sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), PIECES),
    "op12_merkle_manifest": lambda spark, sf_dir: merkle.verified_manifest(table(spark, sf_dir, "documents")),
    "op13_whitening": lambda spark, sf_dir: whitening.whitened_components(table(spark, sf_dir, "embeddings")),
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The rounds of the permutation, each from the (u, v) of the one before.
_ROUNDS = ",\n".join(
    f"r{i} as (select {'id, (u + f) % a as u, v' if i % 2 == 0 else 'id, u, (v + f) % b as v'}, a, b from ("
    f" select *, xor(z, z >> 11) as f from (select *, xor(y, y >> 13) % 2147483647 * 69621 % 2147483647 as z from ("
    f"  select *, ({'v' if i % 2 == 0 else 'u'} + {k}) % 2147483647 * 48271 % 2147483647 as y from r{i - 1}))))"
    for i, k in enumerate(sharding.round_keys(2024))
).replace("r-1", "pairs")

_CRC_TABLE = """crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: k::ubigint)),
      lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end) as c from range(256) t(i))
)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text, with ``crc_table`` in scope."""
    return f"""xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::ubigint)),
      lambda x, y: xor(x >> 8, t[((xor(x, y) & 255) + 1)::bigint])), 4294967295::ubigint)"""


def _leaf(text: str) -> str:
    """The digest of a row's fields, with the text as given."""
    return "sha256(" + " || ".join(f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, nodes: str) -> str:
    """The nodes of all levels of trees from ``nodes`` (g, idx, h), the runs of those levels that have a level above, and what remains."""
    return f"""{name} as (
  select 0 as lvl, g, idx, h from {nodes} union all
  select lvl + 1, g, idx // {merkle.RUN}, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over (partition by g) as c from {name}) where c > 1 group by lvl, g, idx // {merkle.RUN}
), {name}_runs as (
  select lvl, g, idx // {merkle.RUN} as parent, list(h order by idx) as hs from (select *, count(*) over (partition by g, lvl) as c from {name}) where c > 1 group by all
), {name}_tops as (select g, h from {name} qualify count(*) over (partition by g, lvl) = 1)"""


def _climb(name: str, start: str, tree: str) -> str:
    """Each row's way up: the digest folded so far and the siblings met."""
    before, after = (f"coalesce(array_to_string(hs[{a}], ''), '')" for a in (f"1:w.idx % {merkle.RUN}", f"w.idx % {merkle.RUN} + 2:"))
    return f"""{name} as (
  select * from ({start}) union all
  select w.row, w.g, w.lvl + 1, w.idx // {merkle.RUN}, sha256({before} || w.f || {after}), w.p || {before} || {after}
  from {name} w join {tree}_runs r on r.g = w.g and r.lvl = w.lvl and r.parent = w.idx // {merkle.RUN}
), {name}_end as (select * from {name} qualify row_number() over (partition by row order by lvl desc) = 1)"""


ORACLE_SQL = {
    "op6_line_dedup": rf"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from documents
), w as (
  select doc_id, k, regexp_extract_all({_LOWER.replace("text", "line")}, '[^\x20\x09-\x0D]+') as w from l
), t as (
  select distinct doc_id, k, unnest(case when len(w) >= {line_dedup.K}
      then list_transform(range(1, len(w) - {line_dedup.K} + 2), lambda i: array_to_string(w[i:i + {line_dedup.K} - 1], ' '))
      else ['# ' || array_to_string(w, ' ')] end) as g
  from w where len(w) >= {line_dedup.LEAST_WORDS}
), n as (select doc_id, k, count(*) as n from t group by 1, 2), gone as (
  select distinct doc_id, k from (
    select y.doc_id, y.k from t y join t x on x.g = y.g and (x.doc_id, x.k) < (y.doc_id, y.k)
    join n a on a.doc_id = x.doc_id and a.k = x.k join n b on b.doc_id = y.doc_id and b.k = y.k
    group by y.doc_id, y.k, x.doc_id, x.k having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*)))
), g as (select doc_id, count(*) as n_removed, string_agg(k::varchar, ',' order by k) as removed_lines from gone group by 1)
select d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed_lines, '') as removed_lines
from documents d left join g using (doc_id)
""",
    "op7_feistel_shards": f"""
with recursive {_CRC_TABLE}, sized as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size,
    {_crc32("coalesce(text, '')")} as text_crc32
  from documents cross join crc_table
), numbered as (
  select *, row_number() over (order by bucket, doc_id nulls first, size, text_crc32) - 1 as number, count(*) over () as n
  from (select sized.*, {_crc32("coalesce(doc_id, -1) || '/' || size || '/' || text_crc32")} % {sharding.BUCKETS} as bucket from sized cross join crc_table)
), shape as (
  select n, a, (n + a - 1) // a as b from (select n, ceil(sqrt(n))::bigint as a from (select max(n) as n from numbered))
), pairs as (
  select id, id // b as u, id % b as v, a, b from shape, range(a * b) t(id)
), {_ROUNDS}, step as (
  select id, u * b + v as next from r{sharding.ROUNDS - 1}
), way as (
  select id, next from step, shape where id < n
  union all
  select way.id, step.next from way join step on step.id = way.next, shape where way.next >= n
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (next % 40)::int as shard, next // 40 as slot, null::int as grown_shard
from numbered join way on way.id = number, shape where next < shape.n
""",
    "op9_decontaminate": rf"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), wins as (
  select distinct id as item_id, least(len(w), 10) as k,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as g
  from words where kind = 'b' and len(w) > 0
), ks as (select distinct k from wins), grams as (
  select id as doc_id, k, unnest(range(1, len(w) - k + 2)) as pos,
         unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as g
  from words cross join ks where kind = 'd' and len(w) >= k
), hits as (
  select doc_id, item_id, pos, grams.k from grams join wins on wins.k = grams.k and wins.g = grams.g
), marked as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + k)) as p from hits) group by 1
), named as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from hits) group by 1
)
select w.id as doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join marked m on m.doc_id = w.id left join named n on n.doc_id = w.id where w.kind = 'd'
""",
    "op10_ngram_join": rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 5
      then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      when len(w) > 0 then ['# ' || array_to_string(w, ' ')] else []::varchar[] end) as g
  from w
), n as (
  select w.doc_id, count(s.g) as n from w left join s using (doc_id) group by 1
), links as (
  select a.doc_id as u, b.doc_id as v
  from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), reach(u, v) as (
  select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u
)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(reach.v), n.doc_id)) as component_id
from n left join reach on reach.u = n.doc_id group by n.doc_id, n.n
""",
    "op12_merkle_manifest": f"""
with recursive {_CRC_TABLE}, told as (
  select *, case when {_crc32("doc_id::varchar")} % 2 = 0 then replace(text, chr(10), '') else text end as changed from documents cross join crc_table
), hashed as (
  select row_number() over () as row, doc_id, source, coalesce('=' || source, '') as g, {_leaf("text")} as leaf, {_leaf("changed")} as other from told
), leaves as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf, other) - 1 as number from hashed
), lower_nodes as (select g, number as idx, leaf as h from leaves), {_tree("low", "lower_nodes")}, subs as (
  select g as sub, '' as g, row_number() over (order by g) - 1 as idx, h from low_tops
), {_tree("high", "subs")},
{_climb("one", "select row, g, 0 as lvl, number as idx, other as f, '' as p from leaves", "low")},
{_climb("two", "select o.row, s.g, 0 as lvl, s.idx, o.f, o.p from one_end o join subs s on s.sub = o.g", "high")}
select l.doc_id, l.leaf, s.h as subroot, r.h as root, sha256(w.p) as proof_sha256, w.f as folded_root, w.f = r.h as verified
from leaves l join two_end w using (row) join subs s on s.sub = l.g cross join high_tops r
""",
}
