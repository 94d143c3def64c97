"""The registered queries of the training-data operators, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bitpack, licenses, mixing, near_dups, packing, quality, sharding, suffix_dedup, token_counts, topk
from larkspur.llm.common import read, written

SHARDS = 24


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(read(spark, sf_dir, "documents")))


def op3_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    sharded = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, size)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return sharded.select("doc_id", size.cast("long").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count("text").alias("words")), "sizes")  # both passes need the counts
    mixed = mixing.mix(sized, words=F.col("words"))
    out = mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_position", "second_position")
    return mixing.in_order(out)


def op6_pack_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0))


def op7_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bitpack.write_tokens(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return bitpack.read_tokens(spark, out)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, F.col("id") % 20 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", "posterior")


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = token_counts.length_histogram(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_counts.suffix_sums(hist)


def _words_sql(text: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low if text == 'lower' else text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    vocabulary = licenses.index_words(licenses.TEMPLATES)
    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, {quoted(t.words)}, {quoted(t.key_words)}, {t.key_at})" for t in licenses.TEMPLATES)
    return f"""
with t(label, base, words, key, lead) as (values {rows}),
d as materialized (select doc_id, {_words_sql("lower")} as w from documents),
df as (select u.x as x, count(*) as n from d, unnest(list_distinct(list_filter(w, lambda y: y in {quoted(vocabulary)}))) as u(x) group by 1),
weights as materialized (select map_from_entries(list((v.x, ln(((select count(*) from d) + 1) / (coalesce(df.n, 0) + 1)) + 1))) as idf from (select unnest({quoted(vocabulary)}) as x) v left join df using (x)),
h as materialized (select doc_id, w, t.*, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = key[1] and w[i : i + len(key) - 1] = key)) as s from d, t where contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(key, ' ') || ' ')),
m as materialized (select doc_id, cast(s - 1 as bigint) as start, label, base,
  list_sum(list_transform(range(1, len(words) + 1), lambda o: case when s - lead + o - 1 >= 1 and w[s - lead + o - 1] = words[o] then coalesce(idf[words[o]], 0.0) else 0.0 end)) / list_sum(list_transform(words, lambda x: coalesce(idf[x], 0.0))) as share from h, weights),
a as (select doc_id,
  count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels,
  coalesce(string_agg(distinct label, ',' order by label) filter (base or share >= {licenses.ENOUGH}), '') as labels,
  max(share) filter (base or share >= {licenses.ENOUGH}) as score from m group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0.0), 6) as score
from d left join a on d.doc_id = a.doc_id"""


_MIX_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
k as (select *, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || cast(size as varchar)), 1, 15) as bigint) as h from d),
src as (select source, cast(sum(size) as bigint) as source_size from k group by 1),
w as (select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 as int) + 1] as weight,
  [-0.5, 0.0, 0.5][cast((row_number() over (order by source nulls last) - 1) % 3 as int) + 1]::double as slope, 2 * source_size as cap from src),
f as (select *, coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
  sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as rest, sum(source_size) over () as total from w),
l as (select *, (3 * total - 2 * before)::double / (2 * rest)::double as level from f),
g as (select source, source_size, slope, least(cap::double, coalesce((select max(level) from l where cap / weight > level) * weight, cap::double)) as target from l),
p as (select k.*, g.source_size, g.slope, g.target, cast(round(g.target) as bigint) as demand,
  sum(k.size) over (partition by k.source order by h, doc_id, k.size rows between unbounded preceding and current row) - k.size as start from k join g on k.source is not distinct from g.source),
t as (select *, greatest(0, least(size, demand - start)) as a, greatest(0, least(size, demand - source_size - start)) as b from p),
u as (select *, start / demand as ua, (start + source_size) / demand as ub, 1 - slope as q from t)
select doc_id, size, source_size, round(target, 6) as target, cast(a + b as bigint) as taken,
  case when a > 0 then round(2 * ua / (q + sqrt(q * q + 4 * slope * ua)), 9) end as first_position,
  case when b > 0 then round(2 * ub / (q + sqrt(q * q + 4 * slope * ub)), 9) end as second_position from u"""

_TOPK_SQL = """
with v as materialized (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.n, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.n <> c.n),
r as (select *, cast(row_number() over (partition by n order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""


# crc32 byte by byte, over a table that its rule makes
_SHARD_SQL = f"""
with tab as materialized (select list(c order by i) as t from (select i, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(0, 256) r(i))),
d as materialized (select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, coalesce(text, '') as text, case when text is null then -1 else cast('0x' || substr(md5(text), 1, 15) as bigint) end as h from documents),
b as (select *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) as bytes from d),
k as (select doc_id, size, h, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32 from b, tab),
p as (select *, row_number() over (order by h, doc_id nulls first) as n, sum(size) over (order by h, doc_id nulls first rows between unbounded preceding and current row) - size as below, sum(size) over () as total from k),
s as (select *, cast(below * {SHARDS} // total as int) as shard from p)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by n) - 1 as slot, cast(null as int) as grown_shard from s"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_license_scan, op3_histogram_sort_shards, op4_super_minhash, op5_curriculum_mix, op6_pack_tournament, op7_bit_packed_tokens, op8_exact_topk, op9_weak_supervision, op10_length_histogram)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _license_sql(), "op3_histogram_sort_shards": _SHARD_SQL, "op5_curriculum_mix": _MIX_SQL, "op8_exact_topk": _TOPK_SQL}
