"""The registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfmesh.functions.geom import rounded
from surfmesh.llm import compression, decontaminate, htmlcut, mixing, sharding, simhash, toxicity, unitdedup, warczip, winnowing


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where labels may not be learnt from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and toxic spans of every document; learnt from labels outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), learn=lambda i: ~held_out(i))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_toxic_words", "spans")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, with the bytes of its text."""
    found = sharding.sharded(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("_shard").alias("shard"), F.col("_bytes").alias("n_bytes"))
    return found


def op3_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmlcut.extract(_read(spark, sf_dir, "pages"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, base rules and the verdict of the compression bands for every document."""
    return compression.quality(_read(spark, sf_dir, "documents"))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later repeated runs of lines."""
    return winnowing.deduplicated(_read(spark, sf_dir, "documents"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP packages, and what reading those back by byte ranges gives."""
    packages = warczip.write_packages(_read(spark, sf_dir, "pages"), warczip.new_folder(spark))
    return warczip.read_packages(packages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later occurrences of repeated passages."""
    return unitdedup.deduplicated(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a window similar to a benchmark item, by item."""
    found = decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", rounded("similarity", 6).alias("similarity"), "start_word", "n_shingles")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources, targets being the square roots of their sizes."""
    found = mixing.mixed(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"), F.col("_in_target").alias("in_target"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_html_mincut, op4_compression_bands, op5_line_winnowing, op6_warc_zip, op7_simhash, op8_unit_dedup, op9_decontamination, op10_mixing)}
ORACLE_SQL: dict[str, str] = {
    # The shortest prefix of the hash whose rows fit the limit; at 60 bits all that is left.
    "op2_sharding": """
with d as (select doc_id, coalesce(strlen(text), 0) as n_bytes,
  coalesce(('0x' || substr(md5(coalesce(doc_id::varchar, text)), 1, 15))::bigint, 0) as h from documents),
p as (select doc_id, n_bytes, h, k, h >> (60 - k) as cell from d, range(0, 61) r(k)),
s as (select k, cell from p group by k, cell having sum(n_bytes) <= 33554432),
f as (select doc_id, h, n_bytes, min(k) as k from p join s using (k, cell) group by doc_id, h, n_bytes)
select doc_id, substr(lpad(bin(h), 60, '0'), 1, k::int) as shard, n_bytes::bigint as n_bytes from f""",
    # One step a slot: of the released blocks the one with the earliest deadline, the lower source on ties.
    "op10_mixing": """
with recursive d as (select doc_id, source, coalesce(('0x' || substr(md5(coalesce(doc_id::varchar, text)), 1, 15))::bigint, 0) as h from documents),
s as (select source, count(*) as n, row_number() over (order by source nulls first) - 1 as g from d group by source),
a as (select list(sqrt(n) order by g) as w, list((n + 63) // 64 order by g) as b, sum(sqrt(n)) as t, count(*) as c from s),
v as (
  select -1::bigint as slot, -1::bigint as pick, list_transform(b, lambda x: 0::bigint) as done, null::bigint as dry, 0::bigint as tick from a
  union all
  select slot + 1, pick.g, list_transform(range(len(done)), lambda i: case when i = pick.g then done[i + 1] + 1 else done[i + 1] end),
    case when dry is null and late is not null and (early is null or late < early) then slot + 1 else dry end, greatest(tick, pick.due0) + 1
  from (
    select *, coalesce(early, list_min(list_transform(list_filter(jobs, lambda x: x.due0 = soon), lambda x: {'due': x.due, 'g': x.g, 'due0': x.due0}))) as pick
    from (
      select *, list_min(list_filter(jobs, lambda x: x.due0 <= tick)) as early, list_min(list_transform(jobs, lambda x: x.due0)) as soon,
        list_min(list_filter(list_transform(range(c), lambda i: case when done[i + 1] = b[i + 1] then {'due': ceil((done[i + 1] + 1) * t / w[i + 1] - 1e-9)::bigint, 'g': i,
          'due0': floor(done[i + 1] * t / w[i + 1] + 1e-9)::bigint} end), lambda x: x is not null and x.due0 <= tick)) as late
      from (
        select v.slot, v.done, v.dry, v.tick, a.*, list_filter(list_transform(range(c), lambda i: case when done[i + 1] < b[i + 1] then {'due': ceil((done[i + 1] + 1) * t / w[i + 1] - 1e-9)::bigint, 'g': i,
          'due0': floor(done[i + 1] * t / w[i + 1] + 1e-9)::bigint} end), lambda x: x is not null) as jobs
        from v, a where list_sum(done) < list_sum(b)))))
,
placed as (select slot, pick as g, row_number() over (partition by pick order by slot) - 1 as block from v where pick >= 0),
finish as (select coalesce(min(dry), max(slot) + 1) as dry from v),
ranked as (select doc_id, d.source as source, g, row_number() over (partition by g order by h % ((n + 1999) // 2000), h, doc_id) - 1 as i from d join s on s.source is not distinct from d.source),
dealt as (select doc_id, source, g, i // 64 as block, i % 64 as r from ranked)
select doc_id, source, block::bigint as block, slot, slot * 64 + r as position, slot < dry as in_target from dealt join placed using (g, block), finish""",
    "op6_warc_zip": """
with p as (select page_id, url, coalesce(html, '') as h from pages),
d as (select page_id, url, strlen(h) as n, sha256(h) as digest from p),
f as (select digest, min(page_id) as first, count(*) as c from d where n >= 100 group by digest)
select page_id, n::bigint as payload_bytes, d.digest as payload_digest, case when c > 1 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when c > 1 and page_id <> first then first end as refers_to, url
from d left join f on f.digest = d.digest""",
    # Every window of an item's length that starts at one of its shingles (or ends with the text), compared exactly.
    "op9_decontamination": """
with words as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents
  union all select 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') from benchmark),
s as (select kind, id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end as s from words),
items as (select id as item_id, s as b, len(s) as n from s where kind = 'b' and len(s) > 0),
grams as (select item_id, n, unnest(b) as g from items),
icount as (select item_id, n, g, count(*) as c from grams group by all),
docs as (select id as doc_id, s as a, len(s) as m from s where kind = 'd' and len(s) > 0),
place as (select doc_id, m, unnest(a) as g, generate_subscripts(a, 1) - 1 as p from docs),
start as (select distinct doc_id, item_id, n, greatest(0, least(p, m - n)) as k from place join (select distinct item_id, n, g from grams) using (g)),
wcount as (select doc_id, item_id, n, k, g, count(*) as c from start join place using (doc_id) where p >= k and p < k + n group by all),
same as (select w.doc_id, w.item_id, w.n, w.k, sum(w.c) as size, sum(least(w.c, coalesce(i.c, 0))) as common
  from wcount w left join icount i on i.item_id = w.item_id and i.g = w.g group by all),
scored as (select *, common / (size + n - common)::double as similarity from same)
select doc_id, item_id, round(similarity, 6) as similarity, k::bigint as start_word, n::bigint as n_shingles from scored where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, k) = 1""",
}
