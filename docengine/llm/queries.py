"""One query an operator, on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import alignment, hamming, langid, media, mixing, near_duplicates, ngram_lm, packing, prefix_trie, quality, sharding, simhash, url_filter
from docengine.llm.common import stored, table

LISTED_HOSTS = r"(^|\.)(spam-farm|adult-x)\."
LISTED_EACH = 7


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign codes of all embeddings; queries are the rows whose vec_id is divisible by 50."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.search(codes, codes.where("id % 50 = 0"), k=10)


OP4_SQL = """
with d as (select q.vec_id as query_id, b.vec_id as vec_id,
  (select count(*) from range(1, 65) t(i) where (q.embedding[i] > 0) <> (b.embedding[i] > 0)) as distance
  from embeddings q, embeddings b where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by distance, vec_id) as rank, vec_id, distance from d)
select query_id, cast(rank as int) as rank, vec_id, cast(distance as int) as distance from r where rank <= 10
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is a media payload that the text's own page refers to."""
    kept = media.store_texts(table(spark, sf_dir, "documents"))
    pages = media.interleave(media.pages_of(kept)).withColumn("items", F.size("sequence"))
    found = media.resolve(media.references(pages, "doc_id", "items"), media.decoded(kept))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "items")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.range_sorted(mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", F.get("positions", F.lit(1)).alias("position2")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a list: canonical URLs on hosts of LISTED_HOSTS and, whatever their host, of every LISTED_EACH-th page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS) | ((host != "") & (F.col("page_id") % LISTED_EACH == 0))).select(url_filter.canonical(host, path).alias("listed"))
    return url_filter.url_verdicts(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.crc_of_id("doc_id") % 3 == 1, F.lit(False))
    trees = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), trees).drop("text")


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), langid.crc_of_id("doc_id") % 5 == 1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return scored.select("doc_id", "p_low", "p_toxic", "quality_score", quality.kept().alias("keep"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = alignment.alignments(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    kept = stored(swept.withColumn("groups_sha256", sha).drop("groups"), "aligned", compression="zstd", stay=True)
    return alignment.with_counts(kept).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
with p as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
h as (select page_id, {_LOWER.format("regexp_extract(coalesce(r, ''), '^([^/?#]*)([^?#]*)', 1)")} as host,
  regexp_extract(coalesce(r, ''), '^([^/?#]*)([^?#]*)', 2) as path from p),
c as (select *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') as canon from h),
l as (select distinct canon from c where regexp_matches(host, '(^|\\.)(spam-farm|adult-x)\\.') or (host <> '' and page_id % {LISTED_EACH} = 0)),
r as (select *, case
  when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/de/') then 'example.com/de/'
  when (host = 'org' or suffix(host, '.org')) and prefix(path, '/fr/') then 'org/fr/'
  when (host = 'net' or suffix(host, '.net')) and prefix(path, '/') then 'net/' end as rule from c)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when canon in (select canon from l) then 'block' else 'allow' end as verdict from r
"""

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_hamming_topk": op4_hamming_topk,
    "op5_media": op5_media,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_ngram_lm": op9_ngram_lm,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL = {"op4_hamming_topk": OP4_SQL, "op7_url_filter": OP7_SQL}
