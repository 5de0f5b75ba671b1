"""Corpus building over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scalars as X
from sparkloom.operators import corpus as C
from sparkloom.operators import sets as S
from sparkloom.operators import shards
from sparkloom.plans.registry import query, table

CHUNK = 256
WEIGHTS = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}
SEED = 132017026
LIMIT = 200_000
#: Thresholds of the cumulative stages, in tokens.
STAGES = {"s1": 4_000, "s2": 12_000, "s3": 30_000}
TARGET = 32_000

_POOL = C.STRUCTURED
_LINES = "select doc_id, lang, trim(unnest(string_split(text, chr(10))), ' ' || chr(9)) as line from documents"


@query(f"with l as ({_LINES}) select lang, case when regexp_matches(line, '{_POOL}') then 'structured' else lang end as pool, count(*) as lines, cast(sum(length(line)) as bigint) as chars from l where line <> '' group by all")
def line_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.pooled(C.split_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), "lang")
    return lines.groupBy("lang", "pool").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"""with t as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents), c as (select doc_id, w, unnest(range(0, cast(ceil(len(w) / {CHUNK}) as bigint))) as chunk_no from t)
  select doc_id, chunk_no, len(list_slice(w, chunk_no * {CHUNK} + 1, (chunk_no + 1) * {CHUNK})) as n_tokens, md5(array_to_string(list_slice(w, chunk_no * {CHUNK} + 1, (chunk_no + 1) * {CHUNK}), ' ')) as digest from c""")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.token_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", CHUNK)
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("chunk").alias("digest"))


_WEIGHTS = ", ".join(f"('{k}', {v}::double)" for k, v in WEIGHTS.items())
_INTERLEAVED = f"""
weights(lang, w) as (values {_WEIGHTS}),
items as (select doc_id, lang, w, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as tokens from documents join weights using (lang)),
placed as (select *, row_number() over (partition by lang order by doc_id) as place, coalesce(sum(tokens) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from items),
timed as (select *, before / w as vt from placed),
summed as (select *, sum(tokens) over (order by vt, lang, place rows between unbounded preceding and current row) as total from timed),
chosen as (select * from summed where total - tokens < {TARGET})
"""


def _interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).cast("long")
    items = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("tokens"))
    return C.interleaved(items, "lang", ["doc_id"], "tokens", WEIGHTS, TARGET)


@query(f"with {_INTERLEAVED} select lang, place, doc_id, tokens, cast(total as bigint) as total from chosen")
def weighted_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interleaved(spark, sf_dir).select("lang", F.col("place").cast("long").alias("place"), "doc_id", "tokens", "total")


_CASES = " union all ".join(f"select '{n}' as stage, {t} as threshold, (select min(total) from chosen where total >= {t}) as stage_tokens" for n, t in STAGES.items())


@query(f"""with {_INTERLEAVED}, s as ({_CASES}) select stage, threshold, lang, cast(sum(tokens) as bigint) as tokens, cast(stage_tokens as bigint) as stage_tokens, round(sum(tokens) / stage_tokens, 9) as ratio
  from chosen join s on total <= stage_tokens group by stage, threshold, lang, stage_tokens""")
def stage_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.stage_counts(_interleaved(spark, sf_dir), "lang", "tokens", "total", STAGES)
    return found.select("stage", F.col("threshold").cast("int").alias("threshold"), "lang", "tokens", "stage_tokens", F.round("ratio", 9).alias("ratio"))


@query(f"select doc_id, lang, sha256('{SEED}:' || cast(doc_id as varchar)) as shuffle_key, cast(row_number() over (partition by lang order by sha256('{SEED}:' || cast(doc_id as varchar)), doc_id) as bigint) as place from documents")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("shuffle_key", C.shuffle_key(SEED, F.col("doc_id")))
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("shuffle_key", "doc_id")).cast("long"))


@query("select doc_id, strlen(text) as size, sha256(text) as sha256, lower(md5(text)) as md5 from documents")
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("""with p as (select page_id, strlen(html) as size, sha256(html) as digest from pages) select size % 16 as bucket, count(*) as files, cast(sum(size) as bigint) as bytes, min(digest) as first_digest, count(distinct digest) as contents from p group by 1""")
def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest"))
    return pages.groupBy((F.col("size") % 16).alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("digest").alias("first_digest"), F.countDistinct("digest").alias("contents"))


@query("""with b as (select sha256(text) as digest, min(doc_id) as right_id from documents group by text having count(*) = 1)
  select d.doc_id as left_id, b.right_id, b.digest from documents d join b on sha256(d.text) = b.digest""")
def dup_content_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return S.unique_content_matches(docs, docs, "doc_id", "doc_id", "text")


@query(f"""with recursive d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as k from documents),
  f as (select source, doc_id, n_chars, k, cast(0 as bigint) as shard, n_chars as fill from d where k = 1
        union all select d.source, d.doc_id, d.n_chars, d.k, case when f.fill > 0 and f.fill + d.n_chars > {LIMIT} then f.shard + 1 else f.shard end, case when f.fill > 0 and f.fill + d.n_chars > {LIMIT} then d.n_chars else f.fill + d.n_chars end
        from f join d on d.source = f.source and d.k = f.k + 1)
  select source, doc_id, n_chars, shard from f""")
def shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.next_fit(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", LIMIT)


@query("""with a as (select doc_id, n_chars, cast(sum(((n_chars + 31) // 32) * 32) over (order by doc_id rows between unbounded preceding and current row) - ((n_chars + 31) // 32) * 32 as bigint) as "start" from documents)
  select doc_id, n_chars, "start", "start" + n_chars as "end" from a""")
def byte_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_cursor(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 32).select("doc_id", "n_chars", "start", "end")


@query("""with o as (select source, doc_id, cast(sum(n_chars) over (partition by source order by doc_id) - n_chars as bigint) as "offset" from documents), e as (select source, cast(sum(n_chars) as bigint) as total from documents group by source)
  select source, doc_id, "offset", coalesce(lead("offset") over (partition by source order by "offset"), total) - "offset" as size from o join e using (source)""")
def offset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = docs.withColumn("offset", F.sum("n_chars").over(w) - F.col("n_chars"))
    totals = docs.groupBy("source").agg(F.sum("n_chars").alias("total"))
    return shards.sizes_from_offsets(rows.join(totals, "source"), ["source"], "offset", "total").select("source", "doc_id", "offset", "size")


@query(r"""with p as (select regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', ['scheme', 'host', 'lang', 'number']) as x, regexp_replace(url, '\.html$', '') as stem, url from pages)
  select x.scheme as scheme, x.lang as lang, case when starts_with(x.host, 'm.') then 'mobile' when starts_with(x.host, 'www.') then 'www' else 'other' end as kind, count(*) as pages, cast(sum(case when stem <> url then 1 else 0 end) as bigint) as suffixed, cast(sum(case when contains(url, '?') then 1 else 0 end) as bigint) as queried
  from p group by all""")
def name_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, pattern = F.col("url"), r"^(https?)://([^/]+)/([a-z]{2})/([0-9]+)"
    host = F.regexp_extract(url, pattern, 2)
    kind = F.when(host.startswith("m."), "mobile").when(host.startswith("www."), "www").otherwise("other")
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract(url, pattern, 1).alias("scheme"), F.regexp_extract(url, pattern, 3).alias("lang"), kind.alias("kind"))
    return pages.groupBy("scheme", "lang", "kind").agg(F.count("*").alias("pages"), F.count_if(X.without_suffix("url", ".html") != F.col("url")).alias("suffixed"), F.count_if(F.col("url").contains("?")).alias("queried"))


@query("""select event_type, count(*) as lines, min(event_id) as first_event from events where regexp_matches(event_type || ' ' || coalesce(props, ''), '(?i)(error|purchase|"k": ?[0-9]*7)') group by event_type""")
def log_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat_ws(" ", "event_type", F.coalesce("props", F.lit(""))).alias("line"))
    return lines.where(X.forbidden("line", ["error", "purchase", '"k": ?[0-9]*7'])).groupBy("event_type").agg(F.count("*").alias("lines"), F.min("event_id").alias("first_event"))
