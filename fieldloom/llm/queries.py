"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, centroids, decontaminate, hnsw, html_extract, katz, language_id, minhash, periodic, quality, secrets, token_output, url_filters
from fieldloom.llm.common import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Fixed by the contract: sites to allow and to block.
SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Addresses that no corpus wants, wherever they are.
PATTERN_RULES = [("/wp-login.php^", "block"), ("/cgi-bin/", "block"), ("/adserver/", "block"), ("/casino/", "block"), ("/porn/", "block"), ("||doubleclick.net^", "block"), ("/click/redirect^", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.compile_rules(spark, SITE_RULES, PATTERN_RULES)
    return url_filters.judge(_read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
with parts as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
judged as (
  select *,
    case when host = 'www.example.com' or ends_with(host, '.www.example.com') then starts_with(path, '/en/') else false end as r19,
    case when host = 'example.com' or ends_with(host, '.example.com') then starts_with(path, '/en/') else false end as r15,
    case when host = 'net' or ends_with(host, '.net') then starts_with(path, '/es/') else false end as res,
    case when host = 'net' or ends_with(host, '.net') then starts_with(path, '/fr/') else false end as rfr,
    case when host = 'com' or ends_with(host, '.com') then starts_with(path, '/') else false end as rcom,
    regexp_matches(host || path, '/wp-login\.php([^A-Za-z0-9_.%-]|$)|/cgi-bin/|/adserver/|/casino/|/porn/|/click/redirect([^A-Za-z0-9_.%-]|$)|^([^/]*\.)?doubleclick\.net([^A-Za-z0-9_.%-]|$)') as bad
  from parts)
select page_id, host, path,
  case when r19 then 'www.example.com/en/' when r15 then 'example.com/en/' when res then 'net/es/' when rfr then 'net/fr/' when rcom then 'com/' end as rule,
  case when r19 then 'allow' when r15 or res or rfr then 'block' when rcom then 'allow' when bad then 'block' else 'allow' end as verdict
from judged
"""


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialise(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.learn(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "source", "lang", "evidence", "site_rate", "score", "keep")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def vocabulary() -> str:
    """Where the byte-level vocabulary is; part of the tokenizer package that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), path="source")
    return found.select("doc_id", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "chance")


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    docs = docs.withColumn("held_out", F.coalesce(rest == 0, F.lit(False)))
    scores, _ = katz.score(docs, train=rest != 0)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.detect(docs, crc=F.crc32(F.col("doc_id").cast("string")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors, start=F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256))


def _op13_sql() -> str:
    """Lloyd's rounds as chained tables."""
    assign = """a{r} as materialized (
  select vec_id, q, b.j as j, b.d as d from (
    select k.vec_id, k.q, min({{'d': list_sum(list_transform(list_zip(k.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint, 'j': c.j}}) as b
    from kept k, c{r} c group by k.vec_id, k.q) t)"""
    move = """m{n} as (select j, i, sum(x)::hugeint as s, count(*)::hugeint as n from (select j, generate_subscripts(q, 1) as i, unnest(q) as x from a{r}) t group by j, i),
c{n} as materialized (
  select c.j, coalesce(l.c, c.c) as c
  from c{r} c left join (select j, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from m{n} group by j) l on c.j = l.j)"""
    steps = [assign.format(r=0)]
    for r in range(centroids.ROUNDS):
        steps += [move.format(r=r, n=r + 1), assign.format(r=r + 1)]
    last = centroids.ROUNDS
    return f"""
with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({centroids.STEPS} * x::double)::bigint) as q
  from embeddings
  where len(embedding) = {centroids.SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {centroids.SIZE}),
c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id::varchar)) - 1 as j, q as c from kept
  qualify j < {centroids.COUNT}),
{", ".join(steps)}
select a.vec_id, a.j::int as cluster, a.d::bigint as distance,
  (sum(a.d) over (partition by a.j))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
  sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{last} a join c{last} c on a.j = c.j
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_token_output": op2_token_output,
        "op3_quality": op3_quality,
        "op4_html_extraction": op4_html_extraction,
        "op5_decontamination": op5_decontamination,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_language_id": op7_language_id,
        "op8_minhash": op8_minhash,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_secrets": op10_secrets,
        "op11_katz": op11_katz,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op13_centroids": _op13_sql()}
