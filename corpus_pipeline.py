"""A corpus pipeline: quality, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Documents that the
quality classifier rejects go; of each group of near duplicates one stays; documents that hold a benchmark
item go; secrets are replaced by a mark in documents that stay; the last stage encodes what is left.

Edge cases: a null or empty text is rejected by the first stage and, given to a later one, passes it unchanged; an
empty table passes every stage; columns beside those of documents are dropped by each stage; texts of any
length go the same way; rows of one id with different texts are documents of their own; ties are settled by the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, decontaminate, minhash, quality, secrets
from fieldloom.llm.common import Scratch, join_sized, settle, small_batches
from fieldloom.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_scratch: list[Scratch] = []


def _fresh(spark: SparkSession) -> Scratch:
    """Scratch space of a stage. That of the stage before is deleted: its result has been written by then; and what it left in memory goes."""
    small_batches(spark)
    settle(spark)
    while _scratch:
        _scratch.pop().drop()
    _scratch.append(Scratch(spark))
    return _scratch[-1]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, keeps. Those without words go; without labels of both kinds all others stay; repeated rows stay."""
    scratch = _fresh(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, scratch=scratch).where("keep").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id.

    Rows that repeat an id and its text are one document, with the least of their other values; rows of one id with
    different texts are judged each by its own. Texts without words and rows without an id stay.
    """
    scratch = _fresh(spark)
    judged = minhash.near_duplicates(docs.select("doc_id", "text"), scratch=scratch)
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_hash"))
    keys = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    gone = scratch.table(keys(judged.where("not kept")).distinct(), "gone")
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    kept = join_sized(hashed, gone, same, "left_anti")
    twice = keys(judged.where("kept and doc_id is not null")).groupBy("_id", "_hash").count().where("count > 1").drop("count")
    twice = scratch.table(twice, "twice")
    if twice.isEmpty():
        return kept.select(*COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = join_sized(kept, twice, same, "left_semi").groupBy("doc_id", "_text").agg(F.min(F.struct("text", *rest)).alias("r")).select("doc_id", "r.*")
    return join_sized(kept, twice, same, "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows share their fate."""
    scratch = _fresh(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=scratch).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars counted anew. A null text stays null."""
    _fresh(spark)
    return secrets.redact(docs, path="source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, their number, and digests of the ids and of what they decode to. A null text is empty."""
    _fresh(spark)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary(), with_ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", F.col("ids_le").alias("ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", tokens_stage),
]
#: SQL can't express the classifiers; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    between = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = between.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            between.drop(f"stage{k - 1}")
    while _scratch:
        _scratch.pop().drop()
    return docs
