"""A corpus pipeline: each stage reads what its predecessor wrote and works on all of it.

All stages but the last return the columns of documents. A stage keeps whole
rows or changes their texts; n_chars follows the text. Verdicts belong to rows,
not to ids: doc_id may be null or repeated, with the same text or another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.llm import language, lines, ngram_join, packing, pii
from stratalog.llm.arrow import work_dir
from stratalog.llm.queries import KEY, LANGUAGES, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a hash of all their columns, ``row``: only equal rows share it, and no copy of the texts is written."""
    return docs.select(F.xxhash64(*(x for c in COLUMNS for x in (F.col(c), F.col(c).isNull()))).alias("row"), *COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no known language explains go. The verdict comes along with its row."""
    model = language.train(docs, LANGUAGES)
    found = language.identify(docs, model, LANGUAGES, id_col="doc_id", text_col="text", declared_col="lang", host_col="source", carry=COLUMNS)
    return found.where("kept").select("carried.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in five documents or more stay in one."""
    kept = lines.dedup_lines(docs, carry=["lang", "source"])
    return kept.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, one of the least doc_id (null only where all are); five words and a similarity of 0.8. Rows without words all stay."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = keyed(docs).where(worded)
    groups = ngram_join.ngram_components(rows, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = groups.distinct().join(rows.select("row", "doc_id").distinct(), "row").groupBy("component").agg(F.min(rank).alias("least")).select("least.row")
    one = rows.withColumn("check", F.hash("text")).join(kept, "row", "left_semi").dropDuplicates(["row", "check"])  # of equal rows too
    return one.select(*COLUMNS).union(docs.where(~worded).select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms."""
    found = pii.pseudonymise(docs, KEY, carry=["lang", "source"])
    return found.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens; a row a piece."""
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("pii_pseudonyms", replace_personal_data),
    ("lexical_packing", pack),
]

#: No SQL: the stages train a model, tokenise and pack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
