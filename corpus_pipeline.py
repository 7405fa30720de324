"""The corpus pipeline: toxicity, near duplicates, PII, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to documents, each
result written to the shared folder and read again.  All stages but the last return the columns of
documents; other columns are dropped, empty tables pass through with these columns.  Null texts are
clean, in no group, without entities, one token long for the mix, and encoded as empty; null ids are
kept like any other, and drawn by their texts; rows that repeat are scored, replaced and drawn alike,
and one of them passes the near-duplicate stage if it has words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvec.llm import jaccard_join, mixture, piece_bpe, surrogates, toxic_lexicon
from tallyvec.llm.common import stage_table
from tallyvec.llm.queries import SURROGATE_KEY, default_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the lexicon is learned from the labels of the documents at hand."""
    model = toxic_lexicon.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_lexicon.score(docs.select(*COLUMNS), model, out="toxicity").filter("toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, null ids last; of rows that repeat it one.  Rows without words stay.

    Rows are known by their ids where these are all there and all different, else by their places in
    the table, so an id that repeats with other texts is no group.
    """
    rows, ids = docs.select(*COLUMNS), docs.select("doc_id")
    n, known, distinct = ids.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    unique = n == known == distinct
    rows = rows.withColumn("__row", F.col("doc_id") if unique else F.monotonically_increasing_id())
    groups = jaccard_join.jaccard_groups(rows.select("__row", "text"), doc_id="__row").filter("n_shingles > 0").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    if unique:  # the group goes by its smallest id
        dropped = groups.filter("__group <> __row").select("__row")
    else:
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
        kept = stage_table(rows.select("__row", "doc_id").join(groups, "__row").groupBy("__group").agg(first.alias("first")).select(F.col("first.__row").alias("__row")), "kept")
        dropped = groups.join(kept, "__row", "left_anti").select("__row")
    return rows.join(dropped, "__row", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities of the texts replaced; n_chars follows the new text."""
    out = surrogates.replace(docs.select(*COLUMNS), SURROGATE_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by the calibrated probabilities of their source, language and form."""
    return mixture.mix(docs.select(*COLUMNS)).filter("sampled").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text."""
    return piece_bpe.round_trip_digest(docs, default_model())


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", pii),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", tokens),
]
#: The lexicon, the surrogates and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
