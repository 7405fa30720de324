"""The queries op1 to op10 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac_columns, hilbert_shards, jaccard_join, mixture, piece_bpe, simhash, suffix_dedup, surrogates, toxic_lexicon, warc_io
from .common import stage_table


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The key of the registered queries, whose inputs are invented; it is no secret.
SURROGATE_KEY = "key of the registered queries"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digest(_read(spark, sf_dir, "documents"), default_model())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other documents within 3 bits (n_near) and within the radius of near copies (n_near_copies), for the ids that are queries (divisible by 20)."""
    prints = stage_table(simhash.with_edited(_read(spark, sf_dir, "documents")), "prints")
    found = simhash.near_counts(prints.filter("doc_id % 20 = 0"), prints, {"n_near": 3, "n_near_copies": simhash.NEAR_COPY_RADIUS})
    near = stage_table(found.select("q0", "q1", *[(F.col(c) - 1).alias(c) for c in ("n_near", "n_near_copies")]), "near")
    # only queries have counts, and both sides are dealt anew, so the rows of a fingerprint that many share can be split
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    of_query = prints.filter(asked).join(near, (prints.fp0 == near.q0) & (prints.fp1 == near.q1), "left").drop("q0", "q1")
    joined = of_query.unionByName(prints.filter(~asked), allowMissingColumns=True)
    likeness = lambda a, b: simhash.likeness(("fp0", "fp1"), (a, b))
    return joined.select("doc_id", "n_chars", "edited_sha256", simhash.as_text("fp0", "fp1").alias("fingerprint"), simhash.as_text("ed0", "ed1").alias("edited_fingerprint"), likeness("ed0", "ed1").alias("near_edited"), likeness("nx0", "nx1").alias("near_next"), "n_near", "n_near_copies")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc_io.round_trip(_read(spark, sf_dir, "pages"))
    return captures.select("page_id", F.col("payload_length").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxic_lexicon.fit(docs, labels)
    scored = toxic_lexicon.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", toxic_lexicon.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.document_shards(_read(spark, sf_dir, "documents"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_read(spark, sf_dir, "documents"), SURROGATE_KEY, count="n_entities")


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams are written to the shared folder and read back before they are decoded."""
    return flac_columns.media_digest(stage_table(flac_columns.to_flac(_read(spark, sf_dir, "documents")), "flac", "zstd"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_suffix_dedup, op4_warc, op5_toxicity, op6_hilbert_shards, op7_mixture, op8_surrogates, op9_flac, op10_jaccard)}
ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
        d AS (SELECT page_id, payload_bytes, (
            SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(hex, 1 + 5 * (g.i // 4), 5))::BIGINT >> (15 - 5 * (g.i % 4))) & 31))::BIGINT, 1), '' ORDER BY g.i)
            FROM range(32) g(i)) AS payload_digest FROM h),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
        FROM m""",
    "op10_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
        u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN least ON a = doc_id""",
}
