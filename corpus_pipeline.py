"""From landed documents to training ids: quality, near duplicates, repeated passages, leaks, encoding.

Every stage takes the documents its predecessor kept and returns documents again; the last
returns piece ids.  Stages are written as Parquet and read back, so each starts from files that
all executors reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import leaks, passages, pieces, quality, similar
from docketlake.llm.queries import PIECE_MODEL
from docketlake.llm.store import saved

KEEP_SCORE = 0.3       # documents below are rejected
SHINGLE_WORDS, SIMILARITY = 5, 80
PASSAGE_BYTES = 400
BROADCAST_KEYS = 1_000_000
NAMES = {"doc_id": "hash", "text": "notes"}


def _notices(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed(NAMES)


def _documents(notices: DataFrame, columns: list[str]) -> DataFrame:
    return notices.withColumnsRenamed({v: k for k, v in NAMES.items()}).select(*columns)


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose id is not among the given ones; those without an id stay."""
    ids = saved(ids.select(key).where(F.col(key).isNotNull()).distinct(), "dropped")
    return docs.join(_small(ids), key, "left_anti").select(*docs.columns)


def _one_of_equal_rows(docs: DataFrame, key: str) -> DataFrame:
    """The smallest of the rows that share a key; only those are shuffled."""
    again = saved(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "again")
    if again.isEmpty():
        return docs
    again = _small(again)
    rest = F.struct(*[c for c in docs.columns if c != key])
    one = docs.join(again, key, "left_semi").groupBy(key).agg(F.min(rest).alias("row")).select(key, "row.*")
    return docs.join(again, key, "left_anti").select(*docs.columns).unionByName(one)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it is fitted on the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "hash")
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_quality(_notices(source), labels, learn=F.crc32(F.col("hash").cast("string")) % 5 != 0)
    scored = quality.score_quality(_notices(docs), model, threshold=KEEP_SCORE)
    return _documents(scored.where("predicted = 1"), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: that with the smallest id, or one without if none has an id.

    Rows are told apart by id and text, so documents without an id are compared like all
    others, and so are the texts of a repeated id; of rows with equal id and text one stays.
    """
    number = docs.schema["doc_id"].dataType
    node = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0).cast(number)).alias("id"),
                    F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"))
    rows = docs.withColumn("_node", node)
    found = similar.similar_notices(rows.withColumnsRenamed({"text": NAMES["text"]}), key="_node", n=SHINGLE_WORDS, threshold=SIMILARITY)
    kept = _without(rows, found.where("component_id != _node").select("_node"), "_node")
    return _one_of_equal_rows(kept, "_node").select(*docs.columns)


def unrepeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand elsewhere; those that were nothing else go.

    A cut may fall inside a character; its rest is left out.  ``n_chars`` is that of the new text.
    """
    keyed = docs.withColumn("_other", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    cut = passages.drop_repeats(_notices(keyed), length=PASSAGE_BYTES, carry=["_other"])
    text = F.expr("replace(make_valid_utf8(cast(kept AS string)), '\\uFFFD', '')")
    cut = cut.where("size(spans) = 0 OR length(kept) > 0")
    own = F.when(F.col("n_bytes").isNotNull(), F.when(F.size("spans") > 0, text).otherwise(F.col("kept").cast("string")))
    out = cut.select(F.col("hash").alias("doc_id"), own.alias("text"), "_other.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, leaks.leaked_items(_notices(docs), items).select(F.col("hash").alias("doc_id")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every remaining document, with proof that they decode to its text."""
    # Written between, so that a task holds one Python worker, not an encoding and a decoding one.
    ids = pieces.decode_notices(saved(pieces.encode_notices(_notices(docs), PIECE_MODEL), "ids"), PIECE_MODEL)
    return ids.select(F.col("hash").alias("doc_id"), "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids",
                      (F.col("decoded") == F.coalesce("notes", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", unrepeated_text),
    ("benchmark decontamination", without_leaks),
    ("SentencePiece encoding and decoding", encoded),
]

ORACLE_SQL = None  # compression, learned weights and merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
