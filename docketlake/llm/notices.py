"""The notice columns that the operators of this package work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, TEXT = "hash", "notes"


def from_documents(documents: DataFrame) -> DataFrame:
    """Rows of a text table as notices: key in ``hash``, text in ``notes``, origin in ``source_name``."""
    return documents.select(F.col("doc_id").alias(KEY), F.col("text").alias(TEXT),
                            F.col("source").alias("source_name"))


def labelled_sample(notices: DataFrame, labels: DataFrame, key: str, label: str, rows: int, learn: Column | None = None,
                    longest: int | None = None, text: str = TEXT) -> DataFrame:
    """``_key, _label`` and text of at most ``rows`` notices of each label 0 and 1, chosen by a hash of the key.

    ``learn`` is a condition on the key.  Keys are chosen among the labels, which are small, and
    then sent to the notices, so no text is shuffled; texts of over ``longest`` bytes are left out.
    """
    known = labels.where(learn) if learn is not None else labels
    known = known.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")) \
        .where("_key IS NOT NULL AND _label IN (0, 1)").groupBy("_key").agg(F.max("_label").alias("_label"))
    order = F.xxhash64(F.col("_key").cast("string"))
    chosen = [known.where(F.col("_label") == value).orderBy(order, "_key").limit(rows) for value in (0, 1)]
    texts = notices.select(F.col(key).alias("_key"), F.col(text).alias(text))
    if longest is not None:
        texts = texts.where(F.octet_length(text).between(1, longest))
    return texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_key")  # at most 2 * rows keys
