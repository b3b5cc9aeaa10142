"""Bounded samples of labelled rows, the only data that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCALE = 1 << 30


def bounded_ids(labelled: DataFrame, per_class: int, most_rows: int) -> DataFrame:
    """(doc_id, y) of at most ``per_class`` rows of each class of labelled (doc_id, y), spread evenly by a hash of the id.

    At most ``most_rows`` in all: where classes are so many that this would be exceeded, each has fewer rows, and one at
    least, so no class is left out unless there are more classes than ``most_rows``."""
    labelled = labelled.where("doc_id IS NOT NULL AND y IS NOT NULL")
    counts = labelled.groupBy("y").agg(F.count("*").alias("__n"))
    classes = counts.count()
    if not classes:
        return labelled.limit(0)
    each = max(1, min(per_class, most_rows // classes))
    key = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(_SCALE))
    # About twice as many as are wanted and forty more pass the hash, so that no class is missed; the first of these are taken.
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 40) / F.col("__n"))
    some = labelled.join(counts, "y").where(key < F.ceil(share * _SCALE)).withColumn("__key", key)
    first = F.row_number().over(Window.partitionBy("y").orderBy("__key", "doc_id"))
    return some.withColumn("__place", first).where(F.col("__place") <= each).orderBy("__place", "__key", "doc_id").limit(min(most_rows, each * classes)).select("doc_id", "y")


def with_texts(docs: DataFrame, ids: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, y, text) of the sampled ids; ids are bounded by the sample's size, so they are broadcast."""
    return docs.select("doc_id", F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids), "doc_id").where("text IS NOT NULL AND text <> ''")
