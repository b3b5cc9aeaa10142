"""Exact duplicates by a persistent index of text digests.

The index is two Parquet tables in a folder, bucketed by digest and sorted in each bucket. ``entries`` has one row for each
text ever seen: its digest, the id that stays, the generation in which it came and how often it came then. ``repeats`` counts
how often a known text came again, once a generation. New data is reduced to one row a digest where it lies, meets the
entries in a sort-merge anti-join, and what is new is appended; the index itself is never exchanged, as its buckets are the
join's partitions. A generation that is added again, after a failure, finds its own entries and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, stored

# Equal texts are equal after each run of these becomes one space; lone spaces stay as they are and need no replacement.
_RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
# Groups with more than this share of all rows are joined by broadcast, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with its white space normalised; null is the empty text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ").cast("binary"), 256))


class DigestIndex:
    """The index in the folder ``path``, which is made with ``buckets`` buckets if it is not there yet.

    Buckets are at least the shuffle partitions of the session that makes it, else Spark would exchange the entries too. A
    folder has one writer at a time; readers see the generations that were complete when they asked."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(wanted).alias("buckets"), F.lit(id_type).alias("id_type")).write.mode("ignore").parquet(f"{self.path}/made_with")
        made = spark.read.schema("buckets int, id_type string").parquet(f"{self.path}/made_with").first()
        self.buckets, self.id_type = made.buckets, made.id_type
        name = uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        self.entries_table = self._table(f"digest_entries_{name}", "entries", f"digest BINARY, keep_id {self.id_type}, generation BIGINT, n BIGINT")
        self.repeats_table = self._table(f"digest_repeats_{name}", "repeats", "digest BINARY, generation BIGINT, n BIGINT")

    def _table(self, name: str, folder: str, columns: str) -> str:
        # The files are the index; the catalog only tells this session how they are bucketed.
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return name

    def entries(self) -> DataFrame:
        """(digest, keep_id, generation, n), a row for each text."""
        return self.spark.table(self.entries_table)

    def add(self, rows: DataFrame, generation: int) -> None:
        """Appends what is new in rows (digest, doc_id); of equal new texts the smallest id stays, null after all others."""
        met = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first"), F.count("*").alias("n"))
        known = self.entries().select("digest", "generation").withColumnRenamed("generation", "since")
        fresh = met.join(known.hint("merge"), "digest", "left_anti")
        # The entries are appended last: until then the generation counts as new, whatever of it was written.
        again = met.join(known.where(F.col("since") < generation).hint("merge"), "digest", "left_semi")
        again.select("digest", F.lit(generation).cast("bigint").alias("generation"), "n").write.insertInto(self.repeats_table)
        fresh.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(generation).cast("bigint").alias("generation"), "n").write.insertInto(self.entries_table)

    def groups(self) -> DataFrame:
        """(digest, keep_id, since, group_size) over all generations; buckets meet buckets, nothing is exchanged."""
        # A generation that was added twice counted its repeats twice, with the same number.
        repeats = self.spark.table(self.repeats_table).groupBy("digest", "generation").agg(F.max("n").alias("n")).groupBy("digest").agg(F.sum("n").alias("more"))
        both = self.entries().join(repeats.hint("merge"), "digest", "left")
        return both.select("digest", "keep_id", F.col("generation").alias("since"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def compact(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same index in another folder: one file a bucket, repeats summed into their entries."""
        other = DigestIndex(self.spark, path, buckets or self.buckets, self.id_type)
        whole = self.groups().select("digest", "keep_id", F.col("since").alias("generation"), F.col("group_size").alias("n"))
        whole.repartition(other.buckets, "digest").write.insertInto(other.entries_table)
        return other


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row) of every row of df, written once; ``row`` tells rows apart that repeat id and text."""
    return stored(df.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest"), F.monotonically_increasing_id().alias("row")))


def mark(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of rows (doc_id, digest, row, generation), all of them in the index.

    A hot text's rows never meet in one task: texts that more than a thousandth of the rows share are at most a thousand
    and are broadcast, all others are joined by digest."""
    order = F.struct("generation", F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    firsts = rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("here"))
    groups = index.groups()
    found = stored(
        firsts.join(groups.hint("merge"), "digest")
        .select("digest", "keep_id", "group_size", "here", F.when(F.col("first.generation") == F.col("since"), F.col("first.row")).alias("keep_row"))
    )
    hot = F.col("here") > max(1, int(rows.count() * HOT_SHARE))
    few = F.broadcast(found.where(hot))
    joined = rows.join(few, "digest").unionByName(rows.join(few.select("digest"), "digest", "left_anti").join(found.where(~hot).hint("merge"), "digest"))
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(df: DataFrame, index: DigestIndex, generation: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds one generation of documents and marks them: kept are those whose text no earlier generation and no smaller id has.

    Null texts count as empty; of rows that repeat id and text one is kept; null ids are larger than all others. An empty
    df gives no rows. Columns of df other than id and text are not read. ``group_size`` counts all generations so far."""
    rows = digests(df, id_col, text_col).withColumn("generation", F.lit(generation).cast("bigint"))
    index.add(rows, generation)
    return mark(rows, index)


def exact_duplicates(df: DataFrame, path: str | None = None, generations: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of df by a new index in the shared folder, or at ``path``.

    Documents come in ``generations`` of ascending ids, each a generation of the index, so the first of a group to come has
    its smallest id. Each text is read once; generations are cut from the table of digests. Odd rows are as in deduplicate."""
    spark = df.sparkSession
    rows = digests(df, id_col, text_col)
    cuts = rows.agg(F.percentile_approx("doc_id", [g / generations for g in range(1, generations)]).alias("at")).first().at if generations > 1 else []
    number = F.when(F.col("doc_id").isNull(), generations - 1).otherwise(sum(((F.col("doc_id") > c).cast("bigint") for c in cuts or []), F.lit(0).cast("bigint")))
    rows = rows.withColumn("generation", number.cast("bigint"))
    index = DigestIndex(spark, path or f"{checkpoint_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}", id_type=df.schema[id_col].dataType.simpleString())
    for g in range(generations):
        index.add(rows.where(F.col("generation") == g), g)
    return mark(rows, index)
