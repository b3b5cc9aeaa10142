"""Manifest rows: normalising, validating, limiting, combining and expanding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import derive_group_id, derive_speaker_id, non_empty, normalize_text


def normalize_manifest(df: DataFrame, base_dir: str) -> DataFrame:
    """(utt_id, audio_path, reference, speaker_id, group_id, split, named_by_file) from either style of row.

    Rows with ``filename`` and ``text`` name a file in base_dir/audio; others have ``audio_path``, taken relative to base_dir
    unless absolute. utt_id defaults to the file's stem; group_id is the first of group_id, recording_id and video_id that
    is not empty. Absent columns count as null. Other columns are kept unless their name clashes."""
    have = {c.lower() for c in df.columns}
    c = {n: non_empty(n) if n in have else F.lit(None).cast("string") for n in ("utt_id", "audio_path", "reference", "speaker_id", "group_id", "recording_id", "video_id", "split", "filename", "text")}
    by_file = (c["filename"].isNotNull() & c["text"].isNotNull()) if "filename" in have else F.lit(False)
    base = base_dir.rstrip("/")
    path = F.when(by_file, F.concat(F.lit(f"{base}/audio/"), F.regexp_extract(c["filename"], r"([^/]*)$", 1))).otherwise(
        F.when(c["audio_path"].startswith("/"), c["audio_path"]).otherwise(F.concat(F.lit(f"{base}/"), c["audio_path"]))
    )
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    made = {
        "utt_id": F.coalesce(c["utt_id"], non_empty(stem)), "audio_path": path, "reference": F.when(by_file, c["text"]).otherwise(c["reference"]),
        "speaker_id": c["speaker_id"], "group_id": F.coalesce(c["group_id"], c["recording_id"], c["video_id"]), "split": c["split"], "named_by_file": by_file,
    }
    kept = [x for x in df.columns if x.lower() not in {*made, "recording_id", "video_id", "filename", "text"}]
    return df.select(*[f"`{x}`" for x in kept], *[e.alias(n) for n, e in made.items()])


def rejected_manifest(df: DataFrame, audio_listing: DataFrame | None = None, order: str = "input_order") -> DataFrame:
    """df with ``reason``: missing_audio_path, blank_reference, audio_not_present, duplicate_utt_id, or null for a good row.

    Of rows that pass the other checks the first of each utt_id in ``order`` is good. ``audio_listing`` (audio_path) is the
    files that exist; without it presence is not checked."""
    present = F.lit(True)
    if audio_listing is not None:
        df = df.join(audio_listing.select("audio_path").distinct().withColumn("__there", F.lit(True)), "audio_path", "left")
        present = F.coalesce("__there", F.lit(False))
    first = (
        F.when(F.col("audio_path").isNull() & ~F.col("named_by_file"), "missing_audio_path")
        .when(F.coalesce(F.trim("reference"), F.lit("")) == "", "blank_reference")
        .when(~present, "audio_not_present")
    )
    seen = F.row_number().over(Window.partitionBy("utt_id", "__first").orderBy(order))
    out = df.withColumn("__first", first).withColumn("reason", F.when(F.col("__first").isNotNull(), F.col("__first")).when(seen > 1, "duplicate_utt_id"))
    return out.drop("__first", "__there")


def validate_manifest(df: DataFrame, audio_listing: DataFrame | None = None, skip_bad_rows: bool = False, order: str = "input_order") -> DataFrame:
    """Good rows. Without ``skip_bad_rows`` a bad row raises an error when it is read; no good row at all always does."""
    told = rejected_manifest(df, audio_listing, order)
    if not skip_bad_rows:
        fail = F.raise_error(F.concat(F.lit("bad manifest row: "), F.col("reason"))).cast("string")
        return told.withColumn("reason", F.when(F.col("reason").isNull(), F.col("reason")).otherwise(fail)).where("reason IS NULL").drop("reason")
    good = told.where("reason IS NULL").drop("reason")
    if good.isEmpty():
        raise ValueError("no valid manifest rows")
    return good


def drop_zero_word_rows(df: DataFrame, reference: str = "reference") -> DataFrame:
    """Rows whose reference has a word."""
    return df.where(F.size(normalize_text(reference)) > 0)


def limit_rows(df: DataFrame, n: int, order: tuple[str, ...] = ("dataset_idx", "input_order")) -> DataFrame:
    """The first n rows of the combined datasets, in input order."""
    return df.orderBy(*order).limit(n)


def combine_datasets(dfs: list[DataFrame]) -> DataFrame:
    """Union with dataset_idx; an utt_id that an earlier dataset has becomes ``{utt_id}_ds{i}`` in dataset i.

    Earliest datasets are found by an aggregate on utt_id, so repeated ids need no sort; columns that one dataset lacks
    are null there."""
    union = None
    for i, df in enumerate(dfs):
        df = df.drop("dataset_idx").withColumn("dataset_idx", F.lit(i))
        union = df if union is None else union.unionByName(df, allowMissingColumns=True)
    first = F.min("dataset_idx").over(Window.partitionBy("utt_id"))
    return union.withColumn("utt_id", F.when(first < F.col("dataset_idx"), F.concat("utt_id", F.lit("_ds"), F.col("dataset_idx").cast("string"))).otherwise(F.col("utt_id")))


def with_ids(df: DataFrame) -> DataFrame:
    """speaker_id and group_id filled in from the utterance's id."""
    return df.withColumns({"speaker_id": derive_speaker_id("utt_id", "speaker_id"), "group_id": derive_group_id("utt_id", "group_id")})


def snr_text(snr: float) -> str:
    return f"{snr:g}"


def expand_snr(df: DataFrame, levels: list[float]) -> DataFrame:
    """df with snr and original_utt_id, and one more copy of each row a level, whose ids end in ``_snr{S}``."""
    copies = F.array(*[F.struct(F.lit(x).cast("double").alias("snr"), F.lit("" if x is None else f"_snr{snr_text(x)}").alias("suffix")) for x in [None, *levels]])
    out = df.withColumn("__copy", F.explode(copies)).withColumn("original_utt_id", F.col("utt_id"))
    named = {c: F.concat(c, F.col("__copy.suffix")) for c in ("utt_id", "group_id", "speaker_id") if c in df.columns}
    return out.withColumns({**named, "snr": F.col("__copy.snr")}).drop("__copy")
