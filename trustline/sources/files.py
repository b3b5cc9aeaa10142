"""Readers of manifests and recognition documents, writers of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import file_accuracy

# The fields of manifests, events and documents.
MANIFEST = "utt_id string, audio_path string, reference string, speaker_id string, group_id string, recording_id string, video_id string, split string, filename string, text string"
EVENT = "type string, partial_result boolean, window_idx int, ctc_tokens array<string>, ctc_probs array<double>, ctc_frame_len double, audio_duration double, word_array array<string>, word_times array<array<double>>, estimated_accuracy double, words_per_minute double, audio_length double, speech_ratio double, non_speech_ratio double, recognized_word_count double, expected_error_count double"
EVENT = ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in EVENT.split(", ")))
RECOGNITION = f"utt_id string, audio_path string, reference string, endpoint_url string, result_format string, snr double, original_utt_id string, result array<struct<{EVENT}>>"

# A text file of window reports has about so many windows, two megabytes.
PART_WINDOWS = 10_000


def read_manifest(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    """Manifest rows with ``input_order`` from a JSON array, JSON lines or CSV with a header.

    "auto" looks at the first characters, read through Spark: "[" is an array, "{" is lines, anything else CSV."""
    if format == "auto":
        head = next((r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").take(1)), "")
        format = "json" if head.startswith("[") else "jsonl" if head.startswith("{") else "csv"
    if format == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        rows = rows.select(*[F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in (x.split(" ")[0] for x in MANIFEST.split(", "))])
    else:
        rows = spark.read.schema(MANIFEST).json(path, multiLine=format == "json")
    return rows.withColumn("input_order", F.monotonically_increasing_id())


def read_recognitions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a stored document; each file is one JSON document, over several lines or one, or with ``lines`` many, a line each."""
    return spark.read.schema(RECOGNITION).json(path, multiLine=not lines)


def store_recognitions(docs: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of documents to those at path, a folder of its own; storing a batch again replaces it."""
    docs.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={int(batch)}")


def stored_recognitions(spark: SparkSession, path: str) -> DataFrame:
    """All documents of all batches, with ``batch``."""
    return read_recognitions(spark, path, lines=True).withColumn("batch", F.col("batch").cast("int"))


def _binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).withColumn("audio_path", F.regexp_replace("path", "^file:/+", "/"))


def list_audio(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(audio_path, length) of the files below path; their contents are not read."""
    return _binary_files(spark, path, pattern).select("audio_path", "length")


def read_audio(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(audio_path, pcm) of WAV files of 16-bit samples: the bytes of the data chunk; null for files that are none."""
    # Chunks begin at whole bytes, within the first kilobytes of a file.
    head = F.hex(F.substring("content", 1, 4096))
    before = F.regexp_extract(head, "^(52494646(?:[0-9A-F]{2})*?)64617461", 1)
    at = F.length(before) / 2
    size = F.conv(F.concat(*[F.substring(head, (2 * at + 15 - 2 * i).cast("int"), F.lit(2)) for i in range(4)]), 16, 10).cast("bigint")
    data = F.expr("substring(content, __at + 9, cast(least(__size, length(content)) as int))")
    rows = _binary_files(spark, path, pattern).withColumns({"__at": at.cast("int"), "__size": size})
    return rows.select("audio_path", F.when(F.col("__at") > 0, data).alias("pcm"))


def write_reports(df: DataFrame, path: str, format: str = "csv", partition_by: tuple[str, ...] = ()) -> None:
    """Utterance metrics, segments, features, predictions or metrics, as CSV, JSON or Parquet."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if format == "csv" else getattr(writer, format)(path)


def write_dataset_reports(df: DataFrame, path: str, format: str = "csv") -> None:
    """Predictions or metrics in a folder for each dataset and split (or partition), the columns that df has of these."""
    write_reports(df, path, format, tuple(c for c in ("dataset_idx", "split", "partition") if c in df.columns))


def write_window_reports(windows: DataFrame, path: str) -> None:
    """One nested JSON document a file: its name, its totals and its windows in order.

    Documents are told apart in arrays, one a text file, in folders ``part=...`` by a hash of the file; an array holds about
    ``PART_WINDOWS`` windows or a single long document, so there are as many text files as the windows need and not as there
    are files. Every window is a line. Lines come sorted and are written as they come, so no file's windows are ever in one
    place; read documents with ``multiLine``. Of a file's windows each window_idx is one."""
    parts = max(1, -(-windows.count() // PART_WINDOWS))
    totals = file_accuracy(windows).join(windows.groupBy("file").agg(F.min("window_idx").alias("__first")), "file").withColumn("part", F.pmod(F.xxhash64("file"), F.lit(parts)))
    totals = totals.join(totals.groupBy("part").agg(F.min("file").alias("__least"), F.max("file").alias("__most")), "part")
    listed = F.struct("window_idx", "start_time", "end_time", "word_count", "estimated_accuracy", "speech_ratio", "non_speech_ratio")
    record = F.to_json(F.struct("file", "words", "expected_errors", "estimated_accuracy"), {"ignoreNullFields": "false"})
    line = lambda kind, text, idx: ["part", F.col("file"), F.lit(kind).alias("kind"), idx.alias("window_idx"), text.alias("value")]
    none = F.lit(None).cast(windows.schema["window_idx"].dataType)
    before = F.when(F.col("file") == F.col("__least"), F.lit("[")).otherwise(F.lit(", "))
    heads = totals.select(*line(0, F.concat(before, F.regexp_replace(record, "\\}$", ""), F.lit(', "windows": [')), none))
    comma = F.when(F.col("window_idx") == F.col("__first"), F.lit("")).otherwise(F.lit(", "))
    items = windows.join(totals.select("part", "file", "__first"), "file").select(*line(1, F.concat(comma, F.to_json(listed)), F.col("window_idx")))
    ends = totals.select(*line(2, F.when(F.col("file") == F.col("__most"), F.lit("]}]")).otherwise(F.lit("]}")), none))
    lines = heads.unionByName(items).unionByName(ends)
    lines.repartition(parts, "part").sortWithinPartitions("part", "file", "kind", "window_idx").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def write_accuracy_report(df: DataFrame, path: str) -> None:
    """One nested JSON record a file."""
    df.write.mode("overwrite").json(path)
