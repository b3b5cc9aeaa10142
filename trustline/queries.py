"""Queries of the library's operators on tables derived from ``conversations``, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as X
from .lineage import checkpointed, scratch_dir, stored
from .operators import ensemble, features, manifest, metrics, noise, recognition, segments, splits, windows
from .plans import boosting, evaluate, fixtures, model, score
from .plans.duck import sql
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def utt(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.utterances(spark, d)


def recs(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.recognitions(spark, d)


def segs(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 10 to 40 reference words with the edits that were planted in them."""
    words = utt(spark, d).select("utt_id", "conv_id", "turn", "dataset_idx", F.posexplode(F.expr("filter(split(reference, '\\\\s+'), w -> w <> '')")).alias("pos", "w"))
    words = words.withColumn("op", F.expr("(conv_id * 7 + turn * 13 + pos * 31) % (4 + conv_id % 17)")).withColumn("blk", F.expr("pos div (10 + conv_id % 31)"))
    return (
        words.groupBy("utt_id", "conv_id", "turn", "dataset_idx", "blk")
        .agg(F.count("*").alias("reference_words"), F.count(F.when(F.col("op") <= 2, 1)).alias("edit_errors"), F.expr("sum(CASE op WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END)").alias("hypothesis_words"))
        .where("reference_words >= 10")
        .withColumn("accuracy", X.accuracy("edit_errors", "reference_words"))
        .withColumn("split", F.expr("CASE WHEN turn % 5 = 4 THEN 'test' ELSE 'train' END"))
        .withColumn("segment_id", F.concat_ws("_", "utt_id", "blk"))
    )


def ests(spark: SparkSession, d: str) -> DataFrame:
    rows = ensemble.ranked(segs(spark, d).withColumn("one", F.lit(1)), ["one"], ["segment_id"], "rk").drop("one", "group_rows")
    return rows.withColumn("estimated_accuracy", N.clip_unit(F.expr("accuracy * 0.8D + 0.1D + (((rk + 1) * 37) % 21 - 10) / 200.0D")))


RAW = """CASE WHEN turn % 3 = 0 THEN '' ELSE utt_id END AS utt_id;
 CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN concat('/abs/', audio_path) ELSE audio_path END AS audio_path;
 CASE WHEN conv_id % 4 <> 0 THEN reference END AS reference; speaker_id; CASE WHEN turn % 2 = 0 THEN '' END AS group_id; group_id AS recording_id;
 concat('vid', conv_id) AS video_id; CASE WHEN conv_id % 4 = 0 THEN concat('x/', utt_id, '.wav') END AS filename; CASE WHEN conv_id % 4 = 0 THEN reference END AS text"""


@query(sql(["utt"], """SELECT CASE WHEN utt_id <> '' THEN utt_id ELSE regexp_extract(path, '([^/]*)\\.wav$', 1) END AS utt_id, path AS audio_path,
      coalesce(text, reference) AS reference, speaker_id,
  coalesce(nullif(group_id, ''), nullif(recording_id, ''), video_id) AS group_id FROM (SELECT *,
      CASE WHEN filename IS NOT NULL THEN '/data/audio/' || split_part(filename, '/',
      2) WHEN audio_path LIKE '/%' THEN audio_path ELSE '/data/' || audio_path END AS path FROM raw) q""", extra=[("raw", f"SELECT {RAW.replace(';', ',')} FROM utt")]))
def normalize_manifest(spark: SparkSession, d: str) -> DataFrame:
    raw = utt(spark, d).selectExpr(*RAW.split(";"))
    return manifest.normalize_manifest(raw, "/data").select("utt_id", "audio_path", "reference", "speaker_id", "group_id")


BAD = """CASE WHEN turn % 5 = 4 THEN concat(substr(utt_id, 1, 6), '03_000000') ELSE utt_id END AS utt_id; CASE WHEN (conv_id + turn) % 11 <> 0 THEN audio_path END AS audio_path;
 CASE WHEN (conv_id + turn) % 7 = 0 THEN '  ' ELSE reference END AS reference; conv_id * 100 + turn AS input_order; conv_id; turn % 2 = 1 AND conv_id % 2 = 1 AS named_by_file"""


@query(sql(["utt"], """SELECT input_order, utt_id, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY utt_id,
      bad ORDER BY input_order) > 1 THEN 'duplicate_utt_id' END AS reason FROM (
  SELECT *,
      CASE WHEN audio_path IS NULL AND NOT named_by_file THEN 'missing_audio_path' WHEN trim(reference) = '' THEN 'blank_reference' WHEN audio_path IS NULL OR conv_id % 13 = 0 THEN 'audio_not_present' END AS bad FROM raw) q""", extra=[("raw", f"SELECT {BAD.replace(';', ',')} FROM utt")]))
def validate_manifest(spark: SparkSession, d: str) -> DataFrame:
    raw = utt(spark, d).selectExpr(*BAD.split(";"))
    return manifest.rejected_manifest(raw, utt(spark, d).where("conv_id % 13 <> 0").select("audio_path")).select("input_order", "utt_id", "reason")


@query(sql(["utt"], "SELECT utt_id FROM utt WHERE turn % 4 <> 0 AND len(regexp_extract_all(lower(reference), '[\\p{L}\\p{N}]+')) > 0"))
def drop_zero_word_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = utt(spark, d).withColumn("reference", F.expr("CASE WHEN turn % 4 = 0 THEN '... !' ELSE reference END"))
    return manifest.drop_zero_word_rows(rows).select("utt_id")


@query(sql(["utt"], "SELECT utt_id, dataset_idx FROM utt ORDER BY dataset_idx, conv_id * 100 + turn LIMIT 50"))
def limit_rows(spark: SparkSession, d: str) -> DataFrame:
    return manifest.limit_rows(utt(spark, d).withColumn("input_order", F.expr("conv_id * 100 + turn")), 50).select("utt_id", "dataset_idx")


@query(sql(["utt"], """SELECT CASE WHEN min(ds) OVER (PARTITION BY utt_id) < ds THEN utt_id || '_ds' || ds ELSE utt_id END AS utt_id,
      CAST(ds AS INTEGER) AS dataset_idx, audio_path FROM (
  SELECT utt_id, audio_path, 0 AS ds FROM utt WHERE conv_id % 2 = 0 UNION ALL SELECT utt_id, audio_path,
      1 FROM utt WHERE conv_id % 2 = 1 OR conv_id % 10 = 0) q"""))
def combine_datasets(spark: SparkSession, d: str) -> DataFrame:
    rows = utt(spark, d).select("utt_id", "audio_path", "conv_id")
    return manifest.combine_datasets([rows.where("conv_id % 2 = 0"), rows.where("conv_id % 2 = 1 OR conv_id % 10 = 0")]).select("utt_id", "dataset_idx", "audio_path")


@query(sql(["utt"], """SELECT utt_id || suffix AS utt_id, group_id || suffix AS group_id, speaker_id || suffix AS speaker_id, snr, utt_id AS original_utt_id
  FROM utt, (VALUES (NULL::DOUBLE, ''), (5.0, '_snr5'), (10.0, '_snr10'), (2.5, '_snr2.5')) AS l(snr, suffix)"""))
def expand_snr(spark: SparkSession, d: str) -> DataFrame:
    return manifest.expand_snr(utt(spark, d), [5.0, 10.0, 2.5]).select("utt_id", "group_id", "speaker_id", "snr", "original_utt_id")


@query(sql(["utt"], """SELECT utt_id, coalesce(speaker_id, lpad(nullif(regexp_extract(utt_id, '(^|[^0-9])([0-9]{4,5})([^0-9]|$)', 2), ''), 5,
      '0')) AS speaker_id,
  coalesce(group_id, nullif(regexp_extract(utt_id, '^([0-9]{5}_[A-Z]_[0-9]{3})_', 1), ''), nullif(regexp_extract(utt_id, '^([0-9]{5}_[0-9]{2})_', 1),
      ''), utt_id) AS group_id FROM utt"""))
def derive_ids(spark: SparkSession, d: str) -> DataFrame:
    return manifest.with_ids(utt(spark, d)).select("utt_id", "speaker_id", "group_id")


@query(sql(["hyps", "frames"], "SELECT utt_id, n_words, n_frames, prob_sum FROM (SELECT utt_id, count(*) AS n_words FROM hyps GROUP BY 1) JOIN (SELECT utt_id, count(*) AS n_frames, round(sum(raw), 6) AS prob_sum FROM frames GROUP BY 1) USING (utt_id)"))
def final_recognition(spark: SparkSession, d: str) -> DataFrame:
    f = recognition.final_recognition(fixtures.documents_of(recs(spark, d)))
    out = f.select("utt_id", F.size("final.word_array").cast("bigint").alias("n_words"), F.size("final.ctc_tokens").cast("bigint").alias("n_frames"), r6(F.aggregate("final.ctc_probs", F.lit(0.0), lambda a, p: a + p)).alias("prob_sum"))
    return out.where("n_words > 0")


@query(sql(["utt", "refs"], """SELECT utt_id, CASE (conv_id + turn) % 8 WHEN 0 THEN 'no_final_result' WHEN 1 THEN 'ctc_missing'
      WHEN 2 THEN 'ctc_lengths_differ' WHEN 3 THEN 'words_missing' WHEN 4 THEN 'word_lengths_differ' WHEN 6 THEN 'result_not_a_list' END AS reason,
  (conv_id + turn) % 8 = 5 AS frame_warning FROM utt WHERE utt_id IN (SELECT utt_id FROM refs WHERE op <> 0)"""))
def validate_recognition(spark: SparkSession, d: str) -> DataFrame:
    docs = _faulty(fixtures.documents_of(recs(spark, d).where("size(word_array) > 0")), "(conv_id + turn) % 8")
    return recognition.validate_recognition(docs).select("utt_id", "reason", "frame_warning")


@query(sql(["utt", "hyps"], "SELECT u.utt_id, u.reference, n AS n_words FROM utt u JOIN (SELECT utt_id, count(*) AS n FROM hyps WHERE conv_id % 4 <> 0 GROUP BY 1) h ON u.utt_id = h.utt_id"))
def attach_recognition(spark: SparkSession, d: str) -> DataFrame:
    stored = recs(spark, d).where("conv_id % 4 <> 0 AND size(word_array) > 0").select("utt_id", F.size("word_array").cast("bigint").alias("n_words"))
    return recognition.attach_recognition(utt(spark, d).select("utt_id", "reference"), stored, on_missing="drop")


def _faulty(docs: DataFrame, k: str) -> DataFrame:
    """docs whose result has the fault of number ``k`` of eight; 5 and 7 are usable."""
    docs = docs.withColumn("k", F.expr(k))
    change = F.transform(
        "result",
        lambda e: e.withField("partial_result", F.when(F.col("k") == 0, F.lit(True)).otherwise(e["partial_result"]))
        .withField("ctc_tokens", F.when(F.col("k") == 1, None).otherwise(e["ctc_tokens"]))
        .withField("ctc_probs", F.when(F.col("k") == 2, F.slice(e["ctc_probs"], 1, 1)).otherwise(e["ctc_probs"]))
        .withField("word_array", F.when(F.col("k") == 3, None).otherwise(e["word_array"]))
        .withField("word_times", F.when(F.col("k") == 4, F.concat(e["word_times"], e["word_times"])).otherwise(e["word_times"]))
        .withField("audio_duration", F.when(F.col("k") == 5, e["audio_duration"] + 1.0).otherwise(e["audio_duration"])),
    )
    return docs.withColumn("result", F.when(F.col("k") != 6, change))


def _recognised_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents stored in two batches, the second of which is stored twice; many of them are not usable."""
    path = f"{scratch_dir(spark)}/stored-{uuid.uuid4().hex}"
    docs = fixtures.documents_of(recs(spark, d).where("size(word_array) > 0"))
    for batch, rows in ((0, _faulty(docs, "(conv_id + turn) % 8")), (1, docs.where("turn % 3 = 0").limit(0)), (1, _faulty(docs.where("turn % 3 = 0"), "(conv_id + 2 * turn) % 8"))):
        files.store_recognitions(rows.select("utt_id", "audio_path", "reference", "result"), path, batch)
    return files.stored_recognitions(spark, path)


_STORED = [("docs", """SELECT utt_id, CASE WHEN turn % 3 = 0 AND (conv_id + 2 * turn) % 8 IN (5, 7) THEN 1 WHEN (conv_id + turn) % 8 IN (5, 7) THEN 0 END AS batch
      FROM (SELECT DISTINCT utt_id, conv_id, turn FROM hyps) q""")]


@query(sql(["utt", "hyps"], "SELECT utt_id, audio_path FROM utt WHERE utt_id NOT IN (SELECT utt_id FROM docs WHERE batch IS NOT NULL)", extra=_STORED))
def pending_recognitions(spark: SparkSession, d: str) -> DataFrame:
    """What is still to be recognised when two batches are stored, with many documents that are not usable."""
    return recognition.pending_recognitions(utt(spark, d), _recognised_in_batches(spark, d)).select("utt_id", "audio_path")


@query(sql(["utt", "hyps"], "SELECT utt_id, batch, n AS n_words FROM docs JOIN (SELECT utt_id, count(*) AS n FROM hyps GROUP BY 1) q USING (utt_id) WHERE batch IS NOT NULL", extra=_STORED))
def valid_recognitions(spark: SparkSession, d: str) -> DataFrame:
    """The last usable document of every utterance, and the words of its final event."""
    rows = recognition.final_recognition(recognition.valid_recognitions(_recognised_in_batches(spark, d)))
    return rows.select("utt_id", "batch", F.size("final.word_array").cast("bigint").alias("n_words"))


@query(sql(["utt"], """SELECT utt_id, CASE WHEN conv_id % 13 = 0 THEN 'audio_not_present' END AS reason, CASE WHEN conv_id % 13 <> 0 THEN octet_length(encode(reference)) + 1 END AS n_bytes FROM utt WHERE trim(reference) <> ''"""))
def audio_presence(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows against a listing of files that were written before, one an utterance, some of them not: reasons and sizes."""
    path = f"{scratch_dir(spark)}/audio-{uuid.uuid4().hex}"
    rows = utt(spark, d).where("trim(reference) <> ''")
    rows.where("conv_id % 13 <> 0").select("utt_id", F.col("reference").alias("value")).repartition("utt_id").write.partitionBy("utt_id").text(path)
    listing = files.list_audio(spark, path, "*.txt").select(F.concat(F.lit("audio/"), F.regexp_extract("audio_path", "utt_id=([^/]+)/", 1), F.lit(".wav")).alias("audio_path"), "length")
    told = manifest.rejected_manifest(rows.withColumns({"named_by_file": F.lit(False), "input_order": F.lit(0)}), listing)
    return told.join(listing, "audio_path", "left").select("utt_id", "reason", F.col("length").alias("n_bytes"))


@query(sql(["utt"], """SELECT file, window_idx, coalesce(s_acc, acc) AS estimated_accuracy, coalesce(s_wpm, wpm) AS words_per_minute FROM (
  SELECT conv_id AS file, turn AS window_idx, round(0.5::DOUBLE + (conv_id % 10) / 100.0::DOUBLE, 6) AS acc, 120.0::DOUBLE AS wpm,
    CASE WHEN (conv_id + turn) % 4 <> 0 AND turn % 3 <> 1 THEN round(0.9::DOUBLE - (turn % 7) / 100.0::DOUBLE, 6) END AS s_acc, CASE
      WHEN turn % 3 <> 1 THEN 100.0::DOUBLE + turn END AS s_wpm FROM utt) q"""))
def merge_server_accuracy(spark: SparkSession, d: str) -> DataFrame:
    u = utt(spark, d)
    rows = u.select(F.col("conv_id").alias("file"), F.col("turn").alias("window_idx"), F.expr("round(0.5D + (conv_id % 10) / 100.0D, 6)").alias("estimated_accuracy"), F.lit(120.0).alias("words_per_minute"))
    events = u.where("turn % 3 <> 1").select(F.col("conv_id").alias("file"), F.col("turn").alias("window_idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("event_pos"), "conv_id", "turn")
    events = events.withColumn("estimated_accuracy", F.expr("CASE WHEN event_pos = 0 THEN 0.0D WHEN (conv_id + turn) % 4 <> 0 THEN round(0.9D - (turn % 7) / 100.0D, 6) END")).withColumn("words_per_minute", F.expr("CASE WHEN event_pos = 1 THEN 100.0D + turn ELSE 1.0D END"))
    return recognition.merge_server_accuracy(rows, events)


@query(sql(["utt"], """SELECT conv_id AS file, CAST(turn AS INTEGER) AS window_idx, CASE WHEN turn % 3 = 2 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS estimated_accuracy,
  CASE WHEN turn % 3 = 0 THEN 120.0::DOUBLE ELSE 100.0::DOUBLE + turn END AS words_per_minute FROM utt
  UNION ALL SELECT conv_id, -1, CASE WHEN conv_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END, 120.0::DOUBLE FROM (SELECT DISTINCT conv_id FROM utt) q"""))
def server_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Files (window -1) and windows with what the server's events in their documents say; the last event of each wins."""
    u = utt(spark, d).select(F.col("conv_id").alias("file"), F.col("turn").cast("int").alias("window_idx"))
    event = lambda kind, partial, window, acc, wpm: f"named_struct('type', '{kind}', 'partial_result', {partial}, 'window_idx', {window}, 'estimated_accuracy', {acc}, 'words_per_minute', {wpm})"
    null = {k: f"cast(null as {k})" for k in ("boolean", "int", "double")}
    told = u.where("window_idx % 3 <> 0").select("file", F.posexplode(F.expr(f"""array(
      {event("asr_accuracy_estimate", null["boolean"], "window_idx", "0.1D", "1.0D")},
      {event("asr_accuracy_estimate", null["boolean"], "window_idx", f"IF(window_idx % 3 = 2, 0.75D, {null['double']})", "100.0D + window_idx")})""")).alias("pos", "e"))  # fmt: skip
    whole = u.select("file").distinct().select("file", F.posexplode(F.expr(f"""array(
      {event("asr_accuracy_estimate", "true", null["int"], "0.9D", "9.0D")}, {event("asr_accuracy_estimate", null["boolean"], null["int"], "0.9D", "9.0D")}, {event("asr_result", "false", null["int"], "0.9D", "9.0D")},
      {event("asr_accuracy_estimate", "false", null["int"], f"IF(file % 2 = 0, 0.25D, {null['double']})", null["double"])})""")).alias("pos", "e"))  # fmt: skip
    missing = [m for m in recognition.SERVER_METRICS if m not in ("estimated_accuracy", "words_per_minute")]
    docs = told.unionByName(whole).withColumn("e", F.struct("e.*", *[F.lit(None).cast("double").alias(m) for m in missing]))
    docs = docs.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("result"))
    start = lambda df: df.withColumns({"estimated_accuracy": F.lit(0.5), "words_per_minute": F.lit(120.0)})
    of_files, of_windows = recognition.with_server_accuracy(start(u.select("file").distinct()), start(u), docs)
    return of_windows.unionByName(of_files.withColumn("window_idx", F.lit(-1)))


_SPEAKER = "coalesce(speaker_id, lpad(CAST(conv_id AS VARCHAR), 5, '0'))"


def _split_sql(key: str, expr: str, rest: str) -> str:
    return sql(["utt"], f"""SELECT {rest}, k.split FROM keyed JOIN (
      SELECT {key}, CASE WHEN row_number() OVER (ORDER BY sha256('13:' || {key}), {key}) <= greatest(1, least(n - 1, CAST(round_even(0.8 * n,
      0) AS BIGINT))) THEN 'train' ELSE 'test' END AS split
      FROM (SELECT *, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM keyed)) q) k USING ({key})""", extra=[("keyed", f"SELECT * EXCLUDE (speaker_id), {expr} AS speaker_id FROM utt")])


@query(_split_sql("speaker_id", _SPEAKER, "utt_id, speaker_id"))
def speaker_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.speaker_split(manifest.with_ids(utt(spark, d))).select("utt_id", "speaker_id", "split")


@query(_split_sql("utt_id", "coalesce(speaker_id, 'unknown')", "utt_id, speaker_id"))
def utterance_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.utterance_split(utt(spark, d)).select("utt_id", "speaker_id", "split")


@query(sql(["utt"], "SELECT utt_id, dataset_idx, CASE WHEN dataset_idx = 1 THEN CASE WHEN turn < 4 THEN 'train' ELSE 'test' END END AS split FROM utt WHERE dataset_idx = 0 OR turn < 6"))
def explicit_split(spark: SparkSession, d: str) -> DataFrame:
    rows = utt(spark, d).withColumn("split", F.expr("CASE WHEN dataset_idx = 1 THEN CASE WHEN turn < 4 THEN 'train' WHEN turn < 6 THEN 'test' END END"))
    return splits.explicit_split(rows).select("utt_id", "dataset_idx", "split")


@query(_split_sql("speaker_id", _SPEAKER, "speaker_id").replace("SELECT speaker_id, k.split", "SELECT DISTINCT speaker_id, k.split"))
def split_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_groups(splits.speaker_split(manifest.with_ids(utt(spark, d))))


@query(f"""WITH s AS ({_split_sql("speaker_id", _SPEAKER, "utt_id, speaker_id")}) SELECT (SELECT count(*) FROM (SELECT speaker_id FROM s
      WHERE split = 'train' INTERSECT SELECT speaker_id FROM s WHERE split = 'test') q) AS n_shared,
  count(DISTINCT speaker_id) AS n_speakers FROM s""")
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.speaker_split(manifest.with_ids(utt(spark, d)))
    return splits.overlap(rows).agg(F.count("*").alias("n_shared")).crossJoin(rows.agg(F.countDistinct("speaker_id").alias("n_speakers")))


@query("SELECT doc_id, len(t) AS n_words, md5(array_to_string(t, ' ')) AS words_md5 FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?') AS t FROM documents) q")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.normalize_text("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_words"), F.md5(F.array_join("t", " ").cast("binary")).alias("words_md5"))


_PAIRS = [
    ("pr", """SELECT utt_id, dataset_idx, toks AS r, coalesce(h, []) AS h FROM tokens LEFT JOIN (SELECT utt_id, regexp_extract_all(lower(string_agg(h,
      ' ' ORDER BY j)), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?') AS h FROM hyps GROUP BY 1) q USING (utt_id) WHERE len(toks) > 0"""),
    ("dp", """SELECT utt_id, r, h, 0 AS i, range(0, len(h) + 1)::BIGINT[] AS prow FROM pr UNION ALL SELECT utt_id, r, h, i + 1,
      list_reduce(list_transform(range(1, len(h) + 1), lambda k: [least(prow[k + 1] + 1, prow[k] + (CASE
      WHEN h[k] = r[i + 1] THEN 0 ELSE 1 END))::BIGINT]), lambda a, b: list_append(a, least(a[-1] + 1, b[1])), [(i + 1)::BIGINT])
      FROM dp WHERE i < len(r)"""),
    ("um", "SELECT utt_id, len(r) AS reference_words, len(h) AS hypothesis_words, prow[-1] AS edit_errors FROM dp WHERE i = len(r)"),
]


@query(sql(["tokens", "hyps"], "SELECT utt_id, reference_words, hypothesis_words, edit_errors, round(greatest(0.0::DOUBLE, 1 - edit_errors::DOUBLE / reference_words), 6) AS accuracy FROM um", True, _PAIRS))
def utterance_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.utterance_metrics(recs(spark, d)).select("utt_id", "reference_words", "hypothesis_words", "edit_errors", r6("accuracy").alias("accuracy"))


@query(sql(["tokens", "hyps"], """SELECT dataset_idx, CASE WHEN turn % 5 = 4 THEN 'test' ELSE 'train' END AS split, round(greatest(0.0::DOUBLE,
      1 - sum(edit_errors)::DOUBLE / sum(reference_words)), 6) AS accuracy, count(*) AS n_utterances
  FROM um JOIN utt USING (utt_id) GROUP BY 1, 2""", True, _PAIRS))
def overall_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.utterance_metrics(recs(spark, d).withColumn("split", F.expr("CASE WHEN turn % 5 = 4 THEN 'test' ELSE 'train' END")))
    return metrics.overall_accuracy(rows, ["dataset_idx", "split"]).withColumn("accuracy", r6("accuracy"))


@query(sql(["tokens"], "SELECT utt_id, audio_path FROM tokens WHERE len(toks) > 0 AND turn % 2 = 0"))
def keep_measured_rows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.keep_measured_rows(utt(spark, d), metrics.utterance_metrics(recs(spark, d).where("turn % 2 = 0"))).select("utt_id", "audio_path")


@query(sql(["tokens"], "SELECT utt_id, s AS ref_start, least(s + 64, len(toks)) AS ref_end FROM tokens, unnest(range(0, len(toks), 64)) AS t(s)"))
def fixed_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.fixed_spans(utt(spark, d).withColumn("ref_tokens", X.normalize_text("reference")), 64).select("utt_id", F.explode("spans").alias("s"))
    return rows.select("utt_id", F.col("s.ref_start").cast("bigint").alias("ref_start"), F.col("s.ref_end").cast("bigint").alias("ref_end"))


@query(sql(["utt"], "SELECT utt_id, v AS variant, (CAST('0x' || substr(sha256(utt_id), 1, 8) AS BIGINT) + 13 + v * 1000000) % 4294967296 AS seed FROM utt, unnest(range(0, 3)) AS t(v)"))
def seed_hash(spark: SparkSession, d: str) -> DataFrame:
    return utt(spark, d).select("utt_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("variant")).select("utt_id", "variant", X.seed_hash("utt_id", 13, F.col("variant")).alias("seed"))


_MAP = [("place", "SELECT utt_id, pos, coalesce(CAST(sum(CASE op WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END) OVER (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS j FROM refs"),
        ("spans", """SELECT utt_id, pos // 16 * 16 AS ref_start, greatest(0, least(min(j), n - 1)) AS hyp_start, max(j) + 1 AS hyp_stop, greatest(0,
      least(max(j), n - 1)) AS hyp_end
          FROM place JOIN (SELECT utt_id, count(*) AS n FROM hyps GROUP BY 1) c USING (utt_id) GROUP BY utt_id, 2, n"""),
        ("timed", "SELECT p.*, a.s AS start_time, b.e AS end_time FROM spans p JOIN times a ON a.utt_id = p.utt_id AND a.j = hyp_start JOIN times b ON b.utt_id = p.utt_id AND b.j = hyp_end")]


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Recognitions with the planted edits as their alignment, word for word, and spans of 16 reference words."""
    step = "CASE (conv_id * 7 + turn * 13 + a.i * 31) % (4 + conv_id % 17) WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END"
    start = "named_struct('i', 0, 'j', 0, 'o', cast(array() as array<int>))"
    mapped = f"aggregate(ref_words, {start}, (a, w) -> named_struct('i', a.i + 1, 'j', a.j + {step}, 'o', array_append(a.o, a.j)), a -> a.o)"
    r = recs(spark, d).withColumns({"ref_to_hyp": F.expr(mapped), "hyp_at": F.expr("transform(word_array, (w, i) -> i)")})
    return segments.fixed_spans(r, 16, "ref_words")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    r = _planted(spark, d).withColumn("s", F.explode("spans"))
    return segments.span_to_time(r.withColumns({"ref_start": F.col("s.ref_start"), "ref_end": F.col("s.ref_end")}))


@query(sql(["times"], "SELECT utt_id, ref_start, CAST(hyp_start AS BIGINT) AS hyp_start, CAST(hyp_stop AS BIGINT) AS hyp_stop, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM timed", extra=_MAP))
def span_to_time(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).select("utt_id", F.col("ref_start").cast("bigint").alias("ref_start"), F.col("hyp_start").cast("bigint").alias("hyp_start"), F.col("hyp_stop").cast("bigint").alias("hyp_stop"), r6("start_time").alias("start_time"), r6("end_time").alias("end_time"))


@query(sql(["times", "frames"], "SELECT t.utt_id, ref_start, min(frame) AS first_frame, count(*) AS n_frames, round(sum(raw), 6) AS prob_sum FROM timed t JOIN frames f ON f.utt_id = t.utt_id AND (frame + 0.5::DOUBLE) * 0.04::DOUBLE >= start_time AND (frame + 0.5::DOUBLE) * 0.04::DOUBLE < end_time GROUP BY 1, 2", extra=_MAP))
def slice_ctc_by_time(spark: SparkSession, d: str) -> DataFrame:
    cut = segments.slice_ctc_by_time(_timed(spark, d)).where("size(ctc_tokens) > 0")
    return cut.select("utt_id", F.col("ref_start").cast("bigint").alias("ref_start"), F.col("first_frame").cast("bigint").alias("first_frame"), F.size("ctc_tokens").cast("bigint").alias("n_frames"), r6(F.aggregate("ctc_probs", F.lit(0.0), lambda a, p: a + p)).alias("prob_sum"))


_SEGMENTS = [
    *_MAP,
    ("cut", """SELECT t.utt_id, ref_start, hyp_start, hyp_stop, start_time, end_time, count(*) AS n_frames, count(*) FILTER (token = '<blk>') AS blanks FROM timed t
      JOIN frames f ON f.utt_id = t.utt_id AND (frame + 0.5::DOUBLE) * 0.04::DOUBLE >= start_time AND (frame + 0.5::DOUBLE) * 0.04::DOUBLE < end_time GROUP BY ALL"""),
    ("said", "SELECT utt_id, pos // 16 * 16 AS ref_start, list(w ORDER BY pos) AS r FROM refs GROUP BY 1, 2"),
    ("heard", "SELECT c.utt_id, ref_start, list(h ORDER BY j) AS h FROM cut c JOIN hyps x ON x.utt_id = c.utt_id AND j >= hyp_start AND j < hyp_stop GROUP BY 1, 2"),
    ("dp", """SELECT utt_id, ref_start, r, coalesce(h, []) AS h, 0 AS i, range(0, len(coalesce(h, [])) + 1)::BIGINT[] AS prow FROM said LEFT
      JOIN heard USING (utt_id, ref_start)
      UNION ALL SELECT utt_id, ref_start, r, h, i + 1, list_reduce(list_transform(range(1, len(h) + 1),
        lambda k: [least(prow[k + 1] + 1, prow[k] + (CASE WHEN h[k] = r[i + 1] THEN 0 ELSE 1 END))::BIGINT]), lambda a, b: list_append(a,
      least(a[-1] + 1, b[1])), [(i + 1)::BIGINT]) FROM dp WHERE i < len(r)"""),
]


@query(sql(["times", "frames"], """SELECT utt_id, ref_start, len(r) AS reference_words, len(h) AS hypothesis_words, prow[-1] AS edit_errors,
      round(greatest(0.0::DOUBLE, 1 - prow[-1]::DOUBLE / len(r)), 6) AS accuracy,
  round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, n_frames FROM dp JOIN cut USING (utt_id,
      ref_start) WHERE i = len(r) AND n_frames <= 80 * len(r) AND blanks > 0 AND blanks < n_frames""", True, _SEGMENTS))
def fixed_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of 16 reference words: their times, frames, guards, words and errors, on the planted alignment."""
    out = segments.slice_utterance(_planted(spark, d).withColumns({"ref_tokens": F.col("ref_words"), "hyp_tokens": F.col("word_array")}))
    times = [r6(c).alias(c) for c in ("accuracy", "start_time", "end_time")]
    return out.select("utt_id", F.col("ref_start").cast("bigint").alias("ref_start"), "reference_words", "hypothesis_words", "edit_errors", *times, F.size("ctc_tokens").cast("bigint").alias("n_frames"))


@query(sql(["segs"], "SELECT dataset_idx, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM segs GROUP BY 1"))
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_counts(segs(spark, d))


@query(sql(["segs"], "SELECT dataset_idx, greatest(1, CAST(ceil(8000.0 / count(*)) AS BIGINT)) AS variants FROM segs GROUP BY 1"))
def estimate_variants(spark: SparkSession, d: str) -> DataFrame:
    return segments.estimate_variants(segs(spark, d))


_RANKED = [("rk", """SELECT *, CAST(CASE WHEN m >= 10 THEN (10 * rank + 9) // m ELSE rank END AS INTEGER) AS decile FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY accuracy, segment_id) - 1 AS rank, count(*) OVER (PARTITION BY split) AS m FROM segs) q""")]


@query(sql(["segs"], "SELECT segment_id, split, rank, decile FROM rk", extra=_RANKED))
def accuracy_deciles(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.accuracy_deciles(segs(spark, d)).select("segment_id", "split", "rank", "decile")


def _u(what: str, *extra: str) -> str:
    return "(CAST('0x' || substr(sha256(concat_ws(':', '13', split, sample_id" + "".join(f", {e}" for e in extra) + f", '{what}')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496)"


_DRAWS = _RANKED + [
    ("smp", f"SELECT *, least(m, 10) AS pools FROM (SELECT DISTINCT split, m FROM rk) q, unnest(range(0, 200)) AS t(sample_id)"),
    ("pl", f"SELECT *, 96 + CAST(floor({_u('words')} * 33) AS BIGINT) AS target, CAST(floor({_u('pool')} * pools) AS BIGINT) AS pool FROM smp"),
    ("st", "SELECT *, CASE WHEN m >= 10 THEN pool * m // 10 ELSE pool END AS f, (CASE WHEN m >= 10 THEN (pool + 1) * m // 10 ELSE pool + 1 END) - (CASE WHEN m >= 10 THEN pool * m // 10 ELSE pool END) AS z FROM pl"),
    ("dr", f"SELECT *, CAST(floor(u2 * (m - z)) AS BIGINT) AS o FROM (SELECT *, {_u('kind', 'draw')} AS u1, {_u('rank', 'draw')} AS u2 FROM st, unnest(range(0, 13)) AS t(draw)) q"),
    ("rd", "SELECT split, sample_id, draw, target, CASE WHEN u1 < 0.75 OR pools = 1 THEN f + CAST(floor(u2 * z) AS BIGINT) WHEN o < f THEN o ELSE o + z END AS rank FROM dr"),
    ("dw", """SELECT * FROM (SELECT rd.*, segment_id, reference_words, edit_errors, coalesce(CAST(sum(reference_words) OVER (PARTITION BY rd.split,
      sample_id ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS words_before
      FROM rd JOIN rk ON rk.split = rd.split AND rk.rank = rd.rank) q WHERE words_before < target OR draw < 2"""),
]


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.draw_until_target(ensemble.accuracy_deciles(segs(spark, d)), 200, 13, 96, 128)


@query(sql(["segs"], "SELECT split, sample_id, draw, target, words_before, rank, segment_id FROM dw", extra=_DRAWS))
def draw_until_target(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d).select("split", "sample_id", F.col("draw").cast("bigint").alias("draw"), "target", "words_before", "rank", "segment_id")


_TEST_SEGMENTS = "SELECT * EXCLUDE (split), CAST(dataset_idx AS VARCHAR) AS split FROM segs WHERE split = 'test'"


@query(sql(["segs"], "SELECT CAST(split AS INTEGER) AS dataset_idx, sample_id, draw, target, words_before, rank, segment_id FROM dw",
  extra=[("tsegs", _TEST_SEGMENTS)] + [(n, q.replace("FROM segs", "FROM tsegs")) for n, q in _DRAWS]))
def dataset_test_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws of each dataset's own test segments."""
    pools = ensemble.accuracy_deciles(segs(spark, d).where("split = 'test'"), "dataset_idx")
    out = ensemble.draw_until_target(pools, 200, 13, 96, 128, by="dataset_idx")
    return out.select("dataset_idx", "sample_id", F.col("draw").cast("bigint").alias("draw"), "target", "words_before", "rank", "segment_id")


_EST = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, accuracy * 0.8 + 0.1 + ((sample_id * 37) % 21 - 10) / 200.0::DOUBLE))"
_TEST_DRAWS = [("tsegs", _TEST_SEGMENTS)] + [(n, q.replace("FROM segs", "FROM tsegs")) for n, q in _DRAWS]
_DATASET_SAMPLES = _TEST_DRAWS + [
    ("tested", "SELECT CAST(split AS INTEGER) AS dataset_idx, sample_id, greatest(0.0::DOUBLE, 1 - sum(edit_errors)::DOUBLE / sum(reference_words)) AS accuracy FROM dw GROUP BY 1, 2"),
    ("samples", f"""SELECT 'test' AS partition, dataset_idx, accuracy, {_EST} AS estimated_accuracy FROM tested
      UNION ALL SELECT 'validation', dataset_idx, accuracy, estimated_accuracy FROM (SELECT dataset_idx, accuracy, least(1.0::DOUBLE, greatest(0.0::DOUBLE, accuracy * 0.8 + 0.1 + (turn - 3) / 200.0::DOUBLE)) AS estimated_accuracy FROM segs
        WHERE split = 'train' AND (CAST('0x' || substr(sha256(concat_ws(':', '13', segment_id)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496) < 0.2) q"""),
]


@query(sql(["segs"], """SELECT partition, dataset_idx, round(avg(abs(estimated_accuracy - accuracy)), 6) AS mae, round(avg((estimated_accuracy - accuracy) ** 2), 6) AS mse,
      CASE WHEN count(*) < 2 OR min(accuracy) = max(accuracy) OR min(estimated_accuracy) = max(estimated_accuracy) THEN NULL
        ELSE round(covar_pop(accuracy, estimated_accuracy) / (stddev_pop(accuracy) * stddev_pop(estimated_accuracy)), 6) END AS pearson_correlation, count(*) AS n_points FROM samples GROUP BY 1, 2
  UNION ALL SELECT 'test', 99, 0.0, 0.0, NULL, 0""", extra=_DATASET_SAMPLES))
def dataset_test_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by dataset over samples drawn from each dataset's own test segments, and over held-out training segments; a dataset without rows is there too."""
    rows = segs(spark, d)
    drawn = ensemble.draw_until_target(ensemble.accuracy_deciles(rows.where("split = 'test'"), "dataset_idx"), 200, 13, 96, 128, by="dataset_idx")
    sums = drawn.groupBy("dataset_idx", "sample_id").agg(F.sum("edit_errors").alias("e"), F.sum("reference_words").alias("w"))
    estimate = lambda shift: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("accuracy") * 0.8 + 0.1 + shift / 200.0))
    test = sums.withColumn("accuracy", X.accuracy("e", "w")).select(F.lit("test").alias("split"), "dataset_idx", "accuracy", estimate(F.col("sample_id") * 37 % 21 - 10).alias("estimated_accuracy"))
    held = rows.where((F.col("split") == "train") & metrics.is_validation("segment_id")).select(F.lit("validation").alias("split"), "dataset_idx", "accuracy", estimate(F.col("turn") - 3).alias("estimated_accuracy"))
    datasets = rows.select("dataset_idx").unionByName(spark.range(1).select(F.lit(99).alias("dataset_idx")))
    return evaluate.sample_metrics(test.unionByName(held), datasets).select("partition", "dataset_idx", *[r6(c).alias(c) for c in ("mae", "mse", "pearson_correlation")], "n_points")


@query(sql(["segs", "frames"], """SELECT dw.split, sample_id, count(DISTINCT draw) AS n_segments, md5(string_agg(token, '|' ORDER BY draw,
      frame)) AS tokens_md5, count(*) AS n_frames FROM dw
  JOIN segs USING (segment_id) JOIN frames ON frames.utt_id = segs.utt_id AND frame >= blk * 10 AND frame < blk * 10 + 10 GROUP BY 1, 2""", extra=_DRAWS))
def gather_draws(spark: SparkSession, d: str) -> DataFrame:
    return _gathered(spark, d).select("split", "sample_id", "n_segments", F.md5(F.array_join("ctc_tokens", "|").cast("binary")).alias("tokens_md5"), F.size("ctc_tokens").cast("bigint").alias("n_frames"))


def _gathered(spark: SparkSession, d: str) -> DataFrame:
    ids = segs(spark, d).select("segment_id", "utt_id", "blk")
    streams = ids.join(recs(spark, d).select("utt_id", "ctc_tokens", "ctc_probs", "ctc_frame_len"), "utt_id").withColumns({c: F.expr(f"slice({c}, cast(blk * 10 + 1 as int), 10)") for c in ("ctc_tokens", "ctc_probs")})
    return ensemble.gather_draws(_drawn(spark, d), streams)


@query(sql(["segs"], "SELECT split, sample_id, CAST(sum(edit_errors) AS BIGINT) AS edit_errors, CAST(sum(reference_words) AS BIGINT) AS ref_words, round(greatest(0.0::DOUBLE, 1 - sum(edit_errors)::DOUBLE / sum(reference_words)), 6) AS accuracy FROM dw GROUP BY 1, 2", extra=_DRAWS))
def ensemble_targets(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.ensemble_targets(_gathered(spark, d)).select("split", "sample_id", "edit_errors", "ref_words", r6("accuracy").alias("accuracy"))


_RUNS = [("rl", """SELECT utt_id, run, b, count(*) AS len FROM (SELECT *, sum(c) OVER (PARTITION BY utt_id ORDER BY frame) AS run FROM (
  SELECT *, CASE WHEN b <> lag(b) OVER (PARTITION BY utt_id ORDER BY frame) THEN 1 ELSE 0 END AS c FROM clipped) q) q GROUP BY 1, 2, 3""")]
_WORDS = [("wd", """SELECT utt_id, word, avg(p) AS p FROM (SELECT *, sum(CASE WHEN contains(token, '▁') OR contains(token,
      ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY utt_id ORDER BY place) AS word FROM (
  SELECT utt_id, place, first(token) AS token, max(p) AS p FROM (SELECT *, sum(c) OVER (PARTITION BY utt_id ORDER BY frame) AS place FROM (
    SELECT *, CASE WHEN token <> lag(token) OVER (PARTITION BY utt_id ORDER BY frame) THEN 1 ELSE 0 END AS c FROM clipped) q) q GROUP BY 1,
      2) q WHERE token <> '<blk>') q GROUP BY 1, 2""")]


def _exploded(spark: SparkSession, d: str) -> DataFrame:
    return features.explode_frames(recs(spark, d).where("size(ctc_tokens) > 0"), "utt_id")


@query(sql(["clipped"], "SELECT utt_id, b AS blank, count(*) AS n_runs, max(len) AS longest, CAST(sum(len * len) AS BIGINT) AS squares FROM rl GROUP BY 1, 2", extra=_RUNS))
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return features.run_lengths(_exploded(spark, d), "utt_id").groupBy("utt_id", "blank").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"), F.sum(F.col("length") * F.col("length")).alias("squares"))


@query(sql(["clipped"], "SELECT utt_id, count(*) AS n_words, round(sum(p), 6) AS prob_sum FROM wd GROUP BY 1", extra=_WORDS))
def collapse_tokens(spark: SparkSession, d: str) -> DataFrame:
    return features.collapsed_words(recs(spark, d).where("size(ctc_tokens) > 0"), "utt_id").groupBy("utt_id").agg(F.count("*").alias("n_words"), r6(F.sum("prob")).alias("prob_sum"))


def _nearest(where: str, q: float) -> str:
    return f"list_sort(list(p) FILTER ({where}))[greatest(1, CAST(ceil({q}::DOUBLE / 100 * count(*) FILTER ({where})) AS BIGINT))]"


_B, _N = "b", "NOT b"
_FEATURES = sql(["clipped"], f"""SELECT utt_id, round(b_mean / n, 6) AS ctc_blank_mean_run_fraction, round(eg, 6) AS ctc_nonblank_error_geom_mean,
      round(nn::DOUBLE / greatest(1, nb), 6) AS ctc_nonblank_to_blank_ratio, round(b40, 6) AS ctc_blank_p040,
  round(n_mean / n, 6) AS ctc_nonblank_mean_run_fraction, round(nn / inv, 6) AS ctc_nonblank_harmonic_mean, round(b100 - b0, 6) AS ctc_blank_range,
      round(n1, 6) AS ctc_nonblank_p001, round(b_std / b_mean, 6) AS ctc_blank_run_len_cv,
  round(ln((nb + 1.0::DOUBLE) / (nn + 1)), 6) AS ctc_blank_log_ratio, round(em + 1e-9, 6) AS ctc_nonblank_error_mean, round(b30, 6) AS ctc_blank_p030,
      round(n70, 6) AS ctc_nonblank_p070, round(gm, 6) AS ctc_nonblank_geom_mean, round(lt50, 6) AS ctc_nonblank_frac_lt_50,
  round(n_le2, 6) AS ctc_nonblank_short_run_fraction, round(b0, 6) AS ctc_blank_p000, round(b_le2, 6) AS ctc_blank_short_run_fraction, round(nl50,
      6) AS ctc_blank_neglog_error_p50, round(b_max / n, 6) AS ctc_blank_max_run_fraction, n::DOUBLE AS ctc_token_count,
  round(ps, 6) AS ctc_prob_sum, words::DOUBLE AS ctc_word_count, round(wsum, 6) AS ctc_word_prob_sum, round(words / (greatest(hi - lo,
      1) * 0.04::DOUBLE / 60), 6) AS ctc_wpm
  FROM (SELECT utt_id, count(*) AS n, count(*) FILTER (b) AS nb, count(*) FILTER (NOT b) AS nn, sum(raw) AS ps, {_nearest(_B, 0)} AS b0,
      {_nearest(_B, 30)} AS b30, {_nearest(_B, 40)} AS b40, {_nearest(_B, 100)} AS b100, {_nearest(_N, 1)} AS n1, {_nearest(_N, 70)} AS n70,
    exp(avg(ln(p)) FILTER (NOT b)) AS gm, avg(1 - p) FILTER (NOT b) AS em, sum(1 / p) FILTER (NOT b) AS inv, exp(avg(ln(greatest(1e-9,
      1 - p))) FILTER (NOT b)) AS eg, avg(CASE WHEN p < 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT b) AS lt50,
    quantile_cont(-ln(greatest(1e-9, 1 - p)), 0.5) FILTER (b) AS nl50, min(frame) FILTER (NOT b) AS lo,
      max(frame) FILTER (NOT b) AS hi FROM clipped GROUP BY 1) a
  JOIN (SELECT utt_id, avg(len) FILTER (b) AS b_mean, avg(len) FILTER (NOT b) AS n_mean, max(len) FILTER (b) AS b_max,
      stddev_pop(len) FILTER (b) AS b_std, avg(CASE WHEN len <= 2 THEN 1.0::DOUBLE ELSE 0 END) FILTER (b) AS b_le2,
      avg(CASE WHEN len <= 2 THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT b) AS n_le2 FROM rl GROUP BY 1) r USING (utt_id)
  JOIN (SELECT utt_id, count(*) AS words, sum(p) AS wsum FROM wd GROUP BY 1) w USING (utt_id)""", extra=_RUNS + _WORDS)


def _rounded(names: list[str] = features.STANDARD) -> list[Column]:
    """Means of decimal probabilities can fall on half a digit, where summing order decides; they are moved off it."""
    return [r6(F.col(c) + 1e-9 if c == "ctc_nonblank_error_mean" else c).alias(c) for c in names]


@query(_FEATURES)
def ctc_features_sql(spark: SparkSession, d: str) -> DataFrame:
    rows = features.ctc_features_sql(recs(spark, d), "utt_id")
    return rows.select("utt_id", *_rounded())


@query(_FEATURES)
def ctc_features(spark: SparkSession, d: str) -> DataFrame:
    rows = features.ctc_features(recs(spark, d).select("utt_id", "ctc_tokens", "ctc_probs", "ctc_frame_len"))
    return rows.select("utt_id", *_rounded())


def _full_sql() -> str:
    """The 69 features, from the same parts as the 25."""
    by_rank = {f"ctc_{k}_p{q:03d}": f"list_extract(s{k[0]}, greatest(1, CAST(ceil({q}::DOUBLE / 100 * len(s{k[0]})) AS BIGINT)))" for k in ("blank", "nonblank") for q in features.DECILES}
    made = {
        "ctc_blank_mean_run_fraction": "b_mean / n", "ctc_nonblank_error_geom_mean": "eg", "ctc_nonblank_to_blank_ratio": "nn::DOUBLE / greatest(1, nb)", "ctc_nonblank_mean_run_fraction": "n_mean / n",
        "ctc_nonblank_harmonic_mean": "nn / inv", "ctc_blank_range": "sb[-1] - sb[1]", "ctc_blank_run_len_cv": "b_std / b_mean", "ctc_blank_log_ratio": "ln((nb + 1.0::DOUBLE) / (nn + 1))", "ctc_nonblank_error_mean": "em + 1e-9",
        "ctc_nonblank_geom_mean": "gm", "ctc_blank_max_run_fraction": "b_max / n", "ctc_token_count": "n::DOUBLE", "ctc_prob_sum": "ps", "ctc_word_count": "words::DOUBLE", "ctc_word_prob_sum": "wsum",
        "ctc_wpm": "words / (greatest(hi - lo, 1) * 0.04::DOUBLE / 60)", "ctc_nonblank_p001": "list_extract(sn, greatest(1, CAST(ceil(0.01::DOUBLE * len(sn)) AS BIGINT)))", **by_rank,
        **{f"ctc_nonblank_frac_lt_{t}": f"lt{t}" for t in range(10, 100, 10)}, **{f"ctc_{k}_run_le_{i}": f"{k[0]}_le{i}" for k in ("blank", "nonblank") for i in range(1, 6)},
        **{f"ctc_blank_neglog_error_p{q:03d}": f"nl[{i + 1}]" for i, q in enumerate(features.DECILES)},
    }
    below = ", ".join(f"avg(CASE WHEN p < {t / 100} THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT b) AS lt{t}" for t in range(10, 100, 10))
    short = ", ".join(f"avg(CASE WHEN len <= {i} THEN 1.0::DOUBLE ELSE 0 END) FILTER ({c}) AS {k}_le{i}" for k, c in (("b", "b"), ("n", "NOT b")) for i in range(1, 6))
    return sql(["clipped"], f"""SELECT utt_id, {", ".join(f"round({made[f]}, 6) AS {f}" for f in features.FULL)} FROM (
      SELECT utt_id, count(*) AS n, count(*) FILTER (b) AS nb, count(*) FILTER (NOT b) AS nn, sum(raw) AS ps, list_sort(list(p) FILTER (b)) AS sb,
      list_sort(list(p) FILTER (NOT b)) AS sn, exp(avg(ln(p)) FILTER (NOT b)) AS gm,
        avg(1 - p) FILTER (NOT b) AS em, sum(1 / p) FILTER (NOT b) AS inv, exp(avg(ln(greatest(1e-9, 1 - p))) FILTER (NOT b)) AS eg, {below},
        quantile_cont(-ln(greatest(1e-9, 1 - p)), [{", ".join(str(q / 100) for q in features.DECILES)}]) FILTER (b) AS nl,
      min(frame) FILTER (NOT b) AS lo, max(frame) FILTER (NOT b) AS hi FROM clipped GROUP BY 1) a
      JOIN (SELECT utt_id, avg(len) FILTER (b) AS b_mean, avg(len) FILTER (NOT b) AS n_mean, max(len) FILTER (b) AS b_max,
      stddev_pop(len) FILTER (b) AS b_std, {short} FROM rl GROUP BY 1) r USING (utt_id)
      JOIN (SELECT utt_id, count(*) AS words, sum(p) AS wsum FROM wd GROUP BY 1) w USING (utt_id)""", extra=_RUNS + _WORDS)


@query(_full_sql())
def ctc_features_full(spark: SparkSession, d: str) -> DataFrame:
    return features.ctc_features(recs(spark, d).select("utt_id", "ctc_tokens", "ctc_probs", "ctc_frame_len"), full=True).select("utt_id", *_rounded(features.FULL))


@query(_full_sql())
def ctc_features_full_sql(spark: SparkSession, d: str) -> DataFrame:
    return features.ctc_features_sql(recs(spark, d), "utt_id", full=True).select("utt_id", *_rounded(features.FULL))


@query(sql(["clipped"], f"""SELECT utt_id, round({_nearest(_B, 25)}, 6) AS blank_p25, round({_nearest(_N, 75)}, 6) AS nonblank_p75,
      round(quantile_cont(p, 0.25) FILTER (b), 6) AS blank_linear_p25, round((greatest(max(frame) FILTER (NOT b) - min(frame) FILTER (NOT b),
      1)) * 0.04::DOUBLE, 6) AS speech_seconds
  FROM clipped GROUP BY 1"""))
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    f = _exploded(spark, d)
    pb, pn = F.collect_list(F.when(F.col("blank"), F.col("prob"))), F.collect_list(F.when(~F.col("blank"), F.col("prob")))
    g = f.groupBy("utt_id").agg(pb.alias("pb"), pn.alias("pn"), N.linear_percentile(F.when(F.col("blank"), F.col("prob")), 25).alias("l"), F.min(F.when(~F.col("blank"), F.col("frame"))).alias("a"), F.max(F.when(~F.col("blank"), F.col("frame"))).alias("z"))
    return g.select("utt_id", r6(N.nearest_rank("pb", 25)).alias("blank_p25"), r6(N.nearest_rank("pn", 75)).alias("nonblank_p75"), r6("l").alias("blank_linear_p25"), r6(N.speech_seconds("a", "z", F.lit(0.04))).alias("speech_seconds"))


_CHUNKS = [
    ("ch", "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY utt_id, blk) AS i, count(*) OVER (PARTITION BY conv_id) AS total FROM segs"),
    ("pk", """SELECT conv_id, segment_id, i, total, 0 AS w, CASE WHEN hypothesis_words >= 64 THEN 1 ELSE 0 END AS nw, CASE
      WHEN hypothesis_words >= 64 THEN 0 ELSE hypothesis_words END AS n FROM ch WHERE i = 1
      UNION ALL SELECT ch.conv_id, ch.segment_id, ch.i, ch.total, pk.nw, pk.nw + CASE WHEN pk.n + hypothesis_words >= 64 THEN 1 ELSE 0 END,
      CASE WHEN pk.n + hypothesis_words >= 64 THEN 0 ELSE pk.n + hypothesis_words END
      FROM pk JOIN ch ON ch.conv_id = pk.conv_id AND ch.i = pk.i + 1"""),
    ("win", "SELECT a.segment_id, a.w AS window_idx FROM pk a JOIN pk z ON z.conv_id = a.conv_id AND z.i = z.total WHERE a.w < z.nw OR z.n >= 10"),
]


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.pack_windows(ests(spark, d).withColumn("chunk", F.col("blk")), "conv_id", 64)


@query(sql(["segs"], "SELECT segment_id, CAST(window_idx AS INTEGER) AS window_idx FROM win", True, _CHUNKS))
def pack_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.pack_windows(segs(spark, d).withColumn("chunk", F.col("blk")), "conv_id", 64).select("segment_id", "window_idx")


_REAL = _SEGMENTS + [
    ("recorded", """SELECT 'rec' || conv_id AS group_id, d.utt_id, d.ref_start, len(r) AS reference_words, len(h) AS hypothesis_words, prow[-1] AS edit_errors, start_time, end_time FROM dp d
      JOIN cut USING (utt_id, ref_start) JOIN utt u ON u.utt_id = d.utt_id WHERE i = len(r) AND n_frames <= 80 * len(r) AND blanks > 0 AND blanks < n_frames AND conv_id % 3 <> 0"""),
    ("ch", "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY utt_id, ref_start) AS k, count(*) OVER (PARTITION BY group_id) AS total FROM recorded"),
    ("pk", """SELECT group_id, utt_id, ref_start, k, total, 0 AS w, CASE WHEN hypothesis_words >= 16 THEN 1 ELSE 0 END AS nw, CASE WHEN hypothesis_words >= 16 THEN 0 ELSE hypothesis_words END AS n FROM ch WHERE k = 1
      UNION ALL SELECT ch.group_id, ch.utt_id, ch.ref_start, ch.k, ch.total, pk.nw, pk.nw + CASE WHEN pk.n + hypothesis_words >= 16 THEN 1 ELSE 0 END,
      CASE WHEN pk.n + hypothesis_words >= 16 THEN 0 ELSE pk.n + hypothesis_words END FROM pk JOIN ch ON ch.group_id = pk.group_id AND ch.k = pk.k + 1"""),
    ("wins", "SELECT c.*, a.w FROM pk a JOIN pk z ON z.group_id = a.group_id AND z.k = z.total JOIN ch c ON c.group_id = a.group_id AND c.k = a.k WHERE a.w < z.nw OR z.n >= 10"),
    ("streams", """SELECT group_id, w, md5(string_agg(token, '|' ORDER BY k, frame)) AS tokens_md5, count(*) AS n_frames, avg(raw) AS est FROM wins s
      JOIN frames f ON f.utt_id = s.utt_id AND (frame + 0.5::DOUBLE) * 0.04::DOUBLE >= start_time AND (frame + 0.5::DOUBLE) * 0.04::DOUBLE < end_time GROUP BY 1, 2"""),
    ("sums", "SELECT group_id, w, sum(edit_errors) AS e, sum(reference_words) AS r, sum(hypothesis_words) AS h, greatest(0.0::DOUBLE, 1 - sum(edit_errors)::DOUBLE / sum(reference_words)) AS accuracy FROM wins GROUP BY 1, 2"),
]


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    rows = _planted(spark, d).withColumns({"ref_tokens": F.col("ref_words"), "hyp_tokens": F.col("word_array")}).drop("spans")
    return evaluate.real_windows(rows, 16)


@query(sql(["utt", "times", "frames"], "SELECT group_id, utt_id, CAST(ref_start AS BIGINT) AS ref_start, CAST(w AS INTEGER) AS window_idx, reference_words, hypothesis_words, edit_errors FROM wins", True, _REAL))
def real_windows(spark: SparkSession, d: str) -> DataFrame:
    """Segments of 16 reference words on the planted alignment, packed to windows of each recording."""
    return _recorded(spark, d).select("group_id", "utt_id", F.col("ref_start").cast("bigint").alias("ref_start"), "window_idx", "reference_words", "hypothesis_words", "edit_errors")


@query(sql(["utt", "times", "frames"], "SELECT group_id, CAST(w AS INTEGER) AS window_idx, tokens_md5, n_frames FROM streams", True, _REAL))
def window_streams(spark: SparkSession, d: str) -> DataFrame:
    """The frames of every window of every recording, end to end."""
    out = evaluate.window_streams(_recorded(spark, d))
    return out.select("group_id", "window_idx", F.md5(F.array_join("ctc_tokens", "|").cast("binary")).alias("tokens_md5"), F.size("ctc_tokens").cast("bigint").alias("n_frames"))


@query(sql(["utt", "times", "frames"], """SELECT group_id, CAST(sum(h) AS BIGINT) AS hyp_words, round(sum(h * accuracy) / sum(h), 6) AS accuracy, round(sum(h * est) / sum(h), 6) AS estimated_accuracy, CAST(sum(r) AS BIGINT) AS ref_words,
      count(*) AS n_windows, round(sum(h * accuracy) / sum(h) - sum(h * est) / sum(h), 6) AS residual FROM sums JOIN streams USING (group_id, w) GROUP BY 1 HAVING sum(h) > 0""", True, _REAL))
def evaluate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of every recording from its windows, against the mean probability of their frames as their estimates."""
    rows = checkpointed(_recorded(spark, d))
    mean = F.aggregate("ctc_probs", F.lit(0.0), lambda a, x: a + x) / F.size("ctc_probs")
    estimates = evaluate.window_streams(rows).select("group_id", "window_idx", mean.alias("estimated_accuracy"))
    out = evaluate.evaluate_windows(rows, estimates)
    return out.select("group_id", "hyp_words", r6("accuracy").alias("accuracy"), r6("estimated_accuracy").alias("estimated_accuracy"), "ref_words", "n_windows", r6("residual").alias("residual"))


_TARGETS = _CHUNKS + [
    ("wt", """SELECT conv_id, window_idx, CAST(sum(edit_errors) AS BIGINT) AS edit_errors, CAST(sum(reference_words) AS BIGINT) AS ref_words,
      CAST(sum(hypothesis_words) AS BIGINT) AS hyp_words, count(*) OVER (PARTITION BY conv_id) AS n_windows,
      greatest(0.0::DOUBLE, 1 - sum(edit_errors)::DOUBLE / sum(reference_words)) AS accuracy,
      sum(estimated_accuracy * reference_words) / sum(reference_words) AS est FROM win JOIN ests USING (segment_id) GROUP BY 1, 2"""),
]


@query(sql(["ests"], "SELECT conv_id, CAST(window_idx AS INTEGER) AS window_idx, edit_errors, ref_words, hyp_words, n_windows, round(accuracy, 6) AS accuracy FROM wt", True, _TARGETS))
def window_targets(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_targets(_windows(spark, d), "conv_id").select("conv_id", "window_idx", "edit_errors", "ref_words", "hyp_words", "n_windows", r6("accuracy").alias("accuracy"))


def _window_estimates(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    est = w.groupBy("conv_id", "window_idx").agg((F.sum(F.col("estimated_accuracy") * F.col("reference_words")) / F.sum("reference_words")).alias("estimated_accuracy"))
    return windows.window_targets(w, "conv_id").join(est, ["conv_id", "window_idx"])


@query(sql(["ests"], """SELECT conv_id, round(sum(hyp_words * accuracy) / sum(hyp_words), 6) AS accuracy, round(sum(hyp_words * est) / sum(hyp_words),
      6) AS estimated_accuracy, CAST(sum(ref_words) AS BIGINT) AS ref_words, CAST(sum(hyp_words) AS BIGINT) AS hyp_words, max(n_windows) AS n_windows,
  round(sum(hyp_words * accuracy) / sum(hyp_words) - sum(hyp_words * est) / sum(hyp_words),
      6) AS residual FROM wt GROUP BY 1 HAVING sum(hyp_words) > 0""", True, _TARGETS))
def aggregate_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.aggregate_windows(_window_estimates(spark, d), "conv_id")
    return out.select("conv_id", r6("accuracy").alias("accuracy"), r6("estimated_accuracy").alias("estimated_accuracy"), "ref_words", "hyp_words", "n_windows", r6("residual").alias("residual"))


@query(sql(["hyps", "times"], """SELECT c.utt_id AS file, w AS window_idx, w * 64 AS start_word, least(64, n - w * 64) AS word_count, round(a.s,
      6) AS start_time, round(z.e, 6) AS end_time FROM (SELECT utt_id, count(*) AS n FROM hyps GROUP BY 1) c, unnest(range(0, (n + 63) // 64)) AS t(w)
  JOIN times a ON a.utt_id = c.utt_id AND a.j = w * 64 JOIN times z ON z.utt_id = c.utt_id AND z.j = least(w * 64 + 64, n) - 1"""))
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.word_windows(recs(spark, d).withColumnRenamed("utt_id", "file"), 64)
    return out.select("file", *[F.col(c).cast("bigint").alias(c) for c in ("window_idx", "start_word", "word_count")], r6("start_time").alias("start_time"), r6("end_time").alias("end_time"))


@query(sql(["times"], """SELECT utt_id, round(coalesce(c, 0), 6) AS covered, round(least(1, coalesce(c, 0) / 9), 6) AS ratio
      FROM (SELECT DISTINCT utt_id FROM times) u LEFT JOIN (
  SELECT utt_id, sum(l) AS c FROM (SELECT utt_id, isle, max(e) - min(s) AS l FROM (SELECT *, sum(fresh) OVER (PARTITION BY utt_id ORDER BY s,
      e) AS isle FROM (
    SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY utt_id ORDER BY s,
      e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM (
      SELECT utt_id, greatest(1.0::DOUBLE, s - (j % 3) * 0.2::DOUBLE) AS s, least(10.0::DOUBLE, e) AS e FROM times) q WHERE e > s) q) q GROUP BY 1,
      2) q GROUP BY 1) k USING (utt_id)"""))
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = recs(spark, d).select("utt_id", F.posexplode("word_times").alias("j", "t")).select("utt_id", (F.col("t")[0] - (F.col("j") % 3) * 0.2).alias("s"), F.col("t")[1].alias("e"), F.lit(1.0).alias("low"), F.lit(10.0).alias("high"))
    return windows.merge_intervals(rows, "utt_id").select("utt_id", r6("covered").alias("covered"), r6("ratio").alias("ratio"))


def _guarded(y: str, x: str) -> str:
    return f"CASE WHEN count(*) < 2 OR min({x}) = max({x}) OR min({y}) = max({y}) THEN NULL ELSE round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) END"


@query(sql(["ests"], f"SELECT split, round(avg(abs(estimated_accuracy - accuracy)), 6) AS mae, round(avg((estimated_accuracy - accuracy) ** 2), 6) AS mse, {_guarded('estimated_accuracy', 'accuracy')} AS pearson_correlation, count(*) AS n_points FROM ests GROUP BY 1"))
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.regression_metrics(ests(spark, d), ["split"])
    return out.select("split", *[r6(c).alias(c) for c in ("mae", "mse", "pearson_correlation")], "n_points")


@query(sql(["ests"], f"""SELECT partition, dataset_idx, round(sum(w * abs(estimated_accuracy - accuracy)) / sum(w), 6) AS mae,
      round(sum(w * (estimated_accuracy - accuracy) ** 2) / sum(w), 6) AS mse, {_guarded('estimated_accuracy', 'accuracy')} AS pearson_correlation,
      count(*) AS n_points
  FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'real' ELSE 'validation' END AS partition,
      CASE WHEN turn % 2 = 0 THEN hypothesis_words::DOUBLE ELSE 1.0 END AS w FROM ests) q GROUP BY 1, 2"""))
def per_dataset_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = ests(spark, d).withColumn("partition", F.expr("CASE WHEN turn % 2 = 0 THEN 'real' ELSE 'validation' END")).withColumn("hyp_words", F.col("hypothesis_words"))
    return metrics.per_dataset_metrics(rows).select("partition", "dataset_idx", *[r6(c).alias(c) for c in ("mae", "mse", "pearson_correlation")], "n_points")


_LEVELS = (5.0, 2.5)
_NOISY = [
    ("base", """SELECT conv_id, dataset_idx, CAST(sum(hypothesis_words) AS BIGINT) AS hyp_words,
      sum(hypothesis_words * accuracy) / sum(hypothesis_words) AS accuracy, sum(hypothesis_words * estimated_accuracy) / sum(hypothesis_words) AS est
      FROM ests WHERE split = 'test' GROUP BY 1, 2 HAVING sum(hypothesis_words) > 0"""),
    ("noisy", """SELECT conv_id || suffix AS sample_id, dataset_idx, snr, hyp_words + extra AS hyp_words, accuracy, greatest(0.0::DOUBLE,
      est - extra / 100.0::DOUBLE) AS estimated_accuracy
      FROM base, (VALUES (NULL::DOUBLE, '', 0), (5.0::DOUBLE, '_snr5', 3), (2.5::DOUBLE, '_snr2.5', 7)) AS l(snr, suffix, extra)"""),
    ("parted", """SELECT *, 'real' AS partition FROM noisy WHERE snr IS NULL UNION ALL SELECT *, 'real_snr' FROM noisy
      UNION ALL SELECT *, 'real_snr_5' FROM noisy WHERE snr IS NULL OR snr = 5.0 UNION ALL SELECT *, 'real_snr_2.5' FROM noisy WHERE snr IS NULL OR snr = 2.5"""),
]


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    """Estimates for recordings of the test split, clean and at two noise levels, dealt to their partitions."""
    w = F.col("hypothesis_words")
    base = ests(spark, d).where("split = 'test'").groupBy("conv_id", "dataset_idx").agg(F.sum(w).alias("hyp_words"), F.sum(w * F.col("accuracy")).alias("a"), F.sum(w * F.col("estimated_accuracy")).alias("e")).where("hyp_words > 0")
    base = base.select(F.col("conv_id").cast("string").alias("utt_id"), "dataset_idx", "hyp_words", (F.col("a") / F.col("hyp_words")).alias("accuracy"), (F.col("e") / F.col("hyp_words")).alias("e"))
    rows = manifest.expand_snr(base.withColumns({"group_id": F.col("utt_id"), "speaker_id": F.col("utt_id")}), list(_LEVELS))
    extra = F.when(F.col("snr") == 5.0, 3).when(F.col("snr") == 2.5, 7).otherwise(0)
    rows = rows.withColumns({"estimated_accuracy": F.greatest(F.lit(0.0), F.col("e") - extra / 100.0), "hyp_words": F.col("hyp_words") + extra})
    return evaluate.union_partitions(rows, "real", _LEVELS).withColumnRenamed("utt_id", "sample_id")


@query(sql(["ests"], "SELECT partition, sample_id, dataset_idx FROM parted", extra=_NOISY))
def union_partitions(spark: SparkSession, d: str) -> DataFrame:
    return _noisy(spark, d).select("partition", "sample_id", "dataset_idx")


@query(sql(["ests"], f"""SELECT partition, dataset_idx, round(sum(w * abs(estimated_accuracy - accuracy)) / sum(w), 6) AS mae,
      round(sum(w * (estimated_accuracy - accuracy) ** 2) / sum(w), 6) AS mse, {_guarded('estimated_accuracy', 'accuracy')} AS pearson_correlation,
      count(*) AS n_points
    FROM (SELECT partition, dataset_idx, hyp_words::DOUBLE AS w, accuracy, estimated_accuracy FROM parted
      UNION ALL SELECT partition, NULL, CASE WHEN partition LIKE 'real_snr_%' THEN 1.0::DOUBLE ELSE hyp_words END, accuracy,
      estimated_accuracy FROM parted) q GROUP BY 1, 2
  UNION ALL SELECT 'none', NULL, 0.0::DOUBLE, 0.0::DOUBLE, NULL, 0""", extra=_NOISY))
def evaluation_snr(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of clean recordings, of all, and of clean ones with each noise level, over all datasets and by dataset."""
    names = [*evaluate.partition_names("real", _LEVELS), "none"]
    return evaluate.partition_metrics(_noisy(spark, d), names).select("partition", "dataset_idx", *[r6(c).alias(c) for c in ("mae", "mse", "pearson_correlation")], "n_points")


@query(sql(["ests"], f"""SELECT round(avg(abs(estimated_accuracy - accuracy)), 6) AS mae, round(avg((estimated_accuracy - accuracy) ** 2), 6) AS mse,
      {_guarded('estimated_accuracy', 'accuracy')} AS pearson_correlation, count(*) AS n_points
  FROM ests WHERE split = 'train' AND (CAST('0x' || substr(sha256(concat_ws(':', '13', segment_id)), 1,
      13) AS BIGINT)::DOUBLE / 4503599627370496) < 0.2"""))
def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics over the training rows that are held out for validation."""
    held = ests(spark, d).where((F.col("split") == "train") & metrics.is_validation("segment_id"))
    return metrics.regression_metrics(held, []).select(*[r6(c).alias(c) for c in ("mae", "mse", "pearson_correlation")], "n_points")


@query(sql(["utt"], "SELECT utt_id || suffix AS sample_id, dataset_idx FROM utt, (VALUES (''), ('_snr5'), ('_snr2.5_w3'), ('_w12')) AS l(suffix)"))
def assign_dataset(spark: SparkSession, d: str) -> DataFrame:
    u = utt(spark, d)
    ids = u.select(F.explode(F.array(*[F.concat("utt_id", F.lit(s)) for s in ("", "_snr5", "_snr2.5_w3", "_w12")])).alias("sample_id"))
    return metrics.assign_dataset(ids, u).select("sample_id", "dataset_idx")


@query(sql(["ests"], "SELECT conv_id AS file, CAST(sum(hypothesis_words) AS BIGINT) AS words, round(sum(hypothesis_words * (1 - estimated_accuracy)), 6) AS expected_errors, round(least(1, greatest(0, 1 - sum(hypothesis_words * (1 - estimated_accuracy)) / nullif(sum(hypothesis_words), 0))), 6) AS estimated_accuracy FROM ests GROUP BY 1"))
def file_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = ests(spark, d).select(F.col("conv_id").alias("file"), F.col("hypothesis_words").alias("word_count"), "estimated_accuracy")
    return metrics.file_accuracy(rows).select("file", "words", r6("expected_errors").alias("expected_errors"), r6("estimated_accuracy").alias("estimated_accuracy"))


@query(sql(["ests"], "SELECT round(regr_intercept(accuracy, estimated_accuracy), 6) AS a, round(regr_slope(accuracy, estimated_accuracy), 6) AS b FROM ests"))
def fit_affine(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fit_affine(ests(spark, d), "estimated_accuracy").select(r6("a").alias("a"), r6("b").alias("b"))


@query(sql(["ests"], "SELECT segment_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, -0.3::DOUBLE + 1.6::DOUBLE * estimated_accuracy)), 6) AS calibrated, (CAST('0x' || substr(sha256(concat_ws(':', '13', segment_id)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496) < 0.2 AS is_val FROM ests"))
def calibrate_and_hold_out(spark: SparkSession, d: str) -> DataFrame:
    return ests(spark, d).select("segment_id", r6(N.calibrated("estimated_accuracy", -0.3, 1.6)).alias("calibrated"), metrics.is_validation("segment_id").alias("is_val"))


_TRACE = [
    *_PAIRS[:2],
    ("prows", "SELECT utt_id, i, prow FROM dp"),
    # From the end: a deletion if it is on a cheapest way, else an insertion, else a match or substitution.
    ("trace", """SELECT utt_id, len(r)::BIGINT AS i, len(h)::BIGINT AS j, -1::BIGINT AS hyp_at FROM pr UNION ALL
      SELECT utt_id, CASE WHEN insertion THEN i ELSE i - 1 END, CASE WHEN deletion THEN j ELSE j - 1 END, CASE WHEN insertion THEN -1 WHEN deletion THEN j ELSE j - 1 END FROM (
        SELECT t.utt_id, t.i, t.j, b.prow[t.j + 1] + 1 = a.prow[t.j + 1] AS deletion, b.prow[t.j + 1] + 1 <> a.prow[t.j + 1] AND t.j > 0 AND coalesce(a.prow[t.j], -9) + 1 = a.prow[t.j + 1] AS insertion
        FROM trace t JOIN prows a ON a.utt_id = t.utt_id AND a.i = t.i JOIN prows b ON b.utt_id = t.utt_id AND b.i = t.i - 1 WHERE t.i > 0) q"""),
]


@query(sql(["tokens", "hyps"], """SELECT u.utt_id, coalesce(w, '') AS ref_to_hyp FROM tokens u LEFT JOIN (SELECT utt_id, string_agg(hyp_at::VARCHAR, ' ' ORDER BY i) AS w FROM trace WHERE hyp_at >= 0 GROUP BY 1) q USING (utt_id)""", True, _TRACE))
def align_words(spark: SparkSession, d: str) -> DataFrame:
    """Hypothesis index of every reference word of every utterance."""
    rows = segments.with_alignment(segments.with_tokens(recs(spark, d)))
    return rows.select("utt_id", F.array_join(F.col("ref_to_hyp").cast("array<string>"), " ").alias("ref_to_hyp"))


@query()
def random_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of random lengths, three variants of every utterance."""
    rows = segments.random_spans(utt(spark, d).withColumn("ref_tokens", X.normalize_text("reference")), variants=3)
    return rows.select("utt_id", "variant", F.explode("spans").alias("s")).select("utt_id", "variant", "s.ref_start", "s.ref_end")


@query()
def segment_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Aligned, timed and guarded segments of two variants."""
    return segments.segment_dataset(recs(spark, d), variants=2, max_words=40, keep_ctc=False)


def _split_recs(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Recognitions of the utterances of a split by speakers; utterances are dealt and chosen before they have frames."""
    return fixtures.recognitions(spark, d, splits.speaker_split(manifest.with_ids(utt(spark, d))).where(where))


def _samples(spark: SparkSession, d: str, seed: int) -> DataFrame:
    """Training examples of 64 words and more from segments of at most 40, as many a split as there are segments, with features."""
    rows = _split_recs(spark, d)
    parts = stored(features.flagged(segments.segment_dataset(rows, variants=2, max_words=40)))
    samples = ensemble.sample_features(parts, parts.count(), seed, 64, 64)
    return samples.withColumn("sample_id", F.concat_ws("_", "split", F.col("sample_id").cast("string"))).select("sample_id", "split", "accuracy", "ref_words", *features.STANDARD)


def _predictor(spark: SparkSession, d: str) -> tuple[model.Predictor, DataFrame]:
    """A predictor by the whole grid, of 4 rounds, and samples: 64 words each, as many a split as the table has segments."""
    samples = _samples(spark, d, 13)
    return model.train(samples.where("split = 'train'"), features.STANDARD, rounds=4), samples


_STUMP_FEATURES = ["reference_words", "hypothesis_words", "edit_errors"]


def _cut_sql(source: str) -> str:
    """The best split of each node of ``source`` (node, f, v, r): at least 5 rows a side, l2 of 0.1, the first of ties."""
    return f"""SELECT node, f, v AS cut, gain FROM (SELECT DISTINCT node, f, v, gl * gl / (nl + 0.1) + (g - gl) * (g - gl) / (n - nl + 0.1) - g * g / (n + 0.1) AS gain, nl, n FROM (
      SELECT node, f, v, sum(r) OVER (PARTITION BY node, f ORDER BY v) AS gl, count(*) OVER (PARTITION BY node, f ORDER BY v) AS nl, sum(r) OVER (PARTITION BY node, f) AS g,
      count(*) OVER (PARTITION BY node, f) AS n FROM {source}) q) q WHERE nl >= 5 AND n - nl >= 5 AND gain > 1e-10 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, v) = 1"""


_TREE = [
    ("measured", """SELECT segment_id, f, v, accuracy - avg(accuracy) OVER () AS r, 0 AS node FROM ests,
      unnest([{'f': 1, 'v': reference_words}, {'f': 2, 'v': hypothesis_words}, {'f': 3, 'v': edit_errors}]) AS t(u), unnest([u.f]) AS t2(f), unnest([u.v]) AS t3(v)"""),
    ("root", _cut_sql("measured")),
    ("sides", """SELECT m.segment_id, m.f, m.v, m.r, CASE WHEN k.cut IS NULL THEN 0 WHEN x.v <= k.cut THEN 1 ELSE 2 END AS node FROM measured m LEFT JOIN root k ON true
      LEFT JOIN measured x ON x.segment_id = m.segment_id AND x.f = k.f"""),
    ("second", f"SELECT * FROM ({_cut_sql('(SELECT * FROM sides WHERE node > 0)')}) q ORDER BY round(gain, 9) DESC, node LIMIT 1"),
    ("leaves", """SELECT DISTINCT s.segment_id, s.r, CASE WHEN k.node = s.node AND x.v <= k.cut THEN 3 WHEN k.node = s.node THEN 4 ELSE s.node END AS leaf FROM sides s LEFT JOIN second k ON true
      LEFT JOIN measured x ON x.segment_id = s.segment_id AND x.f = k.f"""),
]


@query(sql(["ests"], """SELECT segment_id, round((SELECT avg(accuracy) FROM ests) + 0.5 * sum(r) OVER (PARTITION BY leaf) / (count(*) OVER (PARTITION BY leaf) + 0.1), 6) AS raw FROM leaves""", extra=_TREE))
def boosted_tree(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of one tree of three leaves, grown best first on squared loss with l2, of every segment."""
    rows = ests(spark, d).select("segment_id", "accuracy", *[F.col(c).cast("double").alias(c) for c in _STUMP_FEATURES])
    tree = boosting.boost(rows, _STUMP_FEATURES, [{"step": 0.5, "leaves": 3, "least_rows": 5, "l2": 0.1}], 1, "mse")[0][0]
    return boosting.with_raw(rows, tree, _STUMP_FEATURES).select("segment_id", r6("raw").alias("raw"))


@query()
def train_and_test(spark: SparkSession, d: str) -> DataFrame:
    """Estimates on the test samples of a predictor that is fitted to the training samples."""
    p, samples = _predictor(spark, d)
    return model.predictions(samples.where("split = 'test'"), p)


@query()
def dataset_test_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Estimates on samples of each dataset's own test recordings, as many a dataset as the table has utterances in four."""
    p, _ = _predictor(spark, d)
    rows = _split_recs(spark, d)
    variants = segments.estimate_variants(segments.segment_dataset(rows, max_words=40, keep_ctc=False), 4 * rows.count())
    return model.predictions(evaluate.dataset_test_samples(rows, rows.count() // 4, variants=variants, min_words=64, max_words=64, segment_words=(10, 40)), p)


@query()
def validation_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Estimates on the training samples that were held out when the setting was chosen."""
    p, samples = _predictor(spark, d)
    return model.validation_predictions(samples, p)


@query()
def evaluation_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the test speakers' recordings and utterances, packed in windows of 128 words, over all and by dataset."""
    p, _ = _predictor(spark, d)
    test = _split_recs(spark, d, "split = 'test'")
    names = [n for kind in ("real", "real_part") for n in evaluate.partition_names(kind)]
    return evaluate.partition_metrics(evaluate.evaluate_partitions(test, p, 128), names)


@query()
def score_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Estimated accuracy, expected errors and speech shares of every window of 64 words."""
    p, _ = _predictor(spark, d)
    out = score.score_recordings(recs(spark, d).withColumnRenamed("utt_id", "file"), p, 64)
    return out.select("file", "window_idx", "word_count", "start_time", "end_time", "speech_ratio", "non_speech_ratio", "estimated_accuracy", "expected_error_count")


@query(sql(["times"], """SELECT utt_id AS file, CAST(w AS BIGINT) AS window_idx, min(j) AS start_word, count(*) AS word_count, round(min(s),
      6) AS start_time, round(max(e), 6) AS end_time, count(*) FILTER (e > s) > 0 AS spoken
  FROM (SELECT *, j // 64 AS w FROM times) q GROUP BY 1, 2"""))
def scored_windows(spark: SparkSession, d: str) -> DataFrame:
    out = score.scored_windows(recs(spark, d).withColumnRenamed("utt_id", "file"), 64)
    return out.select("file", *[F.col(c).cast("bigint").alias(c) for c in ("window_idx", "start_word", "word_count")], r6("start_time").alias("start_time"), r6("end_time").alias("end_time"), (F.col("speech_ratio") > 0).alias("spoken"))


@query(sql(["ests"], """SELECT conv_id AS file, CAST(sum(hypothesis_words) AS BIGINT) AS words,
      round(sum(hypothesis_words * (1 - estimated_accuracy)), 6) AS expected_errors, count(*) AS n_windows FROM ests GROUP BY 1"""))
def accuracy_report(spark: SparkSession, d: str) -> DataFrame:
    rows = ests(spark, d).select(
        F.col("conv_id").alias("file"), F.col("segment_id").alias("window_idx"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"), F.col("hypothesis_words").alias("word_count"),
        "estimated_accuracy", F.lit(0.5).alias("speech_ratio"), F.lit(0.5).alias("non_speech_ratio"),
    )
    return score.accuracy_report(rows).select("file", "words", r6("expected_errors").alias("expected_errors"), F.size("windows").cast("bigint").alias("n_windows"))


@query()
def add_noise(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of 16-bit samples made from embeddings, with noise at 10 dB, and the level measured afterwards."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("utt_id"), "embedding").where("embedding IS NOT NULL")
    pcm = e.withColumn("pcm", F.unhex(F.array_join(F.transform("embedding", lambda x: _le16(F.round(x.cast("double") * 8000).cast("int"))), ""))).withColumn("snr", F.lit(10.0))
    return noise.add_noise(pcm.select("utt_id", "pcm", "snr")).select("utt_id", "snr", F.octet_length("pcm").alias("n_bytes"), F.md5("pcm").alias("pcm_md5"))


def _le16(x: Column) -> Column:
    """Four hex digits of a signed 16-bit number, low byte first."""
    v = F.pmod(x, F.lit(65536))
    return F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))


@query(sql(["utt"], "SELECT utt_id, audio_path, reference, speaker_id, coalesce(group_id, utt_id) AS group_id FROM utt"))
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Utterances written as JSON lines and read as a manifest."""
    path = f"{scratch_dir(spark)}/manifest-{uuid.uuid4().hex}"
    utt(spark, d).select("utt_id", "audio_path", "reference", "speaker_id", F.coalesce("group_id", "utt_id").alias("group_id")).write.json(path)
    return files.read_manifest(spark, path, "jsonl").select("utt_id", "audio_path", "reference", "speaker_id", "group_id")


@query(sql(["hyps"], "SELECT utt_id, count(*) AS n_words, md5(string_agg(h, '|' ORDER BY j)) AS words_md5 FROM hyps GROUP BY 1"))
def recognition_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Recognition documents written as JSON, read again and reduced to their final event."""
    path = f"{scratch_dir(spark)}/recognitions-{uuid.uuid4().hex}"
    fixtures.documents_of(recs(spark, d)).where("size(result[1].word_array) > 0").drop("conv_id", "turn").write.option("ignoreNullFields", "false").json(path)
    rows = recognition.final_recognition(files.read_recognitions(spark, path, lines=True))
    return rows.select("utt_id", F.size("final.word_array").cast("bigint").alias("n_words"), F.md5(F.array_join("final.word_array", "|").cast("binary")).alias("words_md5"))


@query(sql(["ests"], "SELECT dataset_idx, split, count(*) AS n_rows, round(sum(accuracy), 5) AS accuracy, CAST(sum(reference_words) AS BIGINT) AS ref_words FROM ests GROUP BY 1, 2"))
def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Estimates written as CSV in a folder for each dataset and split, read again and added up."""
    path = f"{scratch_dir(spark)}/report-{uuid.uuid4().hex}"
    files.write_dataset_reports(ests(spark, d).select("segment_id", "dataset_idx", "split", "accuracy", "estimated_accuracy", "reference_words"), path)
    rows = spark.read.schema("segment_id string, accuracy double, estimated_accuracy double, reference_words bigint, dataset_idx int, split string").csv(path, header=True)
    return rows.groupBy("dataset_idx", "split").agg(F.count("*").alias("n_rows"), F.round(F.sum("accuracy"), 5).alias("accuracy"), F.sum("reference_words").alias("ref_words"))


@query(sql(["ests"], """SELECT conv_id AS file, CAST(sum(hypothesis_words) AS BIGINT) AS words,
      round(sum(hypothesis_words * (1 - estimated_accuracy)), 5) AS expected_errors, count(*) AS n_windows,
      min(segment_id) AS first_window FROM ests GROUP BY 1"""))
def accuracy_report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy reports written as JSON, one record a file with its windows, and read again."""
    rows = ests(spark, d).select(
        F.col("conv_id").alias("file"), F.col("segment_id").alias("window_idx"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"), F.col("hypothesis_words").alias("word_count"),
        "estimated_accuracy", F.lit(0.5).alias("speech_ratio"), F.lit(0.5).alias("non_speech_ratio"),
    )
    path = f"{scratch_dir(spark)}/accuracy-{uuid.uuid4().hex}"
    files.write_window_reports(rows, path)
    read = spark.read.schema(score.accuracy_report(rows).schema).json(path, multiLine=True)
    return read.select("file", "words", F.round("expected_errors", 5).alias("expected_errors"), F.size("windows").cast("bigint").alias("n_windows"), F.col("windows")[0]["window_idx"].alias("first_window"))
