"""Utterances and recognitions derived from ``conversations`` with whole-number arithmetic, as Spark tables.

Everything stays in one row an utterance: words, word times and frames are arrays, so no exchange is needed to make them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, conv_id, turn, dataset_idx, reference, speaker_id, group_id, audio_path)."""
    utt = "concat(lpad(cast(conv_id as string), 5, '0'), '_', lpad(cast(turn as string), 2, '0'), '_000000')"
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(
        f"{utt} AS utt_id", "cast(conv_id as bigint) AS conv_id", "cast(turn as bigint) AS turn", "cast(conv_id % 2 as int) AS dataset_idx", "text AS reference",
        "CASE WHEN conv_id % 5 = 0 THEN concat('spk', conv_id) END AS speaker_id",
        "CASE WHEN conv_id % 3 <> 0 THEN concat('rec', conv_id) END AS group_id",
        f"concat('audio/', {utt}, '.wav') AS audio_path",
    )


def recognitions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """utterances with word_array, word_ops, word_times, ctc_tokens, ctc_probs, ctc_frame_len and audio_duration.

    A row grows a hundredfold here, so the small texts are first spread over all cores; files may be few. ``rows`` are
    utterances that have been joined or chosen already, when they were small."""
    spread = (utterances(spark, sf_dir) if rows is None else rows).repartition(3 * spark.sparkContext.defaultParallelism, "utt_id")
    words = spread.withColumn("ref_words", F.expr("filter(split(reference, '\\\\s+'), w -> w <> '')"))
    hyps = F.expr("""flatten(transform(ref_words, (w, pos) -> transform(array((conv_id * 7 + turn * 13 + pos * 31) % (4 + conv_id % 17)), op ->
          CASE WHEN op = 0 THEN cast(array() as array<struct<h: string, op: bigint>>)
               WHEN op = 1 THEN array(named_struct('h', concat('x', w), 'op', op))
               WHEN op = 2 THEN array(named_struct('h', w, 'op', op), named_struct('h', 'uh', 'op', op))
               ELSE array(named_struct('h', w, 'op', op)) END)[0]))""")
    # Filters do not go below what is not deterministic: taken to the scan, they would make all of this there again for each
    # mention, in as many tasks as there are files.
    once = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    ops = words.withColumn("hyps", once(hyps))
    start = "(10 * j + 6 * (j div 4) + ((j % 4) * ((j % 4) - 1)) div 2)"
    tokens = """flatten(transform(hyps, (s, j) -> concat(array('<blk>', '<blk>'), array_repeat(concat('▁', substr(s.h, 1, 2)), 3),
      array_repeat(IF(length(s.h) <= 2, concat('▁', substr(s.h, 1, 2)), substr(s.h, 3)), 3), array_repeat('<blk>', 2 + j % 4))))"""
    # The remainder of frames by 97 goes up by 17 a frame, so a word's numbers are a stretch of a table: 40 * 17 is 1 by 97.
    table = lambda by: "array(" + ", ".join(f"cast({9999 - i * 17 % 97 * by} as double) / 10000D" for i in range(97 + 12)) + ")"
    first = f"cast((40 * (conv_id * 3 + turn * 5) + {start}) % 97 as int)"
    whole = f"""flatten(transform(hyps, (s, j) -> IF(s.op IN (1, 2),
      concat(slice({table(10)}, {first} + 1, 2), slice({table(60)}, {first} + 3, 6), slice({table(10)}, {first} + 9, 2 + j % 4)), slice({table(10)}, {first} + 1, 10 + j % 4))))"""
    # By its definition, for ids that are null or negative.
    each = f"""flatten(transform(hyps, (s, j) -> transform(sequence(0, 9 + j % 4), k ->
      cast(9999 - ((conv_id * 3 + turn * 5 + ({start} + k) * 17) % 97) * IF(s.op IN (1, 2) AND k BETWEEN 2 AND 7, 60, 10) as double) / 10000D)))"""
    frames = ops.withColumns({"ctc_tokens": once(F.expr(tokens)), "ctc_probs": once(F.expr(f"IF(conv_id >= 0 AND turn >= 0, {whole}, {each})"))})
    return frames.select(
        *words.columns,
        F.expr("transform(hyps, s -> s.h)").alias("word_array"),
        F.expr("transform(hyps, s -> s.op)").alias("word_ops"),
        F.expr(f"transform(hyps, (s, j) -> array(({start} + 2) * 0.04D, ({start} + 8) * 0.04D))").alias("word_times"),
        "ctc_tokens",
        "ctc_probs",
        F.lit(0.04).alias("ctc_frame_len"),
        (F.size("ctc_probs") * 0.04).alias("audio_duration"),
    )


def documents_of(recs: DataFrame) -> DataFrame:
    """Stored recognition documents: a partial event, then the final one, in ``result``."""
    event = "struct<type: string, partial_result: boolean, ctc_tokens: array<string>, ctc_probs: array<double>, ctc_frame_len: double, audio_duration: double, word_array: array<string>, word_times: array<array<double>>>"
    return recs.select(
        "utt_id", "conv_id", "turn", "audio_path", "reference",
        F.expr(f"""array(
          cast(named_struct('type', 'asr_result', 'partial_result', true, 'ctc_tokens', cast(null as array<string>), 'ctc_probs', cast(null as array<double>), 'ctc_frame_len', ctc_frame_len, 'audio_duration', audio_duration, 'word_array', slice(word_array, 1, 1), 'word_times', slice(word_times, 1, 1)) as {event}),
          cast(named_struct('type', 'asr_result', 'partial_result', cast(null as boolean), 'ctc_tokens', ctc_tokens, 'ctc_probs', ctc_probs, 'ctc_frame_len', ctc_frame_len, 'audio_duration', audio_duration, 'word_array', word_array, 'word_times', word_times) as {event}))""").alias("result"),
    )
