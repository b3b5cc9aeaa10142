"""Audio files, stored recognitions and window reports, written and read again."""

import json
import wave

import numpy as np
from pyspark.sql import functions as F

from trustline.operators import manifest, noise, recognition
from trustline.plans import score
from trustline.sources import files


def sound(path, samples, extra=b""):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(samples.astype("<i2").tobytes())
    if extra:
        # Another chunk before the data, whose bytes spell its name at an odd place.
        raw = path.read_bytes()
        path.write_bytes(raw[:36] + b"LIST" + len(extra).to_bytes(4, "little") + extra + raw[36:])


def test_audio_files_to_noisy_samples(spark, tmp_path):
    rng, folder = np.random.default_rng(1), tmp_path / "audio" / "deep"
    folder.mkdir(parents=True)
    signal = {n: (rng.normal(size=4000) * 3000).astype("<i2") for n in ("a", "b")}
    sound(folder / "a.wav", signal["a"])
    sound(folder / "b.wav", signal["b"], b"INFOx\x06\x46\x17\x46\x10")
    sound(folder / "empty.wav", signal["a"][:0])
    (folder / "not.wav").write_bytes(b"no audio at all, though it says data")
    listed = {r.audio_path: r.length for r in files.list_audio(spark, str(tmp_path), "*.wav").collect()}
    assert listed == {str(f): f.stat().st_size for f in folder.iterdir()}
    pcm = {r.audio_path.rsplit("/", 1)[1]: r.pcm for r in files.read_audio(spark, str(tmp_path)).collect()}
    assert pcm["a.wav"] == signal["a"].tobytes() and pcm["b.wav"] == signal["b"].tobytes() and pcm["empty.wav"] == b"" and pcm["not.wav"] is None
    rows = files.read_audio(spark, str(tmp_path)).withColumns({"utt_id": F.regexp_extract("audio_path", r"(\w+)\.wav", 1), "snr": F.lit(10.0)})
    for r in noise.add_noise(rows).where("utt_id IN ('a', 'b')").collect():
        clean = signal[r.utt_id].astype(float)
        added = np.frombuffer(r.pcm, "<i2") - clean
        assert abs(10 * np.log10((clean**2).mean() / (added**2).mean()) - 10) < 0.3


def test_absent_audio_is_rejected(spark, tmp_path):
    sound(tmp_path / "there.wav", np.zeros(5))
    raw = spark.createDataFrame([("there.wav", "hello"), ("gone.wav", "hello")], "filename string, text string").withColumn("input_order", F.monotonically_increasing_id())
    (tmp_path / "audio").mkdir()
    (tmp_path / "there.wav").rename(tmp_path / "audio" / "there.wav")
    rows = manifest.normalize_manifest(raw, str(tmp_path))
    told = manifest.rejected_manifest(rows, files.list_audio(spark, str(tmp_path)))
    assert {r.utt_id: r.reason for r in told.collect()} == {"there": None, "gone": "audio_not_present"}


def test_resuming_by_usable_documents(spark, tmp_path):
    good = {"type": "asr_result", "ctc_tokens": ["a"], "ctc_probs": [0.5], "word_array": ["a"], "word_times": [[0.0, 1.0]]}
    bad = {**good, "word_times": []}
    make = lambda docs: spark.read.schema(files.RECOGNITION).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))
    path, rows = str(tmp_path / "stored"), spark.createDataFrame([("u",), ("v",), ("w",), ("x",)], "utt_id string")
    files.store_recognitions(make([{"utt_id": "u", "result": [good]}, {"utt_id": "v", "result": [bad]}, {"utt_id": "w", "result": None}]), path, 0)
    pending = lambda: {r.utt_id for r in recognition.pending_recognitions(rows, files.stored_recognitions(spark, path)).collect()}
    assert pending() == {"v", "w", "x"}
    for _ in range(2):  # storing a batch again changes nothing
        files.store_recognitions(make([{"utt_id": "v", "result": [good]}, {"utt_id": "u", "result": [bad]}, {"utt_id": "v", "result": [good]}]), path, 1)
        assert pending() == {"w", "x"}
        docs = files.stored_recognitions(spark, path)
        assert docs.count() == 6 and {(r.utt_id, r.batch) for r in recognition.valid_recognitions(docs).collect()} == {("u", 0), ("v", 1)}


def test_window_reports_equal_the_listed_ones(spark, tmp_path):
    windows = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN concat('f', id % 30) ELSE 'long' END AS file", "cast(id as int) AS window_idx", "id * 1.0D AS start_time", "CASE WHEN id % 7 > 0 THEN id + 1.0D END AS end_time",
        "cast(id % 5 as bigint) AS word_count", "0.25D AS estimated_accuracy", "0.5D AS speech_ratio", "0.5D AS non_speech_ratio",
    )
    want = score.accuracy_report(windows)
    files.write_window_reports(windows.repartition(6), str(tmp_path / "r"))
    read = spark.read.schema(want.schema).json(str(tmp_path / "r"), multiLine=True).select(want.columns)
    key = lambda r: r.file
    got, want = (sorted(df.collect(), key=key) for df in (read, want))
    assert [r.windows for r in got] == [r.windows for r in want] and [(r.file, r.words, r.estimated_accuracy) for r in got] == [(r.file, r.words, r.estimated_accuracy) for r in want]
    assert np.allclose([r.expected_errors for r in got], [r.expected_errors for r in want])
