"""Every query with SQL gives the rows that DuckDB gives."""

import os
from pathlib import Path

import duckdb
import pytest

from trustline import queries

SLOW = {"utterance_metrics", "overall_accuracy", "ctc_features_sql"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(queries.ORACLES[name])
    want = plain([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    for a, b in zip(*(x[1] for x in (got, want))):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-4) for x, y in zip(a, b)), (a, b)


def test_model_round_trip(spark, sf_dir, tmp_path):
    from trustline.operators.features import STANDARD
    from trustline.plans import model

    names = STANDARD[:3]
    df = spark.range(120).selectExpr("concat('s', id) AS sample_id", "id / 120.0D AS accuracy", *[f"(id * {i + 1} % 50) / 50.0D AS {n}" for i, n in enumerate(names)])
    p = model.train(df, names, grid=[{"step": 0.1, "leaves": 4, "least_rows": 2, "l2": 0.0}], rounds=3)
    model.save_predictor(p, str(tmp_path / "p"), spark)
    q = model.load_predictor(spark, str(tmp_path / "p"))
    a, b = (model.predict(df, x).select("sample_id", "estimated_accuracy").orderBy("sample_id").collect() for x in (p, q))
    assert a == b and all(0 <= r.estimated_accuracy <= 1 for r in a)


def test_manifest_formats(spark, tmp_path):
    from trustline.sources import files

    (tmp_path / "a.json").write_text('[{"filename": "x.wav", "text": "hi"},\n {"filename": "y.wav", "text": "ho", "speaker_id": "s"}]')
    (tmp_path / "b.jsonl").write_text('{"utt_id": "u", "audio_path": "p", "reference": "r"}\n')
    (tmp_path / "c.csv").write_text('utt_id,audio_path,reference\nu,p,"a, b"\n')
    read = lambda n: files.read_manifest(spark, str(tmp_path / n))
    assert {r.filename for r in read("a.json").collect()} == {"x.wav", "y.wav"}
    assert read("b.jsonl").first().reference == "r" and read("c.csv").first().reference == "a, b"
