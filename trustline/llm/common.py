"""Helpers that the operators of this subpackage share: Arrow batches, hashes, word shingles, lineage cuts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

T = TypeVar("T")
SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage: rows and their partitions are fixed from here on, whatever executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage through a Parquet table in the shared folder; later reads see only the columns they need."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; null ids hash as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)) % parts


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice hold about ``most`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if len(sizes) == 0:
        return
    bins = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts laid end to end, and where each starts (one more entry than texts); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def append_columns(
    df: DataFrame, column: str, fields: list[tuple[str, str]], compute: Callable[[pa.RecordBatch], list[pa.Array]], most: int = SLICE_BYTES
) -> DataFrame:
    """All columns of df, then ``fields`` computed from slices of its batches of about ``most`` bytes of text; a clashing name gives way to the new column."""
    names = {n.lower() for n, _ in fields}
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names or c == column])
    passed = [c for c in source.columns if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in passed), *compute(part)], names=[*passed, *(n for n, _ in fields)]
                )
        release_memory()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in passed), *(f"`{n}` {t}" for n, t in fields)])
    return source.mapInArrow(run, schema)


class Recent:
    """What strings stand for, made in batches and kept while it is met: strings that a whole generation has not met go.

    A generation ends when it holds ``most_bytes``, by ``size`` of strings and their values, so a worker keeps about twice that."""

    def __init__(self, make: Callable[[list[str]], Iterable], most_bytes: int, size: Callable[[list[str], list], int]):
        self.make, self.most, self.size, self.young, self.old, self.held = make, most_bytes, size, {}, {}, 0

    def of(self, strings: list[str]) -> list:
        """The values of distinct strings, in order; all that are new are made at once."""
        if self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        found = list(map(self.young.get, strings))
        new, met = [], []
        for row in [i for i, f in enumerate(found) if f is None]:
            if (kept := self.old.get(strings[row])) is not None:
                found[row] = self.young[strings[row]] = kept
                met.append(row)
            else:
                new.append(row)
        if new:
            for row, made in zip(new, self.make([strings[row] for row in new]), strict=True):
                found[row] = self.young[strings[row]] = made
        if met or new:
            met += new
            self.held += self.size([strings[row] for row in met], [found[row] for row in met])
        return found


def running_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` over all rows before this one in the order of ``order``, which no two rows share.

    Rows are dealt to ranges, numbered inside and shifted by the sums of the ranges before, of which there are as many as
    shuffle partitions; no task sees all rows. df is written to the shared folder."""
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = sorted(dealt.groupBy("__range").agg(F.sum(value)).collect())
    starts = [(r, int(sum(t for _, t in totals[:i]))) for i, (r, _) in enumerate(totals)]
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shifted = dealt.join(F.broadcast(df.sparkSession.createDataFrame(starts, "__range int, __start bigint")), "__range")
    return shifted.withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(before), F.lit(0))).drop("__range", "__start")


def release_memory() -> None:
    """Gives freed memory back to the system: workers live on from task to task and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task; only one thing is kept, what was kept under another name goes first."""
    if name not in _kept:
        keep_nothing()
        _kept[name] = make()
    return _kept[name]


def keep_nothing() -> None:
    """For tasks that need a worker's room for themselves: what earlier tasks of other operators left there goes."""
    if _kept:
        _kept.clear()
        release_memory()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (parts between ASCII white space) of the texts, and where each text's words start."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    black = data > 32
    before = np.empty(n, bool)
    before[0], before[1:] = False, black[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(black & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, black[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(black & ~after) + 1
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


_PLACES = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xA0761D6478BD642F], np.uint64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words of each text, in order with repeats, and where each text's runs start.

    A text of one to four words has one run, all its words; a text without words has none."""
    words, at = word_hashes(data, offsets)
    n = len(words)
    if n == 0:
        return words, np.zeros(len(offsets), np.int64)
    each = np.diff(at)
    end, first = np.repeat(at[1:], each), np.repeat(at[:-1], each)
    here = np.arange(n)
    total, padded = np.zeros(n, np.uint64), np.concatenate([words, np.zeros(SHINGLE_WORDS, np.uint64)])
    for j in range(SHINGLE_WORDS):
        total += padded[j : j + n] * _PLACES[j] * (here + j < end)
    valid = (here + SHINGLE_WORDS <= end) | ((here == first) & (end - first < SHINGLE_WORDS))
    counts = np.where(each >= SHINGLE_WORDS, each - SHINGLE_WORDS + 1, np.minimum(each, 1))
    return mix64(total[valid]), np.concatenate([[0], np.cumsum(counts)])
