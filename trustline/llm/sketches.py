"""Document fingerprints: the k smallest hashes of a text's five-word shingles.

A bottom-k sketch is a uniform sample of the distinct shingles, so two of them estimate resemblance and containment, one of
them the number of distinct shingles, and the sketch of texts laid together is the k smallest of their sketches' hashes.
A fingerprint is its sketch's hashes in order, 48 bits each, in base64: eight characters a hash.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, append_columns, shingle_hashes, slices, stored, text_bytes

K = 128
RANGE_BYTES = 16 << 20
# Beyond so many ranges, ranges grow with the table: their marks are 160 KB at most.
MOST_RANGES = 20_000
_BITS = 48


def bottom_k(hashes: np.ndarray, starts: np.ndarray, k: int = K) -> list[np.ndarray]:
    """The k smallest distinct 48-bit hashes of each text, in order."""
    hashes = hashes >> np.uint64(64 - _BITS)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own, n = hashes[a:b], b - a
        if n > 4 * k:
            # Nearly always enough lie under this mark; if repeats leave too few, all are sorted.
            low = np.unique(own[own < np.uint64(int((2.0**_BITS) * min(1.0, 2.2 * k / n)))])
            own = low if len(low) >= k else own
        out.append(np.unique(own)[:k])
    return out


def fingerprint(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def sketch_of(text: str) -> np.ndarray:
    """The sketch that a fingerprint stands for."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, _BITS // 8)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of all parts together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0**_BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; of two empty sketches 1, of an empty and another 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * distinct(merge(a, b, k=k), k) / max(distinct(a, k), 1.0))


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with its texts' fingerprints; null and empty texts have the empty one. Other columns pass through."""
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        hashes, starts = shingle_hashes(*text_bytes(batch.column(text_col)))
        return [pa.array([fingerprint(s) for s in bottom_k(hashes, starts)], pa.string())]

    return append_columns(df, text_col, [(out_col, "string")], compute)


def edited_fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """For docs (doc_id, text): fingerprints of each text and of its edited text, and their likenesses.

    The edited text is the text with its last floor(n / 2) code points replaced by as many first ones of the next document
    in ascending doc_id (after the last comes the first). Null texts are empty; null ids come first; rows with the same id
    follow each other in the order of their texts; a single document is its own next; no rows in, none out. Texts are
    exchanged once, by ranges of ids of about RANGE_BYTES of text each, unless ``partitions`` says how many, and of more where
    that would be over MOST_RANGES; they stream through a range. A range's first text is also sent to the range before. docs are read three times (their bytes, their ids, their texts) and must be the
    same rows each time; otherwise an error is raised.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not whole["rows"]:
        return _compared(docs.withColumn("part", F.lit(0)).withColumn("lent", F.lit(0)))
    wanted = min(MOST_RANGES, partitions or max(1, math.ceil(whole["bytes"] / RANGE_BYTES)))
    # Every mark is some document's id, so a range's first text is known when it is read. The marks, eight bytes a range, are
    # one row of a table; in runs, so that a row compares with few of them.
    coarse = max(1, int(wanted**0.5))
    ranges = docs.select("key").repartitionByRange(wanted, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("mark"))
    marks = stored(ranges.agg(F.array_sort(F.collect_list("mark")).alias("all")).select(
        F.lit(0).alias("one"), F.size("all").alias("parts"), F.expr(f"transform(sequence(1, size(all), {coarse}), i -> slice(all, i, {coarse}))").alias("marks")
    ))
    run = F.greatest(F.lit(0), F.size(F.filter("marks", lambda m: m[0] <= F.col("key"))) - 1)
    placed = docs.withColumn("one", F.lit(0)).join(F.broadcast(marks), "one").withColumn("run", run).withColumn("near", F.get("marks", F.col("run")))
    placed = placed.withColumn("part", (F.col("run") * coarse + F.size(F.filter("near", lambda m: m <= F.col("key"))) - 1).cast("int")).withColumn("first", F.array_contains("near", F.col("key")))
    home = F.struct(F.col("part"), F.lit(0).alias("lent"))
    away = F.struct(F.pmod(F.col("part") - 1, F.col("parts")).cast("int").alias("part"), F.lit(1).alias("lent"))
    sent = placed.withColumn("to", F.explode(F.when(F.col("first"), F.array(home, away)).otherwise(F.array(home)))).select("key", "doc_id", "text", "to.part", "to.lent")
    # A range is a task: dealt by hash, several would meet in one.
    return _compared(sent.repartitionById(wanted, "part").sortWithinPartitions("part", "lent", "key", "text"))


def _compared(rows: DataFrame) -> DataFrame:
    """rows by range, own texts in order and then lent ones, of which the first is the next of the range's last."""

    def finish(batch: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
        """batch and nexts: (doc_id, text, ...) of documents and of the documents after them."""
        ids, texts, after = [b[0] for b in batch], [b[1] for b in batch], [n[1] for n in nexts]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
        own = bottom_k(*shingle_hashes(*text_bytes(pa.array([*texts, after[-1]], pa.string()))))
        new = bottom_k(*shingle_hashes(*text_bytes(pa.array(edited, pa.string()))))
        # The next document is mostly the one that follows in the batch.
        following = [*own[1:-1], own[-1]]
        for i in range(len(batch) - 1):
            if after[i] is not texts[i + 1]:
                following[i] = bottom_k(*shingle_hashes(*text_bytes(pa.array([after[i]], pa.string()))))[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([fingerprint(s) for s in own[:-1]], pa.string()), pa.array([fingerprint(s) for s in new], pa.string()),
                pa.array([resemblance(a, b) for a, b in zip(own, new)], pa.float64()),
                pa.array([resemblance(a, b) for a, b in zip(own, following)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (doc_id, text, part, index) of documents whose next is not known yet
        ready: list[tuple] = []
        size = 0
        lent_to = None
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text, part, lent in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "lent"))):
                    if lent:
                        if lent_to != part:  # only the first lent text is anyone's next
                            lent_to = part
                            if waiting and waiting[0][2] == part:
                                ready.append((waiting.pop(), (doc_id, text)))
                        continue
                    row = (doc_id, text, part)
                    if waiting and waiting[0][2] != part:
                        raise RuntimeError("the documents changed between two reads")
                    if waiting:
                        ready.append((waiting.pop(), row))
                    waiting.append(row)
                    size += len(text)
                    if size > SLICE_BYTES:
                        if ready:
                            yield finish([r for r, _ in ready], [n for _, n in ready])
                        ready, size = [], 0
        if waiting:
            raise RuntimeError("the documents changed between two reads")
        if ready:
            yield finish([r for r, _ in ready], [n for _, n in ready])

    return rows.select("doc_id", "text", "part", "lent").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
