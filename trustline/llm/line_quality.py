"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are counts of its bytes and words, and those of the lines before and after
it; the chain adds weights for what follows what. The field is fitted to labelled documents, whose lines carry the
document's label, and a document's quality is the mean of its lines' forward-backward marginals weighted by length,
passed through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, release_memory, slices, text_bytes, word_hashes
from .sampling import bounded_ids, with_texts

FEATURES = 13
_KINDS = np.zeros((256, 6), np.uint8)
_KINDS[ord("a") : ord("z") + 1, 0] = 1
_KINDS[128:, 0] = 1  # letters beyond ASCII, and their parts
_KINDS[ord("A") : ord("Z") + 1, 1] = 1
_KINDS[ord("0") : ord("9") + 1, 2] = 1
for _c in b".,;:'\"-()?":
    _KINDS[_c, 3] = 1
for _c in b"!|#$%&*@<>{}[]=+_~^/\\":
    _KINDS[_c, 4] = 1
for _c in b" \t\r":
    _KINDS[_c, 5] = 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of every line, its text, its length) for lines that are not blank; lines end at line breaks."""
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(data))
    text = np.searchsorted(offsets, starts, side="right") - 1
    kinds = np.stack([np.add.reduceat(_KINDS[:, k][data], starts, dtype=np.int64) for k in range(6)], axis=1).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    bounds = np.append(starts, len(data))
    words, at = word_hashes(data, bounds)
    each = np.diff(at).astype(np.float64)
    # Words like the word before, or the word before that, in the same line.
    line = np.repeat(np.arange(len(starts)), np.diff(at))
    same, second = np.zeros(len(words)), np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    second[2:] = (words[2:] == words[:-2]) & (line[2:] == line[:-2])
    again = np.bincount(line, same, len(starts))
    again2 = np.bincount(line, second, len(starts))
    n, w = np.maximum(length, 1), np.maximum(each, 1)
    last = data[np.maximum(ends - 1 - (data[ends - 1] == 10), starts)]
    x = np.stack(
        [
            np.minimum(kinds[:, 0] / n, 1), np.sqrt(kinds[:, 1] / n), np.sqrt(kinds[:, 2] / n), np.sqrt(kinds[:, 3] / n),
            np.sqrt(kinds[:, 4] / n), kinds[:, 5] / n, again / w, again2 / w, np.log1p(each) / 5, np.minimum(n / w, 20) / 10,
            (last == ord(".")).astype(float), np.minimum(kinds[:, 4] / w, 4), np.ones(len(starts)),
        ],
        axis=1,
    )
    kept = each > 0
    return x[kept].astype(np.float32), text[kept], (ends - starts)[kept]


def with_neighbours(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A line's features, then those of the line before and after in the same text (zeros beyond the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        joined = (text[1:] == text[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * joined, x[1:] * joined
    return np.concatenate([x, before, after], axis=1)


def _chains(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text that has lines, longest first."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(first, len(text)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def marginals(scores: np.ndarray, text: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for all texts at once: P(good) of every line, expected counts of what follows what, log Z.

    scores (lines, 2) are of bad and good; chain (2, 2) of a line's label given the label before."""
    n = len(scores)
    if n == 0:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first, size = _chains(text)
    top = scores.max(axis=1, keepdims=True)
    local, step = np.exp(scores - top), np.exp(chain)
    ahead, behind, norm = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
    longest = size[0]
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more lines than t
    for t in range(longest):
        rows = first[: live[t]] + t
        a = local[rows] if t == 0 else (ahead[rows - 1] @ step) * local[rows]
        norm[rows] = a.sum(axis=1)
        ahead[rows] = a / norm[rows][:, None]
    for t in range(longest - 2, -1, -1):
        rows = first[: live[t + 1]] + t
        behind[rows] = ((local[rows + 1] * behind[rows + 1]) @ step.T) / norm[rows + 1][:, None]
    p = ahead * behind
    p /= p.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(text[1:] == text[:-1])
    pairs = ahead[inner][:, :, None] * step * (local[inner + 1] * behind[inner + 1] / norm[inner + 1][:, None])[:, None, :]
    return p[:, 1], pairs.sum(axis=0), float(np.log(norm).sum() + top.sum())


@dataclass
class LineField:
    """weights (3 x FEATURES) for good against bad, chain (2, 2), and the logistic curve's slope and offset."""

    weights: np.ndarray
    chain: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def documents(self, x: np.ndarray, text: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; texts without lines have 0."""
        z = with_neighbours(x, text) @ self.weights
        good, _, _ = marginals(np.stack([-z / 2, z / 2], axis=1).astype(np.float64), text, self.chain)
        return np.bincount(text, good * length, n) / np.maximum(np.bincount(text, length, n), 1)

    def curve(self, mean: np.ndarray) -> np.ndarray:
        m = np.clip(mean, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(m / (1 - m)) + self.offset)))


def fit(x: np.ndarray, text: np.ndarray, length: np.ndarray, label: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> LineField:
    """Adam on the conditional log-likelihood of the lines' labels; label is of texts 0, 1, ..."""
    wide, y = with_neighbours(x, text).astype(np.float64), label[text]
    field = LineField(np.zeros(wide.shape[1]), np.zeros((2, 2)))
    inner = text[1:] == text[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.weights, field.chain)]
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for step in range(1, rounds + 1):
        z = wide @ field.weights
        good, pairs, _ = marginals(np.stack([-z / 2, z / 2], axis=1), text, field.chain)
        grads = [wide.T @ ((good - y) * share) + ridge * field.weights, (pairs - seen) / max(seen.sum(), 1) + 0.02 * field.chain]
        for w, m, g in zip((field.weights, field.chain), moments, grads):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            w -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
    n = len(label)
    mean = np.clip(field.documents(x, text, length, n), 1e-4, 1 - 1e-4)
    s, used = np.log(mean / (1 - mean)), np.isin(np.arange(n), text)
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton's method, slightly damped
        p = 1 / (1 + np.exp(-(a * s + b)))
        r, h = (p - label) * used, p * (1 - p) * used + 1e-6
        g = np.array([(r * s).sum() + 0.5 * (a - 1), r.sum() + 0.01 * b])
        hess = np.array([[(h * s * s).sum() + 0.5, (h * s).sum()], [(h * s).sum(), h.sum() + 0.01]])
        d = np.linalg.solve(hess, g)
        a, b = a - 0.7 * d[0], b - 0.7 * d[1]
    field.slope, field.offset = max(float(a), 0.05), float(b)
    return field


def sampled_lines(rows: DataFrame, most_lines: int) -> DataFrame:
    """(doc_id, y, of, x array<float>, length) of rows (doc_id, y, text): a line's features; ``of`` tells texts of an id apart.

    A text of over ``most_lines`` lines gives a run of so many, which begins at a place drawn by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x, text, length = line_features(*text_bytes(batch.column("text")))
                size = np.bincount(text, minlength=batch.num_rows)
                number = np.arange(len(text)) - (np.cumsum(size) - size)[text]
                of = batch.column("of").to_numpy()
                first = (of.astype(np.uint64) % np.maximum(size - most_lines + 1, 1).astype(np.uint64)).astype(np.int64)
                kept = (number >= first[text]) & (number < first[text] + most_lines)
                rows_of = pa.array(text[kept])
                features = pa.FixedSizeListArray.from_arrays(pa.array(x[kept].reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows_of) for c in ("doc_id", "y", "of")), pa.array(number[kept]), features, pa.array(length[kept])],
                    names=["doc_id", "y", "of", "line", "x", "length"],
                )
        release_memory()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "y", "text", F.xxhash64("text").alias("of")).mapInArrow(run, f"doc_id {kind}, y int, of bigint, line bigint, x array<float>, length bigint")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 2000, most_lines: int = 200, label_col: str = "quality") -> LineField | None:
    """A field fitted to at most ``per_class`` labelled texts of each quality where ``may_learn``; None without both kinds.

    Texts stay on the executors; the driver gets the features of at most ``most_lines`` lines of each. Repeated rows count once."""
    ids = bounded_ids(labels.where(may_learn).select("doc_id", F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)"), per_class, 2 * per_class)
    lines = sampled_lines(with_texts(docs, ids).dropDuplicates(["doc_id", "y", "text"]), most_lines).toArrow().sort_by([(c, "ascending") for c in ("doc_id", "y", "of", "line")])
    y, of = lines.column("y").to_numpy(), lines.column("of").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = pc.list_flatten(lines.column("x")).to_numpy().reshape(-1, FEATURES)
    doc = lines.column("doc_id").to_numpy()
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (y[1:] != y[:-1])])
    return fit(x, np.cumsum(new) - 1, lines.column("length").to_numpy(), y[new])


def score_quality(df: DataFrame, field: LineField | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with ``score`` double in 0 to 1, higher for better texts.

    Texts that are null or have no line with a word score 0; without a field all others score 0.5. Whole texts are read;
    a very long text takes memory in proportion to its lines. Repeated rows and other columns pass through; a column named
    like the new one gives way; no rows in, none out.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        x, text, length = line_features(*text_bytes(batch.column(text_col)))
        used = np.isin(np.arange(n), text)
        p = field.curve(field.documents(x, text, length, n)) if field is not None else np.full(n, 0.5)
        return [pa.array(np.where(used, p, 0.0), pa.float64())]

    return append_columns(df, text_col, [(score_col, "double")], compute)
