"""Language identification with a byte convolutional network.

A text's UTF-8 bytes are cut into windows of a fixed length that overlap by the widest filter less one, so every run of
bytes is inside some window. Bytes are embedded, filters of several widths slide over them, the largest response of each
filter in a window goes through a softmax, and a text's probabilities are its windows' mean, weighted by their bytes.
The network is trained in numpy on windows of a bounded sample of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, keep_nothing, text_bytes
from .sampling import bounded_ids, with_texts

WINDOW = 256
WIDTHS = (2, 3, 5)
STRIDE = WINDOW - max(WIDTHS) + 1
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """embed (256, d), filters (widest * d, f) zero beyond each filter's width, bias (f), dense (f, classes), offset (classes)."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(n, places, widest * d) of windows (n, WINDOW) of bytes."""
        x = self.embed[windows]
        n, length, d = x.shape
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, STRIDE, max(WIDTHS) * d), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window, at least zero."""
        x = self.patches(windows)
        y = x.reshape(-1, x.shape[2]) @ self.filters
        return np.maximum(y.reshape(x.shape[0], STRIDE, -1).max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray, chunk: int = 96) -> np.ndarray:
        if not len(windows):
            return np.zeros((0, len(self.languages)), np.float32)
        z = np.concatenate([self.pooled(windows[i : i + chunk]) for i in range(0, len(windows), chunk)]) @ self.dense + self.offset
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of windows, and its gradients by embed (not of byte 0), filters (where mask is 1), bias, dense and offset."""
        n, f, wide, dims = len(windows), len(self.bias), max(WIDTHS), self.embed.shape[1]
        x = self.patches(windows)
        y = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(n, STRIDE, f)
        best = y.argmax(axis=1)
        raw = np.take_along_axis(y, best[:, None, :], 1)[:, 0] + self.bias
        h = np.maximum(raw, 0)
        z = h @ self.dense + self.offset
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -float(np.log(np.maximum(p[np.arange(n), labels], 1e-30)).mean())
        p[np.arange(n), labels] -= 1
        p /= n
        dh = (p @ self.dense.T) * (raw > 0)
        # The pool passes the gradient to one place a filter and window.
        at = x[np.arange(n)[:, None], best]
        d_filters = np.einsum("bfk,bf->kf", at, dh) * mask
        d_embed = np.zeros_like(self.embed)
        back = (dh[:, :, None] * self.filters.T[None]).reshape(n, f, wide, dims)
        np.add.at(d_embed, windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(wide)], back)
        d_embed[0] = 0
        return loss, [d_embed, d_filters, dh.sum(0), h.T @ p, p.sum(0)]


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, WINDOW) of all texts, the text of each, and its bytes; the last window of a text is padded with zeros."""
    sizes = np.diff(offsets)
    each = np.where(sizes > 0, np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    starts = offsets[text] + number * STRIDE
    length = np.minimum(WINDOW, offsets[text + 1] - starts)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts] if len(starts) else np.zeros((0, WINDOW), np.uint8)
    windows = np.where(np.arange(WINDOW) < length[:, None], windows, 0).astype(np.uint8)
    return windows, text, length


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], dims: int = 8, per_width: int = 8, epochs: int = 14, seed: int = 0) -> ByteNet:
    """Adam on the cross-entropy of windows; some windows are cut short, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    f, wide = per_width * len(WIDTHS), max(WIDTHS)
    mask = np.zeros((wide * dims, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * dims, i * per_width : (i + 1) * per_width] = 1
    net = ByteNet(
        languages,
        rng.normal(0, 0.5, (256, dims)).astype(np.float32),
        (rng.normal(0, 0.25, (wide * dims, f)) * mask).astype(np.float32),
        np.zeros(f, np.float32),
        rng.normal(0, 0.3, (f, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    net.embed[0] = 0
    weights = [net.embed, net.filters, net.bias, net.dense, net.offset]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step, batch = 0, 64
    for epoch in range(epochs):
        rate = 0.006 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            x_bytes = windows[rows].copy()
            cut = rng.random(len(rows)) < 0.5
            keep = np.where(cut, np.exp(rng.uniform(np.log(6), np.log(WINDOW), len(rows))).astype(int), WINDOW)
            x_bytes[np.arange(WINDOW) >= keep[:, None]] = 0
            _, grads = net.gradients(x_bytes, labels[rows], mask)
            step += 1
            for w, (m, v), g in zip(weights, moments, grads):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, may_learn: Column, per_language: int = 1200, windows_per_text: int = 3, most_texts: int = 100_000, lang_col: str = "lang", text_col: str = "text") -> ByteNet | None:
    """A network for the non-null languages of rows where ``may_learn``; None if there are none.

    Fitted on ``windows_per_text`` windows, at places chosen by hash, of at most ``per_language`` texts of each language, and
    ``most_texts`` in all: the more languages there are, the fewer texts of each; all are learned."""
    ids = bounded_ids(docs.where(may_learn).select("doc_id", F.col(f"`{lang_col}`").cast("string").alias("y")), per_language, most_texts)
    place = F.pmod(F.xxhash64("doc_id", "i"), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))
    rows = (
        with_texts(docs, ids, text_col)
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(windows_per_text))))
        .select("doc_id", "i", "y", F.substring("text", (place + 1).cast("int"), F.lit(WINDOW)).alias("piece"))
        .orderBy("doc_id", "i", "y", "piece")
        .toPandas()
    )
    if not len(rows):
        return None
    languages = sorted(set(rows["y"]))
    data, offsets = text_bytes(pa.array(rows["piece"], pa.string()))
    windows, text, _ = cut_windows(data, offsets)
    first = np.concatenate([[True], np.diff(text) > 0])  # a piece of wide characters has more bytes than one window
    labels = np.array([languages.index(y) for y in rows["y"]])
    return fit(windows[first], labels[text[first]], languages)


def classify(df: DataFrame, net: ByteNet | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with ``lang_pred`` string and ``score`` double, the probability of that language.

    Texts that are null or have no letter are ``und`` with score 0, as is everything without a network. Whole texts are
    read, in windows, so a very long text takes no more memory than its bytes. Repeated rows and other columns pass
    through; columns named like a new one give way; no rows in, none out.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        keep_nothing()
        texts = batch.column(text_col)
        n = len(texts)
        spoken = np.fromiter((next(filter(str.isalpha, t or ""), None) is not None for t in texts.to_pylist()), bool, n)
        if net is None or not spoken.any():
            return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n), pa.float64())]
        windows, text, length = cut_windows(*text_bytes(texts))
        p = net.probabilities(windows).astype(np.float64) * length[:, None]
        total = np.zeros((n, len(net.languages)))
        np.add.at(total, text, p)
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        best = total.argmax(axis=1)
        names = [net.languages[b] if s else UNDETERMINED for b, s in zip(best, spoken)]
        return [pa.array(names, pa.string()), pa.array(np.where(spoken, total.max(axis=1), 0.0), pa.float64())]

    return append_columns(df, text_col, [(lang_col, "string"), (score_col, "double")], compute)
