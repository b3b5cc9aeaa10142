"""Gradient-boosted regression trees with leaf budgets and l2, all settings of a grid side by side.

Features are cut into at most 255 bins once. In every pass over the rows, each partition sums gradients by bin for the nodes
that any setting needs next; the histograms meet by node, where the best split is taken, so the driver gets one small row a
node. Trees grow best first: the leaf of the largest gain is split until the budget is spent. Children of leaves that are
likely to be split are summed ahead, so a tree takes about as many passes as it is deep, whatever the number of settings.

Squared loss: leaves are -G / (n + l2). Absolute loss: gradients are signs, and leaves are medians of the residuals, told by
counts in bins of 1/4096. Ties between splits go to the first feature and the lowest cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import scratch_dir, stored

BINS = 255
# Rows' predictions are written anew after so many rounds; in between, the rounds' trees are walked again.
KEEP_EVERY = 5
RESIDUAL_BINS = 4096
# Passes are many and most of a short one is the start of its tasks: so many rows times settings are a task's.
TASK_ROWS, TASK_BYTES, TASK_LEAVES = 64_000, 16 << 20, 256
_NODE = 32


@dataclass
class Tree:
    """Nodes in numpy arrays; a leaf has feature -1 and its value, another node sends bins up to ``cut`` to the left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows, features)."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            f = self.feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            at = node[rows]
            node[rows] = np.where(bins[rows, f] <= self.cut[at], self.left[at], self.right[at])
        return node


@dataclass
class Boosted:
    """A sum of trees over binned features: ``edges`` are each feature's upper bounds of all bins but the last."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows of feature values."""
        bins, out = self.bins(x), np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaf_of(bins)]
        return out

    def rows(self) -> list[tuple]:
        """(tree, node, feature, cut, left, right, value) of all nodes."""
        each = lambda i, t: zip(*[[i] * len(t.value), range(len(t.value))], *(x.tolist() for x in (t.feature, t.cut, t.left, t.right, t.value)))
        return [r for i, t in enumerate(self.trees) for r in each(i, t)]

    @staticmethod
    def of(edges: list[list[float]], base: float, rows: list[tuple]) -> Boosted:
        trees: dict[int, list[tuple]] = {}
        for r in sorted(rows):
            trees.setdefault(r[0], []).append(tuple(r[2:]))
        kinds = (np.int64, np.int64, np.int64, np.int64, float)
        return Boosted([np.array(e, float) for e in edges], base, [Tree(*(np.array(c, k) for c, k in zip(zip(*t), kinds))) for t in trees.values()])


class Growing:
    """A tree that grows best first from what is known of its nodes: their sums, and the best split of each."""

    def __init__(self, leaves: int, least_rows: int = 1):
        self.leaves, self.least_rows, self.sums, self.split, self.children = leaves, least_rows, {}, {}, {}

    def learn(self, node: int, g: float, n: int, best: tuple[float, int, int, float, int] | None) -> None:
        """best is (gain, feature, cut, gradient and rows on the left), None if the node cannot be split."""
        self.sums[node], self.split[node] = (g, n), best
        if best is not None and node not in self.children:
            ids = (1 + 2 * len(self.children), 2 + 2 * len(self.children))
            self.children[node] = ids
            self.sums[ids[0]], self.sums[ids[1]] = (best[3], best[4]), (g - best[3], n - best[4])
            for child in ids:
                if self.sums[child][1] < 2 * self.least_rows:
                    self.split[child] = None

    def grown(self) -> tuple[list[int], list[int]]:
        """Nodes that are split so far, in order, and the nodes whose best splits must be known to go on (none: done)."""
        leaves, done = [0], []
        while len(leaves) < self.leaves:
            unknown = [x for x in leaves if x not in self.split]
            able = [x for x in leaves if self.split.get(x) is not None]
            if unknown:
                # Ahead of need: children of the leaves that may still be split.
                room = self.leaves - len(leaves)
                ahead = sorted(able, key=lambda x: (-self.split[x][0], x))[:room]
                return done, unknown + [c for x in ahead for c in self.children[x] if c not in self.split]
            if not able:
                break
            best = min(able, key=lambda x: (-self.split[x][0], x))
            leaves.remove(best)
            leaves += self.children[best]
            done.append(best)
        return done, []

    def tree(self, every: bool, value=None) -> Tree:
        """The grown tree, or with ``every`` the one in which each node that can be split is."""
        done = sorted(self.children) if every else self.grown()[0]
        number, todo = {0: 0}, [0]
        while todo:
            x = todo.pop(0)
            for c in self.children[x] if x in done else ():
                number[c] = len(number)
                todo.append(c)
        inner = lambda x: self.split[x] if x in done else None
        arrays = [[inner(x)[1] if inner(x) else -1 for x in number], [inner(x)[2] if inner(x) else 0 for x in number]]
        arrays += [[number[self.children[x][side]] if inner(x) else 0 for x in number] for side in (0, 1)]
        tree = Tree(*(np.array(a, np.int64) for a in arrays), np.zeros(len(number)))
        tree.names = np.array(list(number), np.int64)
        if value is not None:
            tree.value = np.array([0.0 if inner(x) else value(x) for x in number])
        return tree


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(n, -1)


def _edges(samples: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Bounds between bins: half way between neighbours where a feature has few values, else quantiles."""
    quantiles = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    told = samples.agg(*[F.struct(F.approx_count_distinct(f).alias("n"), F.percentile_approx(f, quantiles, 10_000).alias("q")).alias(f"f{i}") for i, f in enumerate(features)]).first()
    few = [i for i in range(len(features)) if told[i].n <= BINS]
    values = samples.agg(*[F.array_sort(F.collect_set(features[i])).alias(f"f{i}") for i in few]).first() if few else ()
    out = [np.unique(t.q or [0.0]) for t in told]
    for i, v in zip(few, values):
        if len(v) <= BINS + 1:
            out[i] = (np.array(v[1:]) + np.array(v[:-1])) / 2
    return out


def binned(samples: DataFrame, features: list[str], held: Column, models: int, base: float, edges: list[np.ndarray], tasks: int, target: str = "accuracy") -> DataFrame:
    """(bins binary, y, held, raw binary) in so many partitions: a byte for each feature and eight for each model's prediction; written once."""
    booster, start = Boosted(edges, base), np.full(models, base).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1) if b.num_rows else np.zeros((0, len(features)))
            if np.isnan(x).any():
                raise ValueError("a feature of a training sample is null")
            bins = booster.bins(x)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column("y"), b.column("held"), pa.array([start] * len(x), pa.binary())], names=["bins", "y", "held", "raw"])

    columns = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    return stored(samples.select(*columns, F.col(target).cast("double").alias("y"), held.alias("held")).mapInArrow(run, "bins binary, y double, held boolean, raw binary").repartition(tasks))


def _residuals(batch: pa.RecordBatch, models: int, since: list[list[Tree]], all_rows: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bins and y less prediction (rows, models) of the rows that are learned from."""
    bins, raw, y = _matrix(batch.column("bins"), np.uint8), _matrix(batch.column("raw"), np.float64), batch.column("y").to_numpy()
    if not all_rows:
        use = ~batch.column("held").to_numpy(zero_copy_only=False)
        bins, raw, y = bins[use], raw[use], y[use]
    raw = raw.copy()
    for m in range(models):
        for t in since[m]:
            raw[:, m] += t.value[t.leaf_of(bins)]
    return bins, y[:, None] - raw


def best_split(g: np.ndarray, n: np.ndarray, least_rows: int, l2: float) -> tuple[float, int, int, float, int] | None:
    """(gain, feature, cut, gradient and rows on the left) of the best split of a node's histogram (features, bins)."""
    all_g, all_n = g[0].sum(), n[0].sum()
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    right_g, right_n = all_g - left_g, all_n - left_n
    able = (left_n >= max(least_rows, 1)) & (right_n >= max(least_rows, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / (left_n + l2) + right_g**2 / (right_n + l2) - all_g**2 / (all_n + l2)
    gain = np.where(able, gain, -np.inf)
    # Sums in another order must not choose another of equal splits.
    top = gain.max(initial=-np.inf)
    if not top > 1e-10:
        return None
    f, cut = divmod(int(np.argmax(gain.ravel() >= top - 1e-9 * max(1.0, abs(top)))), gain.shape[1])
    return float(gain[f, cut]), f, cut, float(left_g[f, cut]), int(left_n[f, cut])


def _best_splits(rows: DataFrame, features: int, absolute: bool, all_rows: bool, settings: list[dict], since: list[list[Tree]], growing: list[Tree], wanted: list[list[int]]) -> list[tuple]:
    """(model, node, g, n, split) of all wanted nodes; one pass over the rows."""
    models, width = len(settings), features * (BINS + 1)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        shift = np.arange(features) * (BINS + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, residual = _residuals(batch, models, since, all_rows)
            for m in range(models):
                if not wanted[m]:
                    continue
                slot = np.full(int(growing[m].names.max()) + 1, -1)
                slot[wanted[m]] = np.arange(len(wanted[m]))
                # A wanted node may be inside the tree by now only as a leaf, so leaves tell all.
                at = slot[growing[m].names[growing[m].leaf_of(bins)]]
                rows_in = np.flatnonzero(at >= 0)
                index = (at[rows_in, None] * width + shift + bins[rows_in]).ravel()
                g = -np.sign(residual[rows_in, m]) if absolute else -residual[rows_in, m]
                both = np.stack([np.bincount(index, np.repeat(g, features), len(wanted[m]) * width), np.bincount(index, minlength=len(wanted[m]) * width)])
                for i, node in enumerate(wanted[m]):
                    key = m << _NODE | node
                    part = both[:, i * width : (i + 1) * width]
                    sums[key] = sums[key] + part if key in sums else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["key", "sums"])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(raw).reshape(2, features, BINS + 1)
                sums[key] = sums[key] + part if key in sums else part
        out = []
        for key, (g, n) in sums.items():
            s = settings[key >> _NODE]
            best = best_split(g, n, s["least_rows"], s["l2"])
            out.append((key, g[0].sum(), int(n[0].sum()), *(best or (None,) * 5)))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "g", "n", "gain", "feature", "cut", "left_g", "left_n"])

    # A task for each sixteen megabytes of a partition's histograms.
    tasks = -(-sum(map(len, wanted)) * width * 16 // TASK_BYTES)
    met = rows.mapInArrow(histograms, "key bigint, sums binary").repartition(tasks, "key")
    found = met.mapInArrow(splits, "key bigint, g double, n bigint, gain double, feature bigint, cut bigint, left_g double, left_n bigint").collect()
    told = [(r.key >> _NODE, r.key & ((1 << _NODE) - 1), r.g, r.n, tuple(r)[3:] if r.gain is not None else None) for r in found]
    seen = {(m, x) for m, x, *_ in told}
    # In one order, whichever task told first: later numbers of nodes follow from it.
    return sorted(told + [(m, x, 0.0, 0, None) for m in range(models) for x in wanted[m] if (m, x) not in seen], key=lambda t: t[:2])


def _medians(rows: DataFrame, all_rows: bool, since: list[list[Tree]], grown: list[Tree]) -> dict[tuple[int, int], float]:
    """Median residual of each leaf (by name) of each model, to 1/4096; one pass over the rows."""
    models, span = len(grown), 1 << 20

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, residual = _residuals(batch, models, since, all_rows)
            for m in range(models):
                leaf = grown[m].names[grown[m].leaf_of(bins)]
                place = np.clip(np.floor(residual[:, m] * RESIDUAL_BINS).astype(np.int64) + span // 2, 0, span - 1)
                at, inverse = np.unique(leaf * span + place, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m << _NODE | at // span), pa.array(at % span), pa.array(np.bincount(inverse)), pa.array(np.bincount(inverse, residual[:, m]))], names=["key", "place", "n", "total"]
                )

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A leaf has as many places as its residuals span, some thousands at most.
        parts = [[b.column(c).to_numpy() for c in ("key", "place", "n", "total")] for b in batches if b.num_rows]
        keys, medians = [], []
        if parts:
            key, place, n, total = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((place, key))
            key, place, n, total = key[order], place[order], n[order], total[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])))
            key, n, total = key[first], np.add.reduceat(n, first), np.add.reduceat(total, first)
            for a, z in zip(*(lambda c: (c, np.append(c[1:], len(key))))(np.flatnonzero(np.append(True, key[1:] != key[:-1])))):
                upto, mean = np.cumsum(n[a:z]), total[a:z] / n[a:z]
                middle = [mean[np.searchsorted(upto, rank)] for rank in ((upto[-1] + 1) // 2, upto[-1] // 2 + 1)]
                keys.append(int(key[a]))
                medians.append(float(sum(middle) / 2))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(medians, pa.float64())], names=["key", "median"])

    met = rows.mapInArrow(counted, "key bigint, place bigint, n bigint, total double").repartition(-(-sum(len(t.value) for t in grown) // TASK_LEAVES), "key")
    return {(r.key >> _NODE, r.key & ((1 << _NODE) - 1)): r.median for r in met.mapInArrow(halved, "key bigint, median double").collect()}


def boost(samples: DataFrame, features: list[str], settings: list[dict], rounds: int, loss: str = "mae", held: Column | None = None, target: str = "accuracy") -> list[tuple[Boosted, float, float]]:
    """A model for each setting ({step, leaves, least_rows, l2}) and its mean absolute and squared error on the held rows.

    Held rows are not learned from. All settings read the rows together, so sixteen take as many passes as one. Samples must
    have all features and a target; without a row to learn from there is no model to fit and an error is raised."""
    held = F.lit(False) if held is None else held
    absolute, models, spark = loss == "mae", len(settings), samples.sparkSession
    learned = samples.where(~held)
    base, n = learned.agg(F.percentile_approx(target, 0.5, 100_000) if absolute else F.avg(target), F.count("*")).first()
    if base is None:
        raise ValueError("no samples to learn from")
    edges = _edges(learned, features)
    rows = binned(samples, features, held, models, float(base), edges, -(-n * models // TASK_ROWS), target).persist()
    kept, since = [[] for _ in settings], [[] for _ in settings]
    for number in range(rounds):
        growing = [Growing(s["leaves"], s["least_rows"]) for s in settings]
        while any(wanted := [t.grown()[1] for t in growing]):
            for m, node, g, n, best in _best_splits(rows, len(features), absolute, False, settings, since, [t.tree(True) for t in growing], wanted):
                growing[m].learn(node, g, n, best)
        if absolute:
            medians = _medians(rows, False, since, [t.tree(False) for t in growing])
            value = lambda m: lambda x: settings[m]["step"] * medians.get((m, x), 0.0)
        else:
            value = lambda m: lambda x: -settings[m]["step"] * growing[m].sums[x][0] / max(growing[m].sums[x][1] + settings[m]["l2"], 1e-12)
        for m, t in enumerate(growing):
            since[m].append(t.tree(False, value(m)))
        if len(since[0]) == KEEP_EVERY and number + 1 < rounds:
            new = _predicted(rows, since).persist()
            rows.unpersist()
            kept, since, rows = [k + s for k, s in zip(kept, since)], [[] for _ in settings], new
    errors = _held_errors(rows, since)
    rows.unpersist()
    return [(Boosted(edges, float(base), kept[m] + since[m]), *errors.get(m, (float("inf"), float("inf")))) for m in range(models)]


def _predicted(rows: DataFrame, since: list[list[Tree]]) -> DataFrame:
    """rows with the trees since they were written added to their predictions; written, so lineage stays short."""
    models = len(since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, residual = _residuals(b, models, since, True)
                raw = b.column("y").to_numpy()[:, None] - residual
                yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), b.column("held"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["bins", "y", "held", "raw"])

    return stored(rows.mapInArrow(run, "bins binary, y double, held boolean, raw binary"))


def _held_errors(rows: DataFrame, since: list[list[Tree]]) -> dict[int, tuple[float, float]]:
    models = len(since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, residual = _residuals(b, models, since, True)
                residual = residual[b.column("held").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(models)), pa.array(np.abs(residual).sum(axis=0)), pa.array((residual**2).sum(axis=0)), pa.array([len(residual)] * models)], names=["model", "a", "s", "n"])

    sums = rows.mapInArrow(run, "model bigint, a double, s double, n bigint").groupBy("model").agg(F.sum("a").alias("a"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return {r.model: (r.a / r.n, r.s / r.n) for r in sums.where("n > 0").collect()}


def with_raw(df: DataFrame, booster: Boosted, features: list[str], out: str = "raw") -> DataFrame:
    """df with the model's prediction of each row; features must not be null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(booster.raw(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    return df.withColumn(out, F.pandas_udf(run, "double")(*[F.col(f"`{f}`").cast("double") for f in features]))
