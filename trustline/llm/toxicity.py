"""Toxicity from a weighted finite-state pattern grammar.

Words become tags: insult stems (a stem followed by any letters, learned from labelled texts and seeded by a short list),
threat verbs, targets, negations and verbs of reported speech. Small weighted transducers, one for each phenomenon, read a
clause's tags; their composition is built once as a table over product states. An insult scores its weight times the
weights of the arcs on its path: more with a target or a threat, little under negation or in reported speech. A threat
scores next to nothing by itself; the target that follows it scores. Arc weights start from a prior and are fitted, with
the logistic curve over a text's clause scores in sum and for its length, on a bounded labelled sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, keep_nothing, slices, stored
from .sampling import bounded_ids, with_texts

# A few words of each tag, in English, German, French and Spanish.
SEED_INSULTS = "idiot moron stupid worthless pathetic disgusting trash scum loser clown dummkopf arschloch abschaum crétin imbécile ordure imbécil estúpido basura".split()
THREATS = "kill hurt destroy beat töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your he she they him them du dich ihr euch sie tu vous toi ils tú te ustedes ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie pas jamais nunca ni".split()
REPORTS = "said says wrote quoted claimed sagte schrieb behauptete dit écrit affirmé dijo escribió afirmó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CLAUSE_END = re.compile(r"\n|[.?!] ").finditer
STEM_LENGTHS = range(4, 11)
# Texts of this score and more count as toxic.
TOXIC_FROM = 0.3
# The sample has a bounded number of rows, so it is written by so many tasks, however many read the documents.
SAMPLE_FILES = 8


# Prior weights of the arcs that have one; a sample moves them as far as it gives reason to.
ARCS = {"negated": 0.1, "reported": 0.4, "insulted target": 1.25, "target before threat": 10.0, "insult after threat": 1.25, "threat alone": 0.02, "threat on target": 1.0}
ARC_NAMES = list(ARCS)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, tag) -> (next state, arc); arcs are names in ARCS, None (weight 1) or "" (weight 0). A missing
    arc goes to ``rest[state]`` with None."""

    arcs: dict[tuple[int, int], tuple[int, str | None]]
    rest: dict[int, int]
    start: int = 0

    def step(self, state: int, tag: int) -> tuple[int, str | None]:
        return self.arcs.get((state, tag), (self.rest[state], None))


# State is the number of words for which the negation still holds; a negated threat leaves it as it is, for its target.
NEGATED = Transducer({**{(s, NEGATION): (3, None) for s in range(4)}, **{(s, t): (s - (t != THREAT), "negated") for s in range(1, 4) for t in (INSULT, THREAT, TARGET)}}, {0: 0, 1: 0, 2: 1, 3: 2})
REPORTED = Transducer({(0, REPORT): (1, None), **{(1, t): (1, "reported") for t in (INSULT, THREAT, TARGET)}}, {0: 0, 1: 1})
# A target before a threat ("ich werde dich töten") may be its subject, so it gives a fifth of what one after it gives.
TARGETED = Transducer({(0, TARGET): (1, None), (1, INSULT): (1, "insulted target"), (1, THREAT): (1, "target before threat")}, {0: 0, 1: 1})
# A threat counts once a target follows it within six words, on the target's arc: states 6 to 1 wait for it, 7 has given up.
_WAIT = {7: 7, 1: 7, **{s: s - 1 for s in range(2, 7)}}
THREATENED = Transducer(
    {
        **{(s, THREAT): (6, "threat alone") for s in range(8)}, **{(s, TARGET): (0, "threat on target") for s in range(1, 7)}, **{(s, TARGET): (s, "") for s in (0, 7)},
        **{(s, INSULT): (n, "insult after threat") for s, n in _WAIT.items()},
    },
    {0: 0, **_WAIT},
)


def compose(*machines: Transducer) -> list[list[tuple[int, frozenset[str]]]]:
    """The machines read in step: table[state][tag] -> (next state, names of the arcs taken) over reachable product states."""
    start = tuple(m.start for m in machines)
    number, table, todo = {start: 0}, [], [start]
    while todo:
        states = todo.pop(0)
        row = []
        for tag in range(6):
            moves = [m.step(s, tag) for m, s in zip(machines, states)]
            nxt = tuple(n for n, _ in moves)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append((number[nxt], frozenset(arc for _, arc in moves if arc is not None)))
        table.append(row)
    return table


GRAMMAR = compose(NEGATED, REPORTED, TARGETED, THREATENED)
# The sets of arcs that a scoring word can take together, and which arcs each of them has.
SCORING = (INSULT, THREAT, TARGET)
PATHS = sorted({row[tag][1] for row in GRAMMAR for tag in SCORING if "" not in row[tag][1]}, key=sorted)
PATH_ARCS = np.array([[name in path for name in ARC_NAMES] for path in PATHS], float)


@dataclass
class Toxicity:
    """Insult stems with weights, the arcs' weights, and the logistic curve over a text's features."""

    stems: dict[str, float]
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 1.0]))
    arcs: dict[str, float] = field(default_factory=lambda: dict(ARCS))

    def __post_init__(self) -> None:
        # One expression finds every place where a tagged word that can score begins; longer stems are tried first.
        stems = sorted(self.stems, key=lambda s: (-len(s), s))
        self._find = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, [*stems, *THREATS])) + ")").search
        self._finditer = re.compile(r"(?<![^\W_])(?:(" + "|".join(map(re.escape, stems)) + ")|(?:" + "|".join(map(re.escape, THREATS)) + r")(?![^\W_]))").finditer
        self._stem = re.compile("(?:" + "|".join(map(re.escape, stems)) + ")").match
        self._tags = {w: t for t, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        number = {path: i for i, path in enumerate(PATHS)}
        self._table = [[(nxt, number.get(path, -1) if tag in SCORING else -1) for tag, (nxt, path) in enumerate(row)] for row in GRAMMAR]
        self._factors = np.exp(PATH_ARCS @ np.log([self.arcs[a] for a in ARC_NAMES]))

    def __getstate__(self) -> dict:
        return {"stems": self.stems, "curve": self.curve, "arcs": self.arcs}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def add_clause(self, text: str, paths: np.ndarray) -> None:
        """Adds the weights of one clause's scoring words to ``paths``, by the path that the composed machine reads them on."""
        state = 0
        for word in _WORD.findall(text):
            tag = self._tags.get(word, OTHER)
            weight = 1.0
            if tag == OTHER and (m := self._stem(word)):
                tag, weight = INSULT, self.stems[m[0]]
            state, path = self._table[state][tag]
            if path >= 0:
                paths[path] += weight

    def clause(self, text: str) -> float:
        """Score of one clause."""
        paths = np.zeros(len(PATHS))
        self.add_clause(text, paths)
        return float(paths @ self._factors)

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses in which something matches, in order; text is in lower case, and is gone through once."""
        # Reported speech and negation reach over a comma, so a clause ends at a line or sentence end.
        ends = _CLAUSE_END(text)
        before, after, done = -1, next(ends, None), -1
        for m in self._finditer(text):
            if m.start() < done:
                continue
            while after is not None and after.start() < m.start():
                before, after = after.start(), next(ends, None)
            done = after.start() if after is not None else len(text)
            yield text[before + 1 : done]

    def paths(self, text: str) -> np.ndarray:
        """Weights of a whole text's scoring words, by path."""
        paths, low = np.zeros(len(PATHS)), text.lower()
        if self._find(low):
            for clause in self.clauses(low):
                self.add_clause(clause, paths)
        return paths

    def score(self, paths: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Of texts with these path weights (texts, paths) and lengths."""
        return 1 / (1 + np.exp(-_features(paths @ self._factors, chars) @ self.curve))


def _features(total: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.sqrt(1000 * total / (chars + 200))], axis=1)


def _stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, toxic, clean): in how many sampled texts of each kind some word begins so; one row a stem and task slice first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                counts = (Counter(), Counter())
                for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                    words = {w for w in set(_WORD.findall(text.lower())) if len(w) >= STEM_LENGTHS[0]}
                    counts[y].update({w[:k] for w in words for k in STEM_LENGTHS if k <= len(w)})
                stems = list({*counts[0], *counts[1]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stems, pa.string()), pa.array([counts[1][s] for s in stems], pa.int64()), pa.array([counts[0][s] for s in stems], pa.int64())],
                    names=["stem", "toxic", "clean"],
                )

    return rows.select("text", "y").mapInArrow(run, "stem string, toxic bigint, clean bigint").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_stems(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems far more frequent in toxic texts, as specific as their support allows, with log-odds of 1 to 8 scaled to at most 1."""
    by = {s: (p, n) for s, p, n in counts}
    # A stem gives way to one a letter longer that keeps nearly all of its toxic texts.
    longer: dict[str, int] = {}
    for s, (p, _) in by.items():
        longer[s[:-1]] = max(longer.get(s[:-1], 0), p)
    specific = [s for s, (p, _) in by.items() if longer.get(s, 0) < 0.9 * p]
    chosen: dict[str, float] = {}
    for s in sorted(specific, key=lambda s: (len(s), s)):
        if not any(s[:k] in chosen for k in range(STEM_LENGTHS[0], len(s))):
            p, n = by[s]
            odds = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
            chosen[s] = min(1.0, odds / 4)
    return chosen


def stems_of_texts(rows: DataFrame, stems: list[str]) -> list[list[int]]:
    """Of each text in which a word begins with one of the stems, the numbers of those stems; texts stay on the executors."""
    number = {s: i for i, s in enumerate(stems)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [sorted({number[w[:k]] for w in set(_WORD.findall(t.lower())) for k in STEM_LENGTHS if w[:k] in number}) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([f for f in found if f], pa.list_(pa.int32()))], names=["found"])

    return rows.select("text").mapInArrow(run, "found array<int>").toArrow().column("found").to_pylist()


def explaining(stems: dict[str, float], found_in: list[list[int]], texts: int, common: float = 0.02) -> dict[str, float]:
    """Stems that are in a share ``common`` of the toxic texts, or explain texts that more frequent stems leave unexplained.

    found_in has the numbers of the stems of each text. Rare words of toxic texts that were copied are frequent too, but
    come with stems that explain their texts already."""
    found: dict[str, set[int]] = {s: set() for s in stems}
    names = list(stems)
    for i, numbers in enumerate(found_in):
        for n in numbers:
            found[names[n]].add(i)
    kept, explained = {}, set()
    for s in sorted(found, key=lambda s: (-len(found[s]), s)):
        new = found[s] - explained
        if len(found[s]) >= common * texts or len(new) >= max(3, len(found[s]) / 2):
            kept[s] = stems[s]
            explained |= found[s]
    return kept


def sampled_paths(rows: DataFrame, model: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path weights, characters, label) of each text of rows (doc_id, y, text), in an order that no partitioning changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                paths = pa.array([model.paths(t).tolist() for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([paths, pa.array(list(map(len, texts)), pa.int64()), batch.column("y"), batch.column("of")], names=["paths", "chars", "y", "of"])

    made = rows.select("text", "y", F.xxhash64("text", "doc_id").alias("of")).mapInArrow(run, "paths array<double>, chars bigint, y int, of bigint").toArrow()
    made = made.sort_by([("of", "ascending"), ("y", "ascending")])
    paths = pc.list_flatten(made.column("paths")).to_numpy().reshape(-1, len(PATHS))
    return paths, made.column("chars").to_numpy().astype(float), made.column("y").to_numpy().astype(float)


def fit_weights(model: Toxicity, paths: np.ndarray, chars: np.ndarray, y: np.ndarray, rounds: int = 600, pull: float = 0.02, ridge: float = 1e-4) -> None:
    """Sets the model's arc weights and curve: Adam on the log-likelihood of the labels, with arcs drawn to their priors.

    An arc on which no text of the sample has a word keeps its prior."""
    prior = np.log([ARCS[a] for a in ARC_NAMES])
    w = [model.curve.copy(), prior.copy()]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in w]
    for step in range(1, rounds + 1):
        factors = np.exp(PATH_ARCS @ w[1])
        total = paths @ factors
        x = _features(total, chars)
        r = (1 / (1 + np.exp(-np.clip(x @ w[0], -30, 30))) - y) / len(y)
        by_total = r * (w[0][1] / (1 + total) + w[0][2] * np.sqrt(1000 / (chars + 200)) * 0.5 / np.sqrt(np.maximum(total, 1e-6)) * (total > 0))
        grads = [x.T @ r + ridge * np.array([0, *w[0][1:]]), ((by_total @ paths) * factors) @ PATH_ARCS + pull * (w[1] - prior) / len(ARC_NAMES)]
        for v, (m, s), g in zip(w, moments, grads):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    model.curve, model.arcs = w[0], dict(zip(ARC_NAMES, np.exp(w[1]).tolist()))
    model.__post_init__()


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 3000, most_stems: int = 20_000, label_col: str = "toxic") -> Toxicity:
    """Stems, arc weights and curve from at most ``per_class`` labelled texts of each kind where ``may_learn``; without both
    kinds, the seeds and priors.

    Texts stay on the executors; the driver gets counts of at most ``most_stems`` stems (the most frequent of those that pass
    the test), the stems of each toxic text, and each text's path weights."""
    seeds = {s: 1.0 for s in SEED_INSULTS}
    ids = bounded_ids(labels.where(may_learn).select("doc_id", F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)"), per_class, 2 * per_class)
    rows = stored(with_texts(docs, ids).repartition(SAMPLE_FILES))
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Toxicity(seeds)
    toxic, clean = sizes[1], sizes[0]
    # As improbable as seven toxic texts in a row where one in eight is toxic: no chance finding among many stems.
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    found = (
        _stem_counts(rows)
        .where((F.col("toxic") * math.log((toxic + clean) / toxic) - F.col("clean") * 1.0 >= 14) & (ratio >= 12))
        .orderBy(F.desc("toxic"), "stem")
        .limit(most_stems)
        .collect()
    )
    learned = choose_stems([(r.stem, r.toxic, r.clean) for r in found], toxic, clean)
    model = Toxicity(seeds | explaining(learned, stems_of_texts(rows.where("y = 1"), list(learned)), toxic))
    fit_weights(model, *sampled_paths(rows, model))
    return model


def score_toxicity(df: DataFrame, model: Toxicity, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with ``score`` double in 0 to 1, the curve's value for the text's matched clauses.

    Null and empty texts score as texts in which nothing matches. Whole texts are read; a very long text takes no more
    memory than itself in lower case. Repeated rows and other columns pass through; a column named like the new one gives
    way; no rows in, none out.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        keep_nothing()
        texts = [t or "" for t in batch.column(text_col).to_pylist()]
        paths = np.array([model.paths(t) for t in texts]).reshape(-1, len(PATHS))
        return [pa.array(model.score(paths, np.array([len(t) for t in texts], float)), pa.float64())]

    return append_columns(df, text_col, [(score_col, "double")], compute)
