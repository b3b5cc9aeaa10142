"""Token counts of a unigram vocabulary without the tokens: count-only Viterbi.

An Aho-Corasick automaton of the vocabulary lists all pieces that end at each place; dynamic programming carries, for each
place, the best score of a segmentation up to it and its number of pieces. Ties go to the segmentation found first by a
left-to-right search, that is to the longest last piece, as in the tokenizers and sentencepiece libraries. A character
that is no piece by itself also counts as unknown, at the lowest score less ten, and as many pieces as it has bytes.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Of words that a worker keeps; a word and its place in a table take about 150 more.
CACHE_BYTES = 160 << 20


def scored_pieces(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a model file with their scores, in id order."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.get_piece_size())]


class Counter(dict):
    """word -> number of pieces; a word begins with U+2581 or follows a line break."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.held = 0
        self.automaton = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in pieces:
            best[piece] = score  # a repeated piece keeps its last score, as a map by piece does
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        if any("\n" in p or SPACE in p[1:] and p.strip(SPACE) and SPACE in p.lstrip(SPACE) for p in best):
            raise ValueError("pieces reach across spaces or line breaks")
        self.single = {p for p in best if len(p) == 1}

    def __missing__(self, word: str) -> int:
        self[word] = n = self.count(word)
        self.held += 150 + 2 * len(word)
        return n

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def count(self, word: str) -> int:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        single, unknown = self.single, self.unknown
        for i in range(n):
            top, count = None, 0
            # The longest piece starts first, so it wins ties: later ones must be strictly better.
            for length, s in sorted(ends[i], reverse=True) if len(ends[i]) > 1 else ends[i]:
                if top is None or s + score[i + 1 - length] > top:
                    top, count = s + score[i + 1 - length], pieces[i + 1 - length] + 1
            if word[i] not in single and (top is None or unknown + score[i] > top):
                top, count = unknown + score[i], pieces[i] + len(word[i].encode())
            score[i + 1], pieces[i + 1] = top, count
        return pieces[n]


def split_words(text: str) -> list[str]:
    """Words as the tokenizer sees them: each begins at a space, which it keeps; line breaks stand between."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    if text[0] != SPACE:
        text = SPACE + text
    if "\0" in text:
        return [w for part in text.replace(SPACE, "\n" + SPACE).split("\n") for w in [part] if w]
    return [w for w in text.replace(SPACE, "\0" + SPACE).replace("\n", "\0").split("\0") if w]


@cache
def counter(model_path: str) -> Counter:
    return Counter(scored_pieces(model_path))


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df with ``n_tokens`` long: pieces of the best segmentation of the whole text, a line break counting as one (its byte).

    Null and empty texts have 0. Words are segmented one by one, so a very long text needs no more memory than its longest
    word. Other columns and repeated rows pass through; a column named like the new one gives way; no rows in, none out.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        words = counter(model_path)
        out = [sum(map(words.__getitem__, split_words(t))) + t.count("\n") if t else 0 for t in batch.column(text_col).to_pylist()]
        if words.held > CACHE_BYTES:
            words.clear()
        return [pa.array(out, pa.int64())]

    return append_columns(df, text_col, [(out_col, "bigint")], compute)
