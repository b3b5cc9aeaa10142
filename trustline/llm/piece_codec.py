"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte pieces.

A text becomes symbols (characters, spaces as U+2581 with one more in front). An agenda holds the adjacent symbol pairs
whose concatenation is a vocabulary piece, best score first and then leftmost; the top pair is merged, pairs with the new
symbol join the agenda, and entries whose symbols are gone leave it, until the agenda is empty. Characters without a piece
fall back to byte pieces. No piece has U+2581 after another character or holds a line break, so a text falls apart at those
places into parts. The parts that are new in an Arrow batch are encoded together, each with its own agenda: symbols and
pairs are numbers, and a step merges the top pair of every part's agenda. All their ids, and the text decoded from them,
are checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, Recent, append_columns

SPACE = "▁"
# Of parts, their ids and texts that a worker keeps; a string and its place in a table take about 300 more.
CACHE_BYTES = 160 << 20
# Parts of more symbols than this are cut where no piece can reach across. What is longer still runs side by side up to the
# second width, if there are so many rows of it; agendas of the rest are heaps, one part at a time.
MOST_WIDTH, WIDEST, LEAST_ROWS = 128, 512, 64
TABLE_CELLS = 1 << 22
CHECKED_TOGETHER = 256
NONE = 1 << 40
_PART = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall


class Strings:
    """A string for each id, and their lengths."""

    def __init__(self, of: list[str]):
        self.of, self.size = of, np.fromiter(map(len, of), np.int64, len(of))


class Vocabulary:
    """Pieces and scores of a merge-type model file, as numbered symbols and a table of the pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = lib.eos_id()
        self.byte_ids = [-1] * 256
        self.byte_of: dict[int, int] = {}
        texts = [""] * lib.get_piece_size()
        pieces: dict[str, tuple[float, int]] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
            elif not lib.is_control(i) and not lib.is_unknown(i) and not lib.is_unused(i):
                pieces[piece] = (lib.get_score(i), i)
                texts[i] = piece.replace(SPACE, " ")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces reach across spaces or line breaks")
        if -1 in self.byte_ids:
            raise ValueError("the vocabulary lacks byte pieces")
        self.texts, self.names = Strings(texts), Strings([f"{i} " for i in range(len(texts))])
        self.is_byte = np.isin(np.arange(len(texts)), list(self.byte_of))
        self._number(pieces)

    def _number(self, pieces: dict[str, tuple[float, int]]) -> None:
        """Symbols are the pieces and their characters, numbered from 1; 0 is any other character."""
        number: dict[str, int] = {}
        for p in pieces:
            for symbol in (p, *p):
                number.setdefault(symbol, len(number) + 1)
        self.number, self.base = number, len(number) + 1
        self.of_char = np.zeros(0x110000, np.int64)
        self.id_of = np.full(self.base, -1, np.int64)
        for symbol, n in number.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = n
            if symbol in pieces:
                self.id_of[n] = pieces[symbol][1]
        place = {s: r for r, s in enumerate(sorted({s for s, _ in pieces.values()}, reverse=True))}
        self.pairs: dict[int, tuple[int, int]] = {}
        for p, (score, _) in pieces.items():
            for k in range(1, len(p)):
                if (left := number.get(p[:k])) and (right := number.get(p[k:])):
                    self.pairs[left * self.base + right] = (place[score], number[p])
        # Pairs of characters that stand next to each other in some piece.
        self.inside = np.unique(np.array([number[a] * self.base + number[b] for p in pieces for a, b in zip(p, p[1:])], np.int64))
        # The same pairs in an open hash table, for lookups of whole arrays.
        self.bits = int(8 * len(self.pairs) + 16).bit_length()
        keys, self.rank, self.into = (np.full((1 << self.bits) + 256, v, np.int64) for v in (-1, NONE, 0))
        self.probes = 1
        slots = self._slot(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        for (key, (rank, into)), first in zip(self.pairs.items(), slots.tolist()):
            at = first
            while keys[at] >= 0:
                at += 1
            keys[at], self.rank[at], self.into[at] = key, rank, into
            self.probes = max(self.probes, at - first + 1)
        self.keys = keys

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (from 0, the best score; NONE for no piece) and merged symbol of pairs of symbols."""
        key = left * self.base + right
        at = self._slot(key)
        found = at
        for step in range(1, self.probes):
            found = np.where(self.keys[found] == key, found, at + step)
        hit = self.keys[found] == key
        return np.where(hit, self.rank[found], NONE), self.into[found]

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts laid end to end, and how many each part has."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(size) - size
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        symbols = self.of_char[chars]
        alive = np.ones(len(chars), bool)
        begin, length = self._apart(symbols, start, size)
        edges = [1, *(w for w in (8, 12, 16, 32, MOST_WIDTH, 2 * MOST_WIDTH, WIDEST) if 1 < w <= WIDEST), NONE]
        for low, high in zip(edges, edges[1:]):
            rows = np.flatnonzero((length > low) & (length <= high))
            if high == NONE or low >= MOST_WIDTH and len(rows) < LEAST_ROWS:
                for row in rows.tolist():
                    a, b = int(begin[row]), int(begin[row] + length[row])
                    symbols[a:b], alive[a:b] = self._run_agenda(symbols[a:b].tolist())
                continue
            step = min(1 << 15, TABLE_CELLS // high)
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                width = int(length[some].max())
                inside = np.arange(width) < length[some][:, None]
                at = (begin[some][:, None] + np.arange(width))[inside]
                table = np.zeros(inside.shape, np.int64)
                table[inside] = symbols[at]
                kept = inside.copy()
                self._run_agendas(table, kept)
                symbols[at], alive[at] = table[inside], kept[inside]
        ids = np.where(alive, self.id_of[symbols], -2)
        each = alive.astype(np.int64)
        bare = np.flatnonzero(ids == -1)  # characters without a piece
        raw = [[self.byte_ids[b] for b in chr(chars[i]).encode()] for i in bare.tolist()]
        each[bare] = [len(r) for r in raw]
        counts = np.add.reduceat(each, start) if len(parts) else each
        out = np.repeat(ids, each)
        if raw:
            ends = np.cumsum(each)
            places = np.concatenate([np.arange(ends[i] - each[i], ends[i]) for i in bare.tolist()])
            out[places] = list(chain.from_iterable(raw))
        return out, counts

    def _apart(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts begin and how long they are, long ones cut between characters that no piece holds side by side."""
        long = np.flatnonzero(size > MOST_WIDTH)
        if not len(long):
            return start, size
        here = np.repeat(start[long], size[long]) + np.arange(size[long].sum()) - np.repeat(np.cumsum(size[long]) - size[long], size[long])
        first = np.zeros(len(symbols), bool)
        first[start[long]] = True
        # A character begins a piece of the part unless some piece holds it after the one before.
        key = symbols[np.maximum(here - 1, 0)] * self.base + symbols[here]
        spot = np.minimum(np.searchsorted(self.inside, key), max(len(self.inside) - 1, 0))
        first[here] |= ~(self.inside[spot] == key) if len(self.inside) else True
        cuts = here[first[here]]
        ends = np.append(cuts[1:], 0)
        # The last cut of a part ends where the part does.
        last = np.append(np.searchsorted(cuts, start[long][1:]) - 1, len(cuts) - 1)
        ends[last] = (start + size)[long]
        short = size <= MOST_WIDTH
        return np.concatenate([start[short], cuts]), np.concatenate([size[short], ends - cuts])

    def _run_agendas(self, symbols: np.ndarray, alive: np.ndarray) -> None:
        """Merges in place, a row for each part (0 beyond its end): a row's agenda is its pairs' ranks, the top its first least."""
        n, width = symbols.shape
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        rank, into = np.full((n, width), NONE), np.zeros((n, width), np.int64)
        rank[:, :-1], into[:, :-1] = self.merges(symbols[:, :-1], symbols[:, 1:])
        symbols, alive, after, before, rank, into = (x.reshape(-1) for x in (symbols, alive, after, before, rank, into))
        row = np.arange(n) * width
        while True:
            at = rank.reshape(n, width)[row // width].argmin(axis=1) + row
            going = rank[at] < NONE
            row, at = row[going], at[going]
            if not len(row):
                return
            new, gone = into[at], after[at] + row
            symbols[at], alive[gone], rank[gone] = new, False, NONE
            nxt = after[gone]
            after[at] = nxt
            last = nxt >= width
            nxt = np.minimum(nxt, width - 1) + row
            ranks, merged = self.merges(new, symbols[nxt])
            rank[at], into[at] = np.where(last, NONE, ranks), merged
            before[nxt[~last]] = (at - row)[~last]
            first = before[at]
            has = first >= 0
            left = (first + row)[has]
            rank[left], into[left] = self.merges(symbols[left], new[has])

    def _run_agenda(self, symbols: list[int]) -> tuple[list[int], list[bool]]:
        """The same for one part, with its agenda in a heap; stale entries are passed over."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if (found := self.pairs.get(symbols[left] * self.base + symbols[right])) is not None:
                heapq.heappush(agenda, (found[0], left, right, symbols[left], symbols[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, a, b = heapq.heappop(agenda)
            if not alive[left] or after[left] != right or symbols[left] != a or symbols[right] != b:
                continue
            symbols[left] = self.pairs[a * self.base + b][1]
            alive[right] = False
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                offer(left, nxt)
            if before[left] >= 0:
                offer(before[left], left)
        return symbols, alive

    def decode_ids(self, ids: list[int]) -> str:
        """Text of a run of ids, the first space included; byte pieces form UTF-8, broken bytes become U+FFFD each."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(self.texts.of[i])
        return "".join(out) + _utf8(bytes(raw))

    def check(self, parts: list[str], ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> None:
        """Raises where the library gives other ids, or another text for them; it reads many parts at once, a line each."""
        (space, *more), _ = self.encode_parts([SPACE, "\n"])
        # The library puts a space before any text; then every part follows a line break.
        want = np.insert(ids, np.cumsum(counts) - counts, more).tolist()
        ends = [0, *(np.cumsum(counts) + np.arange(1, len(counts) + 1)).tolist()]
        for a in range(0, len(parts), CHECKED_TOGETHER):
            b = min(a + CHECKED_TOGETHER, len(parts))
            asked = "\n" + "\n".join(parts[a:b]).replace(SPACE, " ")
            got = [int(space), *want[ends[a] : ends[b]]]
            if self.library.encode(asked, num_threads=1) != got:
                raise ValueError(f"agenda and library disagree on a part in {asked[:200]!r}")
            if self.library.decode(got) != "\n" + "\n".join(texts[a:b]):
                raise ValueError(f"decoded texts differ from the library's on a part in {asked[:200]!r}")


large = partial(pa.scalar, type=pa.large_string())


def _utf8(raw: bytes) -> str:
    """UTF-8 with each byte that belongs to no character replaced by U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def split_parts(text: str) -> list[str]:
    """The parts of a text: each begins at a run's first space, at a line break or after one."""
    return _PART(SPACE + text.replace(" ", SPACE))


def parts_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The parts of all texts laid end to end, and where each text's parts start; an empty text may have empty parts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    spaced = pc.replace_substring(texts, " ", SPACE)
    runs = pc.or_(pc.match_substring(spaced, SPACE + SPACE), pc.or_(pc.match_substring(spaced, "\0"), pc.starts_with(spaced, SPACE)))
    if pc.any(runs).as_py():
        # Runs of spaces stay whole, as pieces of several spaces exist.
        lists = [split_parts(t) if t else [] for t in texts.to_pylist()]
        return pa.array(list(chain.from_iterable(lists)), pa.large_string()), pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    marked = pc.replace_substring(pc.replace_substring(spaced, SPACE, "\0" + SPACE), "\n", "\0\n\0")
    some = pc.not_equal(texts, "")
    marked = pc.if_else(some, pc.binary_join_element_wise(large(SPACE), marked, large("")), marked)
    lists = pc.split_pattern(marked, "\0")
    return lists.flatten(), lists.offsets


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _made(vocab: Vocabulary, parts: list[str]) -> Iterator[tuple[str, int, str]]:
    """(ids, a space after each; their number; decoded text) of each part; the empty part has none."""
    spoken = [p for p in parts if p]
    if not spoken:
        return iter([("", 0, "")] * len(parts))
    ids, counts = vocab.encode_parts(spoken)
    starts = np.cumsum(counts) - counts
    names, texts = _cut(vocab.names, ids, starts), _cut(vocab.texts, ids, starts)
    for row in np.flatnonzero(np.add.reduceat(vocab.is_byte[ids].astype(np.int64), starts)).tolist():
        texts[row] = vocab.decode_ids(ids[starts[row] : starts[row] + counts[row]].tolist())
    vocab.check(spoken, ids, counts, texts)
    made = zip(names, counts.tolist(), texts)
    return (next(made) if p else ("", 0, "") for p in parts)


def _cut(strings: Strings, ids: np.ndarray, starts: np.ndarray) -> list[str]:
    """The strings of the ids, laid together for each run of ids that begins at ``starts``."""
    whole = "".join(map(strings.of.__getitem__, ids.tolist()))
    ends = np.cumsum(strings.size[ids])
    cuts = [0, *ends[starts[1:] - 1].tolist(), len(whole)]
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


@cache
def known_parts(path: str) -> Recent:
    return Recent(partial(_made, vocabulary(path)), CACHE_BYTES, lambda parts, made: 300 * len(parts) + 2 * sum(map(len, parts)) + sum(len(m[0]) + 2 * len(m[2]) for m in made))


def encode_ids(text: str | None, vocab: Vocabulary) -> list[int]:
    """All ids of a text, with an end id only."""
    return [*(vocab.encode_parts(split_parts(text))[0].tolist() if text else []), vocab.eos]


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens long, ids_sha256 and decoded_sha256 string: the ids with an end id, and the text decoded from them.

    Null texts count as empty: one id, the end, and the empty text. Ids, repeated rows and all other columns pass
    through; columns named like a new one give way to it; an empty table gives an empty result.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        parts, starts = parts_of(batch.column(text_col))
        coded = parts.dictionary_encode()
        found = known_parts(model_path).of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        names, counts, texts = zip(*found) if found else ((), (), ())
        joined = lambda strings: pc.binary_join(pa.ListArray.from_arrays(starts, pa.array(strings, pa.large_string()).take(coded.indices)), large(""))
        total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[coded.indices.to_numpy()])])
        at, end = starts.to_numpy(), str(vocabulary(model_path).eos)
        hashes = [hashlib.sha256(f"{ids}{end}".encode()).hexdigest() for ids in joined(names).to_pylist()]
        decoded = [hashlib.sha256(body.removeprefix(" ").encode()).hexdigest() for body in joined(texts).to_pylist()]
        return [pa.array(total[at[1:]] - total[at[:-1]] + 1, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]

    return append_columns(df, text_col, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], compute, most=4 * SLICE_BYTES)
