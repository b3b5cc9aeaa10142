"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of tokens. In every window (a sequence of ``width`` tokens) a queue earns width x its share of the
mixture, takes whole tokens of what it has earned, and carries the rest, its deficit, to the next window, wherever that
window is packed. Served in a fixed order, with A_s the tokens of queues up to s and T all tokens, the queues up to s have
taken floor(n A_s / T) tokens when n tokens are packed: windows are exactly full, each queue's deficit stays below one
token, and any task finds its documents' windows by arithmetic from the document's place in its queue. No task steps
through windows of others.

A queue whose share of a window is under ``least_piece`` tokens would cut its documents to shreds. Such queues form classes
by size, each of which is a queue of windows, and inside a class the same law holds for rounds: after r of R rounds the
queues up to s of the class, with B_s tokens, have given floor(r B_s / R). A round is as long as it takes to give the
smallest queue of its class ``least_piece`` tokens, so a source has its share, to the token, in every run of windows in
which it is due so many. B_(s-1) and B_s travel as columns; the driver knows classes, not sources. A target mixture is met
while all its queues last; what is left then follows in the proportions left.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, kept, mix64, release_memory, running_sums, slices, stored, text_bytes

# Of words and their ids that a worker keeps from task to task.
CACHE_BYTES = 64 << 20
# Words of more bytes are not kept.
KEY_BYTES = 24
# The library reads so many words in one text; much longer texts cost it more a word.
READ_TOGETHER = 1000
OTHER, LETTER, DIGIT, SIGN, SPACE, BREAK, ODD = range(7)
APOSTROPHE = ord("'")


def _kinds() -> np.ndarray:
    """Kind of each byte: OTHER belongs to characters that may be anything but white space, ODD may belong to other white space."""
    kinds = np.full(256, OTHER, np.uint8)
    for b in range(33, 127):
        kinds[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
    kinds[[9, 11, 12, 13, 28, 29, 30, 31, 0, 0xC2, 0xE1, 0xE2, 0xE3]] = ODD
    kinds[32], kinds[10] = SPACE, BREAK
    return kinds


def _pairs(holds: Callable[[int, int], bool]) -> np.ndarray:
    return np.array([holds(i >> 3, i & 7) for i in range(64)])


KINDS = _kinds()
# Where a word of the pre-tokenizer begins between two bytes: at a space, around a line break, and where letters, digits and
# signs meet, but not after an apostrophe, which may take letters with it.
BEGINS = _pairs(lambda a, b: b in (SPACE, BREAK) or a == BREAK or (a != b and {a, b} <= {LETTER, DIGIT, SIGN}))
DOUBLE = _pairs(lambda a, b: {a, b} <= {SPACE, BREAK})


class Known:
    """Ids of words that were met, by the words' bytes: sorted columns, about 50 bytes a word.

    Words are looked for by a hash of their bytes and found only if all their bytes are equal. Beyond ``most_bytes`` those
    go that were not met again since the last time."""

    def __init__(self, most_bytes: int, kind: str):
        self.most, self.kind = most_bytes, kind
        self.clear()

    def clear(self) -> None:
        self.hashes, self.keys = np.zeros(0, np.uint64), np.zeros((0, KEY_BYTES // 8), np.uint64)
        self.starts, self.counts, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = np.zeros(0, self.kind)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.keys, self.starts, self.counts, self.again, self.ids))

    def find(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rows of the words, -1 for those that are not known."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        if len(self.hashes):
            at[(self.keys[at] != keys).any(axis=1)] = -1
            self.again[at[at >= 0]] = True
        else:
            at -= 1
        return at

    def add(self, hashes: np.ndarray, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds words that are not known; ids of all words one after another."""
        if self.held() > self.most:
            kept = np.flatnonzero(self.again)
            if 2 * len(kept) > len(self.again):  # most were met again: every other one goes
                kept = kept[::2]
            self.ids, self.counts = gathered(self.ids, self.starts[kept], self.counts[kept]), self.counts[kept]
            self.hashes, self.keys, self.starts, self.again = self.hashes[kept], self.keys[kept], np.cumsum(self.counts) - self.counts, np.zeros(len(kept), bool)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.starts = np.insert(self.starts, at, (len(self.ids) + np.cumsum(counts) - counts)[order])
        self.hashes, self.keys = np.insert(self.hashes, at, hashes[order]), np.insert(self.keys, at, keys[order], axis=0)
        self.counts, self.again = np.insert(self.counts, at, counts[order]), np.insert(self.again, at, False)
        self.ids = np.concatenate([self.ids, ids])


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of values, one after another."""
    upto = np.cumsum(counts, dtype=np.int64)
    at = np.repeat(starts - (upto - counts), counts)
    at += np.arange(len(at))
    return values[at]


class TextIds:
    """Ids of texts as little-endian unsigned numbers of ``width`` bytes, all of them from the tokenizers library.

    Where the tokenizer is byte-level BPE with the usual word pattern, a text falls apart at single spaces and line breaks
    and where ASCII letters, digits and signs meet; words that are new are read by the library many in one text, and a
    token's number of bytes tells whose it is. Texts with other white space or an added token's content, and texts of other
    tokenizers, are read whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known(CACHE_BYTES, f"<u{self.width}")
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.apart = told["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not told["normalizer"]
        # In the byte-level alphabet a character of a token is a byte.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(False).items():
            self.bytes_of[i] = len(token)
        del told
        release_memory()
        self.other_space = re.compile("[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x00]").search

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}")

    def _made(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with the space before them, of words without one, and of the line break: all ids, and each word's number.

        The library starts a word where a part starts: at a space, or after a line break."""
        ids, counts = [], np.zeros(len(starts), np.int64)
        first = data[starts]
        order = []
        for rows, end in ((np.flatnonzero(first == 32), 0), (np.flatnonzero((first != 32) & (first != 10)), 1)):
            for a in range(0, len(rows), READ_TOGETHER):
                some = rows[a : a + READ_TOGETHER]
                want = np.cumsum(sizes[some] + end)
                text = np.full(want[-1], 10, np.uint8)
                text[np.arange(want[-1]) < np.repeat(want - end, sizes[some] + end)] = gathered(data, starts[some], sizes[some])
                got = np.asarray(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
                ends = np.cumsum(self.bytes_of[got])
                upto = np.searchsorted(ends, want - end) + 1
                if not (ends[upto - 1] == want - end).all() or len(got) != upto[-1] + end:
                    raise ValueError("a token reaches across words")
                if end:
                    kept = np.ones(len(got), bool)
                    kept[upto] = False
                    got, upto = got[kept], upto - np.arange(len(upto))
                counts[some] = np.diff(upto, prepend=0)
                ids.append(got.astype(f"<u{self.width}"))
                order.append(some)
        for row in np.flatnonzero(first == 10):
            ids.append(self.encode("\n"))
            order.append(np.array([row]))
            counts[row] = len(ids[-1])
        if not order:
            return np.zeros(0, f"<u{self.width}"), counts
        made, order = np.concatenate(ids), np.concatenate(order)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(made, at, counts), counts

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of the distinct words begins in the ids, its number of ids, and the ids."""
        data, offsets = text_bytes(words)
        starts, sizes = offsets[:-1], np.diff(offsets)
        short = np.flatnonzero(sizes <= KEY_BYTES)
        if len(short) == 0:
            hashes, keys, at = np.zeros(0, np.uint64), np.zeros((0, KEY_BYTES // 8), np.uint64), np.zeros(0, np.int64)
        else:
            padded = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
            keys = np.lib.stride_tricks.sliding_window_view(padded, KEY_BYTES)[starts[short]]
            keys *= np.arange(KEY_BYTES) < sizes[short][:, None]
            keys, hashes = keys.view("<u8"), np.zeros(len(short), np.uint64)
            for c in range(keys.shape[1]):
                hashes = mix64(hashes ^ keys[:, c]) + np.uint64(c + 1)
            at = self.known.find(hashes, keys)
        rows = np.full(len(words), -1, np.int64)
        rows[short] = at
        new = np.flatnonzero(rows < 0)
        made, counts = self._made(data, starts[new], sizes[new])
        where, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = np.flatnonzero(rows >= 0)
        where[old], number[old] = self.known.starts[rows[old]], self.known.counts[rows[old]]
        where[new], number[new] = len(self.known.ids) + np.cumsum(counts) - counts, counts
        ids = np.concatenate([self.known.ids, made])
        kept, fresh = sizes[new] <= KEY_BYTES, np.flatnonzero(at < 0)
        if len(fresh):
            self.known.add(hashes[fresh], keys[fresh], made[np.repeat(kept, counts)], counts[kept])
        return where, number, ids

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin in the texts, and which texts cutting them there might change."""
        kinds = KINDS[data]
        odd = kinds == ODD
        pairs = kinds[:-1] << np.uint8(3)
        pairs |= kinds[1:]
        begins = np.ones(len(data), bool)
        begins[1:] = BEGINS[pairs] & ((data[:-1] != APOSTROPHE) | (kinds[1:] == SPACE) | (kinds[1:] == BREAK))
        odd[1:] |= DOUBLE[pairs]
        filled = offsets[:-1] < offsets[1:]
        firsts = offsets[:-1][filled]
        odd[firsts] = kinds[firsts] == ODD
        odd[offsets[1:][filled] - 1] |= data[offsets[1:][filled] - 1] == 32
        begins[firsts] = True
        doubtful = np.zeros(len(offsets) - 1, bool)
        doubtful[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        return np.flatnonzero(begins), doubtful

    def whole(self, text: str) -> bool:
        """Whether cutting the text at spaces and line breaks might change a word of the pre-tokenizer, or an added token."""
        if not self.apart or text[-1] == " " or any(t in text for t in ("  ", "\n\n", " \n", "\n ", *self.added)):
            return True
        return self.other_space(text) is not None

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null and empty texts have none."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, f"<u{self.width}"), np.zeros(len(texts), np.int64)
        begins, doubtful = self._cut(data, offsets)
        if not self.apart or any(t.encode() in data.tobytes() for t in self.added):
            doubtful[:] = np.diff(offsets) > 0
        rows = np.flatnonzero(doubtful)
        whole = np.array([r for r, t in zip(rows, texts.take(pa.array(rows)).to_pylist()) if self.whole(t)], np.int64)
        if len(whole):
            read = np.zeros(len(texts), bool)
            read[whole] = True
            ids, counts = self.ids(pc.if_else(pa.array(read), pa.scalar("", texts.type), texts))
            alone = [self.encode(t) for t in texts.take(pa.array(whole)).to_pylist()]
            counts[whole] = [len(x) for x in alone]
            out, at = np.empty(counts.sum(), f"<u{self.width}"), np.repeat(read, counts)
            out[at], out[~at] = np.concatenate(alone), ids
            return out, counts
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)).dictionary_encode()
        starts, number, ids = self._ids_of(words.dictionary)
        coded = words.indices.to_numpy()
        counts = number[coded]
        upto = np.concatenate([[0], np.cumsum(counts)])
        out = gathered(ids, starts[coded], counts)
        return out, np.diff(upto[np.searchsorted(begins, offsets)])

    def documents(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; null and empty texts have none."""
        ids, counts = self.ids(texts)
        ends = np.cumsum(counts)
        return [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), counts.tolist())]


def text_ids(path: str) -> TextIds:
    return kept(f"text ids {path}", lambda: TextIds(path))


def queue_key(name: Column) -> Column:
    """A queue's key is never null: null sources are a queue of their own."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def tokenized(df: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source") -> DataFrame:
    """(doc_id, queue_key, part int, before long, doc_tokens long, ids binary): ids of each text and the end id, two or four bytes each.

    ``part`` is the task, ``before`` the tokens that the same task has met before in the same queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = text_ids(tokenizer_path)
        met: dict[str, int] = {}
        for whole in batches:
            for batch in slices(whole, "text", 8 * SLICE_BYTES):
                ids, counts = words.ids(batch.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                sizes = counts + 1
                before = []
                for s, n in zip(batch.column("queue_key").to_pylist(), sizes.tolist()):
                    before.append(met.get(s, 0))
                    met[s] = before[-1] + n
                ends = np.concatenate([[0], np.cumsum(sizes) * words.width]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("queue_key"), batch.column("part"), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                    ],
                    names=["doc_id", "queue_key", "part", "before", "doc_tokens", "ids"],
                )
        release_memory()

    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), queue_key(F.col(f"`{queue_col}`")).alias("queue_key")).withColumn("part", F.spark_partition_id())
    kind = df.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, queue_key string, part int, before bigint, doc_tokens bigint, ids binary")


class Mixture:
    """Queues in serving order and their tokens, in one or two phases; places of windows in a queue, in whole numbers."""

    def __init__(self, tokens: list[int], width: int, target: list[float] | None = None):
        self.width = width
        first = [0] * len(tokens)
        if target is not None and any(target):
            # The longest run of whole windows for which no queue with a target is short.
            lasts = min(t / (w / sum(target)) for t, w in zip(tokens, target) if w > 0)
            windows = int(lasts // width)
            ends, have = 0.0, 0
            for i, w in enumerate(target):
                ends += w / sum(target)
                upto = min(int(round(windows * width * ends)), windows * width)
                first[i] = min(tokens[i], upto - have)
                have += first[i]
            if have % width:
                first = [0] * len(tokens)  # rounding met an empty queue; everything goes by the proportions that are left
        self.phases = [(first, sum(first)), ([t - f for t, f in zip(tokens, first)], sum(tokens) - sum(first))]
        self.sums = [[sum(p[: i + 1]) for i in range(len(p))] for p, _ in self.phases]

    def upto(self, packed: int, queue: int) -> int:
        """Tokens that queues 0 to ``queue`` have given when ``packed`` tokens are packed."""
        if queue < 0:
            return 0
        done = 0
        for (_, total), sums in zip(self.phases, self.sums):
            n = min(max(packed, 0), total)
            done += n * sums[queue] // total if total else 0
            packed -= total
        return done

    def taken(self, window: int, queue: int) -> int:
        """Tokens of the queue in windows before ``window``."""
        n = window * self.width
        return self.upto(n, queue) - self.upto(n, queue - 1)

    def window_of(self, token: int, queue: int) -> int:
        """The window that takes the queue's token of this number."""
        low, high = 0, (sum(t for _, t in self.phases) + self.width - 1) // self.width
        first = self.phases[0][0][queue]
        inside, total, base = (token, self.phases[0][1], 0) if token < first else (token - first, self.phases[1][1], self.phases[0][1])
        own = first if token < first else self.phases[1][0][queue]
        guess = (base + inside * total // max(own, 1)) // self.width
        # The quota line is off by two tokens at most, so the window is near the guess.
        w = max(low, min(guess, high))
        while w > 0 and self.taken(w, queue) > token:
            w -= 1
        while self.taken(w + 1, queue) <= token:
            w += 1
        return w


@dataclass(frozen=True)
class Rounds:
    """How the queues of a class take turns: ``tokens`` of the class in ``rounds`` rounds."""

    tokens: int
    rounds: int

    def taken(self, r: int, low: int, high: int) -> int:
        """Tokens that the queue between the class's tokens ``low`` and ``high`` has given in the first r rounds."""
        return r * high // self.rounds - r * low // self.rounds

    def runs(self, at: int, n: int, low: int, high: int) -> Iterator[tuple[int, int]]:
        """(place in the class, length) of the queue's tokens from ``at`` on, a run for each round."""
        if self.rounds == 1:
            yield low + at, n
            return
        r, end = min(at * self.rounds // max(high - low, 1), self.rounds - 1), at + n
        # The quota line is off by two tokens at most, so the round is near the guess.
        while r > 0 and self.taken(r, low, high) > at:
            r -= 1
        while at < end:
            before, after = self.taken(r, low, high), self.taken(r + 1, low, high)
            stop = min(end, after)
            if stop > at:
                # What the round's queues before this one give, and what it has given itself.
                start = r * self.tokens // self.rounds + (r + 1) * low // self.rounds - r * low // self.rounds
                yield start + at - before, stop - at
                at = stop
            r += 1


def pack(
    df: DataFrame, tokenizer_path: str, width: int = 2048, end_id: int = 1, target: dict[str, float] | None = None, least_piece: int = 64,
    id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source",
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents of df.

    Every sequence but the last is exactly full and holds the mixture's proportions to the token, for sources that are due
    less than ``least_piece`` tokens a sequence every run of sequences in which they are due so many. Null texts are empty and
    give one token, the end id; null sources are a queue of their own; repeated rows, null ids too, are packed as often as
    they occur; an empty table gives no pieces; other columns of df are not read. A document longer than a sequence spans
    several.
    ``target`` maps sources to weights, by default the corpus's own proportions; sources without a weight come last.
    """
    # Written once: tokens are needed when all counts are known, and parts must stay as they were counted.
    tokens = stored(tokenized(df, tokenizer_path, end_id, id_col, text_col, queue_col))
    by_part = running_sums(tokens.groupBy("part", "queue_key").agg(F.sum("doc_tokens").alias("n")), ["queue_key", "part"], "n", "upto")
    by_queue = by_part.groupBy("queue_key").agg(F.sum("n").alias("tokens"), F.min("upto").alias("start"))
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    wanted = {f"={name}" if name is not None else "": w for name, w in (target or {}).items()}
    # A source that is due least_piece tokens a window, or has a target, is a class of its own; others are put together by
    # powers of two. There are width / least_piece classes of the first kind at most, and one for each bit of the second.
    alone = (F.col("tokens") * width >= F.lit(least_piece * total).cast("bigint")) | F.col("queue_key").isin(list(wanted))
    # Zeros lead: a class's name is its size, so classes are served from the largest.
    size = lambda c: F.lpad(c.cast("string"), 20, "0")
    named = F.when(alone, F.concat(F.lit("b"), size(F.col("tokens")), "queue_key")).otherwise(F.concat(F.lit("a"), size(F.length(F.bin("tokens")))))
    # Where a queue begins and ends among the tokens of its class.
    queues = running_sums(by_queue.withColumn("class", named), ["class", "queue_key"], "tokens", "below")
    classes = queues.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.min("tokens").alias("least"), F.min("below").alias("start"), F.max("queue_key").alias("of"), F.count("*").alias("n")).orderBy(F.desc("class")).collect()
    counts = [r.tokens for r in classes]
    weights = [wanted.get(r.of, 0.0) if r.n == 1 else 0.0 for r in classes]
    mixture = Mixture(counts, width, weights if any(weights) else None)
    rounds = [Rounds(r.tokens, 1 if r.n == 1 else max(1, r.tokens // -(-least_piece * r.tokens // r.least))) for r in classes]
    numbered = df.sparkSession.createDataFrame([(r["class"], i, r.start) for i, r in enumerate(classes)], "class string, queue int, class_start bigint")
    low = (F.col("below") - F.col("class_start")).alias("low")
    shares = queues.join(F.broadcast(numbered), "class").select("queue_key", "queue", "start", low, (low + F.col("tokens")).alias("high"))
    # Where the tokens of a part begin in their own queue. Written first, so that Spark knows its size: it is broadcast if
    # small enough, else ids are exchanged by part and queue.
    places = stored(by_part.join(shares, "queue_key").select("part", "queue_key", "queue", "low", "high", (F.col("upto") - F.col("start")).alias("base")))
    placed = tokens.join(places, ["part", "queue_key"]).select("doc_id", "doc_tokens", "queue", "low", "high", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                rows, starts, lengths, crcs, windows, offsets = [], [], [], [], [], []
                each = zip(*(batch.column(c).to_pylist() for c in ("queue", "low", "high", "at", "doc_tokens")), batch.column("ids"))
                for row, (queue, low, high, at, n_ids, ids) in enumerate(each):
                    raw = memoryview(np.frombuffer(ids.as_buffer(), f"<u{len(ids.as_buffer()) // n_ids}").astype("<u4")).cast("B")
                    done = 0
                    for here, n in rounds[queue].runs(at, n_ids, low, high):
                        end, w = here + n, mixture.window_of(here, queue)
                        from_ = mixture.taken(w, queue)
                        while here < end:
                            upto = mixture.taken(w + 1, queue)
                            stop = min(end, upto)
                            if stop > here:
                                packed = w * width
                                rows.append(row)
                                starts.append(done)
                                lengths.append(stop - here)
                                crcs.append(zlib.crc32(raw[4 * done : 4 * (done + stop - here)]))
                                windows.append(w)
                                offsets.append(mixture.upto(packed + width, queue - 1) - mixture.upto(packed, queue - 1) + here - from_)
                                done += stop - here
                            here, from_, w = stop, upto, w + 1
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs)), batch.column("doc_tokens").take(take), pa.array(windows, pa.int64()), pa.array(offsets, pa.int64())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
