"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

Every token is predicted from the REACH tokens on both of its sides, in three parts whose probabilities
multiply or mix:

- The network hides a token and predicts its class: an embedding for each neighbouring place, their sum
  through tanh, and a softmax over CLASSES. The TOP most frequent words of the corpus are classes of
  their own; all others fall into classes by their last two letters.
- A word's probability within its class is its share of the class's tokens in the whole corpus. The
  counts of all words are a table, however many there are; only those of the WORDS most frequent are
  broadcast, the others are joined.
- A memory holds all windows of the corpus: how often each word stood between the same neighbours anywhere.
  There a token's probability is (seen - 1 + PRIOR * p) / (windows - 1 + PRIOR), p being the network's: the
  window itself doesn't count. The memory grows with the corpus, and passages that recur score high.
  Chunks of documents count their own windows, as sorted arrays, and send each part of the range of hashes what
  falls into it; a part adds up what all chunks sent, and answers each in the order of its arrays.

A document's score is the sum of the log probabilities of all its tokens, each given both its sides.

Training is data-parallel over cells of about CELL tokens: a document's cell is a hash of its text and id,
and within a cell documents are in order, so the result depends neither on partitions nor on retries.
Each cell takes gradient steps from the same start, and parameters are averaged by tokens seen, up a
tree of FAN rows a task. Each of ROUNDS rounds trains on its share of the windows, all rounds on all.

Nulls and texts without words have no tokens, score 0 and a null mean. Repeated rows and rows without an
id are scored by themselves. Texts are kept as a byte a token, so very long ones need little memory.
Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, kept, swept

TOP = 47
CLASSES = 96
#: Words whose counts are broadcast: some 10 MB; any others are joined by a shuffle.
WORDS = 262_144
REACH = 2
HIDDEN = 16
ROUNDS = 2
RATE = 0.1
BATCH = 4096
CELL = 1 << 22
#: The memory holds the windows whose neighbours hash to 0 modulo this: all of them.
EVERY = 1
#: Tokens of a chunk, and windows of a part of the memory; a task holds one at a time.
CHUNK, PART = 1 << 20, 1 << 20
PRIOR = 1.0
FAN = 64
_SIDES = [*range(-REACH, 0), *range(1, REACH + 1)]
_BLOCK = 1 << 11
#: Parts of one that a hidden number and a weight are rounded to: HIDDEN products of numbers below 1 and 2 ** 8 fit 53 bits.
_GRID = float(1 << 20)
#: Characters whose words are counted, and tokens that are coded, before a task passes them on.
_FLUSH, _PASSED = 1 << 25, 1 << 21


def ending_class(word: str) -> int:
    """The class of a word that has none of its own."""
    return TOP + 1 + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % (CLASSES - TOP - 1)


def rare_number(word: str) -> int:
    return WORDS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % ((1 << 32) - WORDS)


class Vocabulary(dict):
    """A number of 32 bits for every word, its class in the byte below. Numbers from WORDS up are hashes of words that have no count here."""

    def __missing__(self, word: str) -> int:
        return rare_number(word) << 8 | ending_class(word)


class _Words:
    """The words of texts one after the other, in Arrow's memory; n has how many each text has."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.n: list[int] = []
        self.size = 0

    def add(self, text: str | None) -> int:
        parts = (text or "").lower().split()
        if parts:
            self.lines.append(" ".join(parts))
            self.size += len(self.lines[-1])
        self.n.append(len(parts))
        return len(parts)

    def encoded(self) -> tuple[pa.Array, np.ndarray]:
        """The different words, a space after each, and each word's place among them."""
        raw = np.frombuffer((" ".join(self.lines) + " ").encode("utf-8"), np.uint8)
        ends = np.zeros(sum(self.n) + 1, np.int32)
        ends[1:] = np.flatnonzero(raw == 32)[: len(ends) - 1] + 1
        words = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        return words.dictionary, words.indices.to_numpy()


def _unspaced(words: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(words, 0, -1)


def _unknown(words: pa.Array) -> np.ndarray:
    """What Vocabulary gives words that have no count."""
    endings = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    classes = np.array([ending_class(w) for w in endings.dictionary.to_pylist()], dtype=np.int64)[endings.indices.to_numpy()]
    return np.fromiter(map(rare_number, words.to_pylist()), np.int64, len(words)) << 8 | classes


class Network:
    """sides: a table (place, class, hidden); out and bias: the softmax; all in one vector, flat. Class 0 stands for what lies outside a text."""

    def __init__(self, flat: np.ndarray) -> None:
        shapes = [(2 * REACH, CLASSES, HIDDEN), (HIDDEN, CLASSES), (CLASSES,)]
        at = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        self.flat = np.array(flat, dtype=np.float32)
        self.sides, self.out, self.bias = (self.flat[at[i] : at[i + 1]].reshape(s) for i, s in enumerate(shapes))
        self.top = self.flat[at[1] :].reshape(HIDDEN + 1, CLASSES)  # out, and bias as the weights of a hidden number that is 1

    @classmethod
    def start(cls, mass: np.ndarray) -> Network:
        """Small random weights; the bias gives each class its share of the tokens."""
        n = 2 * REACH * CLASSES * HIDDEN + HIDDEN * CLASSES
        share = (mass + 0.5) / (mass + 0.5).sum()
        return cls(np.concatenate((np.random.default_rng(11).normal(0, 0.1, n), np.log(share))))

    def hidden(self, x: np.ndarray, at: slice) -> np.ndarray:
        z = self.sides[0].take(x[at.start + _SIDES[0] : at.stop + _SIDES[0] : at.step], axis=0)
        for side, d in zip(self.sides[1:], _SIDES[1:]):
            z += side.take(x[at.start + d : at.stop + d : at.step], axis=0)
        return np.tanh(z, out=z)

    def large(self) -> bool:
        """Whether a class's logit may be beyond 60 (hidden numbers are 1 at most)."""
        return bool(np.abs(self.bias).max() + np.abs(self.out).sum(axis=0).max() >= 59)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the classes at all places of x but the REACH first and last.

        Both factors are rounded to so few bits that doubles hold their products' sums exactly: no sum
        then depends on how a product of matrices orders it, nor a text's score on what shares its batch.
        """
        out = np.empty(max(0, len(x) - 2 * REACH))
        weights = np.rint(self.top.astype(np.float64) * _GRID) / _GRID
        large, rows = self.large(), np.arange(_BLOCK)
        ones, whole, single = np.ones((_BLOCK, HIDDEN + 1)), np.empty((_BLOCK, CLASSES)), np.empty((_BLOCK, CLASSES), np.float32)
        for i in range(REACH, len(x) - REACH, _BLOCK):
            at = slice(i, min(i + _BLOCK, len(x) - REACH))
            n = at.stop - i
            h = self.hidden(x, at)
            h *= np.float32(_GRID)
            np.multiply(np.rint(h, out=h), 1 / _GRID, out=ones[:n, :HIDDEN])
            z = single[:n]
            z[:] = np.matmul(ones[:n], weights, out=whole[:n])
            if large:
                np.clip(z, -60, 60, out=z)
            own = z[rows[:n], x[at]].astype(np.float64)
            out[i - REACH : at.stop - REACH] = own - np.log(np.einsum("ij->i", np.exp(z, out=z)).astype(np.float64))
        return out

    def step(self, x: np.ndarray, at: slice, seen: np.ndarray, rate: float) -> int:
        """One step of Adagrad on the tokens at these places; seen holds the sums of squared gradients."""
        y = x[at]
        here = y != 0
        n = int(here.sum())
        if not n:
            return 0
        z = self.hidden(x, at)
        h = np.ones((len(y), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = z
        p = h @ self.top
        if self.large():
            np.clip(p, -60, 60, out=p)
        np.exp(p, out=p)
        share = (here / n).astype(np.float32)
        p *= (share / np.einsum("ij->i", p))[:, None]
        p[np.arange(len(y)), y] -= share
        grad = Network(np.zeros_like(self.flat))
        np.matmul(h.T, p, out=grad.top)
        z *= z
        d = p @ self.out.T
        d *= np.subtract(1, z, out=z)
        for k, place in enumerate(_SIDES):
            c = x[at.start + place : at.stop + place : at.step]
            order = np.argsort(c, kind="stable")
            first = np.flatnonzero(np.diff(c[order], prepend=-1))
            grad.sides[k][c[order][first]] = np.add.reduceat(d.take(order, axis=0), first)
        seen += grad.flat**2
        self.flat -= rate * grad.flat / (np.sqrt(seen) + 1e-6)
        return n


def line_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts (a class a byte) in one array, REACH zeros around each, and where each begins."""
    pad = bytes(REACH)
    x = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    return x, REACH + np.cumsum(lengths + REACH) - lengths - REACH


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; tasks add up their own words before anything is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words, places = own.encoded()
            return pa.RecordBatch.from_arrays([_unspaced(words), pa.array(np.bincount(places, minlength=len(words)))], names=["word", "n"])

        own = _Words()
        for b in batches:
            for t in b.column(0):
                own.add(t.as_py())
                if own.size > _FLUSH:
                    yield out()
                    own = _Words()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def classed(counts: DataFrame) -> tuple[list[tuple[str, int]], DataFrame, np.ndarray]:
    """At most WORDS of the most frequent (word, n); (word, n, class) of the others; and the tokens of each class."""
    # How many words have each count: a few thousand rows. Words of one count are broadcast together or not at all.
    least, room = 1 << 62, WORDS
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    top = sorted(((r["word"], r["n"]) for r in counts.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))
    own = [w for w, _ in top[:TOP]]
    ending = F.crc32(F.substring("word", -2, 2).cast("binary")) % (CLASSES - TOP - 1) + TOP + 1
    of: Column = ending.cast("int")
    for i, w in enumerate(own):
        of = F.when(F.col("word") == w, i + 1).otherwise(of)
    rows = counts.withColumn("class", of)
    mass = np.zeros(CLASSES)
    for r in rows.groupBy("class").agg(F.sum("n").alias("n")).collect():
        mass[r["class"]] = r["n"]
    return top, rows.where(F.col("n") < least), mass


_CODED = "row long, chunk long, doc_id long, text_key long, n long, codes binary, byte0 binary, byte1 binary, byte2 binary, byte3 binary, rare array<string>"


_BYTES = ["byte0", "byte1", "byte2", "byte3"]


def contexts(x: np.ndarray) -> np.ndarray:
    """Hashes of the neighbours at all places of x but the REACH first and last; x has words' ids + 1, and zeros outside texts."""
    h = np.zeros(len(x) - 2 * REACH, dtype=np.uint64)
    for d in _SIDES:
        h ^= x[REACH + d : REACH + d + len(h)]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text that the memory holds, and the hashes of their neighbours."""
    x = np.zeros(len(ids) + 2 * REACH, dtype=np.uint64)
    x[REACH : REACH + len(ids)] = ids + 1
    h = contexts(x)
    at = np.flatnonzero(h % np.uint64(EVERY) == 0)
    return at, h[at].view(np.int64)


def coded(docs: DataFrame, top: list[tuple[str, int]], mass: np.ndarray) -> DataFrame:
    """A row for each document: its tokens' classes, the four bytes of their words' numbers (from WORDS up: a rare word), and its rare words.

    chunk: the row of the first of those documents, in order, that have CHUNK tokens together.
    """
    numbers = [i << 8 | (i + 1 if i < TOP else ending_class(w)) for i, (w, _) in enumerate(top)]
    shared = docs.sparkSession.sparkContext.broadcast((pa.array([w + " " for w, _ in top], pa.string()), np.array([*numbers, 0], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, numbers = shared.value
        row = chunk = TaskContext.get().partitionId() << 40
        size = 0

        def out(b: pa.RecordBatch, own: _Words, chunks: list[int]) -> pa.RecordBatch:
            words, places = own.encoded()
            at = pc.index_in(words, value_set=known)
            missing = at.is_null().to_numpy(zero_copy_only=False)
            rare = _unspaced(words.filter(at.is_null()))
            number = numbers[at.fill_null(0).to_numpy()]
            number[missing] = _unknown(rare)
            flat, met = number[places], missing[places]
            ends = np.concatenate(([0], np.cumsum(own.n))).astype(np.int32)
            offsets = pa.py_buffer(ends)
            bytewise = [pa.Array.from_buffers(pa.binary(), len(own.n), [None, offsets, pa.py_buffer(np.ascontiguousarray(flat.view(np.uint8)[k::8]))]) for k in range(5)]
            rares = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(met)))[ends], pa.int32()), rare.take(pa.array((np.cumsum(missing) - 1)[places[met]])))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row - len(own.n), row)), pa.array(chunks, pa.int64()), b.column(0), b.column(1), pa.array(own.n, pa.int64()), *bytewise, rares],
                names=["row", "chunk", "doc_id", "text_key", "n", "codes", *_BYTES, "rare"],
            )

        for b in batches:
            first, own, chunks, held = 0, _Words(), [], 0  # the first document that is not yet passed on
            for i, t in enumerate(b.column(2)):
                n = own.add(t.as_py())
                if size >= CHUNK:
                    chunk, size = row, 0
                chunks.append(chunk)
                size += n
                held += n
                row += 1
                if held >= _PASSED or i + 1 == b.num_rows:
                    yield out(b.slice(first, i + 1 - first), own, chunks)
                    first, own, chunks, held = i + 1, _Words(), [], 0

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, _CODED)


class _Held:
    """The tokens of some documents (rows of coded()) and the order of their windows in the memory, by neighbours and word.

    keys: also the different windows in that order, and how often each is there.
    """

    def __init__(self, docs: pa.Table, keys: bool = False) -> None:
        self.n = docs["n"].to_numpy()
        self.codes, number = self.tokens(docs)
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.length = len(self.doc) + REACH * (len(self.n) + 1)
        x = number.astype(np.uint64)
        x <<= np.uint64(8)
        x |= self.codes
        x += np.uint64(1)
        h = contexts(self.line(x))[self.places()]
        del x
        self.at = slice(None) if EVERY == 1 else np.flatnonzero(h % np.uint64(EVERY) == 0)
        h, word = h[self.at], number[self.at]
        self.order, _, first = sorted_windows(h, word)
        times = np.diff(first, append=len(h))
        self.which = np.repeat(np.arange(len(first), dtype=np.int32), times)
        self.number = number
        if keys:
            self.h, self.word, self.times = h[self.order[first]], word[self.order[first]], times.astype(np.uint32)

    @staticmethod
    def tokens(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The class of each token, and its word's number."""
        codes, *parts = (np.frombuffer(b"".join(docs[c].to_pylist()), np.uint8) for c in ("codes", *_BYTES))
        return codes, np.column_stack(parts).view("<u4").ravel()

    def places(self) -> np.ndarray:
        """Of each token in line(), less REACH."""
        return np.arange(len(self.doc)) + REACH * self.doc.astype(np.int64)

    def line(self, values: np.ndarray) -> np.ndarray:
        """The documents' values one after the other, REACH zeros around each."""
        x = np.zeros(self.length, dtype=values.dtype)
        x[REACH:][self.places()] = values
        return x

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value for each window's token in the documents' order, of values for each different window."""
        out = np.empty(len(self.order), dtype=values.dtype)
        out[self.order] = values[self.which]
        return out


def sorted_windows(h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (h, word), and where in it another h, and another (h, word), begins."""
    order = np.argsort(h)
    h = h[order]
    other = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    alike = np.flatnonzero(~other | ~np.append(other[1:], np.ones(min(1, len(h)), bool)))
    order[alike] = order[alike][np.lexsort((word[order[alike]], h[alike]))]
    word = word[order]
    new = other.copy()
    new[1:] |= word[1:] != word[:-1]
    return order, np.flatnonzero(other), np.flatnonzero(new)


def _bytewise(a: np.ndarray) -> bytes:
    """How many bytes the largest of the numbers takes, all first bytes, then all second ones: small or sorted numbers take little room."""
    size = next(k for k in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * k)
    out, each = np.empty((size, len(a)), np.uint8), a.astype(f"<u{size}").view(np.uint8)
    for k in range(size):
        out[k] = each[k::size]
    return bytes([size]) + out.tobytes()


def _count(column: bytes) -> int:
    return (len(column) - 1) // column[0]


def _numbers(columns: list[bytes], kind: type) -> np.ndarray:
    """What _bytewise() made of several arrays, as one."""
    out, at = np.empty(sum(map(_count, columns)), kind), 0
    for c in columns:
        size, n = c[0], _count(c)
        out[at : at + n] = np.ascontiguousarray(np.frombuffer(c, np.uint8, offset=1).reshape(size, n).T).view(f"<u{size}").ravel()
        at += n
    return out


_SENT = "part long, chunk long, first long, last long, h binary, word binary, times binary"
_ANSWER = "chunk long, first long, last long, part long, seen binary, windows binary"


def sent(texts: DataFrame, parts: int) -> DataFrame:
    """What documents that lie together, first to last, send to each part of the memory: their different windows, and how often they have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def message(docs: list[pa.RecordBatch]) -> pa.RecordBatch:
            docs = pa.Table.from_batches(docs)
            held = _Held(docs, keys=True)
            part = (held.h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            to = [i for i in range(parts) if cut[i] < cut[i + 1]] or [0]  # one at least, so that no document is without an answer
            columns = [[_bytewise(a[cut[i] : cut[i + 1]]) for i in to] for a in (held.h, held.word, held.times)]
            same = [np.full(len(to), docs[c][k].as_py()) for c, k in (("chunk", 0), ("row", 0), ("row", -1))]
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *map(pa.array, same), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "chunk", "first", "last", "h", "word", "times"])

        docs: list[pa.RecordBatch] = []
        for b in batches:
            chunk = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for i, j in zip(cut[:-1], cut[1:]):
                if docs and i < j and docs[0].column(0)[0].as_py() != chunk[i]:
                    yield message(docs)
                    docs = []
                if i < j:
                    docs.append(b.slice(i, j - i))
        if docs:
            yield message(docs)

    return texts.select("chunk", "row", "n", "codes", *_BYTES).mapInArrow(run, _SENT)


def answered(messages: DataFrame) -> DataFrame:
    """For each message, and each of its windows: how often it is seen, and how many windows have these neighbours, in the whole corpus."""

    def run(group: pa.Table) -> pa.Table:
        h, word, times = (_numbers(group[c].to_pylist(), k) for c, k in (("h", np.uint64), ("word", np.uint32), ("times", np.uint32)))
        order, other, new = sorted_windows(h, word)
        times, sums = times[order].astype(np.int64), []
        for first in (new, other):
            out = np.empty(len(h), dtype=np.int64)
            out[order] = np.repeat(np.add.reduceat(times, first), np.diff(first, append=len(h))) if len(h) else 0
            sums.append(out)
        ends = np.cumsum([_count(x) for x in group["h"].to_pylist()])
        each = [pa.array([_bytewise(x) for x in np.split(a, ends[:-1])], pa.binary()) for a in sums]
        return pa.table([*(group[c] for c in ("chunk", "first", "last", "part")), *each], names=["chunk", "first", "last", "part", "seen", "windows"])

    return messages.groupBy("part").applyInArrow(run, _ANSWER)


def _trained_cell(codes: list[bytes], flat: np.ndarray, turn: int) -> tuple[int, np.ndarray]:
    """(tokens seen, parameters) after the steps of one round over a cell. A batch takes its places at even steps over the whole cell."""
    x, _ = line_of(codes)
    net, places = Network(flat), len(x) - 2 * REACH
    seen, trained = np.full_like(net.flat, 1e-4), 0
    stride = max(ROUNDS, -(-places // BATCH))
    for i in range(turn, stride, ROUNDS):
        trained += net.step(x, slice(REACH + i, REACH + places, stride), seen, RATE)
    return trained, net.flat


def _round(rows: DataFrame, start, turn: int) -> DataFrame:
    """(cell, weight, flat) of rows (cell, codes) that are together by cell and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def learnt() -> pa.RecordBatch:
            weight, flat = _trained_cell(codes, start.value, turn)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([float(weight)]), pa.array([flat.tobytes()], pa.binary())], names=["cell", "weight", "flat"])

        cell, codes = None, []
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c != cell and codes:
                    yield learnt()
                    codes = []
                cell = c
                codes.append(x)
        if codes:
            yield learnt()

    return rows.mapInArrow(run, "cell long, weight double, flat binary")


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cell")
    w = pdf["weight"].to_numpy()
    flat = sum(x * np.frombuffer(f, np.float32).astype(np.float64) for x, f in zip(w, pdf["flat"])) / w.sum()
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0] // FAN], "weight": [w.sum()], "flat": [flat.astype(np.float32).tobytes()]})


def trained(texts: DataFrame, mass: np.ndarray, cell: int = CELL) -> np.ndarray:
    """The network's parameters after ROUNDS rounds over texts (doc_id, text_key, n, codes)."""
    sc = texts.sparkSession.sparkContext
    flat = Network.start(mass).flat
    cells = -(-int(mass.sum()) // cell)
    own = texts.where("n > 0").select(F.pmod(F.xxhash64("text_key", "doc_id"), F.lit(cells)).alias("cell"), "text_key", "doc_id", "codes")
    for turn in range(ROUNDS if cells else 0):
        rows = own.repartition(cells, "cell").sortWithinPartitions("cell", "text_key", "doc_id").select("cell", "codes")
        rows, left = kept(_round(rows, sc.broadcast(flat), turn).where("weight > 0")), cells
        while left > FAN:
            rows = kept(rows.groupBy(F.floor(F.col("cell") / FAN)).applyInPandas(_mean, rows.schema))
            left = -(-left // FAN)
        top = rows.toPandas()  # FAN rows at most
        if len(top):
            flat = np.frombuffer(_mean(top)["flat"].iloc[0], np.float32)
    return flat


_SCORED = "row long, doc_id long, n long, held long, met long, base double, rare array<struct<word: string, p: double, seen: long, windows: long>>"


def _scored(texts: DataFrame, answers: DataFrame, flat: np.ndarray, top: list[tuple[str, int]], mass: np.ndarray) -> DataFrame:
    """Of each document the sum of log probabilities, without the shares of its rare words, and those with what their terms need."""
    counts = np.log(np.array([n for _, n in top], dtype=np.float64))
    shared = texts.sparkSession.sparkContext.broadcast((flat, counts, np.log(np.maximum(mass, 1))))

    def some(docs: pa.Table, seen: np.ndarray, around: np.ndarray) -> pa.Table:
        flat, counts, tokens = shared.value
        held = _Held(docs)
        sees, wide = np.ones(len(held.doc), seen.dtype), np.ones(len(held.doc), around.dtype)
        sees[held.at], wide[held.at] = held.spread(seen), held.spread(around)
        del held.order, held.which
        p = Network(flat).log_probabilities(held.line(held.codes))[held.places()]
        score, often = p.copy(), held.number < WORDS
        score[often] += counts[held.number[often]] - tokens[held.codes[often]]
        mixed = np.flatnonzero(often & (wide > 1))
        score[mixed] = np.log((sees[mixed] - 1 + PRIOR * np.exp(score[mixed])) / (wide[mixed] - 1 + PRIOR))
        total = lambda weights, doc: np.bincount(doc, weights, len(held.n)).astype(np.float64)  # noqa: E731  of nothing it is whole
        number = lambda doc: pa.array(np.bincount(doc, minlength=len(held.n)))
        rare = np.flatnonzero(~often)
        words = docs["rare"].combine_chunks().flatten()
        terms = pa.StructArray.from_arrays([words, *(pa.array(a[rare]) for a in (p, sees, wide))], names=["word", "p", "seen", "windows"])
        ends = np.concatenate(([0], np.cumsum(np.bincount(held.doc[rare], minlength=len(held.n))))).astype(np.int32)
        return pa.table(
            [docs["row"], docs["doc_id"], docs["n"], number(held.doc[held.at]), number(held.doc[wide > 1]), pa.array(total(score, held.doc)), pa.ListArray.from_arrays(pa.array(ends), terms)],
            names=["row", "doc_id", "n", "held", "met", "base", "rare"],
        )

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, answers = docs.sort_by("row"), answers.sort_by([("first", "ascending"), ("part", "ascending")])
        rows, first = docs["row"].to_numpy(), answers["first"].to_numpy()
        cut, out = [*np.flatnonzero(np.diff(first, prepend=-1)).tolist(), len(first)], []
        for i, j in zip(cut[:-1], cut[1:]):
            a, b = np.searchsorted(rows, first[i]), np.searchsorted(rows, answers["last"][i].as_py(), "right")
            out.append(some(docs.slice(a, b - a), *(_numbers(answers[c].slice(i, j - i).to_pylist(), np.int64) for c in ("seen", "windows"))))
        return pa.concat_tables(out)

    return texts.drop("text_key").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _SCORED)


def scored(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood, memory_windows, memory_share) of every document.

    memory_share: of the document's windows in the memory the share that is met elsewhere in the corpus; null if it has none.
    """
    counts = kept(word_counts(docs))
    top, rest, mass = classed(counts)
    texts = kept(coded(docs, top, mass))
    flat = trained(texts, mass, cell)
    swept(docs.sparkSession)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(mass.sum()) // PART))
    answers = kept(answered(sent(texts, parts)))
    swept(docs.sparkSession)
    rows = kept(_scored(texts, answers, flat, top, mass))
    discard(texts, answers)
    swept(docs.sparkSession)
    share = F.log(F.col("n") / F.element_at(F.array(*(F.lit(float(max(m, 1))) for m in mass)), F.col("class") + 1))
    mixed = F.log((F.col("seen") - 1 + PRIOR * F.exp(F.col("p") + share)) / (F.col("windows") - 1 + PRIOR)) - F.col("p")
    terms = rows.select("row", F.explode("rare").alias("w")).select("row", "w.*").join(rest.hint("shuffle_hash"), "word")
    terms = terms.groupBy("row").agg(F.sum(F.when(F.col("windows") > 1, mixed).otherwise(share)).alias("rest"))
    total = F.col("base") + F.coalesce("rest", F.lit(0.0))
    return rows.drop("rare").join(terms, "row", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), total.alias("log_likelihood"), F.when(F.col("n") > 0, total / F.col("n")).alias("mean_log_likelihood"),
        F.col("held").alias("memory_windows"), F.when(F.col("held") > 0, F.col("met") / F.col("held")).alias("memory_share"))
