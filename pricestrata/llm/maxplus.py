"""SentencePiece encoding and decoding by a max-plus scan.

A text's pieces are the segmentation of the largest sum of scores (ties: the longest last piece). The
vocabulary file's pieces and scores are read as such a lattice, whatever algorithm found them.
Scores are summed in doubles, so rank-like scores stay exact however long the text.

Ordinary texts are encoded whole. A giant text is cut into chunks of CHUNK characters. The state at a
cut is how many characters beyond it the piece that crosses it reaches. Each chunk yields a matrix of
the best scores from every state at its start to every state at its end; these combine by the
max-plus product, associatively: within runs of RUN chunks first, then across runs. That gives the best
scores up to every cut. With them each chunk traces back from every state at its end to the one at its
start that the tie rule leads to; these maps, too, combine associatively, and give the state at every
cut. Each chunk is then traced back by itself, to the same pieces as in one pass over the whole text.
Chunks and runs are rows, so a giant text is the work of many tasks, and no task holds more than a
run's matrices or a text's runs.

Nulls give null; an empty text has no pieces. Repeated rows get equal rows. Other columns are not
read. Decoding gives the text back unless it holds U+2581, which stands for a space in pieces.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, once_a_process

VOCABULARY = "piece_bpe_32k.model"
GIANT = 65_536
CHUNK = 16_384
RUN = 64
SPACE = "▁"
_NONE = -np.inf
#: Characters of the parts that are remembered, and of the longest one of them.
_CACHE, _CACHED = 8_000_000, 256
NORMAL, BYTE, USER = 1, 6, 4


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protocol buffer's fields."""
    i = 0
    while i < len(b):
        k, i = _varint(b, i)
        if k & 7 == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if k & 7 == 2 else (4 if k & 7 == 5 else 8, i)
            v, i = b[i : i + n], i + n
        yield k >> 3, k & 7, v


class Pieces:
    """The pieces of a model file, with the best segmentation of texts and the matrices of chunks."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as f:
            raw = f.read()
        self.ids: dict[str, int] = {}
        self.bytes_id: dict[int, int] = {}
        surface: list[bytes] = []
        scores: list[float] = []
        for number, _, v in _fields(raw):
            if number == 1:
                own = {k: x for k, _, x in _fields(v)}
                text, kind = own.get(1, b""), own.get(3, NORMAL)
                score = struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0]
                if kind in (NORMAL, USER):
                    self.ids[text.decode()] = len(scores)
                elif kind == BYTE:
                    self.bytes_id[int(text[1:-1], 16)] = len(scores)
                surface.append(bytes([int(text[1:-1], 16)]) if kind == BYTE else text if kind in (NORMAL, USER) else b"")
                scores.append(score)
        self.surface, self.scores = surface, scores
        self.longest = max(map(len, self.ids))
        self.unknown = min(scores[i] for i in self.ids.values()) - 10
        # The score of every piece, and None for what only begins one: a search ends where neither is found.
        self.table: dict[str, float | None] = {p[:n]: None for p in self.ids for n in range(1, len(p))}
        self.table |= {p: scores[i] for p, i in self.ids.items()}
        # Where no piece spans a boundary, the parts on both sides are encoded apart.
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids)
        self.part = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n") if apart else re.compile("(?s).+")
        # Texts of known characters alone are matched by an automaton of all pieces.
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matches.add_word(p, (len(p), scores[i]))
        self.matches.make_automaton()
        self.odd = re.compile("[^" + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]")
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cache: dict[str, tuple[bytes, float]] = {}
        self.cached = 0

    def normal(self, text: str) -> str:
        """What is segmented: spaces become U+2581, with one more before the text."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _unknown_ids(self, c: str) -> list[int]:
        return [self.bytes_id.get(b, 0) for b in c.encode("utf-8", "surrogatepass")]

    def lattice(self, text: str, n: int, entry: np.ndarray | None = None) -> tuple[list[float], list[int]]:
        """Best scores at each place of text, and the start of the last piece (-1: an entry); pieces start before n."""
        best = [_NONE] * (len(text) + 1)
        back = [-1] * (len(text) + 1)
        if entry is None:
            best[0] = 0.0
        else:
            for i, x in enumerate(entry[: len(text) + 1]):
                best[i] = float(x)
        if not self.odd.search(text):
            # All matches by their ends, the longest first.
            for e, (size, score) in self.matches.iter(text):
                s = e + 1 - size
                x = best[s] + score
                if x > best[e + 1] and s < n:
                    best[e + 1], back[e + 1] = x, s
            return best, back
        get, end = self.table.get, len(text)
        for s in range(n):
            own = best[s]
            if own == _NONE:
                continue
            e = s + 1
            score = get(text[s:e], False)
            if score is None or score is False:
                if own + self.unknown > best[e]:
                    best[e], back[e] = own + self.unknown, s
            while score is not False:
                if score is not None and own + score > best[e]:
                    best[e], back[e] = own + score, s
                if e == end:
                    break
                e += 1
                score = get(text[s:e], False)
        return best, back

    def traced(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """The ids of the pieces up to end, and the place where they begin."""
        out: list[int] = []
        while back[end] >= 0:
            piece = text[back[end] : end]
            i = self.ids.get(piece)
            out += [i] if i is not None else self._unknown_ids(piece)[::-1]
            end = back[end]
        return out[::-1], end

    def parts(self, names: list[str]) -> tuple[bytes, float]:
        """The ids (int32, joined) and the score of parts that stand apart."""
        if self.cached > _CACHE:
            self.cache.clear()
            self.cached = 0
        got = list(map(self.cache.get, names))
        if None in got:
            get = self.cache.get
            got = [g or get(p) or self._learn(p) for p, g in zip(names, got)]
        ids, scores = zip(*got) if got else ((), ())
        return b"".join(ids), sum(scores)

    def _learn(self, p: str) -> tuple[bytes, float]:
        """The entry of a part. Last characters that no piece joins to what stands before them have entries of their own."""
        n = len(p)
        while n > 1 and p[n - 2 : n] not in self.inside:
            n -= 1
        if n < len(p):
            ends = [self.cache.get(x) or self._learn(x) for x in (p[:n], *p[n:])]
            found = b"".join([e[0] for e in ends]), sum([e[1] for e in ends])
        else:
            best, back = self.lattice(p, n)
            found = array("i", self.traced(p, back, n)[0]).tobytes(), best[-1]
        if len(p) <= _CACHED:
            self.cache[p] = found
            self.cached += len(p) + 40
        return found

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        ids, score = self.parts(self.part.findall(self.normal(text)))
        return np.frombuffer(ids, "<i4"), score

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def _ends(self, chunk: str) -> tuple[int, int, list[str]]:
        """The first and the last boundary inside a chunk that no piece spans, and the parts between; (-1, -1, []): fewer than two."""
        names = self.part.findall(chunk)
        if len(names) < 3:
            return -1, -1, []
        return len(names[0]), len(chunk) - len(names[-1]), names[1:-1]

    def matrix(self, chunk: str, ahead: str) -> np.ndarray:
        """Best scores from each state at the chunk's start to each at its end."""
        size, n = self.longest, len(chunk)
        out = np.full((size, size), _NONE)
        p, q, names = self._ends(chunk)
        unit = lambda i: np.where(np.arange(size) == i, 0.0, _NONE)
        if p < 0:
            for i in range(min(size, n + 1)):
                best, _ = self.lattice(chunk + ahead, n, unit(i))
                out[i, : len(best) - n] = best[n : n + size]
            for i in range(n + 1, size):  # a piece that reaches beyond a short chunk
                out[i, i - n] = 0.0
            return out
        tail = np.full(size, _NONE)
        best, _ = self.lattice(chunk[q:] + ahead, n - q)
        tail[: len(best) - (n - q)] = best[n - q : n - q + size]
        middle = self.parts(names)[1]
        for i in range(min(size, p + 1)):
            out[i] = self.lattice(chunk[:p], p, unit(i))[0][p] + middle + tail
        return out

    def entries(self, chunk: str, ahead: str, entry: np.ndarray) -> np.ndarray:
        """The state at a chunk's start that each state at its end is traced back to, given the best scores up to its start; -1: not reached."""
        n = len(chunk)
        p, _, _ = self._ends(chunk)
        if p >= 0:  # whatever the end, the trace passes this boundary
            return np.full(self.longest, self.traced(chunk[:p], self.lattice(chunk[:p], p, entry)[1], p)[1])
        best, back = self.lattice(chunk + ahead, n, entry)
        return np.array([self.traced(chunk + ahead, back, n + j)[1] if n + j < len(best) and best[n + j] > _NONE else -1 for j in range(self.longest)])

    def back(self, chunk: str, ahead: str, entry: np.ndarray, leave: int) -> bytes:
        """The ids of a chunk's pieces (int32, joined) up to a state at its end, given the best scores up to its start."""
        n = len(chunk)
        p, q, names = self._ends(chunk)
        pack = lambda x: array("i", x).tobytes()
        whole = chunk + ahead
        if p < 0:
            return pack(self.traced(whole, self.lattice(whole, n, entry)[1], n + leave)[0])
        head = self.traced(chunk[:p], self.lattice(chunk[:p], p, entry)[1], p)[0]
        tail = self.traced(whole[q:], self.lattice(whole[q:], n - q)[1], n - q + leave)[0]
        return pack(head) + self.parts(names)[0] + pack(tail)


@once_a_process
def pieces(path: str) -> Pieces:
    return Pieces(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def prefixes(matrices: list[np.ndarray], entry: np.ndarray) -> list[np.ndarray]:
    """The best scores of all states at every cut, the first one (entry) and the last one included."""
    out = [entry]
    for m in matrices:
        out.append((out[-1][:, None] + m).max(axis=0))
    return out


def followed(maps: list[np.ndarray], leave: int) -> list[int]:
    """The states at all cuts, from the first to the last one (leave), by maps from the state at an end to that at the start."""
    out = [leave]
    for m in maps[::-1]:
        out.append(int(m[out[-1]]))
    return out[::-1]


def composed(maps: list[np.ndarray]) -> np.ndarray:
    """One map in place of several that follow one another; -1 stays -1."""
    out = np.arange(len(maps[0]))
    for m in maps[::-1]:
        out = np.where(out >= 0, m[out], -1)
    return out


def _giants(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """(text_key, ids, score) of (text_key, text): each text by its chunks."""
    size = pieces(path).longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                line = own.normal(text)
                for k, i in enumerate(range(0, len(line), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int64()), pa.array([line[i : i + chunk]]), pa.array([line[i + chunk : i + chunk + own.longest - 1]])], names=["text_key", "k", "chunk", "ahead"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            m = [own.matrix(c, a).ravel() for c, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m, pa.list_(pa.float64()))], names=["text_key", "k", "chunk", "ahead", "m"])

    # Cut first and dealt out again: the chunks of one text go to many tasks.
    chunks = texts.mapInArrow(cut, "text_key string, k long, chunk string, ahead string").repartition("text_key", "k")
    chunks = kept(chunks.mapInArrow(score, "text_key string, k long, chunk string, ahead string, m array<double>"))
    square = lambda column: [np.asarray(m, dtype=float).reshape(size, size) for m in column]

    first = np.where(np.arange(size) == 0, 0.0, _NONE)

    def run_product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"text_key": pdf["text_key"][:1], "run": pdf["run"][:1], "m": [functools.reduce(product, square(pdf["m"])).ravel()]})

    def run_entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        entry = prefixes(square(pdf["m"]), first)
        return pd.DataFrame({"text_key": pdf["text_key"], "run": pdf["run"], "entry": entry[:-1], "score": entry[-1][0]})

    def chunk_entries(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("k")
        entry = prefixes(square(left["m"]), np.asarray(right["entry"].iloc[0], dtype=float))
        return pd.DataFrame({"text_key": left["text_key"], "k": left["k"], "run": left["run"], "entry": entry[:-1], "score": right["score"].iloc[0]})

    def map_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            found = [own.entries(c, a, np.asarray(e)) for c, a, e in zip(*(b.column(i).to_pylist() for i in (2, 3, 5)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=["text_key", "k", "chunk", "ahead", "run", "entry", "score", "origin"])

    maps = lambda column: [np.asarray(m, dtype=np.int64) for m in column]

    def run_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"text_key": pdf["text_key"][:1], "run": pdf["run"][:1], "origin": [composed(maps(pdf["origin"]))]})

    def run_leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        return pd.DataFrame({"text_key": pdf["text_key"], "run": pdf["run"], "leave": followed(maps(pdf["origin"]), 0)[1:]})

    def chunk_leaves(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("k")
        return pd.DataFrame({"text_key": left["text_key"], "k": left["k"], "leave": followed(maps(left["origin"]), int(right["leave"].iloc[0]))[1:]})

    # Up: products by run, scores at the runs' and then at the chunks' starts.
    runs = chunks.select("text_key", "k", F.floor(F.col("k") / RUN).alias("run"), "m")
    entry = runs.groupBy("text_key", "run").applyInPandas(run_product, "text_key string, run long, m array<double>").groupBy("text_key").applyInPandas(run_entries, "text_key string, run long, entry array<double>, score double")
    entry = runs.groupBy("text_key", "run").cogroup(entry.groupBy("text_key", "run")).applyInPandas(chunk_entries, "text_key string, k long, run long, entry array<double>, score double")
    known = chunks.drop("m").join(entry, ["text_key", "k"])
    known = kept(known.mapInArrow(map_back, "text_key string, k long, chunk string, ahead string, run long, entry array<double>, score double, origin array<long>"))
    # Down: maps by run, states at the runs' and then at the chunks' ends.
    back = known.select("text_key", "k", "run", "origin")
    leave = back.groupBy("text_key", "run").applyInPandas(run_map, "text_key string, run long, origin array<long>").groupBy("text_key").applyInPandas(run_leaves, "text_key string, run long, leave int")
    leave = back.groupBy("text_key", "run").cogroup(leave.groupBy("text_key", "run")).applyInPandas(chunk_leaves, "text_key string, k long, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            ids = [np.frombuffer(own.back(c, a, np.asarray(e), leave), "<i4") for c, a, e, leave in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 6)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), pa.array(ids, pa.list_(pa.int32()))], names=["text_key", "k", "score", "ids"])

    traced = known.drop("run", "origin").join(leave, ["text_key", "k"]).mapInArrow(trace, "text_key string, k long, score double, ids array<int>")
    rows = F.array_sort(F.collect_list(F.struct("k", "ids")))
    return traced.groupBy("text_key").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"), F.first("score").alias("score"))


def encoded(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, score): the pieces of every whole text and the sum of their scores; null for a null text."""
    path = path or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    large = F.coalesce(F.length("text") > giant, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            found, scores, lengths = [], [], []
            for t in b.column(1):
                t = t.as_py()
                ids, s = own.encode(t or "")
                found.append(ids)
                scores.append(None if t is None else float(s))
                lengths.append(None if t is None else len(ids))
            at = np.concatenate(([0], np.cumsum([n or 0 for n in lengths]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)), mask=pa.array([n is None for n in lengths]))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(scores, pa.float64())], names=["doc_id", "ids", "score"])

    small = rows.where(~large).mapInArrow(run, "doc_id long, ids array<int>, score double")
    big = rows.where(large).withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))
    by = _giants(big.select("text_key", "text").dropDuplicates(["text_key"]), path, chunk)
    return small.unionAll(big.select("doc_id", "text_key").join(by, "text_key").select("doc_id", "ids", "score"))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (doc_id, ids, score) with text: what the pieces spell."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            ids = b.column(1)
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
            text = [own.decode(flat[i:j].tolist()) if there else None for i, j, there in zip(at, at[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=["doc_id", "ids", "score", "text"])

    return rows.select("doc_id", "ids", "score").mapInArrow(run, "doc_id long, ids array<int>, score double, text string")
