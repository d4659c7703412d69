"""Chroma audio fingerprints, and the alignment of recordings by them.

A recording's samples are cut into overlapping frames, and each frame's spectrum is folded into twelve
pitch classes. Filters, boxes of added and subtracted classes and frames, are read off an integral
image of these; each gives two bits, and a place's sixteen filters one packed 32-bit integer.

Two recordings are compared if they share a mark: two packed integers APART places apart, or, for two
recordings of SHORT integers or fewer, a single one. Equal marks vote for offsets, every place of a mark
counting; at the offset of most votes the differing bits of every place of the overlap give the best
segment, the run of places with the largest sum of (MOST_BITS - differing bits). Recordings align if that
segment has LEAST places, or, of short recordings, half of the longer one's, and no more than ERROR of its
bits differ. Recordings of one fingerprint form a class, named by its smallest id; classes are compared.

Silence gives no marks. Null recordings and those of fewer than frame + (WIDTH - 1) * hop samples have no
integers and align with nothing. Very long ones are read in blocks of frames, and a mark that repeats in
both of two votes by a Fourier transform, so that a steady tone takes no square of its length. Recordings without an id are members of their class, but name none and
are no queries. Repeated rows fall into one class. Columns other than the two named are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, once_a_process

RATE = 11_025
FRAME = 256
HOP = 64
CLASSES = 12
WIDTH = 8
#: A mark is two packed integers so many places apart: together they rarely agree by chance.
APART = 8
LOWEST, HIGHEST = 28.0, 3520.0
#: Recordings of so many integers or fewer also meet by single ones.
SHORT = 16
#: Places of the best segment, what its differing bits are held against place by place, and the share that may differ in all.
LEAST, MOST_BITS, ERROR = 9, 10, 0.25
#: A mark's pairs are dealt out to so many tasks, since many recordings may share it.
SALTS = 16
_BLOCK = 4096


class Sound(NamedTuple):
    """How a media column's bytes are read: mono samples of 8 bits (unsigned) or 16 (signed, little-endian), and the frames cut of them.

    A frame of n samples tells pitches rate / n apart: semitones above 17 * rate / n.
    """

    rate: int = RATE
    frame: int = FRAME
    hop: int = HOP
    bits: int = 8


#: Texts as samples; the frames are short, as texts are.
TEXT = Sound()
#: Music of 16 bits: semitones from 46 Hz up, eight frames a second.
MUSIC = Sound(11_025, 4096, 1365, 16)


@once_a_process
def fold(rate: int, frame: int) -> np.ndarray:
    """(bins, CLASSES): which pitch class each bin of the spectrum counts for."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(f), CLASSES))
    at = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[at, np.round(CLASSES * np.log2(f[at] / 440.0)).astype(int) % CLASSES] = 1
    return out


def filters() -> list[tuple[list[tuple[int, int, int, int, int]], float]]:
    """(boxes, threshold) of the sixteen filters; a box is (sign, first frame, last, first class, last).

    Made by a rule: four shapes (halves in time, halves in pitch, quarters, middle third in time), each
    at four heights and places, so that they cover all classes and several widths.
    """
    out = []
    for i in range(16):
        shape, k = i % 4, i // 4
        width, height = (WIDTH, WIDTH // 2, WIDTH - 2, WIDTH)[k], (4, 6, 8, 12)[k]
        y = (5 * i) % (CLASSES - height + 1)
        w, h = width // 2, height // 2
        boxes = {
            0: [(1, 0, w, y, y + height), (-1, w, width, y, y + height)],
            1: [(1, 0, width, y, y + h), (-1, 0, width, y + h, y + height)],
            2: [(1, 0, w, y, y + h), (1, w, width, y + h, y + height), (-1, w, width, y, y + h), (-1, 0, w, y + h, y + height)],
            3: [(1, w - 1, w + 1, y, y + height), (-1, 0, w - 1, y, y + height), (-1, w + 1, width, y, y + height)],
        }[shape]
        out.append((boxes, 0.1))
    return out


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, CLASSES): each frame's share of energy by pitch class; zeros for silence."""
    n = (len(samples) - frame) // hop + 1
    if n < 1:
        return np.zeros((0, CLASSES))
    windows = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop][:n]
    shape = np.hanning(frame).astype(np.float32)
    parts = []
    for i in range(0, n, _BLOCK):
        power = np.abs(np.fft.rfft((windows[i : i + _BLOCK] - windows[i : i + _BLOCK].mean(axis=1, keepdims=True)) * shape)) ** 2
        parts.append(power @ fold(rate, frame))
    out = np.concatenate(parts)
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-6), 0.0)


def packed(frames: np.ndarray) -> np.ndarray:
    """The packed integers (int64, of 32 bits) of a recording's frames."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    for boxes, threshold in filters():
        plus = minus = 0.0
        for sign, a, b, y, z in boxes:
            area = image[at + b, z] - image[at + a, z] - image[at + b, y] + image[at + a, y]
            plus, minus = (plus + area, minus) if sign > 0 else (plus, minus + area)
        value = np.round(np.log1p(plus) - np.log1p(minus), 9)
        level = (value > -threshold).astype(np.int64) + (value > 0) + (value > threshold)
        out = out << 2 | level ^ level >> 1  # neighbouring levels differ in one bit
    return out


@once_a_process
def silence() -> int:
    """The packed integer of silence."""
    return int(packed(np.zeros((WIDTH, CLASSES)))[0])


def marks(hashes: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(marks, places) of a recording: pairs of integers, or single ones; none where an integer is silence."""
    h = hashes.astype(np.int64)
    at = np.arange(len(h) if single else max(0, len(h) - APART))
    heard = h[at] != silence()
    if single:
        return h[at][heard], at[heard]
    heard &= h[at + APART] != silence()
    at = at[heard]
    return h[at] << 32 | h[at + APART], at


def _repeated(m: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The marks with more pairs of places than a transform of all places has steps."""
    (own, k), (other, l) = np.unique(m, return_counts=True), np.unique(n, return_counts=True)
    both, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
    return both[k[i] * l[j] > 4 * size * np.log2(max(size, 2))]


def _correlated(p: np.ndarray, q: np.ndarray, a: int, b: int) -> np.ndarray:
    """How many pairs of places p below a and q below b lie at each offset p - q + b."""
    size = 1 << (a + b).bit_length()
    x, y = (np.bincount(at, minlength=size).astype(float) for at in (p, b - q))
    return np.rint(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)).astype(np.int64)[: a + b]


def histogram(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Votes by offset of two recordings' packed integers: every two places of an equal mark vote."""
    single = max(len(a), len(b)) <= SHORT
    (m, p), (n, q) = marks(a, single), marks(b, single)
    order = np.argsort(n, kind="stable")
    n, q = n[order], q[order]
    left, right = np.searchsorted(n, m, "left"), np.searchsorted(n, m, "right")
    votes = np.zeros(len(a) + len(b), dtype=np.int64)
    much = np.isin(m, _repeated(m, n, len(votes)))
    for i in np.flatnonzero((right > left) & ~much):
        votes[p[i] - q[left[i] : right[i]] + len(b)] += 1  # places of one mark differ
    for mark in np.unique(m[much]):
        votes += _correlated(p[m == mark], q[n == mark], len(a), len(b))
    return {int(o) - len(b): int(votes[o]) for o in np.flatnonzero(votes)}


def compared(a: np.ndarray, b: np.ndarray) -> tuple | None:
    """(offset, votes, overlap, bit_errors, start, length, segment_errors) if two recordings align.

    offset: the place of a at which b's first one lies; of those with equal votes the smallest in size,
    then the earlier. bit_errors: the share of differing bits over the whole overlap. start (a place of a)
    and length: the best segment, the earliest of equal ones.
    """
    votes = histogram(a, b)
    if not votes:
        return None
    offset = min(votes, key=lambda o: (-votes[o], abs(o), o))
    first, other = max(offset, 0), max(-offset, 0)
    n = min(len(a) - first, len(b) - other)
    bits = np.bitwise_count(a[first : first + n].astype(np.int64) ^ b[other : other + n].astype(np.int64)).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(MOST_BITS - bits)))
    gain = total - np.minimum.accumulate(total)
    end = int(np.argmax(gain))
    start = int(np.argmin(total[: end + 1]))
    length = end - start
    wrong = int(bits[start:end].sum())
    needed = min(LEAST, -(-max(len(a), len(b)) // 2))
    if length < needed or wrong > ERROR * 32 * length:
        return None
    return offset, votes[offset], n, bits.sum() / (32 * n), first + start, length, wrong / (32 * length)


def samples_of(raw: bytes, bits: int = 8) -> np.ndarray:
    """Mono samples of -1 to 1; of 16 bits a last odd byte goes."""
    if bits == 16:
        return np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.float32) / 32768
    return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128


def fingerprints(recordings: DataFrame, media: Column, key: str = "doc_id", sound: Sound = TEXT) -> DataFrame:
    """(rec_id, n_frames, hashes) of a media column of samples; hashes are packed, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found = [], []
            for raw in b.column(1):
                frames = chroma(samples_of(raw.as_py() or b"", sound.bits), sound.rate, sound.frame, sound.hop)
                n.append(len(frames))
                found.append(packed(frames).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["rec_id", "n_frames", "hashes"])

    return recordings.select(F.col(key).cast("long"), media.cast("binary")).mapInArrow(run, "rec_id long, n_frames long, hashes binary")


def unpacked(hashes: bytes) -> np.ndarray:
    return np.frombuffer(hashes, "<u4").astype(np.int64)


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rec_id, n_frames, n_hashes, fp_key) of all recordings, and (fp_key, class_id, members, hashes) of distinct fingerprints."""
    size = F.octet_length("hashes")
    none = F.concat(F.lit("none "), F.pmod(F.xxhash64("rec_id"), F.lit(4096)).cast("string"))  # many recordings may have no integers
    keyed = prints.withColumn("fp_key", F.when(size > 0, F.sha2("hashes", 256)).otherwise(none))
    by = keyed.where(size > 0).groupBy("fp_key").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("members"), F.first("hashes").alias("hashes"))
    return keyed.select("rec_id", "n_frames", F.floor(size / 4).cast("int").alias("n_hashes"), "fp_key"), by


def marked(by: DataFrame, name: str) -> DataFrame:
    """(name, single, mark): the distinct marks of classes (class_id, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, single, found = [], [], []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = unpacked(raw)
                for one in (False, True) if len(h) <= SHORT else (False,):
                    own = np.unique(marks(h, one)[0])
                    ids.append(np.full(len(own), i))
                    single.append(np.full(len(own), one))
                    found.append(own)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(single), pa.bool_()), pa.array(np.concatenate(found), pa.int64())], names=[name, "single", "mark"])

    return by.where(F.col("class_id").isNotNull()).select("class_id", "hashes").mapInArrow(run, f"{name} long, single boolean, mark long")


def alignments(asked: DataFrame, all_of: DataFrame) -> DataFrame:
    """(query_class, class_id, offset, votes, overlap, bit_errors, start, length, segment_errors): the classes that align with those asked.

    Both sides: (class_id, hashes). See compared() for the columns.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    q = marked(asked, "query_class").withColumn("salt", salts)
    every = marked(all_of, "class_id").withColumn("salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int"))
    pairs = q.join(every, ["mark", "single", "salt"]).where("query_class <> class_id").select("query_class", "class_id").distinct()
    both = kept(pairs).join(asked.select(F.col("class_id").alias("query_class"), F.col("hashes").alias("a")), "query_class").join(all_of.select("class_id", F.col("hashes").alias("b")), "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for one, other, x, y in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = compared(unpacked(x), unpacked(y))
                if found:
                    out.append((one, other, *found))
            columns = list(zip(*out)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], names=list(_TYPES))

    return both.select("query_class", "class_id", "a", "b").mapInArrow(run, "query_class long, class_id long, offset int, votes long, overlap int, bit_errors double, start int, length int, segment_errors double")


_TYPES = {
    "query_class": pa.int64(), "class_id": pa.int64(), "offset": pa.int32(), "votes": pa.int64(), "overlap": pa.int32(),
    "bit_errors": pa.float64(), "start": pa.int32(), "length": pa.int32(), "segment_errors": pa.float64(),
}


def matched(recordings: DataFrame, media: Column, is_query: Column, key: str = "doc_id", sound: Sound = TEXT) -> DataFrame:
    """A row for each recording, with its class, and for queries what aligns with that class and how the best of it does.

    links: the other classes that align; linked_recordings: their members; best_class is the one of the
    longest segment, then the fewest differing bits, then the smallest id. All of these are null for
    recordings that are no query, and best_class also where nothing aligns.
    """
    rows, by = classes(kept(fingerprints(recordings, media, key, sound)))
    by = kept(by)
    rows = rows.join(by.select("fp_key", "class_id", "members"), "fp_key", "left").drop("fp_key")
    rows = kept(rows.select("rec_id", "n_frames", "n_hashes", "class_id", "members", F.coalesce(is_query, F.lit(False)).alias("is_query")))
    asked = by.join(rows.where("is_query").select("class_id").distinct(), "class_id", "left_semi")
    found = alignments(asked, by).join(by.select("class_id", "members"), "class_id")
    best = F.min(F.struct((-F.col("length")).alias("l"), "segment_errors", F.col("class_id").alias("best_class"), "offset", "votes", "overlap", "bit_errors", "start", "length")).alias("b")
    links = found.groupBy(F.col("query_class").alias("class_id")).agg(F.count("*").alias("links"), F.sum("members").alias("linked_recordings"), best)
    of_best = ["best_class", "offset", "votes", "overlap", "bit_errors", "start", "length", "segment_errors"]
    some = [F.when(F.col("n_hashes") > 0, F.coalesce(c, F.lit(0))).alias(c) for c in ("links", "linked_recordings")]
    told = rows.where("is_query").join(links, "class_id", "left").select(*rows.columns, *some, *(F.col(f"b.{c}").alias(c) for c in of_best))
    return told.unionByName(rows.where(~F.col("is_query")), allowMissingColumns=True)
