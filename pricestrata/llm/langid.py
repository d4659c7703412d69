"""Language identification: words first, then ever shorter character n-grams.

A word seen in training scores by its log frequency in each language. An unseen word backs off to its
n-grams of the greatest length of which any was seen: GRAMS characters, then fewer, down to one.
Scores are log posteriors under equal priors, added up over the words of the whole text. A word is a
letter and the letters and combining marks that follow it.

The model is fitted on a bounded sample: of each language the SAMPLE_ROWS labelled rows of the
smallest md5 of doc_id, of which whole texts count. Words are counted on the executors. The model holds
the most frequent words and n-grams of each length, CELLS numbers (words times languages) at most of
each. Every document is then predicted from its text alone.

Nulls and texts without letters are `und` with score 0; ties go to the first language by name.
Rows without id or lang, or held out, are never learnt from, and repeated ones count once; with nothing
to learn from, all are `und`. Repeated rows get equal predictions. Other columns are not read. An empty
table stays empty.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, once_a_process

SAMPLE_ROWS = 500
CELLS = 8_000_000
#: Languages whose row counts may be broadcast; more are joined by a shuffle.
BROADCAST_LANGS = 10_000
GRAMS = 4
UNKNOWN = "und"
_CACHE = 300_000
_FLUSH = 300_000


#: What ASCII letters become in lower case, and a space for every other byte.
_ASCII = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LAST_SHORT = 0xFFFF


@once_a_process
def word_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """A letter (Unicode category L), then letters and marks (M); of the code points up to `last`."""

    def ranges(kinds: str) -> str:
        out, first = [], None
        for c in range(last + 2):
            inside = c <= last and unicodedata.category(chr(c))[0] in kinds
            if inside and first is None:
                first = c
            elif not inside and first is not None:
                out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
                first = None
        return "".join(out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case: what word_pattern() finds.

    Ranges above 0xFFFF are tried one by one at each end of a word, so texts without such characters have a pattern without these ranges.
    """
    line = text or ""
    if line.isascii():
        return line.encode().translate(_ASCII).decode().split()
    line = line.lower()
    short = len(line.encode("utf-16-le", "surrogatepass")) == 2 * len(line)
    return word_pattern(*[_LAST_SHORT] * short).findall(line)


class Model:
    """words and grams give rows of scores: log posteriors of the languages. Made of plain values, so that workers need no code to load it."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: list[dict[str, int]], scores: np.ndarray) -> None:
        self.langs, self.words, self.grams, self.scores = langs, words, grams, scores

    @property
    def parts(self) -> tuple:
        return self.langs, self.words, self.grams, self.scores

    @classmethod
    def fitted(cls, counted: list[tuple[str, str, int]]) -> Model:
        """Of (lang, word, n)."""
        langs = sorted({lang for lang, _, _ in counted})
        at = {lang: i for i, lang in enumerate(langs)}
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(at)))
        grams: list[dict] = [defaultdict(lambda: np.zeros(len(at))) for _ in range(GRAMS + 1)]
        for lang, w, n in counted:
            words[w][at[lang]] += n
        for w, n in words.items():
            for g in _grams(w):
                grams[len(g)][g] += n
        rows: list[np.ndarray] = []
        tables = [cls._table(t, rows, len(at)) for t in (words, *grams)]
        return cls(langs, tables[0], tables[1:], np.array(rows, dtype=np.float32) if rows else np.zeros((0, len(at)), np.float32))

    @staticmethod
    def _table(counts: dict[str, np.ndarray], rows: list, langs: int) -> dict[str, int]:
        """Rows of what was seen twice or more, and is among the most frequent."""
        total = sorted(((-n.sum(), k) for k, n in counts.items() if n.sum() >= 2))[: CELLS // max(1, langs)]
        if not total:
            return {}
        n = np.array([counts[k] for _, k in total])
        p = np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * len(n))
        p -= p.max(axis=1, keepdims=True)
        p -= np.log(np.exp(p).sum(axis=1, keepdims=True))
        first = len(rows)
        rows.extend(p)
        return {k: first + i for i, (_, k) in enumerate(total)}

    def rows_of(self, word: str) -> list[int]:
        """The rows that a word scores by: its own, or those of its longest n-grams seen."""
        if (row := self.words.get(word)) is not None:
            return [row]
        for size in range(GRAMS, 0, -1):
            table = self.grams[size]
            if found := [r for g in _grams(word, size) if (r := table.get(g)) is not None]:
                return found
        return []

    def predict(self, text: str | None, cache: dict[str, list[int]]) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        found = list(map(cache.get, counts))
        if None in found:
            for i, w in enumerate(counts):
                if found[i] is None:
                    if len(cache) >= _CACHE:
                        cache.clear()
                    found[i] = self.rows_of(w)
                    if len(w) < 64:
                        cache[w] = found[i]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rows = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        share = np.fromiter(counts.values(), np.float64, len(found)) / np.maximum(sizes, 1)
        total = np.repeat(share, sizes) @ self.scores[rows]
        best = int(np.argmax(total))
        mean = (total - total[best]) / counts.total()
        return self.langs[best], 1.0 / math.fsum(np.exp(mean))


def _grams(word: str, size: int | None = None) -> Iterator[str]:
    """The n-grams of a word between spaces (of one size, or of all); single characters are the word's own."""
    padded = f" {word} "
    for k in range(1, GRAMS + 1) if size is None else (size,):
        line = word if k == 1 else padded
        for i in range(len(line) - k + 1):
            yield line[i : i + k]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text) of the bounded training sample.

    Each language's rows are first cut to those whose hash is below a bound that leaves a little more than
    the sample, whatever their number, so that no task ranks a whole language.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.select("lang", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = kept(own.groupBy("lang").agg((F.lit(rows + 10 * math.sqrt(rows) + 10) / F.count("*")).alias("share")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGS else counts
    md5 = F.md5(F.col("doc_id").cast("string").cast("binary"))
    place = F.conv(F.substring(md5, 1, 13), 16, 10).cast("double") / float(2**52)
    some = own.join(counts, "lang").where(place < F.col("share")).withColumn("key", F.xxhash64("text")).dropDuplicates(["lang", "doc_id", "key"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(md5, "doc_id", "key"))
    return some.withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "text")


def learnt(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model fitted on the sample of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def batch() -> pa.RecordBatch:
            langs, words = zip(*own) if own else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                own.update((lang, w) for w in words_of(text.as_py()))
                if len(own) > _FLUSH:
                    yield batch()
                    own.clear()
        yield batch()

    counted = kept(sampled(docs, rows).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    # How many words have each count, to send no more than the model can hold to the driver.
    least, room = 1 << 62, CELLS
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    return Model.fitted([tuple(r) for r in counted.where(F.col("n") >= least).collect()])


def clear(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, with all their columns, of which a language is told with a score of least or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)

    @F.pandas_udf("boolean")
    def told(texts):
        import pandas as pd

        cache: dict[str, list[int]] = {}
        own = Model(*shared.value)
        found = (own.predict(t, cache) for t in texts)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in found], dtype=bool)

    return docs.where(told(F.col("text").cast("string")))


def identified(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model fitted on a sample of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt(docs, rows).parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        own = Model(*shared.value)
        for b in batches:
            got = [own.predict(t.as_py(), cache) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
