"""Secrets in texts: base patterns, and random strings that a tokenizer can't shorten.

Base kinds are assign, access and hex. The token-efficiency test adds kind random: a run of key-like
characters is one if its characters per token under a byte-pair vocabulary stay at RATIO or below,
since a vocabulary learnt from text has long tokens for text and short ones for noise. A name or path
glued to a key would hide it in the mean, so the parts of a run between separators are tested like the
run itself, the longest first. Known digests (hex of a digest's length), UUIDs and numbers are excluded
first, and what overlaps a base span stays that span alone.

Nulls count as empty texts. Repeated rows get equal rows. Columns other than doc_id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_spans, once_a_process

VOCABULARY = "byte_bpe_50k.tiktoken"
RATIO = 1.9
LEAST = 20
#: Longer runs are judged by the mean over pieces of this length, so none costs more than its length.
PIECE = 512

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the greedy runs of 32 and more
RUN = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % LEAST)
#: What parts a run, from its whole to its smallest parts: a key may itself hold characters that part others.
PARTS = [re.compile(p) for p in (r"[A-Za-z0-9+/=_-]+", r"[A-Za-z0-9+/_-]+", r"[A-Za-z0-9+_-]+", r"[A-Za-z0-9+/]+", r"[A-Za-z0-9+]+")]
WORDS = ("passw", "secret", "token", "apikey", "api_key")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
KINDS = ("assign", "access", "hex", "random")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@once_a_process
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Whether a run is of a kind that is no secret by its form."""
    plain = run.strip("-_=+/")
    if re.fullmatch("[0-9a-fA-F]+", plain) and len(plain) in DIGESTS or UUID.fullmatch(plain):
        return True
    return not re.search("[A-Za-z]", plain)


def ratio(run: str, enc) -> float:
    return len(run) / sum(len(enc.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]


def random_parts(run: str, enc, most: float, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places of a run's random parts outside what is taken; of parts within one another, the longest random one."""
    out, tested = [], set()
    for part in PARTS if not known(run) else ():
        for m in part.finditer(run):
            a, b = m.span()
            if b - a < LEAST or m.span() in tested or any(s < b and a < e for s, e in out + taken):
                continue
            tested.add(m.span())
            if not known(m[0]) and ratio(m[0], enc) <= most:
                out.append(m.span())
    return sorted(out)


def all_spans(text: str, enc, most: float = RATIO) -> tuple[list, list]:
    """The base spans, and those that token efficiency adds."""
    base = base_spans(text)
    more = []
    for m in RUN.finditer(text):
        at = m.start()
        taken = [(s - at, e - at) for s, _, e, _ in base if s < m.end() and at < e]
        more += [(at + a, 3, at + b, "random") for a, b in random_parts(m[0], enc, most, taken)]
    return base, more


def scanned(docs: DataFrame, path: str | None = None, most: float = RATIO) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base, spans); base and spans are strings of kind:start:end."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = []
            for t in b.column(1):
                base, more = all_spans(t.as_py() or "", enc, most)
                n = [sum(k == kind for _, _, _, k in base + more) for kind in KINDS]
                rows.append((*n, joined_spans(base), joined_spans(base + more)))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def without_secrets(docs: DataFrame, path: str | None = None, most: float = RATIO) -> DataFrame:
    """The rows of docs, with all their columns, whose texts hold no secret."""
    path = path or vocabulary_path()

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        enc = encoder(path)
        return pd.Series([not any(all_spans(t or "", enc, most)) for t in texts], dtype=bool)

    return docs.where(clean(F.col("text").cast("string")))
