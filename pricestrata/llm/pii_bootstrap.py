"""Personal data by base patterns, and by contexts bootstrapped from them. DataFrame functions only.

Base spans are the seeds. A seed's lexical patterns are the word to its left and the word to its
right. Candidates are identifier-like runs that no base span covers. Patterns and instances form a
graph; a pattern scores the share of its occurrences, among all words of all documents and what
precedes a boundary in them, that stand beside trusted instances, and an instance the chance that one of its trusted patterns is
right. ROUNDS turns pass trust from seeds to patterns to instances. A candidate beside a pattern of
TRUST or more, seen with SUPPORT distinct instances at least, becomes a span of kind context.

Nulls count as empty texts. Repeated rows get equal rows. Columns other than doc_id and text are not
read. Positions are code points. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

ROUNDS = 2
TRUST = 0.8
SUPPORT = 5
KINDS = ("email", "ip", "card", "phone", "context")

# A dot or separator that joins its neighbours is marked (JOIN) before matching: repeated groups
# become one class, which Java matches without recursion however long the run is.
JOIN, OTHER = "\x01", "\x02"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What every text with a candidate has; and where a candidate may begin within a word.
LIKELY = r"[0-9](?:[^0-9]*+[0-9]){3}"
BOUNDARY = r"(?<=[^A-Za-z0-9_@.+-])(?=[A-Za-z0-9_@.+-])"
CANDIDATE = r"(?<![A-Za-z0-9_@.+-])(?=[A-Za-z_@.+-]*+[0-9])[A-Za-z0-9_@.+-]++"

_SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def found(text: Column, pattern: str, kind: str, valid) -> Column:
    """The leftmost non-overlapping matches of pattern for which valid(match) holds, as _SPANS.

    Each find takes the gap before a match too; places are running sums of both lengths.
    """
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)")
    parts = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"))
    none = F.array().cast(_SPANS)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("place"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when((F.length(x["hit"]) > 0) & valid(x["hit"]), F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """The spans of the four base kinds, by start and then kind. A search runs where its cheap precondition holds."""
    none = F.array().cast(_SPANS)
    plain = F.translate(text, JOIN, OTHER)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    carded = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", JOIN)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    octets = lambda x: F.forall(F.split(x, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.expr("try_cast(0 as int)") + F.substring(F.lpad(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), 9, "0"), -3, 3).cast("int"), F.lit(999)) <= 255)
    by = [
        F.when(F.contains(text, F.lit("@")), found(dotted, EMAIL, "email", lambda x: F.lit(True))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), found(text, IP, "ip", octets)).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), found(carded, CARD, "card", lambda x: F.length(digits(x)).between(14, 19) & luhn(digits(x)))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), found(text, PHONE, "phone", lambda x: F.length(digits(x)).between(10, 15))).otherwise(none),
    ]
    return F.array_sort(F.concat(*by))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _left(text: Column, start: Column) -> Column:
    """The word before a place: what stands in the last 40 characters after their last space but one."""
    before = F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40)))
    return F.lower(F.regexp_extract(before, r"([^\s]+)\s*\z", 1))


def _right(text: Column, end: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(text, end + 1, F.lit(40)), r"\A[^\s\w]?\s+([^\s]+)", 1))


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, end, trusted, instance, pattern) of rows (doc_id, row_key, text, base)."""
    with_digits = F.col("text").rlike("[0-9]")
    none = F.array().cast(_SPANS)
    enough = lambda x: (F.length(x) >= 6) & (F.length(F.regexp_replace(x, "[^0-9]", "")) >= 4)
    runs = F.when(with_digits, found(F.col("text"), CANDIDATE, "context", enough)).otherwise(none)
    free = F.filter(runs, lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    one = rows.withColumn("span", F.explode(F.concat("base", free))).select(
        "doc_id", "row_key", "span.start", "span.end", (F.col("span.kind") != "context").alias("trusted"),
        F.xxhash64(F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))).alias("instance"),
        _left(F.col("text"), F.col("span.start")).alias("left"), _right(F.col("text"), F.col("span.end")).alias("right"))
    sides = F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word"))))
    out = one.withColumn("p", sides).where("p.word <> ''")
    return out.select("doc_id", "row_key", "start", "end", "trusted", "instance", "p.side", "p.word")


def counted_words(texts: DataFrame) -> DataFrame:
    """(side, word, times): how often each word, or what _left() sees of one before a BOUNDARY, stands in the texts."""
    words = kept(texts.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("times")))
    cut = words.withColumn("pieces", F.split(F.substring("word", 1, 41), BOUNDARY)).where(F.size("pieces") > 1)
    starts = F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.array_join(F.slice("pieces", F.lit(1), i), ""))
    left = words.unionAll(cut.select(F.explode(starts).alias("word"), "times")).groupBy("word").agg(F.sum("times").alias("times"))
    return left.select(F.lit("L").alias("side"), "word", "times").unionAll(words.select(F.lit("R").alias("side"), "word", "times"))


def trusted_patterns(seen: DataFrame, words: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(side, word, score) of the patterns that end at trust or more. words: (side, word, times) over all documents."""
    edges = kept(seen.groupBy("side", "word", "instance").agg(F.count("*").alias("n"), F.max(F.col("trusted").cast("double")).alias("seed")))
    score = edges.select("side", "word", "instance", "n", F.col("seed").alias("s"), "seed")
    for _ in range(rounds):
        by = score.groupBy("side", "word").agg(F.sum(F.col("n") * F.col("s")).alias("good"), F.sum((F.col("s") > 0).cast("long")).alias("distinct"), F.sum("n").alias("seen"))
        times = F.greatest("seen", F.coalesce("times", F.lit(0)))
        patterns = kept(by.where(F.col("distinct") >= support).join(words, ["side", "word"], "left").select("side", "word", F.least(F.col("good") / times, F.lit(0.999)).alias("score")).where(F.col("score") >= trust))
        doubt = edges.join(patterns, ["side", "word"]).groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("found"))
        score = edges.join(doubt, "instance", "left").select("side", "word", "instance", "n", F.greatest("seed", F.coalesce("found", F.lit(0.0))).alias("s"), "seed")
    return patterns


def extracted(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """(doc_id, base, spans): arrays of spans (start, place, end, kind), positions in code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("row_key", F.xxhash64("text"))
    base = kept(rows.select("doc_id", "row_key", base_spans(F.col("text")).alias("base"), F.col("text").rlike(LIKELY).alias("likely")))
    concerned = base.where(F.col("likely") | (F.size("base") > 0)).select("doc_id", "row_key", "base").distinct()
    a, b = rows.where(F.col("text").rlike("[0-9@]")).alias("a"), concerned.alias("b")
    near = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_key") == F.col("b.row_key"))).select("a.doc_id", "a.row_key", "a.text", "b.base")
    seen = kept(occurrences(near))
    patterns = trusted_patterns(seen, kept(counted_words(rows)), rounds, trust, support)
    new = seen.where(~F.col("trusted")).join(patterns, ["side", "word"], "left_semi").select("doc_id", "row_key", F.struct("start", F.lit(4).alias("place"), "end", F.lit("context").alias("kind")).alias("s"))
    new = new.groupBy("doc_id", "row_key").agg(F.collect_set("s").alias("more"))
    a, b = base.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_key") == F.col("b.row_key")), "left")
    return both.select("a.doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))).alias("spans"))


def counted(found_in: DataFrame) -> DataFrame:
    """The digest columns of extracted()."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found_in.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
