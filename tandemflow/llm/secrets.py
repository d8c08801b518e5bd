"""Secret scans: fixed patterns and a randomness test battery (DataFrame functions only).

Patterns give the base spans.  Beyond them, every unbroken token of ``MIN_TOKEN`` or more
symbols is a candidate, with or without a digit.  Its encoding is inferred from its alphabet, and three
tests run on its symbols: chi-squared uniformity of the alphabet, runs above and below the
middle symbol, and lag-one serial correlation.

The hypothesis that a discovery rejects is "ordinary text of that encoding", whose departure from uniformity
grows with the token's length; the chi-squared statistic gives its p-value.  Runs and serial
correlation give p-values of "random symbols"; the smaller, corrected for being one of two, is the
chance that a random token looks as structured as this.  The first is divided by it, as a weight that is 1 in the
mean where symbols have no order (``EVEN`` sees to it) and less where they have: so the false-discovery rate
that Benjamini-Hochberg holds stays held, and a token with structure needs so much more evidence.  It is held in each stratum of encoding and length class;
p-values are counted in bins of a tenth of a decade over the whole corpus, so what leaves the
executors is one threshold for each stratum.

The departures in ``ENCODINGS`` are what is granted to ordinary text at least: words of the four
languages of the test documents, run together in various ways, show 1.6 in base32, 2.5 to 4.3 in
the wider alphabets, and numbers 1.5 in hex.  With them the measured share of false discoveries
among planted tokens lies below a hundredth (the test of it is in the test folder).

Defined results: a null text is empty and has no spans; repeated rows are scanned alike; an empty
table gives no rows; all columns beyond the text are carried untouched, whatever their names.
Positions are code points, from 0, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (kind, pattern, group that the length bound is on, least length), in the order of kinds.
#: For access and hex the bound is in the pattern: a run that is too short can't match in part.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
RANDOM = "random"

MIN_TOKEN = 20
#: '=' ends a token: it is padding where no symbol follows it, and what stands behind it is a token of its own.
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+(?:=++(?![A-Za-z0-9+/_-]))?"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (encoding, pattern of the unpadded token, alphabet, non-uniformity of ordinary text for each symbol)
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", 0.6),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", 1.0),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 2.0),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 2.0),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 2.0),
    ("mixed", "", _UPPER + _LOWER + _DIGITS + "+/-_", 2.0),
)
RATE = 0.05
BINS = 400
#: Mean of the smaller of two independent p-values, doubled and cut at 1.
EVEN = 7 / 12


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, hit>> of the leftmost matches that don't overlap.

    A split leaves the text between the matches: the lengths of both give the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,hit:string>>")
    walk = F.aggregate(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), x["hit"].alias("hit")))).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(text.rlike(pattern), walk).otherwise(none)


def _spans(text: Column, rank: int) -> Column:
    """array<struct<start, kind, end>> of a fixed kind."""
    _, pattern, group, least = KINDS[rank]
    part = lambda hit: F.regexp_extract(hit, pattern, group)
    kept = F.filter(located(text, pattern), lambda x: F.length(part(x["hit"])) >= least)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end")))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by a rational approximation (absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, tail).otherwise(1 - tail)


def _by_encoding(token: Column, value) -> Column:
    """value(encoding) of the first encoding whose alphabet holds the token."""
    out = None
    for e in ENCODINGS[:-1]:
        out = F.when(token.rlike(e[1]), value(e)) if out is None else out.when(token.rlike(e[1]), value(e))
    return out.otherwise(value(ENCODINGS[-1]))


def battery(hit: Column) -> Column:
    """struct<encoding, length_class, bin> of a token: bin is the weighted p-value's -10 log10, rounded down."""
    token = F.rtrim(hit, F.lit("="))
    folded = F.when(token.rlike("^[0-9A-F]+$"), F.lower(token)).otherwise(token)
    base = F.struct(
        folded.alias("s"),
        F.length(folded).cast("double").alias("n"),
        _by_encoding(token, lambda e: F.lit(e[0])).alias("encoding"),
        _by_encoding(token, lambda e: F.lit(e[2])).alias("alphabet"),
        _by_encoding(token, lambda e: F.lit(e[3])).alias("effect"),
    )

    def measured(b: Column) -> Column:
        chars = F.split(b["s"], "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(b["n"] - F.length(F.replace(b["s"], c, F.lit(""))), F.lit(2)))
        values = F.transform(chars, lambda c: F.instr(b["alphabet"], c).cast("double") - 1)
        return F.struct(b["n"].alias("n"), b["encoding"].alias("encoding"), b["effect"].alias("effect"), F.length(b["alphabet"]).cast("double").alias("k"), squares.alias("squares"), values.alias("v"))

    def tested(m: Column) -> Column:
        n, k, v = m["n"], m["k"], m["v"]
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        far = n * m["effect"]
        uniform = (k / n * m["squares"] - n - (k - 1 + far)) / F.sqrt(2 * (k - 1 + 2 * far))
        steps = F.zip_with(
            F.slice(v, 1, F.size(v) - 1),
            F.slice(v, 2, F.size(v) - 1),
            lambda a, b: F.struct(((a > middle) != (b > middle)).cast("double").alias("turn"), ((a - middle) * (b - middle)).alias("product")),
        )
        sums = F.aggregate(
            steps,
            F.struct(F.lit(0.0).alias("turn"), F.lit(0.0).alias("product")),
            lambda acc, x: F.struct((acc["turn"] + x["turn"]).alias("turn"), (acc["product"] + x["product"]).alias("product")),
        )
        runs = F.abs(sums["turn"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.abs(sums["product"]) / spread / F.sqrt(n - 1)
        structure = F.least(4 * normal_cdf(-F.greatest(runs, serial)), F.lit(1.0))
        ordinary = normal_cdf(uniform) * EVEN / F.greatest(structure, F.lit(1e-40))
        level = F.least(F.floor(-10 * F.log10(F.greatest(ordinary, F.lit(1e-40)))), F.lit(BINS)).cast("int")
        return F.struct(m["encoding"].alias("encoding"), F.floor(F.log2(n)).cast("int").alias("length_class"), F.greatest(level, F.lit(0)).alias("bin"))

    one = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  names a value inside a lambda
    return one(one(base, measured), tested)


def candidates(text: Column) -> Column:
    """array<struct<start, end, encoding, length_class, bin>> of a text's tokens."""
    return F.transform(located(text, TOKEN), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"), battery(x["hit"]).alias("t")))


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[tuple[str, int], int]:
    """Least p-value bin that is a discovery, by (encoding, length class), over all rows of ``docs``.

    What comes to the driver is one number for each stratum (6 encodings, length classes by powers of two).
    """
    tokens = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c")).select("c.t.*")
    counts = tokens.groupBy("encoding", "length_class", "bin").count()
    stratum = Window.partitionBy("encoding", "length_class")
    at_least = F.sum("count").over(stratum.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
    found = (
        counts.withColumn("at_least", at_least)
        .withColumn("all", F.sum("count").over(stratum))
        .filter((F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("at_least") / F.col("all")) & (F.col("bin") > 0))
        .groupBy("encoding", "length_class")
        .agg(F.min("bin").alias("bin"))
    )
    return {(r["encoding"], r["length_class"]): r["bin"] for r in found.collect()}


def scan(docs: DataFrame, text: str = "text", rate: float = RATE, found: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """``docs`` as the struct scan_row, with scan_text, scan_base and scan_spans.

    Spans are array<struct<start, kind, end>>, sorted; kind is the rank in KINDS, or one more for
    the test battery. found: thresholds of an earlier call, else they are made from ``docs``.
    """
    found = thresholds(docs, text, rate) if found is None else found
    whole = docs.select(F.struct("*").alias("scan_row"), F.coalesce(F.col(text), F.lit("")).alias("scan_text"))
    base = F.array_sort(F.concat(*(_spans(F.col("scan_text"), i) for i in range(len(KINDS)))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    random = none
    if found:
        least = F.create_map(*(F.lit(x) for (e, n), b in sorted(found.items()) for x in (f"{e}:{n}", b)))
        kept = F.filter(candidates(F.col("scan_text")), lambda x: x["t"]["bin"] >= least[F.concat_ws(":", x["t"]["encoding"], x["t"]["length_class"].cast("string"))])
        random = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end")))
    scanned = whole.select("scan_row", "scan_text", base.alias("scan_base"), random.alias("scan_random"))
    return scanned.select("scan_row", "scan_text", "scan_base", F.array_sort(F.concat("scan_base", "scan_random")).alias("scan_spans"))


def joined(spans: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, the count of each base kind, the base spans' SHA-256 and all spans of each row."""
    count = lambda i: F.size(F.filter("scan_base", lambda x: x["kind"] == i)).cast("long")
    return scan(docs, text, rate).select(
        F.col(f"scan_row.{doc_id}").alias("doc_id"),
        *(count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)),
        F.sha2(joined(F.col("scan_base")), 256).alias("base_sha256"),
        joined(F.col("scan_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); a null text stays null."""
    body = F.col("scan_text")
    cut = F.aggregate(
        "scan_spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(body, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))),
    )
    clean = F.when(F.size("scan_spans") > 0, cut).otherwise(F.col(f"scan_row.{text}"))
    return scan(docs, text, rate).select(F.col("scan_row").withField(text, clean).alias("scan_row")).select("scan_row.*")
