"""URL filters: domain rules first, then a logistic regression on hashed character n-grams.

The model sees the n-grams of a url's host and of its path in one hashed space (each side with
its own salt) and is trained by full-batch gradient descent from a small labelled table (``TABLE_SIZE``
urls to leave out and twice as many to keep, on ten domain ends, made from word lists by a rule), so the
driver holds ``2 ** BITS`` weights whatever the number of urls.  Scoring is one Arrow pass.

Defined results: a null url, or one without ``://``, has an empty host and path, matches no rule
and gets the model's verdict on its bias; repeated rows are judged alike; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
GRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with its subdomains, and the paths that begin with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: What the training table's urls are made of.  Words of sites that a corpus keeps, ...
KEPT_WORDS = """
library news docs blog museum university weather recipes health forum wiki travel gardening science journal open music school government magazine
history rivers city council guide install collection paintings research papers articles sleep memory repair bicycle geography mountain roses physics
lecture data population concert lessons fractions laws water kitchen bread football theatre poetry astronomy biology chemistry language grammar
""".split()
#: ... of sites that it leaves out, ...
LEFT_WORDS = """
casino poker slots jackpot betting bets sportsbook lottery winner win bonus gambling roulette pills viagra cheap pharmacy diet miracle replica
adult porn xxx sex nude cams escort dating torrent warez crack keygen pirate loan payday crypto giveaway doubler spam farm
backlinks seo doorway clickbait ads adserver banner track tracker popup coupon discount deals free spins login-verify account-update phishing
""".split()
#: ... sounds of names that say nothing, and what urls of both kinds have around them.
ONSETS = "b c d f g h j k l m n p r s t v w y z th sh ch st tr br cl gr pl fr sp qu wh".split()
CORES = "a e i o u ea ou ai io".split()
CODAS = ("", "", "", "n", "r", "s", "t", "l", "ng", "nd", "ly", "on", "ed", "re")
FRONTS = ("", "", "", "www.", "m.", "blog.", "en.", "shop.")
ENDS = (".com", ".org", ".net", ".example.com", ".example.org", ".example.net", ".de", ".co.uk", ".info", ".edu")
PATHS = ("/", "/en/{n}", "/de/{n}", "/fr/{n}/", "/es/{n}", "/{w}", "/{w}/{n}", "/{w}-{v}.html", "/en/{w}", "/{n}/{w}/", "/{w}?page={n}", "/index.html")
TABLE_SIZE = 600


def training_table(size: int = TABLE_SIZE, seed: int = 11) -> tuple[list[str], list[str]]:
    """(kept, left): ``2 * size`` and ``size`` labelled urls, drawn from the words above by a seeded generator.

    Two thirds of the kept urls have hosts and paths of meaningless names, so that a url without any word of either
    list is kept.  Every left url has words of its kind in its host, half of them in the path as well.
    """
    rng = np.random.default_rng(seed)
    of = lambda words: words[rng.integers(len(words))]
    name = lambda: "".join(of(ONSETS) + of(CORES) + of(CODAS) for _ in range(rng.integers(1, 4)))

    def url(words: list[str] | None, in_path: bool) -> str:
        word = (lambda: of(words)) if words else name
        label = word() if rng.random() < 0.3 else f"{word()}-{word()}" if rng.random() < 0.6 else f"{word()}{rng.integers(1, 99)}"
        middle = f"{name()}." if rng.random() < 0.2 else ""
        inner = word if in_path else name
        path = of(PATHS).format(n=rng.integers(1, 99999), w=inner(), v=inner())
        return f"{of(('http', 'https'))}://{of(FRONTS)}{label}.{middle}{of(ENDS)[1:]}{path}"

    kept = [url(None if i % 3 else KEPT_WORDS, i % 2 == 0) for i in range(2 * size)]
    return kept, [url(LEFT_WORDS, i % 2 == 0) for i in range(size)]


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) text between the first ``://`` and the next ``/``, ``?``, ``#`` or end."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of ``^text$``, by a rolling product of the text's bytes."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    raw = [f"^{t}$".encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    for n in GRAMS:
        if len(data) < n:
            continue
        here = len(data) - n + 1
        h = np.full(here, salt * 31 + n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ data[j : j + here]
        h *= np.uint64(0x9E3779B97F4A7C15)
        inside = owner[:here] == owner[n - 1 :]
        rows.append(owner[:here][inside])
        found.append((h >> np.uint64(64 - BITS)).astype(np.int64)[inside])
    return np.concatenate(rows), np.concatenate(found)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): each side's n-grams weigh one unit vector together."""
    parts = []
    for texts, salt in ((hosts, 1), (paths, 2)):
        row, bucket = _grams(texts, salt)
        n = np.bincount(row, minlength=len(texts)).astype(float)
        parts.append((row, bucket, 1 / np.sqrt(n[row])))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def split_url(url: str) -> tuple[str, str]:
    """Host and path of one url of the training table."""
    rest = url.partition("://")[2].partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def train(kept: list[str] | None = None, left: list[str] | None = None, steps: int = 1000, rate: float = 10.0, decay: float = 2e-5) -> np.ndarray:
    """Weights, the bias last; the score is the chance that a url is to be left out. Default: the training table."""
    if kept is None or left is None:
        kept, left = training_table()
    hosts, paths = zip(*map(split_url, [*kept, *left]), strict=True)
    row, bucket, value = features(list(hosts), list(paths))
    y = np.r_[np.zeros(len(kept)), np.ones(len(left))]
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        z = np.bincount(row, w[bucket] * value, len(y)) + b
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= rate * (np.bincount(bucket, g[row] * value, len(w)) + decay * w)
        b -= rate * g.sum()
    return np.r_[w, b]


def _scorer(weights: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, value = features(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            z = np.bincount(row, weights[bucket] * value, batch.num_rows) + weights[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], [*batch.schema.names, "score"])

    return score


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, weights: np.ndarray | None = None, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of each row.

    rules: a bounded list; the longest that fits decides. threshold: the least score to block.
    """
    weights = train() if weights is None else weights
    parsed = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kind = parsed.schema["page_id"].dataType.simpleString()
    scored = parsed.mapInArrow(_scorer(weights), f"page_id {kind}, host string, path string, score double")

    def fits(rule: Rule) -> Column:
        host = (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
        return host & F.col("path").startswith(rule.path)

    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    pick = lambda value: reduce(lambda c, r: c.when(fits(r), F.lit(value(r))), ordered[1:], F.when(fits(ordered[0]), F.lit(value(ordered[0])))) if ordered else F.lit(None).cast("string")
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", pick(lambda r: r.host + r.path).alias("rule"), F.coalesce(pick(lambda r: r.verdict), by_model).alias("verdict"), "score"
    )
