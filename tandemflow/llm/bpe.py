"""Byte-level BPE encoding and decoding with a pair occurrence index.

The texts of a partition are cut by the tokenizer's own pattern, and every distinct piece is
encoded once.  All new pieces of a block lie in one symbol array, linked to the left and right.
An index maps each mergeable pair, by its rank, to all its positions in that array.  Ranks are
applied in ascending order: all positions of a rank are merged at once, and the pairs made left
and right of them are added to the lists of their ranks.  A merge only makes pairs of higher
ranks (checked when the tokenizer file is read), so one ascending pass gives what merging piece by
piece gives.

Nothing is shuffled.  A task holds one block of texts (``BLOCK_BYTES``, or one longer text), the
merge table and a cache of pieces of bounded size.

Defined results: a null text is encoded as an empty one; repeated rows are encoded alike; an
empty table gives no rows; :func:`encode` carries all columns, whatever their names, beside those it adds.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .names import free_name

#: The pattern of byte-level BPE tokenizers, with Unicode's white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
BLOCK_BYTES = 4 << 20
CACHE_PIECES = 300_000


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in tokenizer files: itself, or the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Merge table, token bytes and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, content: str) -> None:
        file = json.loads(content)
        letters, vocab = _byte_letters(), file["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        token_bytes = [b""] * self.size
        for token, i in vocab.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.token_at = np.cumsum([0, *map(len, token_bytes)])
        self.token_data = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        made = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(made, self.merged, np.arange(len(merges)))
        if (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        keys = left * self.size + right
        self.key_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_order]
        self.left, self.right = left, right
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.piece = regex.compile(PIECE)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it doesn't merge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_order[at], -1)

    def pieces(self, text: str) -> list[str]:
        """The text's pieces; a special token is a piece of its own."""
        if self.split is None or not any(t in text for t in self.special):
            return self.piece.findall(text)
        return [p for part in self.split.split(text) if part for p in ([part] if part in self.special else self.piece.findall(part))]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct pieces, by the pair occurrence index."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        n = int(lengths.sum())
        owner = np.repeat(np.arange(len(raw)), lengths)
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        same = owner[:-1] == owner[1:]
        after[:-1][~same] = n
        before[1:][~same] = -1
        if n:
            after[-1] = n
        waiting: dict[int, list[np.ndarray]] = {}

        def index(at: np.ndarray) -> None:
            """Adds the pairs that begin at these positions to their ranks' lists."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
                waiting.setdefault(r, []).append(part)

        index(np.flatnonzero(after < n))
        alive = np.ones(n, dtype=bool)
        for rank in range(len(self.merged)):
            lists = waiting.pop(rank, None)
            if lists is None:
                continue
            a, b = self.left[rank], self.right[rank]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[alive[at] & (after[at] < n)]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # of a run that overlaps, every second one from the left
                chained = np.r_[False, at[1:] == after[at[:-1]]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            rest = after[gone]
            symbol[at] = self.merged[rank]
            alive[gone] = False
            after[at] = rest
            before[rest[rest < n]] = at[rest < n]
            left = before[at]
            index(np.unique(np.concatenate([at[rest < n], left[left >= 0]])))
        counts = np.bincount(owner[alive], minlength=len(raw)) if n else np.zeros(len(raw), np.int64)
        return symbol[alive], np.cumsum(np.r_[0, counts])


def read(path: str) -> str:
    """The tokenizer file's content; the driver reads it, so executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def _load(content: str) -> Tokenizer:
    return Tokenizer(content)


def gather(data: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``which`` of data, one after another, and where each begins."""
    lengths = np.diff(bounds)[which]
    at = np.cumsum(np.r_[0, lengths])
    return data[np.repeat(bounds[which] - at[:-1], lengths) + np.arange(at[-1])], at


class _Cache:
    """Ids of pieces seen in this task; started anew when it holds ``CACHE_PIECES``."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by text)."""
        if len(self.code) > CACHE_PIECES:
            self.clear()
        code, new, codes = self.code, [], []
        for t in texts:  # of the pieces, only their codes are kept
            own = self.tokenizer.pieces(t)
            for p in own:
                if p not in code:
                    code[p] = len(code)
                    new.append(p)
            codes.append(np.array([code[p] for p in own], dtype=np.int32))
        special = {p: i for p, i in self.tokenizer.special.items() if code.get(p, -1) >= len(code) - len(new)}
        ids, bounds = self.tokenizer.encode_pieces([p for p in new if p not in special])
        if special:  # their own id, in the place that their code has
            own = np.split(ids, bounds[1:-1]) if len(bounds) > 1 else []
            plain = iter(own)
            own = [np.array([special[p]]) if p in special else next(plain) for p in new]
            ids, bounds = np.concatenate(own), np.cumsum([0, *map(len, own)])
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])
        flat, at = gather(self.ids, self.bounds, np.concatenate(codes))
        return flat, at[np.cumsum([0, *map(len, codes)])]


def _run(docs: DataFrame, path: str, work):
    """mapInArrow function: work(tokenizer, batch, ids, bounds) for each block of texts."""
    # A tokenizer file has a fixed size (1.6 MB for 50,000 merges).
    content = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(content.value)
        cache = _Cache(tokenizer)
        for batch in K.blocks(batches, "bpe_text", BLOCK_BYTES):
            texts = [t or "" for t in batch.column("bpe_text").to_pylist()]
            yield work(tokenizer, batch, *cache.encode(texts))

    return run


def decode(tokenizer: Tokenizer, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Decoded texts in UTF-8; bytes that aren't UTF-8 become replacement characters."""
    data, at = gather(tokenizer.token_data, tokenizer.token_at, ids)
    cut = at[bounds]
    raw = data.tobytes()
    return [raw[s:e].decode("utf-8", "replace").encode() for s, e in zip(cut[:-1], cut[1:], strict=True)]


def _digests(tokenizer: Tokenizer, batch: pa.RecordBatch, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    raw = ids.astype("<u4").tobytes()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(np.diff(bounds), pa.int64()),
            pa.array([sha(raw[4 * s : 4 * e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]),
            pa.array([sha(x) for x in decode(tokenizer, ids, bounds)]),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _columns(tokenizer: Tokenizer, batch: pa.RecordBatch, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    row = batch.column("bpe_row")
    tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
    decoded = pa.array([x.decode() for x in decode(tokenizer, ids, bounds)], pa.string())
    return pa.RecordBatch.from_arrays([row, tokens, decoded], ["bpe_row", "tokens", "decoded"])


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian 32-bit) and of the decoded text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("bpe_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_run(docs, path, _digests), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_rows(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each row of ``docs`` as the struct bpe_row, with its text's ids (tokens) and the text decoded from them (decoded)."""
    rows = docs.select(F.struct("*").alias("bpe_row"), F.col(text).alias("bpe_text"))
    kind = rows.schema["bpe_row"].dataType.simpleString()
    return rows.mapInArrow(_run(docs, path, _columns), f"bpe_row {kind}, tokens array<int>, decoded string")


def encode(docs: DataFrame, path: str, text: str = "text", tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and the text decoded from them; an own name that ``docs`` has gets ``bpe_`` in front."""
    own = (F.col(c).alias(free_name(name, docs.columns, "bpe_")) for c, name in (("tokens", tokens), ("decoded", decoded)))
    return encoded_rows(docs, path, text).select("bpe_row.*", *own)
