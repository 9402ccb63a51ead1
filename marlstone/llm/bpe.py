"""Byte-pair encoding and decoding with word-end vocabularies.

Texts are normalised and cut into pre-tokens; each distinct pre-token is merged once per
Python worker and kept in a bounded memo.  The merge loop is a segment tree over the ranks of
adjacent pairs: its root holds the lowest rank, walking down to the left wherever the left
child holds that minimum gives the leftmost such pair, and each merge updates three leaves
in logarithmic time.  Short pre-tokens go through the tree in numpy blocks, many words at
once; longer ones through the same tree one word at a time.

Null and empty texts have no tokens and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.memo import Memo, of_worker

_NONE = np.int32(2**31 - 1)
_BLOCK_SYMBOLS = 64
_BLOCK_WORDS = 16384
MEMO_WORDS = 300_000


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer read from the JSON description of a word-end BPE vocabulary."""

    def __init__(self, description: bytes):
        spec = json.loads(description)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        alphabet = _byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        pairs = []
        for rank, (a, b) in enumerate(model["merges"]):
            pairs.append((vocab[a] << 32 | vocab[b], rank, vocab[a + b]))
        self.ranks = {key: (rank, new) for key, rank, new in reversed(pairs)}
        keys = np.array([p[0] for p in pairs], np.int64)
        keys, at = np.unique(keys, return_index=True)
        self.keys = keys
        self.key_rank = np.array([p[1] for p in pairs], np.int32)[at]
        self.key_new = np.array([p[2] for p in pairs], np.int32)[at]
        (split,) = (p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = Memo(MEMO_WORDS)

    # ----- text to pre-tokens

    def normalize(self, text: str) -> str:
        """Canonical composition and lower case, a letter at a time (no final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; the strings of special tokens stay as they are."""
        if self.cut is None or "<|" not in text:
            return self.pieces.findall(self.normalize(text))
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(part)
            else:
                out.extend(self.pieces.findall(self.normalize(part)))
        return out

    # ----- merging

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.key_rank[at], _NONE), self.key_new[at]

    def merge_block(self, words: list[bytes], size: int) -> list[bytes]:
        """Ids of words of at most ``size`` bytes (a power of two), merged all at once."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        here = np.arange(size)
        symbols = np.full((n, size + 1), -1, np.int32)
        symbols[:, :size] = np.where(here < lengths[:, None], self.first[flat], -1)
        rows = np.arange(n)
        symbols[rows, lengths - 1] = self.last[flat[rows, lengths - 1]]
        after = np.broadcast_to(np.minimum(here + 1, size).astype(np.int32), (n, size)).copy()
        before = np.broadcast_to((here - 1).astype(np.int32), (n, size)).copy()
        tree = np.full((n, 2 * size), _NONE, np.int32)
        tree[:, size:] = self._look_up(symbols[:, :size], symbols[:, 1:])[0]
        for level in range(size.bit_length() - 2, -1, -1):
            at = np.arange(1 << level, 2 << level)
            tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])

        def put(r: np.ndarray, slot: np.ndarray, rank: np.ndarray) -> None:
            node = slot + size
            tree[r, node] = rank
            node = node >> 1
            while node.size and node[0]:
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                node >>= 1

        live = rows[tree[:, 1] != _NONE]
        while live.size:
            best = tree[live, 1]
            node = np.ones(live.size, np.int64)
            while node[0] < size:
                node = 2 * node + (tree[live, 2 * node] != best)
            slot = node - size
            right = after[live, slot].astype(np.int64)
            _, new = self._look_up(symbols[live, slot], symbols[live, right])
            symbols[live, slot] = new
            symbols[live, right] = -2  # swallowed
            follow = after[live, right].astype(np.int64)
            after[live, slot] = follow
            inner = follow < size
            before[live[inner], follow[inner]] = slot[inner]
            lead = before[live, slot].astype(np.int64)
            has = lead >= 0
            led = live[has]
            put(
                np.concatenate([live, live, led]),
                np.concatenate([right, slot, lead[has]]),
                np.concatenate([np.full(live.size, _NONE, np.int32), self._look_up(new, symbols[live, follow])[0], self._look_up(symbols[led, lead[has]], new[has])[0]]),
            )
            live = live[tree[live, 1] != _NONE]
        kept = symbols >= 0
        ids = symbols[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Merge one word of any length."""
        n = len(word)
        symbols = self.first[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(self.last[word[-1]])
        size = 1 << max(1, (n - 1).bit_length())
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        none = (1 << 31, 0)
        ranks = self.ranks
        tree = [1 << 31] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(symbols[i] << 32 | symbols[i + 1], none)[0]
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(slot: int, rank: int) -> None:
            k = slot + size
            tree[k] = rank
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < 1 << 31:
            best, k = tree[1], 1
            while k < size:
                k = 2 * k if tree[2 * k] == best else 2 * k + 1
            slot = k - size
            right = after[slot]
            symbols[slot] = ranks[symbols[slot] << 32 | symbols[right]][1]
            symbols[right] = -1
            follow = after[slot] = after[right]
            put(right, 1 << 31)
            if follow < n:
                before[follow] = slot
                put(slot, ranks.get(symbols[slot] << 32 | symbols[follow], none)[0])
            else:
                put(slot, 1 << 31)
            lead = before[slot]
            if lead >= 0:
                put(lead, ranks.get(symbols[lead] << 32 | symbols[slot], none)[0])
        return np.array([s for s in symbols if s >= 0], np.int32)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of distinct pre-tokens, merged where the memo doesn't know them."""
        memo = self.memo
        fresh = memo.missing(words)
        known = memo.young
        classes: dict[int, list[str]] = {}
        for w in fresh:
            if w in self.special:
                known[w] = int(self.special[w]).to_bytes(4, "little")
                continue
            n = len(w.encode())
            classes.setdefault(0 if n > _BLOCK_SYMBOLS else 1 << max(1, (n - 1).bit_length()), []).append(w)
        for size, group in classes.items():
            if not size:
                for w in group:
                    known[w] = self.merge_long(w.encode()).astype("<u4").tobytes()
                continue
            for at in range(0, len(group), _BLOCK_WORDS):
                block = group[at : at + _BLOCK_WORDS]
                known.update(zip(block, self.merge_block([w.encode() for w in block], size), strict=True))
        return known

    # ----- texts

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut, pending = [], 0
        for i, text in enumerate(texts):
            cut.append(self.pretokens(text or ""))
            pending += len(cut[-1])
            if pending > 300_000 or i == len(texts) - 1:
                known = self.learn(set().union(*cut))
                for words in cut:
                    yield b"".join(map(known.__getitem__, words))
                cut, pending = [], 0

    def decode(self, ids: bytes) -> str:
        """Token strings joined by blanks, special tokens included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _tokenizer(description: bytes) -> WordBpe:
    """The worker's tokenizer for a description; it and its memo serve later tasks too."""
    return of_worker(("bpe", hashlib.sha256(description).hexdigest()), lambda: WordBpe(description))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) for every whole text.

    The vocabulary file (a few MB) is read on the driver and broadcast.  A column already named
    like the output is replaced.  Null texts get no ids: an empty binary.
    """
    with open(tokenizer_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _tokenizer(shared.value)
        for texts in batches:
            yield pd.Series(list(bpe.encode_batch(texts.tolist())), dtype=object)

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids; null ids decode to the empty text."""
    with open(tokenizer_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _tokenizer(shared.value)
        for rows in batches:
            yield pd.Series([bpe.decode(x or b"") for x in rows], dtype=object)

    return df.withColumn(out, run(F.col(ids)))


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass, which takes one worker for each task instead of two.

    Columns already named like the outputs are replaced.
    """
    with open(tokenizer_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _tokenizer(shared.value)
        for texts in batches:
            coded = list(bpe.encode_batch(texts.tolist()))
            yield pd.DataFrame({"ids": coded, "decoded": list(map(bpe.decode, coded))}, dtype=object)

    kept, both = [c for c in df.columns if c not in (ids, out)], "_coded"
    while both in map(str.lower, kept):
        both += "_"
    rows = df.select(*kept, run(F.col(text)).alias(both))
    return rows.select(*kept, F.col(f"{both}.ids").alias(ids), F.col(f"{both}.decoded").alias(out))
