"""Embedding: a pluggable embedder behind an Arrow UDF, with token-aware micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.operators.batching import MAX_ITEMS, MAX_TOKENS


class Embedder(Protocol):
    """Turns texts into vectors of ``dimensions`` components.  Built once in each Python worker."""

    dimensions: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic stand-in: words hashed into signed buckets, at length 1.

    It exercises the plumbing without a model; its vectors say nothing about a model's quality.
    """

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split() or [""]:
                h = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        out[(n == 0).ravel(), 0] = 1.0
        return out / np.where(n == 0, 1.0, n)


class PooledEmbedder:
    """Texts through a tokenizer and a forward function, pooled over their last tokens.

    ``tokenize`` gives a text's token ids, ``forward`` the hidden states ``(items, tokens, width)`` of padded ids and their
    mask.  Tokens beyond ``max_sequence`` are cut off, shorter texts padded on the left, so the last place is
    every text's last token.  The first ``dimensions`` of its state are brought to length 1; a text without tokens
    is the padding alone; states that are no numbers stay so, for the caller to set aside.
    """

    def __init__(self, tokenize, forward, dimensions: int, max_sequence: int = 4096, padding: int = 0):
        if dimensions < 1 or max_sequence < 1:
            raise ValueError("dimensions and max_sequence must be positive")
        self.tokenize, self.forward, self.dimensions, self.max_sequence, self.padding = tokenize, forward, dimensions, max_sequence, padding

    def padded(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and mask, padded on the left."""
        ids = [list(self.tokenize(t))[: self.max_sequence] for t in texts]
        width = max([1, *map(len, ids)])
        out = np.full((len(ids), width), self.padding, dtype=np.int64)
        mask = np.zeros((len(ids), width), dtype=np.int64)
        for row, own, there in zip(out, ids, mask):
            if own:
                row[-len(own) :], there[-len(own) :] = own, 1
        return out, mask

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, self.dimensions), dtype=np.float32)
        ids, mask = self.padded(texts)
        hidden = np.asarray(self.forward(ids, mask))
        if hidden.shape[:2] != ids.shape or hidden.shape[2] < self.dimensions:
            raise RuntimeError(f"hidden states of shape {hidden.shape}")
        last = hidden[:, -1, : self.dimensions].astype(np.float64)
        norm = np.linalg.norm(last, axis=1, keepdims=True)
        return (last / np.where(norm == 0, 1.0, norm)).astype(np.float32)


def split(tokens: Sequence[int], max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS) -> list[slice]:
    """Runs of items whose padded cost and number stay within the limits; an item over them runs alone."""
    out, lo, top = [], 0, 0
    for i, t in enumerate(tokens):
        top_now = max(top, t, 1)
        if i > lo and (i - lo + 1 > max_items or (i - lo + 1) * top_now > max_tokens):
            out.append(slice(lo, i))
            lo, top_now = i, max(t, 1)
        top = top_now
    return [*out, slice(lo, len(tokens))] if len(tokens) else out


def embedding(text: Column, embedder, max_items: int = MAX_ITEMS, max_tokens: int = MAX_TOKENS) -> Column:
    """The vector of each text as ``array<float>``; null texts have none.

    ``embedder`` is a picklable factory without arguments.  Texts of an Arrow batch are sorted by length, so
    batches pad little, and put back in order.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for texts in batches:
            out: list = [None] * len(texts)
            there = [i for i, t in enumerate(texts) if t is not None]
            there.sort(key=lambda i: len(texts.iloc[i]))
            tokens = [max(1, -(-len(texts.iloc[i]) // 4)) for i in there]
            for part in split(tokens, max_items, max_tokens):
                rows = there[part]
                vectors = model.embed([texts.iloc[i] for i in rows])
                if vectors.shape != (len(rows), model.dimensions):
                    raise RuntimeError(f"embedding shape mismatch: {vectors.shape}")
                for i, v in zip(rows, vectors):
                    out[i] = v
            yield pd.Series(out, index=texts.index)

    return run(text)
