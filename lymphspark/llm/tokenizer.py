"""Encoding with a public byte-level BPE vocabulary, in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word merges all occurrences of its lowest-ranked
pair; pairs are looked up by binary search over the sorted keys of all pairs that the vocabulary can merge.
"""

from __future__ import annotations

import base64
import heapq
import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.session import ship_package

#: A fixed value: the pre-tokenization pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes are merged one by one by a heap, as a round merges one kind of pair in a word.
LONG_WORD = 256
#: Symbols of one round, and words that are kept between batches.
FLAT, KEPT = 1 << 20, 200_000
NONE = np.iinfo(np.int64).max


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary lies: in ``folder``, or where the package public_tokenizers has it."""
    return str(Path(folder) / name) if folder else str(importlib.import_module("public_tokenizers").path(name))


@dataclass(frozen=True)
class Vocabulary:
    byte_ids: np.ndarray  # id of each single byte
    keys: np.ndarray  # sorted: left id << 32 | right id
    ranks: np.ndarray  # what the pair merges to, which is its rank

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; no word is empty."""
        out: list[np.ndarray | None] = [None] * len(words)
        group: list[int] = []
        size = 0
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = self._long(w)
                continue
            group.append(k)
            size += len(w)
            if size >= FLAT:
                self._rounds(words, group, out)
                group, size = [], 0
        if group:
            self._rounds(words, group, out)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _rounds(self, words: list[bytes], group: list[int], out: list) -> None:
        lengths = np.fromiter((len(words[k]) for k in group), np.int64, len(group))
        ids = self.byte_ids[np.frombuffer(b"".join(words[k] for k in group), np.uint8)]
        word = np.repeat(np.arange(len(group)), lengths)
        done: dict[int, np.ndarray] = {}
        while len(ids):
            rank = np.full(len(ids), NONE)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self._rank(ids[inside], ids[inside + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                for s, n in zip(starts[over], sizes[over]):
                    done[int(word[s])] = ids[s : s + n]
                keep = ~np.repeat(over, sizes)
                ids, word, rank = ids[keep], word[keep], rank[keep]
                if not len(ids):
                    break
                least, sizes = least[~over], sizes[~over]
            hit = rank == np.repeat(least, sizes)
            # In a stretch of overlapping hits (a pair of equal symbols) every second one counts, from the left.
            at = np.flatnonzero(hit)
            joined = np.append(False, at[1:] == at[:-1] + 1)
            first = np.flatnonzero(~joined)
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[place % 2 == 0]
            ids = ids.copy()
            ids[at] = rank[at]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        for k, w in enumerate(group):
            out[w] = done[k]

    def _long(self, w: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(w, np.uint8)]
        rank = self._rank(ids[:-1], ids[1:])
        sym, nxt, prev = ids.tolist(), list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap = [(int(r), i) for i, r in enumerate(rank.tolist()) if r != NONE]
        heapq.heapify(heap)
        current = rank.tolist() + [NONE]
        pair = lambda a, b: int(self._rank(np.array([sym[a]]), np.array([sym[b]]))[0])
        while heap:
            r, i = heapq.heappop(heap)
            if current[i] != r:
                continue
            j = nxt[i]
            sym[i], nxt[i], current[j] = r, nxt[j], None
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                current[i] = pair(i, nxt[i])
                if current[i] != NONE:
                    heapq.heappush(heap, (current[i], i))
            else:
                current[i] = NONE
            if (p := prev[i]) >= 0:
                current[p] = pair(p, i)
                if current[p] != NONE:
                    heapq.heappush(heap, (current[p], p))
        out, i = [], 0
        while i >= 0:
            out.append(sym[i])
            i = nxt[i]
        return np.array(out, np.int64)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    left, right, made = [], [], []
    for token, rank in ranks.items():
        # Every cut of a token into two tokens is a pair that merges to it.
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                made.append(rank)
    keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
    order = np.argsort(keys)
    return Vocabulary(np.array([ranks[bytes([b])] for b in range(256)], np.int64), keys[order], np.array(made, np.int64)[order])


class Encoder:
    """Encodes texts batch by batch; words seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.pattern = regex.compile(PATTERN)

    def words(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, np.ndarray]]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        new = list({w for ws in split for w in ws if w not in self.known})
        self.known.update(zip(new, self.vocabulary.encode([w.encode("utf-8", "surrogatepass") for w in new])))
        return split, self.known

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        split, known = self.words(texts)
        return [np.concatenate([known[w] for w in ws]) if ws else np.zeros(0, np.int64) for ws in split]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        split, known = self.words(texts)
        return np.array([sum(len(known[w]) for w in ws) for ws in split], np.int64)


def _shared_vocabulary(spark: SparkSession, path: str):
    ship_package(spark)
    return spark.sparkContext.broadcast(load_vocabulary(path))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, batch: int = 512) -> DataFrame:
    """One row per row of ``df``: its id and ``ids`` (array of int), without special tokens.

    Null and empty texts have an empty list; the names of special tokens inside a text are ordinary text. Repeated rows come
    out each; other columns are not looked at. The vocabulary (under 3 MB, a fixed file) is broadcast.
    """
    shared = _shared_vocabulary(df.sparkSession, path or tokenizer_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                got = encoder.ids(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, text_col: str, path: str | None = None, batch: int = 512) -> DataFrame:
    """All columns of ``df`` but the text, and ``n_tokens`` (long), which replaces one of that name. Null and empty texts have 0."""
    shared = _shared_vocabulary(df.sparkSession, path or tokenizer_file())
    rest = [c for c in df.columns if c not in (text_col, "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                n = encoder.lengths(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(F.col(f"`{text_col}`").cast("string"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{schema}, n_tokens long")
