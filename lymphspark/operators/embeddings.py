"""Vectors of words, of their parts and of documents, trained by stochastic gradients.

Every kind is one model: the mean of some input vectors predicts a word, by negative samples or along a Huffman tree. The
inputs are the neighbours of the word (cbow), one neighbour (skip-gram), the document (pv-dbow), or the document and the
neighbours (pv-dm); a word with parts stands for the vectors of its parts. Texts are cut into shards by a hash of their id; in
an epoch each shard starts from the same vectors, and what the shards changed is averaged. Shards, batches and random numbers
depend on ids and on the seed only, so that the result is the same on any partitioning.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphspark.session import Stage

#: Numbers of a model, which is broadcast and gathered at the driver in every epoch; larger ones are refused.
MAX_VALUES = 50_000_000
#: Tokens of a shard, and shards at most; a shard is streamed, never held whole.
SHARD, MAX_SHARDS = 1 << 20, 512
#: Texts that are learned from at once, and rows of a matrix that travel together.
BATCH, BLOCK = 16, 1024
#: A vector that many predictions of a batch change moves as for so many at most.
MOST = 16.0
_BACK = "kind int, shard int, block int, delta binary, touched binary, row_id long, ids array<int>, v array<float>, loss double, n long"
_DOC, _IN, _OUT, _LOSS = range(4)


@dataclass(frozen=True)
class TrainParams:
    size: int = 50
    algorithm: str = "cbow"
    window: int = 5
    negative: int = 5
    epochs: int = 5
    rate: float = 0.025
    least_rate: float = 0.0001
    seed: int = 777

    def __post_init__(self):
        if self.algorithm not in ("cbow", "skip-gram", "pv-dbow", "pv-dm"):
            raise ValueError("algorithm is cbow, skip-gram, pv-dbow or pv-dm")
        if min(self.size, self.window, self.epochs) < 1 or self.negative < 0:
            raise ValueError("size, window and epochs are positive; without negative samples a Huffman tree serves")


@dataclass
class Model:
    """``words`` in order of frequency; word k has the input rows parts[offsets[k]:offsets[k + 1]]."""

    words: list[str]
    counts: np.ndarray
    parts: np.ndarray
    offsets: np.ndarray
    inputs: np.ndarray
    outputs: np.ndarray
    losses: list[float] = field(default_factory=list)

    def vectors(self) -> np.ndarray:
        """One vector a word: the mean of its parts."""
        if not len(self.words):
            return self.inputs[:0]
        return np.add.reduceat(self.inputs[self.parts], self.offsets[:-1]) / np.diff(self.offsets)[:, None]


def uniform(seed: int, shape: tuple[int, int]) -> np.ndarray:
    """Start vectors: small and seeded."""
    return ((np.random.Generator(np.random.Philox(seed)).random(shape, np.float32) - 0.5) / shape[1]).astype(np.float32)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its inner nodes from the root and the turns taken there, flat, with offsets."""
    n = len(counts)
    heap = [(int(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, turn = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8)
    for made in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[i, j]], turn[j] = made, 1
        heapq.heappush(heap, (a + b, made))
    points, turns, offsets = [], [], [0]
    for k in range(n):
        path, at = [], k
        while n > 1 and at != 2 * n - 2:
            path.append((parent[at] - n, turn[at]))
            at = parent[at]
        points += [p for p, _ in reversed(path)]
        turns += [t for _, t in reversed(path)]
        offsets.append(len(points))
    return np.array(points, np.int64), np.array(turns, np.float32), np.array(offsets)


class _Outputs:
    """What a word is predicted by: rows of the output matrix with labels."""

    def __init__(self, counts: np.ndarray, negative: int):
        self.negative = negative
        if negative:
            self.below = np.cumsum(counts.astype(float) ** 0.75)
            self.below /= self.below[-1]
        else:
            self.points, self.turns, self.offsets = huffman(counts)

    def of(self, target: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Example, row and label, by example."""
        if self.negative:
            drawn = np.searchsorted(self.below, random.random((len(target), self.negative)))
            rows = np.column_stack([target, drawn])
            use = np.column_stack([np.ones(len(target), bool), drawn != target[:, None]])
            label = np.zeros(rows.shape, np.float32)
            label[:, 0] = 1
            example = np.repeat(np.arange(len(target)), rows.shape[1]).reshape(rows.shape)
            return example[use], rows[use], label[use]
        size = self.offsets[target + 1] - self.offsets[target]
        at = np.repeat(self.offsets[target] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(target)), size), self.points[at], 1 - self.turns[at]


def neighbours(ids: np.ndarray, text: np.ndarray, window: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(position, position of a neighbour in the same text) within a window that is drawn for each position."""
    width = random.integers(1, window + 1, len(ids))
    step = np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])
    around = np.concatenate([np.full(window, -1), text, np.full(window, -1)])
    same = around[np.arange(window, window + len(ids))[:, None] + step] == text[:, None]
    here, which = np.nonzero(same & (np.abs(step) <= width[:, None]))
    return here, here + step[which]


def _add(to: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    """np.add.at by rows, over the matrix as one line of numbers: these are added in the same order, many times faster."""
    width = to.shape[1]
    np.add.at(to.reshape(-1), (at[:, None] * width + np.arange(width)).reshape(-1), change.reshape(-1))


def learn(ids: np.ndarray, text: np.ndarray, docs: np.ndarray | None, m: Model, outputs: _Outputs, p: TrainParams, rate: float, random: np.random.Generator, frozen: bool = False) -> tuple[float, int, np.ndarray, np.ndarray]:
    """One step on a batch of texts, in place: ``ids`` are word numbers, ``text`` their text in the batch, ``docs`` the texts' vectors.
    Gives the loss, the number of predictions and the rows of both matrices that changed. Frozen, only ``docs`` change."""
    none = np.zeros(0, np.int64)
    if p.algorithm == "pv-dbow":
        example, word, target, own = none, none, ids, text
    else:
        here, there = neighbours(ids, text, p.window, random)
        if p.algorithm == "skip-gram":
            example, word, target, own = np.arange(len(here)), ids[there], ids[here], text[here]
        elif p.algorithm == "pv-dm":
            example, word, target, own = here, ids[there], ids, text
        else:
            kept, example = np.unique(here, return_inverse=True)
            word, target, own = ids[there], ids[kept], text[kept]
    if not len(target):
        return 0.0, 0, none, none
    size = m.offsets[word + 1] - m.offsets[word]
    part = m.parts[np.repeat(m.offsets[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    example = np.repeat(example, size)
    total = np.bincount(example, minlength=len(target)).astype(np.float32) + (docs is not None)
    hidden = np.zeros((len(target), p.size), np.float32)
    _add(hidden, example, m.inputs[part])
    if docs is not None:
        hidden += docs[own]
    hidden /= total[:, None]
    of, row, label = outputs.of(target, random)
    if not len(row):
        return 0.0, 0, none, none
    inner, out = hidden[of], m.outputs[row]
    score = np.clip(np.einsum("ij,ij->i", inner, out), -30, 30)
    likely = 1 / (1 + np.exp(-score))
    loss = -float(np.log(np.where(label > 0, likely, 1 - likely) + 1e-12).sum())
    step = ((label - likely) * rate).astype(np.float32)[:, None]
    back = np.zeros_like(hidden)
    _add(back, of, step * out)
    back /= total[:, None]
    damped = lambda at: np.minimum(1, MOST / np.bincount(at)[at]).astype(np.float32)[:, None]
    if docs is not None:
        _add(docs, own, back * damped(own))
    if not frozen:
        _add(m.outputs, row, step * inner * damped(row))
        if len(part):
            _add(m.inputs, part, back[example] * damped(part))
    return loss, len(target), part, row


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Shard, row ids, word numbers, the texts' lengths and vectors (if any) of up to BATCH texts of one shard, whatever the
    Arrow batches."""

    def cut(whole: pa.RecordBatch, last: bool) -> Iterator:
        nonlocal held
        shard, row = whole.column(0).to_numpy(), whole.column(1).to_numpy()
        words, vectors = whole.column(2), whole.column(3)
        ends, flat = words.offsets.to_numpy(), words.values.to_numpy().astype(np.int64)
        known = vectors.null_count < len(vectors)
        v_ends, v_flat = (vectors.offsets.to_numpy(), vectors.values.to_numpy()) if known else (None, None)
        starts = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        held = None
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
            for lo in range(a, b, BATCH):
                hi = min(lo + BATCH, b)
                if hi == len(shard) and not last:
                    held = whole.slice(lo)
                else:
                    docs = v_flat[v_ends[lo] : v_ends[hi]].reshape(hi - lo, -1).copy() if known else None
                    yield int(shard[lo]), row[lo:hi], flat[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1]), docs

    held = None
    for batch in batches:
        if batch.num_rows:
            yield from cut(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0], False)
    if held is not None:
        yield from cut(held, True)


def _epoch(shared, p: TrainParams, epoch: int, with_docs: bool):
    rate = p.rate - (p.rate - p.least_rate) * epoch / max(p.epochs, 1)
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _BACK.split(", ")])

    def told(kind: int, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | {"kind": kind} for r in rows], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Model = shared.value
        outputs = _Outputs(start.counts, p.negative)
        now, m, seen, loss, n = None, None, None, 0.0, 0
        learned: list[tuple] = []

        def texts() -> Iterator[pa.RecordBatch]:
            """The texts learned from since the last time, with their vectors."""
            if learned:
                shard, row, ids, lengths, docs = (np.concatenate(c) for c in zip(*learned))
                of = lambda ends, x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(x))
                own = {"kind": pa.array(np.full(len(row), _DOC, np.int32)), "shard": pa.array(shard), "row_id": pa.array(row), "ids": of(np.cumsum(lengths), ids.astype(np.int32)), "v": of(np.arange(1, len(row) + 1) * p.size, docs.reshape(-1))}
                yield pa.RecordBatch.from_arrays([own.get(c.name, pa.nulls(len(row), c.type)) for c in schema], schema=schema)
                learned.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if m is None:
                return
            for kind, new, old, touched in ((_IN, m.inputs, start.inputs, seen[0]), (_OUT, m.outputs, start.outputs, seen[1])):
                for block in np.unique(np.flatnonzero(touched) // BLOCK).tolist():
                    at = slice(block * BLOCK, (block + 1) * BLOCK)
                    yield told(kind, [{"shard": now, "block": block, "delta": (new[at] - old[at]).tobytes(), "touched": touched[at].tobytes()}])
            yield told(_LOSS, [{"shard": now, "loss": loss, "n": n}])

        for shard, row, ids, lengths, docs in _batches(batches):
            if shard != now:
                yield from close()
                now, m = shard, Model([], start.counts, start.parts, start.offsets, start.inputs.copy(), start.outputs.copy())
                seen, loss, n = (np.zeros(len(start.inputs), bool), np.zeros(len(start.outputs), bool)), 0.0, 0
            random = np.random.Generator(np.random.Philox(key=[p.seed + epoch, int(row[0]) & (2**63 - 1)]))
            text = np.repeat(np.arange(len(row)), lengths)
            cost, count, ins, outs = learn(ids, text, docs, m, outputs, p, rate, random)
            seen[0][ins], seen[1][outs] = True, True
            loss, n = loss + cost, n + count
            if with_docs:
                learned.append((np.full(len(row), now, np.int32), row, ids, lengths, docs))
                if len(learned) * BATCH >= BLOCK:
                    yield from texts()
        yield from texts()
        yield from close()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what the shards changed, in their order: each row's mean change over the shards that touched it."""
    now, total, count = None, None, None

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": [now[0]], "block": [now[1]], "delta": [(total / np.maximum(count, 1)[:, None]).astype(np.float32).tobytes()]}, schema=pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("delta", pa.binary())]))

    for batch in batches:
        for kind, block, delta, touched in zip(*(batch.column(k).to_pylist() for k in range(4))):
            hit = np.frombuffer(touched, bool)
            change = np.frombuffer(delta, np.float32).reshape(len(hit), -1)
            if (kind, block) != now:
                if now is not None:
                    yield emit()
                now, total, count = (kind, block), np.zeros(change.shape), np.zeros(len(hit))
            total += change
            count += hit
    if now is not None:
        yield emit()


def known_words(tokens: DataFrame, min_count: int, most: int) -> list[tuple[str, int]]:
    """Words that occur often enough, the commonest first; over ``most`` are an error."""
    counts = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} words; raise min_count")
    return sorted(((r.word, r.n) for r in found), key=lambda x: (-x[1], x[0]))


def train(tokens: DataFrame, p: TrainParams, min_count: int = 2, parts: dict[str, list[int]] | None = None, part_rows: int = 0, words: list[tuple[str, int]] | None = None) -> tuple[Model, DataFrame | None]:
    """A model of texts (``row_id``, ``tokens``), and for the pv algorithms ``row_id``, ``v`` of the texts themselves.

    ``parts`` gives the input rows of each word, of ``part_rows`` rows; without it each word has one row. Words below ``min_count``
    are left out, and texts without known words have a vector as started. Null ids and null or empty texts are left out.
    """
    spark, with_docs = tokens.sparkSession, p.algorithm.startswith("pv")
    words = known_words(tokens, min_count, MAX_VALUES // (2 * p.size)) if words is None else words
    names, counts = [w for w, _ in words], np.array([n for _, n in words], np.int64)
    rows = [parts[w] for w in names] if parts else [[k] for k in range(len(names))]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    n_in = part_rows if parts else len(names)
    if (n_in + len(names)) * p.size > MAX_VALUES:
        raise ValueError(f"the model has over {MAX_VALUES} numbers; lower the size or raise min_count")
    m = Model(names, counts, np.array([x for r in rows for x in r], np.int64), offsets, uniform(p.seed, (n_in, p.size)), np.zeros((max(len(names), 1), p.size), np.float32))
    stage = Stage(spark, "vectors")
    number = spark.sparkContext.broadcast({w: k for k, w in enumerate(names)})
    total = int(counts.sum())
    shards = max(1, min(MAX_SHARDS, ceil(total / SHARD)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            ids = [[known[w] for w in t or () if w in known] for t in batch.column(2).to_pylist()]
            start = [uniform(p.seed ^ (i & (2**63 - 1)), (1, p.size))[0].tolist() if with_docs else None for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(start, pa.list_(pa.float32()))], names=["shard", "row_id", "ids", "v"])

    given = tokens.filter("row_id is not null").select(F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int").alias("shard"), F.col("row_id").cast("long").alias("row_id"), "tokens")
    texts = stage.write(given.mapInArrow(coded, "shard int, row_id long, ids array<int>, v array<float>"), "coded")
    for epoch in range(p.epochs if len(names) else 0):
        shared = spark.sparkContext.broadcast(m)
        sorted_ = texts.repartition(shards, "shard").sortWithinPartitions("shard", "row_id", "ids")
        back = stage.write(sorted_.mapInArrow(_epoch(shared, p, epoch, with_docs), _BACK), "back")
        changes = back.filter(F.col("kind").isin(_IN, _OUT)).repartition("kind", "block").sortWithinPartitions("kind", "block", "shard").select("kind", "block", "delta", "touched")
        for r in changes.mapInArrow(_added, "kind int, block int, delta binary").collect():
            matrix = m.inputs if r.kind == _IN else m.outputs
            part = matrix[r.block * BLOCK : (r.block + 1) * BLOCK]
            part += np.frombuffer(r.delta, np.float32).reshape(part.shape)
        cost = back.filter(F.col("kind") == _LOSS).orderBy("shard").select("loss", "n").collect()
        m.losses.append(sum(r.loss for r in cost) / max(sum(r.n for r in cost), 1))
        shared.destroy()
        if with_docs:
            new = stage.write(back.filter(F.col("kind") == _DOC).select("shard", "row_id", "ids", "v"), "coded")
            stage.drop(texts)
            texts = new
        stage.drop(back)
    return m, texts.select("row_id", "v") if with_docs else None


def infer(tokens: DataFrame, m: Model, p: TrainParams) -> DataFrame:
    """``row_id``, ``v`` of new texts by a pv model whose words stay as they are: each text is learned alone, from its seeded start."""
    shared = tokens.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known, outputs = {w: k for k, w in enumerate(model.words)}, _Outputs(model.counts, p.negative) if len(model.words) else None
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([known[w] for w in t or () if w in known], np.int64)
                doc = uniform(p.seed ^ (i & (2**63 - 1)), (1, p.size))
                for epoch in range(p.epochs if len(ids) else 0):
                    random = np.random.Generator(np.random.Philox(key=[p.seed + epoch, i & (2**63 - 1)]))
                    learn(ids, np.zeros(len(ids), np.int64), doc, model, outputs, p, p.rate - (p.rate - p.least_rate) * epoch / p.epochs, random, frozen=True)
                out.append(doc[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in out], pa.list_(pa.float32()))], names=["row_id", "v"])

    return tokens.filter("row_id is not null").select(F.col("row_id").cast("long").alias("row_id"), "tokens").mapInArrow(run, "row_id long, v array<float>")


def join_phrases(tokens: DataFrame, phrases: DataFrame, most: int = 100_000, glue: str = "_") -> DataFrame:
    """``tokens`` (``row_id``, ``tokens``) with neighbouring words that are a phrase (``w1``, ``w2``) joined, from the left, each word once.
    Phrases are broadcast; over ``most`` are an error."""
    found = phrases.select("w1", "w2").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} phrases; raise the threshold")
    shared = tokens.sparkSession.sparkContext.broadcast({(r.w1, r.w2) for r in found})

    def joined(words: list[str]) -> list[str]:
        out, k, known = [], 0, shared.value
        while k < len(words):
            both = k + 1 < len(words) and (words[k], words[k + 1]) in known
            out.append(words[k] + glue + words[k + 1] if both else words[k])
            k += 1 + both
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else joined(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["row_id", "tokens"])

    return tokens.select(F.col("row_id").cast("long").alias("row_id"), "tokens").mapInArrow(run, "row_id long, tokens array<string>")
