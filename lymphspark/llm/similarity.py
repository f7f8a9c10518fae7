"""Exact similarity classes of sets by Jaccard threshold, for collections too large to compare pairwise.

1. Every text becomes a sorted array of 64-bit numbers, one per distinct word or word run.
2. Each set is posted under keys such that two sets above the threshold always share a key (see ``prefix``); keys that many
   sets have are left out first. A posting carries the size and a hashed bitmap of the set. Postings travel as packed
   arrays, one blob per batch and tile part.
3. Within the postings of one key, in order of size, the bits in which two bitmaps differ bound the overlap of the two sets
   from above; pairs that pass are linked. Each part keeps only a spanning forest of its links.
4. The components of these links hold every pair above the threshold. The sets of each component come together in tiles of
   bounded size, where surviving pairs are compared exactly on their sorted arrays.

With ``carried``, a posting has single elements as keys and takes all elements of its set along, the least frequent first. Runs
of a key are then split by the next element that two sets have in common, and again, as long as that leaves fewer pairs; so the
pairs that are compared do not grow with the square of the rows. What the bitmaps let pass is checked on the elements.

Equal sets are one node throughout. Results depend neither on partitioning nor on the frequency estimates, which only decide
what is left out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.llm.components import connected_components
from lymphspark.llm.numeric import forest, join, mix, pairs_in_runs, position_in_run, run_starts
from lymphspark.session import Stage

_U = np.uint64
#: Frequency estimates are counts by hashed key; their number is fixed, and so is the size of the broadcast (1 MB).
BUCKETS = 1 << 17
#: Elements behind one tile part; postings of one key beyond which these are cut into tiles of block pairs; postings that a
#: task holds before it packs them by part.
PART, BLOCK, HELD = 1 << 20, 1 << 20, 1 << 20
#: Codes of carried sets that a tile part holds at a time, whatever its keys have; codes that are turned into wider numbers at a
#: time; bytes of blobs that travel together.
CODES, WIDE, SENT = 1 << 25, 1 << 20, 1 << 22
#: Runs of a key up to SMALL_RUN are compared pair by pair, larger ones as blocks of OUTER rows after up to STARS pivots (all
#: of them in runs of HOT_RUN and more; a smaller run goes on with pivots only while they find near sets).
SMALL_RUN, OUTER, STARS, HOT_RUN = 64, 128, 4, 4096
#: Elements in common by which runs are split at most, and rows of a split that are held at a time.
DEPTH, SPLIT = 6, 1 << 18
#: Sets of a component that one task compares; larger components are cut into tiles of block pairs.
TILE = 2048
#: Bits of the hashed row filter (2 MB broadcast, whatever the input).
FILTER_BITS = 1 << 24


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least num/den. ``runs`` of words make one element; ``paired`` posts pairs of neighbours;
    ``carried`` postings take the elements of their sets along."""

    num: int
    den: int
    run: int = 1
    paired: bool = False
    other: str = r"[^\pL]+"
    carried: bool = False

    def least_overlap(self, total: np.ndarray) -> np.ndarray:
        """Common elements that two sets with ``total`` elements together need."""
        return -(-self.num * total // (self.num + self.den))

    def most_apart(self, total: np.ndarray) -> np.ndarray:
        """Elements in which two such sets may differ."""
        return total - 2 * self.least_overlap(total)

    def prefix(self, n: int) -> int:
        """How many keys of a set of n elements have to be posted."""
        return _prefix(self, n)


@lru_cache(maxsize=1 << 16)
def _prefix(s: Similarity, n: int) -> int:
    """Single elements: two sets with overlap o of at least t*n share one of any n - o + 1 elements in a common order.

    Pairs: order the elements of a set by hash and take neighbours. Two sets with o common elements, which differ in
    d = n + m - 2o, have at least o - 1 - d neighbours in common, as each differing element parts at most one of the o - 1
    neighbouring common elements. So n - 1 pairs less that number plus one have to be posted. Where the bound is not
    positive (tiny sets only, see ``tiny``), single elements are posted as well.
    """
    if not s.paired:
        return n - ceil(s.num * n / s.den) + 1
    sums = [n + m for m in range(ceil(s.num * n / s.den), n * s.den // s.num + 1)]
    shared = [3 * o - t - 1 for t in sums for o in [int(s.least_overlap(np.int64(t)))] if o <= min(n, t - n)]
    return n - max(1, min([x for x in shared if x > 0], default=1))


@lru_cache(maxsize=8)
def tiny(s: Similarity) -> int:
    """Sets up to this size also post single elements, since they have partners that no pair is shared with."""
    most = 0
    if s.paired:
        for n in range(1, 64):
            for m in range(ceil(s.num * n / s.den), n + 1):
                o = int(s.least_overlap(np.int64(n + m)))
                if o <= m and 3 * o - n - m - 1 < 1:
                    most = n
    return most


# ---------------------------------------------------------------- sets


def hashed_words(texts: pa.Array, other: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word of each text, in order; ``other`` is what stands between words."""
    words = pc.split_pattern_regex(pc.fill_null(texts, ""), other)
    flat = pc.list_flatten(words)
    rows = pc.list_parent_indices(words).to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    values = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return rows[full], values[coded.indices.to_numpy()[full]]


def word_runs(rows: np.ndarray, h: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of so many words, in order."""
    if run == 1 or len(h) < run:
        return (rows, h) if run == 1 else (rows[:0], h[:0])
    m = len(h) - run + 1
    whole = rows[:m] == rows[run - 1 :]
    made = np.zeros(m, np.uint64)
    for k in range(run):
        made = mix(made ^ h[k : k + m])
    return rows[:m][whole], made[whole]


def distinct_sorted(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    keep = run_starts(rows, h)
    return rows[keep], h[keep]


def hashed_sets(texts: pa.Array, s: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every distinct element of each text, sorted by row and value."""
    return distinct_sorted(*word_runs(*hashed_words(texts, s.other), s.run))


def _set_maker(s: Similarity) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                rows, h = hashed_sets(batch.column(3), s)
                n = np.bincount(rows, minlength=batch.num_rows)
                ends = np.concatenate([[0], np.cumsum(n)])
                total = np.zeros(batch.num_rows, np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    total[some] = np.add.reduceat(mix(h), ends[some])
                node = mix(total ^ mix(n.astype(np.uint64)) ^ mix(batch.column(0).to_numpy().astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["field", "row_id", "rid", "node", "n", "elements"],
                )

    return run


def make_sets(texts: DataFrame, s: Similarity) -> DataFrame:
    """``field`` (int), ``row_id``, ``rid``, ``node``, ``n``, ``elements`` from ``field``, ``row_id``, ``text``.

    ``node`` is a 64-bit hash of field and set: rows with equal sets share it. Null and empty texts have an empty set. Rows
    without a row_id are left out.
    """
    chosen = texts.filter("row_id is not null").select(F.col("field").cast("int"), F.col("row_id").cast("long"), F.monotonically_increasing_id().alias("rid"), F.lower(F.col("text")).alias("text"))
    return chosen.mapInArrow(_set_maker(s), "field int, row_id long, rid long, node long, n int, elements array<long>")


# ---------------------------------------------------------------- postings


def keys_of(rows: np.ndarray, h: np.ndarray, n: np.ndarray, s: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and whether it is an extra of a tiny set, from elements sorted by row and value; n is each row's size."""
    if not s.paired:
        return rows, mix(h), np.zeros(len(h), bool)
    next_too = np.flatnonzero(rows[:-1] == rows[1:])
    small = np.flatnonzero(n[rows] <= tiny(s))
    key = np.concatenate([mix(mix(h[next_too]) ^ h[next_too + 1]), mix(h[small] ^ _U(0x5BF03635))])
    return np.concatenate([rows[next_too], rows[small]]), key, np.repeat([False, True], [len(next_too), len(small)])


def bitmaps(rows: np.ndarray, h: np.ndarray, count: int, words: int) -> np.ndarray:
    bit = (mix(h ^ _U(0xC2B2AE35)) >> _U(7)) % _U(64 * words)
    out = np.zeros((count, words), np.uint64)
    np.bitwise_or.at(out, (rows, (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))
    return out


def bitmap_words(mean: float) -> int:
    """Words of a field's bitmaps, by its mean set. Fewer let sets pass that have nothing in common, and so join components
    that the exact comparison then has to take apart; the result is the same."""
    return min(max(2, ceil(mean / 20)), 8)


def _unpack(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(name))
    return pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy().view(np.uint64)


def _counter(s: Similarity) -> Callable:
    """Counts keys by bucket over a partition; buckets well above the mean are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            rows, h = _unpack(batch, "elements")
            _, key, _ = keys_of(rows, h, batch.column(batch.schema.get_field_index("n")).to_numpy(), s)
            counts += np.bincount((key >> _U(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
        told = np.flatnonzero(counts > 1.5 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(counts[told])], names=["bucket", "n"])

    return run


def estimate(sets: DataFrame, s: Similarity) -> np.ndarray:
    """Estimated frequency of keys by bucket, over all sets."""
    counted = sets.select("n", "elements").mapInArrow(_counter(s), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counted.bucket.to_numpy()] = counted.n.to_numpy()
    return out


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, the first byte of every number first: they compress better so."""
    return np.ascontiguousarray(a.reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def _from_planes(data: memoryview, dtype, count: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, count * size).reshape(size, count).T).reshape(-1).view(dtype)


def pack(key: np.ndarray, rid: np.ndarray, n: np.ndarray, sig: np.ndarray) -> bytes:
    """Postings sorted by key as one blob: numbers are written by byte planes, and all is compressed lightly."""
    body = b"".join((_planes(np.diff(key, prepend=np.uint32(0))), _planes(rid), _planes(n.astype(np.uint32)), sig.tobytes()))
    return np.array([len(key), sig.shape[1]], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    count, words = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    body = memoryview(zstandard.ZstdDecompressor().decompress(blob[16:]))
    step, rid, n = _from_planes(body, np.uint32, count), _from_planes(body[4 * count :], np.int64, count), _from_planes(body[12 * count :], np.uint32, count)
    return np.cumsum(step, dtype=np.uint32), rid, n.astype(np.int64), np.frombuffer(body, np.uint64, count * words, offset=16 * count).reshape(count, words)


def block_rows(s: Similarity, mean: float) -> int:
    """Postings of one key beyond which these are cut into blocks, by the field's mean set: carried ones are as large as their sets."""
    return max(1, min(BLOCK, int(2 * CODES / max(mean, 1)))) if s.carried else BLOCK


def _poster(s: Similarity, known, parts: dict[int, int], words: dict[int, int], block: dict[int, int] | None = None) -> Callable:
    prefixes, block = np.zeros(0, np.int64), block or {}

    def prefix_of(n: np.ndarray) -> np.ndarray:
        nonlocal prefixes
        top = int(n.max(initial=0))
        if top >= len(prefixes):
            prefixes = np.array([0] + [s.prefix(k) for k in range(1, top + 1)]) if top < 1 << 16 else np.zeros(0, np.int64)
        if top < len(prefixes):
            return prefixes[n]
        return np.array([s.prefix(int(k)) if k else 0 for k in n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = known.value
        held: dict[int, list[tuple]] = {}
        size = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                batch = whole.slice(lo, 8192)
                field, rid, node, n = (batch.column(k).to_numpy() for k in range(4))
                rows, h = _unpack(batch, "elements")
                # Of equal sets in the batch one is posted, that of the least rid: rids need not ascend, as a scan may join files.
                by_node = np.lexsort((rid, node))
                chosen = np.zeros(len(node), bool)
                chosen[by_node[run_starts(node[by_node])]] = True
                chosen &= n > 0
                kept = chosen[rows]
                rows, h = rows[kept], h[kept]
                r, key, extra = keys_of(rows, h, n, s)
                often = frequency[(key >> _U(40)).astype(np.int64) % BUCKETS]
                # One number for row, extras last, and frequency: fewer passes than sorting by each.
                place = (r << 40) | (extra.astype(np.int64) << 39) | np.minimum(often, (1 << 39) - 1)
                order = np.lexsort((key, place))
                r, key, extra, often = r[order], key[order], extra[order], often[order]
                within = position_in_run(run_starts(r), len(r))
                post = extra | (within < prefix_of(n)[r])
                if s.carried:
                    sizes = np.where(chosen, n, 0).astype(np.int64)
                    lists = (rid, sizes, np.cumsum(sizes) - sizes, (key & _U(0xFFFF)).astype(np.uint16))
                    r, key, often, within = r[post], key[post], often[post], within[post]
                    for f in np.unique(field[chosen]).tolist():
                        own = field[r] == f
                        at = np.stack([r[own], within[own]], axis=1)
                        place, _, _, at = _placed(f, np.arange(len(at)), key[own], often[own], rid[r[own]], n[r[own]], at, parts[f], block.get(f, BLOCK))
                        held.setdefault(f, []).append((place, at, lists))
                        size += len(place)
                    if size >= HELD:
                        for f, found in held.items():
                            yield from _carried_blobs(f, found)
                        held, size = {}, 0
                    continue
                r, key, often = r[post], key[post], often[post]
                for f in np.unique(field[chosen]).tolist():
                    own = field[r] == f
                    made = _placed(f, r[own], key[own], often[own], rid, n, bitmaps(rows, h, len(n), words[f]), parts[f], block.get(f, BLOCK))
                    held.setdefault(f, []).append(made)
                    size += len(made[0])
                if size >= HELD:
                    for f, found in held.items():
                        yield _blobs(f, found)
                    held, size = {}, 0
        for f, found in held.items():
            yield from _carried_blobs(f, found) if s.carried else [_blobs(f, found)]

    return run


def _placed(f: int, r, key, often, rid, n, sig, parts: int, block: int = BLOCK) -> tuple:
    """Part and short key of each posting in one number, and what it carries: row, size, bitmap."""
    key = mix(key ^ _U(f + 1))
    blocks = np.maximum(1, -(-often // block))
    if (blocks > 1).any():
        # A key with too many postings is cut into blocks by row, and its postings go to the tiles of all block pairs.
        at = np.repeat(np.arange(len(r)), blocks)
        own = (mix(rid[r].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)[at]
        other = position_in_run(run_starts(at), len(at))
        tile = (np.minimum(own, other) << 32) | np.maximum(own, other)
        r, key = r[at], np.where(blocks[at] > 1, mix(key[at] ^ mix(tile.astype(np.uint64))), key[at])
    part = (key >> _U(32)).astype(np.int64) % parts
    return (part << 32) | (key & _U(0xFFFFFFFF)).astype(np.int64), rid[r], n[r], sig[r]


def _blobs(f: int, held: list[tuple]) -> pa.RecordBatch:
    place, rid, n, sig = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(place, kind="stable")
    place, rid, n, sig = place[order], rid[order], n[order], sig[order]
    part, short = place >> 32, (place & 0xFFFFFFFF).astype(np.uint32)
    cuts = np.append(run_starts(part), len(part))
    blobs = [pack(short[a:b], rid[a:b], n[a:b], sig[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array((f << 40) | part[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1 ... of each list, one list after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _carried_blobs(f: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """As _blobs(), some at a time; every blob has the sets of its postings once, as the codes of their elements in order of frequency."""
    rows, codes = np.cumsum([0, *[len(x[0]) for _, _, x in held]]), np.cumsum([0, *[len(x[3]) for _, _, x in held]])
    rid, n, first, code = (np.concatenate(c) for c in zip(*[(x[0], x[1], x[2] + start, x[3]) for (_, _, x), start in zip(held, codes)]))
    place = np.concatenate([p for p, _, _ in held])
    row, pos = np.concatenate([at + [start, 0] for (_, at, _), start in zip(held, rows)]).T
    order = np.argsort(place, kind="stable")
    place, row, pos = place[order], row[order], pos[order]
    part, short = place >> 32, (place & 0xFFFFFFFF).astype(np.uint32)
    cuts, parts, blobs, size = np.append(run_starts(part), len(part)), [], [], 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, at = np.unique(row[a:b], return_inverse=True)
        blobs.append(pack_carried(short[a:b], at, pos[a:b], rid[own], n[own], code[_ragged(first[own], n[own])]))
        parts.append((f << 40) | int(part[a]))
        size += len(blobs[-1])
        if size >= SENT or b == len(part):
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])
            parts, blobs, size = [], [], 0


def pack_carried(key: np.ndarray, at: np.ndarray, pos: np.ndarray, rid: np.ndarray, n: np.ndarray, code: np.ndarray) -> bytes:
    """Postings sorted by key, with the place of their set and that of the key in it; the sets, and apart from these their codes."""
    small = zstandard.ZstdCompressor(level=1).compress
    head = small(b"".join((_planes(np.diff(key, prepend=np.uint32(0))), _planes(at.astype(np.uint32)), _planes(pos.astype(np.uint32)), _planes(rid), _planes(n.astype(np.uint32)))))
    return np.array([len(key), len(rid), len(code), len(head)], np.int64).tobytes() + head + small(_planes(code))


def _carried_head(blob: bytes) -> tuple[np.ndarray, ...]:
    """All of a blob but its codes."""
    count, sets, _, size = (int(x) for x in np.frombuffer(blob, np.int64, 4))
    body, out = memoryview(zstandard.ZstdDecompressor().decompress(memoryview(blob)[32 : 32 + size])), []
    for dtype, k in ((np.uint32, count), (np.uint32, count), (np.uint32, count), (np.int64, sets), (np.uint32, sets)):
        out.append(_from_planes(body, dtype, k))
        body = body[k * np.dtype(dtype).itemsize :]
    key, at, pos, rid, n = out
    return np.cumsum(key, dtype=np.uint32), at.astype(np.int64), pos.astype(np.int64), rid, n.astype(np.int64)


def unpack_carried(blob: bytes, keys: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """What pack_carried() was given; with ``keys`` only their postings and the sets of these."""
    codes, size = (int(x) for x in np.frombuffer(blob, np.int64, 4)[2:])
    key, at, pos, rid, n = _carried_head(blob)
    use = slice(None) if keys is None else np.isin(key, keys)
    if not len(key[use]):
        return key[:0], at[:0], pos[:0], rid[:0], n[:0], np.zeros(0, np.uint16)
    code = _from_planes(memoryview(zstandard.ZstdDecompressor().decompress(memoryview(blob)[32 + size :])), np.uint16, codes)
    if keys is None:
        return key, at, pos, rid, n, code
    own, at = np.unique(at[use], return_inverse=True)
    return key[use], at, pos[use], rid[own], n[own], code[_ragged((np.cumsum(n) - n)[own], n[own])]


def key_groups(blobs: list[bytes]) -> list[np.ndarray | None]:
    """The keys of a part in groups of up to CODES carried codes, a key with more being alone; [None] if that is one group."""
    found = []
    for blob in blobs:
        key, at, _, _, n = _carried_head(blob)
        starts = run_starts(key)
        found.append((key[starts], np.add.reduceat(n[at], starts) if len(key) else n[:0]))
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    ends = np.cumsum(np.bincount(at, np.concatenate([w for _, w in found]), len(keys)))
    if not len(keys) or ends[-1] <= CODES:
        return [None]
    groups, lo = [], 0
    while lo < len(keys):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CODES, "right")))
        groups.append(keys[lo:hi])
        lo = hi
    return groups


# ---------------------------------------------------------------- tiles


class _Splits:
    """Links between the sets of one part, from carried postings.

    Two sets above the threshold with o elements in common have the k-th of these, in order of frequency, among the first
    n - o + k of each. So the sets of a run that share k elements are split by each further one that stands there, and pairs
    with no more than k in common (tiny sets only) are compared before. With the k-th at pos, a set has at most n - pos + k - 1
    in common with another (``most``); if that is too few even for one of its own size it is not ``near``, and of every pair
    the smaller set is. Codes may agree by chance: that lets more pairs be compared.
    """

    def __init__(self, s: Similarity, n: np.ndarray, first: np.ndarray, code: np.ndarray):
        self.s, self.n, self.first, self.code = s, n, first, code
        self.label = np.arange(len(n))
        fewest = -(-s.num * n // s.den)
        #: Last place (from 0) of the first common element, the smallest similar set, and what similar sets have in common.
        self.last, self.fewest = n - fewest, fewest
        self.need = s.least_overlap(np.arange(2 * int(n.max(initial=0)) + 1))
        #: The fewest elements that the set can have in common with a similar one.
        self.least = s.least_overlap(n + fewest)
        self.far = s.most_apart(np.arange(len(self.need)))
        # Equal lists are one set.
        self.sig, whole = np.zeros((len(n), 4), np.uint64), np.zeros(len(n), np.uint64)
        ends, lo = np.cumsum(n), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + WIDE, "right")))
            start, wide = first[lo:hi] - first[lo], code[first[lo] : ends[hi - 1]].astype(np.uint64)
            self.sig[lo:hi] = bitmaps(np.repeat(np.arange(hi - lo), n[lo:hi]), wide, hi - lo, 4)
            line = mix((wide << _U(32)) + position_in_run(start, len(wide)).astype(np.uint64))
            whole[lo:hi] = np.add.reduceat(line, start) + mix(n[lo:hi].astype(np.uint64))
            lo = hi
        _, at, inverse = np.unique(whole, return_index=True, return_inverse=True)
        self.same = at[inverse]
        self.label = join(self.label, np.arange(len(n)), self.same)

    def run(self, key: np.ndarray, at: np.ndarray, pos: np.ndarray) -> np.ndarray:
        at = self.same[at]
        order = np.lexsort((at, key))
        key, at, pos = key[order], at[order], pos[order]
        own = run_starts(key, at)
        self._split(key[own].astype(np.int64), at[own], pos[own], 1)
        return self.label

    def _split(self, group: np.ndarray, at: np.ndarray, pos: np.ndarray, k: int) -> None:
        """Links the sets of every group; the sets of one have k elements in common, the k-th of which is at pos."""
        if not len(group):
            return
        starts = run_starts(group)
        sizes = np.diff(np.append(starts, len(group)))
        label, n = self.label[at], self.n[at]
        most = n - pos + k - 1
        near = most >= self.need[2 * n]
        open_ = (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)) & np.logical_or.reduceat(near, starts)
        small = np.repeat(open_ & (sizes <= SMALL_RUN), sizes)
        self._compare(group[small], at[small], most[small])
        large = np.flatnonzero(open_ & (sizes > SMALL_RUN))
        if not len(large):
            return
        more = np.minimum(self.last[at] + k, n - 1) - pos
        more = np.maximum(more, 0) if k < DEPTH else np.zeros(len(at), np.int64)
        # Sets that have too few elements left for the smallest set of their group.
        more[most < self.need[n + np.maximum(self.fewest[at], np.repeat(np.minimum.reduceat(n, starts), sizes))]] = 0
        made = np.add.reduceat(more, starts)[large]
        done = 0
        while done < len(large):
            upto = max(done + 1, done + int(np.searchsorted(np.cumsum(made[done:]), SPLIT, "right")))
            own = _ragged(starts[large[done:upto]], sizes[large[done:upto]])
            self._split_some(np.repeat(np.arange(upto - done), sizes[large[done:upto]]), at[own], pos[own], most[own], more[own], k)
            done = upto

    def _split_some(self, group: np.ndarray, at: np.ndarray, pos: np.ndarray, most: np.ndarray, more: np.ndarray, k: int) -> None:
        # A group that is too large by itself is split by some of the codes at a time.
        turns = max(1, -(-int(more.sum()) // (4 * SPLIT))) if group[-1] == 0 else 1
        sizes = np.bincount(group)
        cost = np.zeros(len(sizes))
        for turn in range(turns):
            head, which = self._next(at, pos, more, turn, turns, group)
            count = np.diff(np.append(own := run_starts(head), len(head)))
            cost += np.bincount(head[own] >> 16, count.astype(float) ** 2, len(sizes))
        better = (cost + 4 * np.bincount(group, more, len(sizes)) < sizes.astype(float) ** 2) & (np.bincount(group, more, len(sizes)) > 0)
        whole = ~better[group]
        if whole.any():
            self._compare(group[whole], at[whole], most[whole])
        tiny_ = better[group] & (self.least[at] <= k)
        self._compare(group[tiny_], at[tiny_], most[tiny_])
        for turn in range(turns):
            if turns > 1:
                head, which = self._next(at, pos, more, turn, turns, group)
            use = better[head >> 16]
            item, place = which
            self._split(head[use], at[item[use]], place[use], k + 1)

    def _next(self, at, pos, more, turn: int, turns: int, group) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Group and code of each next element, sorted; of which item it is, and its place."""
        heads, items, places = [], [], []
        ends = np.cumsum(more)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2 * SPLIT, "right")))
            item = np.repeat(np.arange(lo, hi), more[lo:hi])
            place = _ragged(pos[lo:hi] + 1, more[lo:hi])
            code = self.code[self.first[at[item]] + place].astype(np.int64)
            if turns > 1:
                use = code % turns == turn
                item, place, code = item[use], place[use], code[use]
            heads.append((group[item] << 16) | code)
            items.append(item)
            places.append(place)
            lo = hi
        head, item, place = (np.concatenate(x) for x in (heads, items, places))
        order = np.argsort(head, kind="stable")
        return head[order], (item[order], place[order])

    def _compare(self, group: np.ndarray, at: np.ndarray, most: np.ndarray) -> None:
        if not len(group):
            return
        near = most >= self.need[2 * self.n[at]]
        order = np.lexsort((~near, group))
        group, at, most, near = group[order], at[order], most[order], near[order]
        starts = run_starts(group)
        sizes = np.diff(np.append(starts, len(group)))
        for a, k in zip(starts[sizes >= HOT_RUN].tolist(), sizes[sizes >= HOT_RUN].tolist()):
            own = np.unique(at[a : a + k])
            own = own[np.lexsort((self.sig[own, 0], self.n[own]))]
            for i, j in _compare_block(self.n[own].astype(np.int32), [np.ascontiguousarray(self.sig[own, w]) for w in range(4)], self.far.astype(np.int32)):
                self.label = join(self.label, own[i], own[j])
        # Pairs of which neither end is near are none.
        begin, pos = np.repeat(starts, sizes), position_in_run(starts, len(group))
        partners = np.minimum(pos, np.repeat(np.add.reduceat(near.astype(np.int64), starts), sizes))
        n, sig = self.n[at], self.sig[at]
        for i, j in pairs_in_runs(np.where(np.repeat(sizes, sizes) < HOT_RUN, partners, 0), 1 << 17):
            j = begin[i] + (i - 1 - j)
            total = n[i] + n[j]
            need = self.need[total]
            ok = (most[i] >= need) & (most[j] >= need)
            i, j = i[ok], j[ok]
            least = self.far[total[ok]]
            for w in range(4):
                least = least - np.bitwise_count(sig[i, w] ^ sig[j, w])
                ok = least >= 0
                i, j, least = i[ok], j[ok], least[ok]
            self._join(at[i], at[j])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links the pairs whose codes reach the threshold; of pairs that others link, few are looked at."""
        for turn in range(8):
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            if not turn:
                pair = np.unique(np.maximum(a, b) * len(self.n) + np.minimum(a, b))
                a, b = pair // len(self.n), pair % len(self.n)
            now = np.zeros(len(a), bool)
            now[run_starts(a) if turn < 7 else slice(None)] = True
            x, y = a[now], b[now]
            for lo in range(0, len(x), 1 << 15):
                i, j = x[lo : lo + (1 << 15)], y[lo : lo + (1 << 15)]
                good = self._overlap(i, j) >= self.s.least_overlap(self.n[i] + self.n[j])
                self.label = join(self.label, i[good], j[good])
            a, b = a[~now], b[~now]

    def _overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes of the smaller set the larger one has: no fewer than the elements they have in common."""
        less = self.n[a] <= self.n[b]
        a, b = np.where(less, a, b), np.where(less, b, a)
        own, inverse = np.unique(b, return_inverse=True)
        there = np.sort((np.repeat(np.arange(len(own)), self.n[own]) << 16) | self.code[_ragged(self.first[own], self.n[own])])
        wanted = (np.repeat(inverse, self.n[a]) << 16) | self.code[_ragged(self.first[a], self.n[a])]
        hit = there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted
        return np.bincount(np.repeat(np.arange(len(a)), self.n[a]), hit, len(a)).astype(np.int64)


def _compare_runs(key: np.ndarray, n: np.ndarray, sig: np.ndarray, s: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (as indices) with one key whose bitmaps do not rule the threshold out; of connected ones perhaps not all.

    Rows are sorted by key, size and bitmap. A pair is left out only if its two ends are linked through others.
    """
    far = s.most_apart(np.arange(2 * int(n.max(initial=0)) + 1)).astype(np.int32)
    n = n.astype(np.int32)
    starts = run_starts(key)
    sizes = np.diff(np.append(starts, len(key)))
    pos = position_in_run(starts, len(key))
    for i, j in pairs_in_runs(np.where(np.repeat(sizes, sizes) <= SMALL_RUN, pos, 0)):
        least = far[n[i] + n[j]]
        for w in range(sig.shape[1]):
            apart = np.bitwise_count(sig[i, w] ^ sig[j, w])
            least = least - apart
            ok = least >= 0
            i, j, least = i[ok], j[ok], least[ok]
        yield i, j
    columns = [np.ascontiguousarray(sig[:, w]) for w in range(sig.shape[1])]
    for a, k in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist()):
        for i, j in _compare_block(n[a : a + k], [c[a : a + k] for c in columns], far):
            yield a + i, a + j


def _near(rows: np.ndarray, cols: np.ndarray, n: np.ndarray, sig: list[np.ndarray], far: np.ndarray) -> np.ndarray:
    """Which of rows and cols (as indices) the bitmaps do not rule out as a pair."""
    apart = np.bitwise_count(sig[0][rows][:, None] ^ sig[0][cols])
    wide = apart if len(sig) <= 3 else apart.astype(np.uint16)
    for c in sig[1:]:
        wide += np.bitwise_count(c[rows][:, None] ^ c[cols])
    return wide <= far.take(np.add.outer(n[rows], n[cols]))


def _compare_block(n: np.ndarray, sig: list[np.ndarray], far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A large run: sets near one pivot are linked to it and not compared with each other, then only across pivots."""
    left, stars = np.arange(len(n)), []
    for _ in range(STARS):
        if len(left) < 2:
            break
        pivot = left[len(left) // 2]
        near = _near(left[len(left) // 2 : len(left) // 2 + 1], left, n, sig, far)[0]
        yield np.full(int(near.sum()), pivot), left[near]
        stars.append(left[near])
        left = left[~near]
        if len(stars[-1]) < 8 and len(n) < HOT_RUN:
            break
    # Each star against all that come later, then the rest among itself.
    for k, star in enumerate(stars):
        later = np.concatenate([*stars[k + 1 :], left])
        yield from _across(star, later, n, sig, far)
    for lo in range(0, len(left), OUTER):
        rows = left[lo : lo + OUTER]
        if lo:
            yield from _across(rows, left[:lo], n, sig, far)
        i, j = np.nonzero(np.tril(_near(rows, rows, n, sig, far), -1))
        yield rows[i], rows[j]


def _across(rows: np.ndarray, cols: np.ndarray, n: np.ndarray, sig: list[np.ndarray], far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo in range(0, len(rows), 256):
        for lo2 in range(0, len(cols), 2048):
            a, b = rows[lo : lo + 256], cols[lo2 : lo2 + 2048]
            i, j = np.nonzero(_near(a, b, n, sig, far))
            yield a[i], b[j]


def _tiles(s: Similarity) -> Callable:
    """Reads blobs sorted by part and gives, for each partition, a spanning forest of the links found in its parts."""

    def carried_links(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for keys in key_groups(blobs):
            found = [x for b in blobs if len((x := unpack_carried(b, keys))[0])]
            sets = np.cumsum([0, *[len(x[3]) for x in found]])
            key, at, pos, rid, n = (np.concatenate(c) for c in zip(*[(x[0], x[1] + start, *x[2:5]) for x, start in zip(found, sets)]))
            code = np.concatenate([x[5] for x in found])
            del found
            label = _Splits(s, n, np.cumsum(n) - n, code).run(key, at, pos)
            linked = label != np.arange(len(label))
            yield rid[linked], rid[label[linked]]

    def part_links(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        key, rid, n, sig = (np.concatenate(x) for x in zip(*map(unpack, blobs)))
        order = np.lexsort((sig[:, 0], (key.astype(np.int64) << 16) | np.minimum(n, 65535)))
        key, rid, n, sig = key[order], rid[order], n[order], sig[order]
        # Postings that agree in key, size and bitmap are linked and compared as one.
        ids, at = np.unique(rid, return_inverse=True)
        own = run_starts(key, n, *sig.T)
        label = join(np.arange(len(ids)), at, at[np.repeat(own, np.diff(np.append(own, len(key))))])
        at, held, size = at[own], [], 0
        for i, j in _compare_runs(key[own], n[own], sig[own], s):
            held.append((at[i], at[j]))
            size += len(i)
            if size > 1 << 20:
                label = join(label, *map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            label = join(label, *map(np.concatenate, zip(*held)))
        linked = label != np.arange(len(ids))
        return ids[linked], ids[label[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, blobs, size = None, [], 0

        def close(last: bool):
            nonlocal held, size
            if blobs:
                for a, b in carried_links(blobs) if s.carried else [part_links(blobs)]:
                    held.append((a, b))
                    size += len(a)
            blobs.clear()
            if size and (last or size > 1 << 20):
                nodes, roots = forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                held, size = [], 0
                return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != roots]), pa.array(roots[nodes != roots])], names=["a", "b"])
            return None

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    if (out := close(False)) is not None:
                        yield out
                    now = part
                blobs.append(blob.as_buffer())
        if (out := close(True)) is not None:
            yield out

    return run


def _row_filter(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the hashed positions of a column: false positives are possible, misses are not."""
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    placed = rows.select(place.alias("p")).selectExpr("p div 64 AS w", "shiftleft(1L, cast(p % 64 AS int)) AS bit")
    words = placed.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.w.to_numpy()] = words.bits.to_numpy()
    return out


def block_counts(nodes: DataFrame, most: int) -> DataFrame:
    """Adds ``blocks``: 1 for components of up to ``most`` sets, else as many blocks as hold half of that each."""
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size")).filter(F.col("size") > most).withColumn("blocks", F.ceil(F.col("size") * 2 / most).cast("int"))
    return nodes.join(sizes.select("comp", "blocks"), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def block_tiles(with_blocks: DataFrame) -> DataFrame:
    """Adds ``tile_i``, ``tile_j`` and the own ``block``: each set of a component goes to the tiles of its block with every other block."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = with_blocks.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("tile_i", F.least("block", "other")).withColumn("tile_j", F.greatest("block", "other")).drop("other")


class SimilarSets:
    """The components of similar sets and what is exactly similar in them. ``texts`` has ``field`` (int), ``row_id``, ``text``."""

    def __init__(self, texts: DataFrame, s: Similarity, name: str = "similar", tile: int = TILE):
        self.s, self.spark, self.tile = s, texts.sparkSession, tile
        self.stage = Stage(self.spark, name)
        self.sets = self.stage.write(make_sets(texts, s), "sets")
        self.classes = self.sets.filter("n > 0").groupBy("node").agg(F.min("row_id").alias("first_row"), F.min("rid").alias("rid"), F.count("*").alias("copies"))
        self.nodes = self.stage.write(self._together(), "nodes")

    def _links(self) -> DataFrame:
        spark, s = self.spark, self.s
        means = self.sets.groupBy("field").agg(F.avg("n").alias("mean"), F.sum("n").alias("total")).collect()
        parts = {r.field: max(spark.sparkContext.defaultParallelism, ceil(r.total / PART)) for r in means}
        words = {r.field: bitmap_words(r.mean or 0) for r in means}
        block = {r.field: block_rows(s, r.mean or 0) for r in means}
        known = spark.sparkContext.broadcast(estimate(self.sets, s))
        blobs = self.sets.select("field", "rid", "node", "n", "elements").mapInArrow(_poster(s, known, parts, words, block), "part long, blob binary")
        spread = blobs.repartition(max(sum(parts.values()), 1), "part").sortWithinPartitions("part")
        return spread.mapInArrow(_tiles(s), "a long, b long")

    def _together(self) -> DataFrame:
        """The sets of every component of two or more: ``comp``, ``node``, ``rid``, ``field``, ``first_row``, ``copies``, ``n``, ``elements``."""
        comps = connected_components(self._links(), self.stage)
        shared = self.spark.sparkContext.broadcast(_row_filter(comps, "node"))

        def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                keep = (bits[at >> 6] >> (at & 63)) & 1
                yield batch.filter(pa.array(keep == 1)).select(batch.schema.names[:-1])

        place = F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS)).alias("place")
        schema = "field int, rid long, node long, n int, elements array<long>"
        near = self.sets.select("field", "rid", "node", "n", "elements", place).mapInArrow(passes, schema)
        own = self.classes.select("node", "rid", "first_row", "copies")
        return near.join(comps.select(F.col("node").alias("rid"), F.col("root").alias("comp")), "rid").join(own, ["node", "rid"])

    def blocked(self) -> DataFrame:
        return block_counts(self.nodes, self.tile)


def compare(with_blocks: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Runs ``work`` on Arrow batches of the sets of all components, sorted by component and tile."""
    sorted_ = block_tiles(with_blocks).repartition("comp", "tile_i", "tile_j").sortWithinPartitions("comp", "tile_i", "tile_j", "first_row", "node")
    return sorted_.select("tile_i", "tile_j", "block", "comp", "node", "first_row", "copies", "n", "elements").mapInArrow(work, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("comp", "tile_i", "tile_j"), most: int = 8192) -> Iterator[pa.Table]:
    """Regroups sorted batches so that rows that agree in ``columns`` stay together; about ``most`` rows at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(table: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table | None]:
        if last:
            return table, None
        codes = [table.column(c).combine_chunks() for c in columns]
        ends = [c[len(c) - 1].as_py() for c in codes]
        same = np.logical_and.reduce([pc.equal(c, e).to_numpy(zero_copy_only=False) for c, e in zip(codes, ends)])
        at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        return (table.slice(0, at) if at else None), table.slice(at)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            whole, rest = cut(pa.Table.from_batches(held), False)
            held = rest.combine_chunks().to_batches()
            size = rest.num_rows
            if whole is not None:
                yield whole
    if held:
        yield pa.Table.from_batches(held)


def exact_pairs(group: np.ndarray, block: np.ndarray, cross: np.ndarray, n: np.ndarray, rows: np.ndarray, h: np.ndarray, s: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of all pairs of one group above the threshold, j before i.

    Groups are runs of equal ``group``. In groups with ``cross`` only pairs of two blocks count. Bitmaps rule pairs out
    first; the rest is intersected on sorted arrays, each element of the smaller set being searched in the larger one.
    """
    if not len(group):
        return
    sig = bitmaps(rows, h, len(n), 4)
    _, code = np.unique(h, return_inverse=True)
    width = int(code.max(initial=0)) + 1
    composite = rows * width + code
    order = np.argsort(composite)
    composite = composite[order]
    first = np.searchsorted(composite, np.arange(len(n) + 1) * width)
    pos = position_in_run(run_starts(group), len(group))
    for i, j in pairs_in_runs(pos, 1 << 19):
        use = ~cross[i] | (block[i] != block[j])
        i, j = i[use], j[use]
        far = s.most_apart(n[i] + n[j])
        apart = np.zeros(len(i), np.int64)
        for w in range(4):
            apart += np.bitwise_count(sig[i, w] ^ sig[j, w])
        ok = (apart <= far) & (np.abs(n[i] - n[j]) <= far)
        i, j = i[ok], j[ok]
        for lo in range(0, len(i), 1 << 15):
            a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            small, large = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
            size = n[small]
            ends = np.cumsum(size)
            at = np.repeat(first[small] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            wanted = composite[at] % width + np.repeat(large, size) * width
            found = np.searchsorted(composite, wanted)
            hit = composite[np.minimum(found, len(composite) - 1)] == wanted
            overlap = np.bincount(np.repeat(np.arange(len(a)), size), hit, len(a)).astype(np.int64)
            good = overlap >= s.least_overlap(n[a] + n[b])
            yield a[good], b[good], overlap[good]
