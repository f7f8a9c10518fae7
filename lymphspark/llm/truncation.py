"""Texts that were cut off: by a field limit, or in the middle of a transfer.

A text that has no end, once links, tags, remarks and the like behind it are taken off, is a suspect, unless what it ends
with is a footer or a phrase with which different texts trail off. Suspects are held against near-copies, found by min-hash
banding: where the words of both align up to the suspect's end and the copy goes on inside the same sentence, the suspect is
cut. The others are scored by the terminality of their closing word: how often texts and sentences end with these letters,
of all places where they stand, also inside longer words. What a share tells is learned from sentences of the collection that
are cut at random places; how many suspects of a source are cut is estimated by source, kind of ending and limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lymphspark.llm.numeric import mix, run_starts
from lymphspark.llm.similarity import distinct_sorted, hashed_words, word_runs
from lymphspark.session import Stage, spread

# Marks that end a sentence, quotes and brackets that may follow, ellipses.
STOP, AFTER, ELLIPSIS = "[.!?。！？؟।]", "[\"”»’')\\]]*", r"(?:\.{2,}|…)"
#: Something in brackets behind the text is taken off, as remarks about a cut are.
REMARK = r"\s*[\[(][^\[\]()]{1,40}[\])]\s*$"
#: Rests of characters, escapes and tags that a cut leaves.
BROKEN = r"\s*(?:\x{FFFD}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|</?[A-Za-z]\w*)$"
# What may follow a finished text without a stop: links, tags, handles, closing markup, emoticons, emoji.
TRAILERS = (r"\s*https?://[^\s]+\s*$", r"\s*[#@][\pL\pN_]+\s*$", r"\s*</?\w+[^<>]*>\s*$", r"\s+[:;]-?[()DP]\s*$", r"[\s\p{So}\p{Sk}\x{FE0F}\x{200D}]+$")

#: Writing without spaces between words: every character counts as a word where texts are aligned.
APART = re.compile("[\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

BANDS, ROWS, RUN = 16, 2, 3
#: What this many different texts end with, more often than with other words or at other places, is no cut.
REPEATED = 3
#: The texts of a key are cut into a salt for so many of its suspects, SALTS at most; keys of several salts that are broadcast.
HOT, SALTS, MANY = 16, 1024, 100_000
#: Word runs of a text that a copy has to contain.
CONTAINED = 0.6
SPIKE = 4.0
#: Sentences that are cut at a random place to learn from, at most.
SAMPLE = 20_000
#: Bounds of the closing shares that are told apart, and how many kinds of closing words that makes.
SHARES = (0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7)
CELLS = 1 + 2 * (len(SHARES) + 1)
#: Added to the share of each kind among whole and among cut sentences, beside one sentence.
FLOOR = 0.0005
#: Expected share of cut texts among suspects and its weight in texts: of those that end other sentences or have a mark of a cut;
#: of texts of one segment, as titles are, at what may be a limit and elsewhere.
OPEN, LIMIT, TITLE, WEIGHT = 0.9, 0.5, 0.1, 2.0
#: Texts by which the share of a kind weighs in that of a source.
SHRINK = 8.0

_ENDS = "doc_id long, source string, whole long, last string, opener string, opening string, closer string, before long, n_segments int, tokens int, n_chars int, n_bytes int, ended boolean, dots boolean, remark boolean, broken boolean"
_READ = f"kind int, {_ENDS}, word string, n long, closing long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _READ.split(", ")])
_ENDING, _WORD, _OPENING, _CUT = range(4)


def _some(kind: int, rows: int, **columns) -> pa.RecordBatch:
    known = {"kind": pa.array(np.full(rows, kind, np.int32))} | columns
    return pa.RecordBatch.from_arrays([known[f.name].cast(f.type) if f.name in known else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _np(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _has(a: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.fill_null(pc.match_substring_regex(a, pattern), False))


def _part(a: pa.Array, pattern: str) -> pa.Array:
    """The group of the first match, or null."""
    return pc.struct_field(pc.extract_regex(a, f"(?P<x>{pattern})"), [0])


def _segments(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and string of every segment that isn't blank: sentences and lines."""
    lines = pc.replace_substring_regex(text, rf"({STOP}{AFTER}|…)\s+", "\\1\n")
    lists = pc.split_pattern_regex(pc.replace_substring_regex(lines, "([。！？])", "\\1\n"), r"[\r\n]+")
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = _has(flat, r"\S")
    return row[full], flat.filter(pa.array(full))


def _strip_ends(flat: pa.Array, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, dict[str, np.ndarray], np.ndarray]:
    """Takes what stands behind a text off its last segments: the segment with which the text itself ends, what is left of that,
    what was taken off, and by how many characters and bytes."""
    n = len(at)
    found = {k: np.zeros(n, bool) for k in ("remark", "broken", "trailed", "dots")}
    off = np.zeros((2, n), np.int64)
    last, open_ = pc.utf8_rtrim_whitespace(flat.take(pa.array(at))), np.arange(n)
    sizes = lambda a: np.stack([_np(pc.utf8_length(a)), _np(pc.binary_length(a))]).astype(np.int64)
    for _ in range(8):
        now = last.take(pa.array(open_))
        bare = now
        for name, pattern in (("broken", BROKEN), ("remark", REMARK), *(("trailed", t) for t in TRAILERS)):
            hit = _has(bare, pattern)
            if hit.any():
                bare = pc.replace_substring_regex(bare, pattern, "")
                found[name][open_[hit]] = True
        bare = pc.utf8_rtrim_whitespace(bare)
        gone = sizes(now) - sizes(bare)
        off[:, open_] += gone
        back = _np(pc.equal(bare, "")) & (at[open_] > first[open_])
        at[open_[back]] -= 1
        off[:, open_[back]] += 1
        bare = pc.if_else(pa.array(back), pc.utf8_rtrim_whitespace(flat.take(pa.array(at[open_]))), bare)
        place = np.arange(n)
        place[open_] = n + np.arange(len(open_))
        last = pa.concat_arrays([last, bare]).take(pa.array(place))
        open_ = open_[back | (gone[0] > 0)]
        if not len(open_):
            break
    dots = _has(last, ELLIPSIS + "$")
    shown = pc.replace_substring_regex(last, rf"\s*{ELLIPSIS}$", "")
    found["dots"] = dots
    return at, shown, found, off + sizes(last) - sizes(shown)


def read_endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, source, text, whole): how each text ends, counts of words and of openings of segments (added up by batch),
    and a sentence of each text that was cut at a random place, with the one that wasn't."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            bare = pc.utf8_rtrim_whitespace(part.column(2))
            part = part.filter(pc.not_equal(bare, ""))
            if part.num_rows:
                yield from _read(*part.columns)


def _read(ids: pa.Array, source: pa.Array, text: pa.Array, whole: pa.Array) -> Iterator[pa.RecordBatch]:
    bare = pc.utf8_rtrim_whitespace(text)
    row, flat = _segments(bare)
    if len(np.unique(row)) < len(ids):  # stops alone: no segment is blank then
        kept = pa.array(np.unique(row))
        ids, source, bare, whole = (a.take(kept) for a in (ids, source, bare, whole))
        row = np.unique(row, return_inverse=True)[1]
    first = run_starts(row)
    count = np.diff(np.append(first, len(row)))
    at, shown, found, off = _strip_ends(flat, first, first + count - 1)
    n_segments = at - first + 1
    stops = _has(shown, f"{STOP}{AFTER}$")
    ended = stops | (found["trailed"] & ~found["remark"] & ~found["broken"]) | _np(pc.equal(shown, ""))
    opens = np.flatnonzero(~ended)
    take = pa.array(opens)
    last, heads = shown.take(take), flat.take(pa.array(first[opens])).to_pylist()
    hide = lambda a: pa.concat_arrays([a, pa.nulls(1, a.type)]).take(pa.array(np.where(ended, len(opens), np.cumsum(~ended) - 1)))
    before = np.array([hash_of(h) if k > 1 else i for h, k, i in zip(heads, n_segments[opens], _np(ids)[opens])], np.int64)
    chars, size = (_np(f(bare)).astype(np.int64) - o for f, o in ((pc.utf8_length, off[0]), (pc.binary_length, off[1])))
    yield _some(
        _ENDING, len(ids), doc_id=ids, source=source, whole=whole, last=hide(last), opener=hide(_part(last, r"\S+")), opening=hide(_part(last, r"\S+(?:\s+\S+)?")),
        closer=hide(_closer(last)), before=hide(pa.array(before, pa.int64())), n_segments=pa.array(n_segments), tokens=hide(pa.array(1 + _has(last, r"\S\s+\S").astype(int))),
        n_chars=pa.array(chars), n_bytes=pa.array(size), ended=pa.array(ended), dots=pa.array(found["dots"]), remark=pa.array(found["remark"]), broken=pa.array(found["broken"]),
    )
    # All that is known to go on or to be whole: not the last segments of texts without an end, nor what was taken off.
    open_row = ~ended[row]
    kept = np.flatnonzero(~open_row | (np.arange(len(row)) < at[row]))
    row, flat = row[kept], flat.take(pa.array(kept))
    words = pc.split_pattern_regex(pc.utf8_lower(flat), r"\PL+")
    w, seg = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
    full = _np(pc.not_equal(w, ""))
    w, seg = w.filter(pa.array(full)).dictionary_encode(), seg[full]
    whole_segment = _has(flat, f"{STOP}{AFTER}$")
    finals = np.append(seg[1:] != seg[:-1], True)[: len(seg)] & whole_segment[seg]
    code, size = w.indices.to_numpy(), len(w.dictionary)
    yield _some(_WORD, size, word=w.dictionary, n=pa.array(np.bincount(code, minlength=size)), closing=pa.array(np.bincount(code[finals], minlength=size)))
    openings = pa.chunked_array([_part(flat, r"\S+"), _part(flat, r"\S+\s+\S+").drop_null()]).combine_chunks().dictionary_encode()
    yield _some(_OPENING, len(openings.dictionary), word=openings.dictionary, n=pa.array(np.bincount(openings.indices.to_numpy(), minlength=len(openings.dictionary))))
    yield from _cut_sentences(row, flat, whole_segment, _np(whole))


def _closer(a: pa.Array) -> pa.Array:
    """The last run of letters, in lower case; an empty string if there are none."""
    return pc.fill_null(pc.utf8_lower(pc.struct_field(pc.extract_regex(a, r"(?P<x>\pL+)\PL*$"), [0])), "")


def _cut_sentences(row: np.ndarray, flat: pa.Array, is_whole: np.ndarray, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each text one sentence, chosen by hash: its closing word (n = 0), and the letters before a random place in it (n = 1),
    which are the rest of a longer word (closing = 1) or not."""
    at = np.flatnonzero(is_whole)
    starts = run_starts(row[at])
    if not len(starts):
        return
    key = mix(whole[row[at][starts]].view(np.uint64))
    chosen = at[starts + (key % np.diff(np.append(starts, len(at))).astype(np.uint64)).astype(np.int64)]
    sentences = flat.take(pa.array(chosen)).to_pylist()
    places = [1 + int(k >> np.uint64(20)) % max(len(s) - 1, 1) for s, k in zip(sentences, key)]
    left, inside = pa.array([s[:p] for s, p in zip(sentences, places)], pa.string()), [s[p - 1 : p].isalpha() and s[p : p + 1].isalpha() for s, p in zip(sentences, places)]
    none = np.zeros(len(chosen), np.int64)
    word = pa.concat_arrays([_closer(pa.array(sentences, pa.string())), _closer(left)])
    some = _some(_CUT, 2 * len(chosen), doc_id=pa.array(np.tile(key.view(np.int64), 2)), word=word, n=pa.array(np.r_[none, none + 1]), closing=pa.array(np.r_[none, inside]))
    yield some.filter(pc.not_equal(word, ""))


def hash_of(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def kind_of_word(n: Column, closing: Column) -> Column:
    """Number of the kind of closing words: unknown letters, or the bin of the share of closings among ``n`` places where the
    letters stand; below one half apart for those that are no word of their own (``own`` is 0)."""
    share = (closing + 0.5) / (n + 1.0)
    place = sum(F.when(share >= b, 1).otherwise(0) for b in SHARES)
    return F.when(n <= 0, F.lit(0)).otherwise(1 + place + F.when((F.col("own") <= 0) & (share < 0.5), F.lit(len(SHARES) + 1)).otherwise(0))


def _title() -> Column:
    return (F.col("n_segments") <= 1) & ~F.col("dots") & ~F.col("remark") & ~F.col("broken")


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Shares of the kinds in whole (0) and cut (1) sentences. Where the odds of a cut would rise with the share of closings,
    neighbouring bins are taken together; kinds that the sentences hardly show tell nothing."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    known = counts / total + FLOOR + 1 / total.min()
    for lo in (1, len(SHARES) + 2):
        pools: list[list] = []
        for k in range(lo, lo + len(SHARES) + 1):
            pools.append([known[0, k], known[1, k], 1])
            while len(pools) > 1 and pools[-1][1] * pools[-2][0] > pools[-2][1] * pools[-1][0]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last)]
        known[:, lo : lo + len(SHARES) + 1] = np.concatenate([np.full((n, 2), (a / n, b / n)) for a, b, n in pools]).T
    return known / known.sum(axis=1, keepdims=True)


def share_of_cut(counts: np.ndarray, likely: np.ndarray, prior: float, weight: float) -> float:
    """The share of cut texts of a mixture by expectation maximisation. ``counts`` are texts by kind of closing word, ``likely``
    the shares of the kinds in whole (0) and in cut texts (1)."""
    share, total = prior, float(counts.sum())
    for _ in range(200):
        cut = share * likely[1] / (share * likely[1] + (1 - share) * likely[0])
        new = (prior * weight + float(counts @ cut)) / (weight + total)
        if abs(new - share) < 1e-6:
            break
        share = new
    return min(max(share, 1e-4), 1 - 1e-4)


# ---------------------------------------------------------------- near-copies

_OTHER = r"[^\pL\pN]+"
#: Words before a suspect's last one by which texts that go on are found as well, however much longer they are.
TAIL = 5
#: Bits of the hashed filter of these (2 MB broadcast, whatever the input).
TAIL_BITS = 1 << 24


def tail_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, key) of the TAIL words before the last word of each text."""
    for batch in batches:
        bare = pc.replace_substring_regex(pc.utf8_lower(batch.column(1)), r"[\pL\pN]+[^\pL\pN]*$", "")
        rows, h = word_runs(*hashed_words(bare, _OTHER), TAIL)
        last = np.append(run_starts(rows)[1:], len(rows)) - 1 if len(rows) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[last])), pa.array(h[last].view(np.int64))], names=["whole", "key"])


def _postings(wanted):
    """(doc_id, is_tail, key): the bands of a text's min-hash signature over all its word runs, and those of its runs of TAIL words
    that the filter lets pass."""
    seeds = mix(np.arange(1, BANDS * ROWS + 1).astype(np.uint64))

    def told(ids: pa.Array, tail: bool, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(key), tail)), pa.array(key.view(np.int64))], names=["doc_id", "is_tail", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                rows, words = hashed_words(batch.column(1), _OTHER)
                tails = word_runs(rows, words, TAIL)
                at = tails[1] % np.uint64(TAIL_BITS)
                hit = ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)) == 1
                ends = distinct_sorted(tails[0][hit], tails[1][hit])
                yield told(batch.column(0).take(pa.array(ends[0])), True, ends[1])
                rows, h = distinct_sorted(*word_runs(rows, words, RUN))
                starts = run_starts(rows)
                if not len(starts):
                    continue
                ids = batch.column(0).take(pa.array(rows[starts]))
                low = [np.minimum.reduceat(mix(h ^ s), starts) for s in seeds]
                for b in range(BANDS):
                    yield told(ids, False, mix(np.bitwise_xor.reduce([mix(low[b * ROWS + k] ^ np.uint64(k)) for k in range(ROWS)]) ^ np.uint64(b + 1)))

    return run


@lru_cache(maxsize=4096)
def _aligned_words(text: str) -> list[str]:
    return APART.sub(r" \g<0> ", text).split()


def goes_on(text: str, copy: str) -> str | None:
    """How ``copy`` goes on where ``text`` ends: "inside" a word or sentence, "ended" with the sentence, or None.

    The texts are aligned at the words before the text's last one: their last occurrence in the copy.
    """
    words = _aligned_words(text)
    tail = words[-5:-1]
    if len(words) < 6 or any(w not in copy for w in tail):
        return None
    other = _aligned_words(copy)
    for at in range(len(other) - 5, -1, -1):
        if other[at] == tail[0] and other[at : at + 4] == tail:
            break
    else:
        return None
    there = other[at + 4] if at + 4 < len(other) else ""
    last = words[-1]
    if len(other) < 6 or not there.startswith(last):
        return None
    runs = lambda ws: {tuple(ws[k : k + RUN]) for k in range(len(ws) - RUN + 1)}
    own = runs(words[:-1])
    if len(own & runs(other)) < CONTAINED * len(own):
        return None
    if there != last:
        return "ended" if not any(c.isalnum() for c in there[len(last) :]) and there[-1] in ".!?。！？؟।\"”»’')]" else "inside"
    return "inside" if at + 5 < len(other) else None


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [goes_on(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["doc_id", "goes_on"])


class Truncation:
    """``docs`` has ``doc_id`` (long), ``source`` and ``text``, one row per document; other columns aren't looked at.

    Null, empty and blank texts are not cut, rows without doc_id are left out. Repeated rows are judged each. A null source is
    a source. An empty table gives empty results. Texts of any length are taken whole.
    """

    def __init__(self, docs: DataFrame, sample: int = SAMPLE):
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).filter("doc_id is not null")
        self.stage, self.sample = Stage(docs.sparkSession, "cut"), sample
        given = spread(self.docs.filter("text is not null")).select("doc_id", "source", "text", F.xxhash64("text").alias("whole"))
        self.read = self.stage.write(given.mapInArrow(read_endings, _READ), "read")
        self.ends = self.read.filter(F.col("kind") == _ENDING).select(*[c.split()[0] for c in _ENDS.split(", ")])
        self.facts = self.stage.write(self._facts(), "facts")
        self.suspects = self.stage.write(self._suspects(), "suspects")

    def _open(self) -> DataFrame:
        return self.ends.filter("not ended")

    def _facts(self) -> DataFrame:
        """Of every closing word of a text without an end or of the sample: ``own`` (how often it stands as a word), ``inner`` (how
        often longer words begin with it), ``closing`` (how often a sentence ends with it), ``final`` (how many different texts
        of one segment without an end do, which may be titles)."""
        vocabulary = self.read.filter(F.col("kind") == _WORD).groupBy("word").agg(F.sum("n").alias("own"), F.sum("closing").alias("closing"))
        title = F.when(_title(), F.col("before"))
        final = self._open().groupBy(F.col("closer").alias("word")).agg(F.count_distinct(title).alias("final"))
        needed = final.unionByName(self.read.filter(F.col("kind") == _CUT).select("word", F.lit(0).cast("long").alias("final"))).groupBy("word").agg(F.max("final").alias("final"))
        needed = self.stage.write(needed.filter("word <> ''"), "needed")
        lengths = [r.k for r in needed.select(F.length("word").alias("k")).distinct().collect()]
        starts = F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k < F.length("word"))
        inner = vocabulary.select(F.explode(F.transform(starts, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("word"), "own").groupBy("word").agg(F.sum("own").alias("inner"))
        return needed.join(vocabulary, "word", "left").join(inner, "word", "left").fillna(0, ["own", "closing", "inner"])

    def _suspects(self) -> DataFrame:
        """Texts whose last segment has no end, unless that segment is a footer or a phrase that trails off."""
        openings = self.read.filter(F.col("kind") == _OPENING).groupBy(F.col("word").alias("opening")).agg(F.sum("n").alias("m"))
        open_ = self._open().join(self.facts.withColumnRenamed("word", "closer"), "closer", "left").fillna(0, ["own", "closing", "inner", "final"])
        # What different texts have word for word before an ellipsis, and more often than other segments open so: not the rest of a word.
        same = open_.filter("dots and own >= inner").groupBy("last", "opening").agg(F.count_distinct("before").alias("n")).filter(F.col("n") >= REPEATED)
        deliberate = same.join(openings, "opening", "left").filter("n > coalesce(m, 0)").select("last", F.lit(True).alias("deliberate"))
        # A word that opens the last segments of different texts, and more often than other segments: of a single word more often
        # also than words begin with it, as a cut leaves the rest of a word there.
        heads = open_.filter("n_segments > 1 and not dots").groupBy("opener", "tokens").agg(F.count_distinct("before").alias("n"), F.max("inner").alias("inner")).filter(F.col("n") >= REPEATED)
        known = heads.join(openings.withColumnRenamed("opening", "opener"), "opener", "left").filter("n > coalesce(m, 0) + if(tokens = 1, inner, 0)")
        footers = known.select("opener", "tokens", F.lit(True).alias("footer"))
        marked = open_.join(deliberate, "last", "left").join(footers, ["opener", "tokens"], "left")
        keep = F.col("deliberate").isNull() & (F.col("footer").isNull() | (F.col("n_segments") <= 1) | F.col("dots"))
        return marked.filter(F.col("remark") | F.col("broken") | keep).drop("opener", "opening", "tokens", "deliberate", "footer")

    def _limits(self) -> DataFrame:
        """Lengths at which texts of a source end without an end much more often than at the lengths around."""
        found = []
        for unit in ("n_chars", "n_bytes"):
            n = self.suspects.groupBy("source", F.col(unit).alias("length")).agg(F.count_distinct("whole").alias("n"))
            around = lambda k: F.sum("n").over(Window.partitionBy("source").orderBy("length").rangeBetween(-k, k))
            spike = n.withColumn("wide", around(12)).withColumn("near", around(1)).filter((F.col("near") >= 5) & (F.col("near") > SPIKE * (F.col("wide") - F.col("near")) * 3 / 22) & (F.col("near") > 0.5 * F.col("wide")))
            found.append(spike.select("source", F.lit(unit).alias("unit"), "length"))
        return found[0].unionByName(found[1])

    def _copies(self) -> DataFrame:
        """``doc_id`` and ``inside``, ``at_end``: what the alignments of a suspect with all other texts of its bands say, and with those
        that have the TAIL words before its last one, which no band finds where they are much longer.

        Equal texts are one. A band of r suspects and n different texts is r * n alignments.
        """
        texts = self.docs.filter("text is not null").select(F.xxhash64("text").alias("whole"), "text").dropDuplicates(["whole"])
        texts = self.stage.write(texts, "texts")
        # The suspect's own text, as far as it was kept by what was taken off its end.
        shown = texts.join(self.suspects.groupBy("whole").agg(F.max("n_chars").alias("k")), "whole").select("whole", F.substring("text", F.lit(1), F.col("k")).alias("text"))
        tails = self.stage.write(shown.mapInArrow(tail_keys, "whole long, key long"), "tails")
        wanted = np.zeros(TAIL_BITS // 64, np.uint64)
        place = F.expr(f"cast(pmod(key, {TAIL_BITS}) as int)").alias("p")
        packed = tails.select(place).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("bits")).toPandas()
        wanted[packed.w.to_numpy(np.int64)] = packed.bits.to_numpy(np.int64).view(np.uint64)
        shared = texts.sparkSession.sparkContext.broadcast(wanted)
        keys = texts.select("whole", F.lower("text").alias("text")).mapInArrow(_postings(shared), "doc_id long, is_tail boolean, key long")
        keys = self.stage.write(keys.withColumnRenamed("doc_id", "whole"), "bands")
        bands = keys.filter("not is_tail").select("whole", "key")
        own = bands.join(self.suspects.select("whole").distinct(), "whole", "left_semi").select("whole", "key", F.lit(False).alias("is_tail"))
        own = own.unionByName(tails.select("whole", "key", F.lit(True).alias("is_tail")))
        # The texts of keys that many suspects have are cut into salts; a suspect of such a key goes to all of them.
        hot = own.groupBy("is_tail", "key").agg(F.least(F.ceil(F.count("*") / HOT), F.lit(SALTS)).alias("salts")).filter("salts > 1")
        hot = self.stage.write(hot, "hot")
        few = hot.limit(MANY + 1).count() <= MANY
        with_salts = lambda df: df.join(F.broadcast(hot) if few else hot, ["is_tail", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
        others = with_salts(keys).select(F.col("whole").alias("other"), "is_tail", "key", F.pmod(F.xxhash64("whole"), F.col("salts")).alias("salt"))
        each = with_salts(own).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
        pairs = each.join(others, ["is_tail", "key", "salt"]).filter("whole <> other").select("whole", "other").distinct()
        both = pairs.join(shown, "whole").join(texts.select(F.col("whole").alias("other"), F.col("text").alias("copy")), "other")
        told = both.select("whole", "text", "copy").mapInArrow(_align, "doc_id long, goes_on string").withColumnRenamed("doc_id", "whole")
        told = told.filter("goes_on is not null").distinct().join(self.suspects.select("doc_id", "whole").distinct(), "whole")
        return told.groupBy("doc_id").agg(F.max(F.col("goes_on") == "inside").alias("inside"), F.max(F.col("goes_on") == "ended").alias("at_end"))

    def _likely(self) -> np.ndarray:
        """Shares of the kinds of closing words in whole (0) and in cut sentences (1), from at most ``sample`` sentences each."""
        cut = self.read.filter(F.col("kind") == _CUT).orderBy("doc_id", "n", "word").limit(2 * self.sample).select("word", F.col("n").alias("is_cut"), F.col("closing").alias("inside"))
        known = cut.join(self.facts, "word").withColumn("own", F.col("own") - F.when(F.col("inside") == 1, 0).otherwise(1))
        # The sentence itself doesn't count.
        kinds = known.select("is_cut", kind_of_word(F.col("own") + F.col("inner") + F.col("final") - F.col("inside"), F.col("closing") + F.col("final") - (1 - F.col("is_cut"))).alias("kind"))
        out = np.zeros((2, CELLS))
        for r in kinds.groupBy("is_cut", "kind").count().collect():
            out[r.is_cut, r.kind] += r["count"]
        return likelihoods(out)

    def judged(self) -> DataFrame:
        """Each suspect: ``doc_id``, ``source``, ``is_cut``, ``reason``, ``closing_share`` of its closing word, and the ``score``,
        the probability that it is cut by its closing word and its source."""
        spikes = self._limits()
        of = lambda unit: F.broadcast(spikes.filter(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias(unit), F.lit(True).alias(f"at_{unit}")))
        s = self.suspects
        for unit in ("n_chars", "n_bytes"):
            limit = of(unit)
            s = s.join(limit, s["source"].eqNullSafe(limit["s"]) & (s[unit] == limit[unit]), "left").drop(limit["s"], limit[unit])
        # Ends of other titles count only for what may be a title itself: texts with several sentences end these with stops.
        other = F.when(_title(), F.greatest(F.col("final") - 1, F.lit(0))).otherwise(0)
        n = F.col("own") + F.col("inner") + other
        s = s.select(
            "doc_id", "source", "whole", "last", "n_segments", "before", "dots",
            (F.col("n_segments") > 1).alias("many"), F.coalesce("at_n_chars", "at_n_bytes", F.lit(False)).alias("at_limit"), (F.col("dots") | F.col("remark") | F.col("broken")).alias("mark"),
            kind_of_word(n, F.col("closing") + other).alias("kind"), ((F.col("closing") + other) / F.greatest(n, F.lit(1))).alias("closing_share"),
        )
        s = self.stage.write(s, "kinds")
        likely = self._likely()
        style = ["many", "at_limit", "mark"]
        counts = s.groupBy("source", *style, "kind").agg(F.count_distinct("before").alias("n"))
        whole = {}
        for r in counts.groupBy(*style, "kind").agg(F.sum("n").alias("n")).collect():
            whole.setdefault((r.many, r.at_limit, r.mark), np.zeros(CELLS))[r.kind] += r.n
        expected = lambda many, at_limit, mark: OPEN if many or mark else LIMIT if at_limit else TITLE
        shares = {k: share_of_cut(v, likely, expected(*k), WEIGHT) for k, v in whole.items()}

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            key = tuple(bool(pdf[c].iloc[0]) for c in style)
            by_kind = np.bincount(pdf.kind.to_numpy(), pdf.n.to_numpy(float), CELLS)
            return pdf.head(1)[["source", *style]].assign(share=share_of_cut(by_kind, likely, shares[key], SHRINK))

        found = counts.groupBy("source", *style).applyInPandas(fit, "source string, many boolean, at_limit boolean, mark boolean, share double")
        found = found.select(F.col("source").alias("of"), *[F.col(c).alias(f"of_{c}") for c in style], "share")
        s = s.join(found, s["source"].eqNullSafe(found["of"]) & (F.col("many") == F.col("of_many")) & (F.col("at_limit") == F.col("of_at_limit")) & (F.col("mark") == F.col("of_mark")), "left")
        odds = F.get(F.array(*[F.lit(float(x)) for x in likely[1] / likely[0]]), F.col("kind"))
        score = F.col("share") * odds / (F.col("share") * odds + 1 - F.col("share"))
        s = s.join(self._copies(), "doc_id", "left").withColumn("score", score)
        reason = (
            F.when(F.coalesce("inside", F.lit(False)), "a copy goes on")
            .when(F.coalesce("at_end", F.lit(False)) & ~F.col("mark"), None)
            .when(F.col("score") <= 0.5, None)
            .when(F.col("mark"), "a mark of a cut after an open sentence")
            .when(F.col("at_limit"), "open at a limit of the source")
            .otherwise("an open sentence")
        )
        return s.select("doc_id", "source", reason.isNotNull().alias("is_cut"), reason.alias("reason"), "closing_share", "n_segments", "last", "score")

    def found(self) -> DataFrame:
        return self.judged().filter("is_cut").select("doc_id")

    def by_source(self) -> DataFrame:
        """How often each source cuts: ``source``, ``docs`` (with text), ``cut``, ``cut_share``."""
        cut = self.judged().filter("is_cut").groupBy("source").agg(F.count("*").alias("cut"))
        docs = self.ends.groupBy("source").agg(F.count("*").alias("docs"))
        rows = docs.join(cut, docs["source"].eqNullSafe(cut["source"]), "left").select(docs["source"], "docs", F.coalesce("cut", F.lit(0)).alias("cut"))
        return rows.withColumn("cut_share", F.col("cut") / F.col("docs"))
