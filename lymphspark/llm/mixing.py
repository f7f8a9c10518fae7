"""Put documents of several sources together so that each gives its share of a token budget.

Documents are counted by exact token length. What a source gives is a number of whole passes over its documents and a part
of one more pass, fitted to the remaining budget: the same share of every length first, then a bounded knapsack over the
lengths for the rest, whose sum is the greatest that is within the budget. The documents of each length are drawn by a seeded key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphspark.operators.quota import random_key, take_quotas
from lymphspark.session import Stage

#: Tokens that documents given back for the knapsack may hold at first; as long as the budget isn't met, four times as many.
ROOM = 1 << 14


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that no other choice of them comes nearer to the budget from below.

    The same share of every length is taken first, and the rest is filled with the longest documents that fit. Where that
    falls short, documents are given back, shortest first, and a bounded knapsack chooses among them and those that are left.
    More and more are given back until the budget is met or a bound is reached that proves the choice best: of all choices
    with one sum, some differ from the first in no more than 2m + g + 1 documents (m: greatest length, g: the gap), since
    a longer series of changes, ordered so that its partial sums stay in a window of that width, passes a sum twice, and
    what lies between can be left out.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, budget, total = lengths // unit, budget // unit, total // unit
    take = np.array([c * budget // total for c in counts.tolist()], dtype=np.int64)
    gap = budget - int((lengths * take).sum())
    for k in np.argsort(-lengths, kind="stable"):
        n = min(int(counts[k] - take[k]), gap // int(lengths[k])) if lengths[k] else 0
        take[k] += n
        gap -= n * int(lengths[k])
    most, room = 2 * int(lengths.max()) + gap + 1, ROOM
    while gap:
        back, all_back = _given_back(lengths, take, most, room)
        left = np.minimum(counts - take, most) + back
        chosen = _knapsack(lengths, left, gap + int((lengths * back).sum()))
        better = gap + int((lengths * (back - chosen)).sum())
        if better == 0 or all_back:
            return take - back + chosen
        room *= 4
    return take


def _given_back(lengths: np.ndarray, take: np.ndarray, most: int, room: int) -> tuple[np.ndarray, bool]:
    """Documents of each length to choose again, of ``room`` tokens together, and whether these are all that need be."""
    order = np.argsort(lengths, kind="stable")
    back, each = np.zeros_like(take), 1
    while True:
        wanted = np.minimum(take, min(each, most))
        fits = np.zeros(len(take), bool)
        fits[order] = np.cumsum((wanted * lengths)[order]) <= room
        back = np.maximum(back, np.where(fits, wanted, 0)) if fits.all() or each == 1 else back
        if not fits.all():
            return back, False
        if each >= min(most, int(take.max(initial=0))):
            return back, True
        each *= 2


def _knapsack(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    reach = np.zeros(capacity + 1, dtype=bool)
    reach[0] = True
    owner = np.full(capacity + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths):
        left, power = min(int(counts[k]), capacity // int(lengths[k])) if lengths[k] else 0, 1
        while left > 0 and not reach[capacity]:
            n = min(power, left)
            weight = n * int(lengths[k])
            if weight <= capacity:
                new = np.zeros_like(reach)
                new[weight:] = reach[: capacity + 1 - weight]
                new &= ~reach
                owner[new] = len(items)
                reach |= new
            items.append((int(k), n))
            left -= n
            power *= 2
    take = np.zeros(len(lengths), dtype=np.int64)
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, n = items[owner[at]]
        take[k] += n
        at -= n * int(lengths[k])
    return take


_FIT = "mix_name string, source string, target_share double, max_repeats int, budget_tokens long, n_tokens long, docs long, passes long, quota long, used_up boolean"


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one mix and source, by length, with ``passes`` and ``quota`` filled in, and whether all repeats are used up."""
    share, repeats, budget = pdf.target_share.iloc[0], int(pdf.max_repeats.iloc[0]), int(pdf.budget_tokens.iloc[0])
    lengths, docs = pdf.n_tokens.fillna(0).to_numpy(np.int64), pdf.docs.fillna(0).to_numpy(np.int64)
    used = lengths > 0
    total, target = int((lengths * docs).sum()), share * budget
    passes = min(math.floor(target / total), repeats) if total and math.isfinite(target) else 0
    quota = np.zeros(len(pdf), dtype=np.int64)
    if total and passes < repeats:
        quota[used] = fit_lengths(lengths[used], docs[used], int(math.floor(target)) - passes * total)
    return pdf.assign(n_tokens=lengths, docs=docs, passes=np.where(used, passes, 0), quota=quota, used_up=not total or passes >= repeats)


class Mixture:
    """Mixes of documents. ``sizes`` has ``doc_id``, ``source``, ``n_tokens``, one row per document.

    Documents without tokens (null or empty text) and sources that no mix names take no part. Targets without documents are
    reported with nothing given. Of repeated targets one holds; null shares, repeats and budgets count as 0. A source is
    used at most ``max_repeats`` times over, and no document more often.
    """

    def __init__(self, sizes: DataFrame, targets: DataFrame, seed: int = 9):
        self.seed = seed
        self.stage = Stage(targets.sparkSession, "mix")
        self.sizes = self.stage.write(sizes.select("doc_id", "source", "n_tokens").filter("source is not null and n_tokens > 0"), "sizes")
        wanted = targets.filter("mix_name is not null and source is not null").groupBy("mix_name", "source")
        self.targets = wanted.agg(F.coalesce(F.max("target_share"), F.lit(0.0)).cast("double").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("int").alias("max_repeats"), F.coalesce(F.max("budget_tokens"), F.lit(0)).cast("long").alias("budget_tokens"))
        by_length = self.sizes.groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
        # A group has one row per distinct length of a source: bounded by the longest document, not by the documents.
        joined = self.targets.join(by_length, "source", "left").withColumn("passes", F.lit(0).cast("long")).withColumn("quota", F.lit(0).cast("long")).withColumn("used_up", F.lit(False))
        cols = [c.split()[0] for c in _FIT.split(", ")]
        self.fitted = self.stage.write(joined.select(*cols).groupBy("mix_name", "source").applyInPandas(_fit_source, _FIT), "fitted")

    def report(self) -> DataFrame:
        """One row per target: tokens there, tokens given, their share of the budget, tokens missing, and whether the share can be given.

        It can't where what is given stays below the share though every document is used as often as it may be; tokens that are
        missing for want of documents of the right lengths (``missing_tokens`` of a met target) don't count.
        """
        given = F.sum(F.col("n_tokens") * (F.col("docs") * F.col("passes") + F.col("quota")))
        per = self.fitted.groupBy("mix_name", "source", "target_share", "max_repeats", "budget_tokens").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("source_tokens"), given.alias("given_tokens"), F.bool_and("used_up").alias("used_up"))
        target = F.col("target_share") * F.col("budget_tokens")
        share = F.when(F.col("budget_tokens") > 0, F.col("given_tokens") / F.col("budget_tokens"))
        missing = F.greatest(F.floor(target) - F.col("given_tokens"), F.lit(0).cast("long"))
        return per.withColumn("given_share", share).withColumn("missing_tokens", missing).withColumn("is_met", ~(F.col("used_up") & (F.col("given_tokens") < target))).drop("used_up")

    def documents(self) -> DataFrame:
        """``mix_name``, ``source``, ``doc_id``, ``n_tokens``, ``repeats`` of every document that is used."""
        cells = ["mix_name", "source", "n_tokens"]
        rows = self.sizes.join(self.targets.select("mix_name", "source"), "source").select(*cells, "doc_id")
        extra = take_quotas(rows, cells, random_key(self.seed, "doc_id"), ["doc_id"], self.fitted.filter("quota > 0").select(*cells, "quota")).withColumn("repeats", F.lit(1).cast("long"))
        whole = rows.join(self.fitted.filter("passes > 0").select(*cells, "passes"), cells).withColumnRenamed("passes", "repeats")
        return whole.unionByName(extra).groupBy("mix_name", "source", "doc_id", "n_tokens").agg(F.sum("repeats").alias("repeats"))
