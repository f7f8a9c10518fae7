"""Draw samples whose categories have given shares, keep a minimum from small ones, and report what can't be had.

The quota of a category is spread over strata (as the time of loading) in proportion to the records there. That table has
fractions; a maximum flow makes it integer by rounding each cell, each category and each stratum up or down, so that both
margins are kept, and an exact number of records is then drawn from each cell.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lymphspark.operators.quota import random_key, take_quotas
from lymphspark.session import Stage

#: The targets, and the cells of a target's category and a stratum, are handled at the driver; more are refused.
MAX_TARGETS, MAX_CELLS = 10_000, 200_000
LONE_BLOCK = 4096


def trimmed_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(label.cast("string"), r"(?U)^\s+|\s+$", ""))


class _Flow:
    """Maximum flow by breadth-first levels (Dinic), with lower bounds."""

    def __init__(self):
        self.to, self.cap, self.at = [], [], defaultdict(list)
        self.need: dict = defaultdict(int)

    def add(self, a, b, low: int, high: int) -> int:
        for u, v, c in ((a, b, high - low), (b, a, 0)):
            self.at[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
        self.need[b] += low
        self.need[a] -= low
        return len(self.to) - 2

    def solve(self, source, sink) -> bool:
        self.add(sink, source, 0, 1 << 60)
        want = 0
        for node, n in list(self.need.items()):
            if n > 0:
                self.add("_s", node, 0, n)
                want += n
            elif n < 0:
                self.add(node, "_t", 0, -n)
        return self._max("_s", "_t") == want

    def _max(self, s, t) -> int:
        total = 0
        while True:
            level, queue = {s: 0}, deque([s])
            while queue:
                u = queue.popleft()
                for e in self.at[u]:
                    if self.cap[e] > 0 and self.to[e] not in level:
                        level[self.to[e]] = level[u] + 1
                        queue.append(self.to[e])
            if t not in level:
                return total
            left = {u: iter(es) for u, es in self.at.items()}
            while pushed := self._push(s, t, level, left):
                total += pushed

    def _push(self, s, t, level, left) -> int:
        path, u = [], s
        while u != t:
            for e in left[u]:
                if self.cap[e] > 0 and level.get(self.to[e], -1) == level[u] + 1:
                    path.append(e)
                    u = self.to[e]
                    break
            else:
                if not path:
                    return 0
                level[u] = -1
                e = path.pop()
                u = self.to[e ^ 1]
        n = min(self.cap[e] for e in path)
        for e in path:
            self.cap[e] -= n
            self.cap[e ^ 1] += n
        # The iterators have moved past edges that may still have room.
        for e in path:
            left[self.to[e ^ 1]] = iter(self.at[self.to[e ^ 1]])
        return n


def round_table(table: dict[tuple, Fraction]) -> dict[tuple, int]:
    """Controlled rounding of a two-way table by maximum flow: cells, both margins and the total are each rounded to one of
    the two nearest integers, and add up. An integer flow exists since the table itself is a flow within the bounds."""
    rows, columns = defaultdict(Fraction), defaultdict(Fraction)
    for (r, c), x in table.items():
        rows[r] += x
        columns[c] += x
    flow, cells = _Flow(), {}
    for r, x in rows.items():
        flow.add("in", ("row", r), floor(x), ceil(x))
    for c, x in columns.items():
        flow.add(("column", c), "out", floor(x), ceil(x))
    for (r, c), x in table.items():
        cells[r, c] = (flow.add(("row", r), ("column", c), floor(x), ceil(x)), floor(x))
    total = sum(rows.values(), Fraction(0))
    flow.add("out", "end", round(total), round(total)) if total.denominator == 1 else flow.add("out", "end", floor(total), ceil(total))
    if not flow.solve("in", "end"):
        raise ArithmeticError("the table has no controlled rounding")
    return {k: low + flow.cap[e ^ 1] for k, (e, low) in cells.items()}


def allocate(targets: list[tuple[str, float, int]], available: dict[str, int], size: int) -> dict[str, Fraction]:
    """Records wanted of each category, as fractions that add up to ``size`` or to all records if there are fewer.

    Each category wants its share of the size, at least its minimum, and at most what there is; what is then missing or too
    much is spread over the others in proportion to their shares, never below a minimum or above what there is.
    """
    share = {c: Fraction(str(s or 0)) for c, s, _ in targets}
    low = {c: Fraction(min(m or 0, available.get(c, 0))) for c, _, m in targets}
    high = {c: Fraction(available.get(c, 0)) for c, _, _ in targets}
    size = Fraction(max(min(size, sum(high.values())), 0))
    if sum(low.values()) >= size:
        total = sum(low.values())
        return {c: x * size / total if total else Fraction(0) for c, x in low.items()}
    fixed: dict[str, Fraction] = {}
    while True:
        free = [c for c in share if c not in fixed]
        rest, weight = size - sum(fixed.values()), sum(share[c] for c in free)
        if not free:
            return fixed
        want = {c: rest * share[c] / weight if weight else rest / len(free) for c in free}
        over = sum((want[c] - high[c] for c in free if want[c] > high[c]), Fraction(0))
        under = sum((low[c] - want[c] for c in free if want[c] < low[c]), Fraction(0))
        if not over and not under:
            return fixed | want
        fixed |= {c: high[c] for c in free if want[c] > high[c]} if over >= under else {c: low[c] for c in free if want[c] < low[c]}


class TargetSample:
    """Samples for all target sets.

    ``tables`` maps a table name to (records, key column, stratum expression). A record belongs to a category if its label,
    without outer white space and letter case, is the category's value; rows with one key are one record, and a row without
    key is a record of its own: its key is made of a hash of its values and a number among the rows that have these. Null labels belong to no category. Unknown tables and missing fields count as empty.
    Null shares and minima count as 0; of repeated targets the first by share holds. Columns besides these aren't read.
    """

    def __init__(self, tables: dict[str, tuple[DataFrame, str, Column]], targets: DataFrame, seed: int = 20):
        self.spark, self.seed = targets.sparkSession, seed
        self.stage = Stage(self.spark, "sample")
        rows = targets.select("target_set", "table_name", "field_name", "category_value", "target_share", "min_rows", "sample_size").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"there are over {MAX_TARGETS} targets")
        self.sets: dict[str, dict] = {}
        for r in sorted((r for r in rows if r.target_set is not None and r.category_value is not None), key=str):
            s = self.sets.setdefault(r.target_set, {"table": r.table_name, "field": r.field_name, "size": r.sample_size or 0, "targets": {}})
            s["targets"].setdefault(r.category_value, (r.category_value, r.target_share or 0.0, r.min_rows or 0))
        self.records = self.stage.write(self._records(tables), "records")
        self.cells = self.records.groupBy("target_set", "category_value", "stratum").agg(F.count("*").alias("available"))
        self.plan, self.quotas = self._plan()

    def _records(self, tables) -> DataFrame:
        wanted = self.spark.createDataFrame([(s, c) for s, x in self.sets.items() for c in x["targets"]], "target_set string, category_value string")
        parts = [self.spark.createDataFrame([], "target_set string, category_value string, stratum string, key string, lone long")]
        for name, s in self.sets.items():
            if s["table"] in tables and s["field"] in tables[s["table"]][0].columns:
                df, key, stratum = tables[s["table"]]
                own = F.col(f"`{key}`").cast("string") if key in df.columns else F.lit(None).cast("string")
                values = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])
                parts.append(df.select(F.lit(name).alias("target_set"), trimmed_label(F.col(f"`{s['field']}`")).alias("category_value"), F.coalesce(stratum.cast("string"), F.lit("unknown")).alias("stratum"), own.alias("key"), F.when(own.isNull(), values).alias("lone")))
        every = reduce(DataFrame.unionByName, parts).join(F.broadcast(wanted), ["target_set", "category_value"], "left_semi")
        keyed = every.filter("key is not null").groupBy("target_set", "category_value", "key").agg(F.min("stratum").alias("stratum"))
        return keyed.unionByName(self._lone(every.filter("key is null")))

    @staticmethod
    def _lone(rows: DataFrame) -> DataFrame:
        """Rows without a key, equal ones counted first and then numbered; many equal ones in blocks, so that no array grows with them."""
        counted = rows.groupBy("target_set", "category_value", "stratum", "lone").agg(F.count("*").alias("n"))
        blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LONE_BLOCK))))
        each = blocks.withColumn("k", F.explode(F.sequence(F.col("block") * LONE_BLOCK, F.least(F.col("n"), (F.col("block") + 1) * LONE_BLOCK) - 1)))
        return each.select("target_set", "category_value", F.concat(F.lit("\x00"), F.hex("lone"), F.lit("-"), F.col("k").cast("string")).alias("key"), "stratum")

    def _plan(self):
        found = self.cells.limit(MAX_CELLS + 1).collect()
        if len(found) > MAX_CELLS:
            raise ValueError(f"categories and strata have over {MAX_CELLS} cells; a stratum must have few values")
        have: dict[str, dict[str, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
        for r in found:
            have[r.target_set][r.category_value][r.stratum] = r.available
        plan, quotas = [], []
        for name, s in self.sets.items():
            available = {c: sum(have[name][c].values()) for c in s["targets"]}
            want = allocate(list(s["targets"].values()), available, s["size"])
            rounded = round_table({(c, t): want[c] * n / available[c] for c in s["targets"] for t, n in have[name][c].items()})
            quota = defaultdict(int)
            for (c, t), n in rounded.items():
                quota[c] += n
                quotas.append((name, c, t, n))
            for c, share, least in s["targets"].values():
                few, below = available[c] < share * s["size"], available[c] < least
                why = ", ".join(x for x, yes in (("fewer records than the share", few), ("fewer records than the minimum", below)) if yes)
                plan.append((name, c, float(share), int(least), int(s["size"]), available[c], quota[c], why or None))
        frame = self.spark.createDataFrame
        return (
            frame(plan, "target_set string, category_value string, target_share double, min_rows long, sample_size long, available long, quota long, reason string"),
            frame([q for q in quotas if q[3]], "target_set string, category_value string, stratum string, quota long"),
        )

    def sample(self) -> DataFrame:
        """``target_set``, ``category_value``, ``stratum``, ``key`` of the records drawn."""
        return take_quotas(self.records, ["target_set", "category_value", "stratum"], random_key(self.seed, "key"), ["key"], self.quotas)

    def report(self) -> DataFrame:
        """One row per target: what there is, what was drawn and its share, and whether the target can be met.

        A target is unmet if the draw stays below its share or its minimum, and the records that there are, counted exactly,
        are too few as well (a draw may also stay below a share because minima of other categories take its place).
        """
        drawn = self.sample().groupBy("target_set", "category_value").agg(F.count("*").alias("drawn"))
        joined = self.plan.join(drawn, ["target_set", "category_value"], "left").fillna(0, ["drawn"])
        short = (F.col("drawn") < F.col("target_share") * F.col("sample_size")) | (F.col("drawn") < F.col("min_rows"))
        columns = [*self.plan.columns[:-1], "is_met", "reason", "drawn", "drawn_share"]
        joined = joined.withColumn("is_met", ~(short & F.col("reason").isNotNull()))
        return joined.withColumn("drawn_share", F.when(F.col("sample_size") > 0, F.col("drawn") / F.col("sample_size"))).select(*columns)
