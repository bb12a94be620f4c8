"""Samples whose categories have target shares (problem 5).

1. Weights are raked: iterative proportional fitting over all margins of a plan.  A row's weight is
   the product of one factor per margin, so only factors (as many as there are targets) move.
2. Rows are drawn without replacement by weighted exponential keys, the smallest keys first, so a
   draw always has the size of the plan while there are rows.
3. Categories that hardly have their minimum are drawn whole.  Where a draw leaves a category under
   its minimum or off its quota, its target is corrected and the rows are drawn again by the same
   random numbers: categories under their target get their own next keys, those over it give back
   their largest ones.  A plan with one margin draws its quotas straight away.
4. What could not be met is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.sampling import smallest, uniform
from quillspark.session import read, table

ROUNDS, CLOSE = 50, 1e-9
#: Draws of a plan with several margins, the first among them.
DRAWS = 12
#: A category may be off its quota by this share of its quota and one row before the plan is drawn again.
NEAR = 0.01
#: Occurring category combinations that are raked on the driver (8 bytes each and 2 a margin); above, in the tasks.
DRIVER_CELLS = 1_000_000


def category(column):
    """A category as it is compared: lower case, outer and repeated spaces aside; blank is null."""
    return F.nullif(F.btrim(F.lower(F.regexp_replace(column, r"[\s\p{Z}]+", " "))), F.lit(""))


class Cells:
    """How many rows each combination of categories has: codes (0 for none of the targets) and n.

    Up to DRIVER_CELLS combinations that occur are held as arrays; more of them stay a table, and
    each sum is one pass over it.  Both give the same sums.
    """

    def __init__(self, codes: np.ndarray | None, n: np.ndarray | None, rows: DataFrame | None = None):
        self.codes, self.n, self.rows = codes, n, rows

    @staticmethod
    def _mass(codes, n, factors, d):
        w = n.astype(float)
        for k, f in enumerate(factors):
            w = w * f[codes[:, k]]
        return np.bincount(codes[:, d], w, len(factors[d]))

    def mass(self, factors: list[np.ndarray], d: int) -> np.ndarray:
        """The weight of the rows of each category of margin ``d``."""
        if self.rows is None:
            return self._mass(self.codes, self.n, factors, d)

        def run(batches):
            out = np.zeros(len(factors[d]))
            for b in batches:
                if b.num_rows:
                    codes = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(factors))
                    out += Cells._mass(codes, b.column(1).to_numpy(), factors, d)
            yield pa.RecordBatch.from_arrays([pa.array([out])], names=["m"])

        got = self.rows.select("codes", "n").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(len(factors[d]))
        out[got["at"].to_numpy()] = got["x"].to_numpy()
        return out


def rake_factors(cells: Cells, margins: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """One factor per category and margin so that the rows' weights have every margin's target shares.

    ``margins`` has the targets by code; code 0, no target, has share and factor 0.  Targets of
    categories without weight are spread over the others.
    """
    factors = [np.where(m > 0, 1.0, 0.0) for m in margins]
    for _ in range(rounds):
        worst = 0.0
        for d, margin in enumerate(margins):
            mass = cells.mass(factors, d)
            on = mass > 0
            there = margin[on].sum()
            if not there:
                return factors
            want = np.where(on, margin / there, 0.0)
            step = np.divide(want, mass, out=np.zeros_like(mass), where=on)
            ok = on & (want > 0)
            worst = max(worst, float(np.abs(mass[ok] / want[ok] - 1).max(initial=0.0)))
            factors[d] = factors[d] * step
        if worst < CLOSE:
            break
    return factors


def rake(counts: dict[tuple, int], margins: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple, float]:
    """The weight of one row in each combination of categories so that every margin gets its target shares."""
    code = [{v: k for k, v in enumerate(m, 1)} for m in margins]
    codes = np.array([[c.get(v, 0) for v, c in zip(cell, code)] for cell in counts]).reshape(len(counts), len(margins))
    factors = rake_factors(Cells(codes, np.array(list(counts.values()))), [np.array([0.0, *m.values()]) for m in margins], rounds)
    return {cell: float(np.prod([f[k] for f, k in zip(factors, row)])) for cell, row in zip(counts, codes)}


def quotas(size: int, want: dict[str, float], least: dict[str, int], there: dict[str, int]) -> dict[str, int]:
    """Rows per category: its share of the size, its minimum at least, what is there at most."""
    exact = {v: s * size for v, s in want.items()}
    quota = {v: min(there[v], max(int(x + 1e-9), least[v])) for v, x in exact.items()}
    left = size - sum(quota.values())
    # too many: the minimums are paid for by categories above their own, the largest first
    while left < 0:
        v = max((v for v in quota if quota[v] > min(least[v], there[v])), key=lambda v: quota[v] - max(least[v], 0), default=None)
        if v is None:
            break
        step = min(-left, max(1, (quota[v] - min(least[v], there[v])) // len(quota)))
        quota[v] -= step
        left += step
    # too few: rounding first, then what others lack goes where rows are left, by share
    for v in sorted(quota, key=lambda v: int(exact[v] + 1e-9) - exact[v]):
        if left > 0 and quota[v] < there[v] and exact[v] > quota[v]:
            quota[v] += 1
            left -= 1
    while left > 0 and any(quota[v] < there[v] and want[v] > 0 for v in quota):
        room = [v for v in quota if quota[v] < there[v] and want[v] > 0]
        total = sum(want[v] for v in room)
        for v in room:
            add = min(there[v] - quota[v], max(1, int(left * want[v] / total)), left)
            quota[v] += add
            left -= add
    return quota


class Plan:
    """One plan: its margins' categories by code (from 1), targets, minimums, and the rows there are."""

    def __init__(self, name: str, targets: list, size: int):
        self.name, self.size = name, size
        self.fields = list(dict.fromkeys(t.field_name for t in targets))
        own = [[t for t in targets if t.field_name == f] for f in self.fields]
        self.want = [{t.name: float(t.target_share or 0.0) for t in ts} for ts in own]
        self.least = [{t.name: int(t.min_rows or 0) for t in ts} for ts in own]

    def rows(self, base: DataFrame) -> DataFrame:
        """(id, codes): the rows that have a target category in every margin."""
        codes = [F.coalesce(F.array_position(F.array(*map(F.lit, m)), F.col(f)).cast("int"), F.lit(0)) for f, m in zip(self.fields, self.want)]
        return base.select("id", F.array(*codes).alias("codes")).where(F.forall("codes", lambda c: c > 0))

    def count(self, base: DataFrame) -> None:
        """The rows of each category (those outside other margins' targets too) and the combinations that occur."""
        each = base.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f).alias("v")) for d, f in enumerate(self.fields)])).alias("x")).where("x.v is not null")
        each = each.where(F.concat_ws("\0", "x.d", "x.v").isin([f"{d}\0{v}" for d, m in enumerate(self.want) for v in m])).groupBy("x.d", "x.v").agg(F.count("*").alias("n")).collect()
        found = {(r.d, r.v): r.n for r in each}
        self.there = [{v: found.get((d, v), 0) for v in m} for d, m in enumerate(self.want)]
        if len(self.fields) > 1:
            cells = table(self.rows(base).groupBy("codes").agg(F.count("*").alias("n")), "sample-cells")
            if cells.count() <= DRIVER_CELLS:
                got = cells.toArrow()
                codes = np.array(got["codes"].to_pylist(), np.int32).reshape(-1, len(self.fields))
                self.cells = Cells(codes, got["n"].to_numpy())
            else:
                self.cells = Cells(None, None, cells)


def _margins(drawn: DataFrame, plan: Plan) -> list[np.ndarray]:
    """Drawn rows of each category, by margin and code."""
    out = [np.zeros(len(m) + 1) for m in plan.want]
    for r in drawn.select(F.posexplode("codes").alias("d", "c")).groupBy("d", "c").agg(F.count("*").alias("n")).collect():
        out[r.d][r.c] = r.n
    return out


def _keys(rows: DataFrame, plan: Plan, factors: list[np.ndarray], sure: list[np.ndarray]) -> DataFrame:
    """``rows`` with weighted exponential keys in [0, 1); rows with a category that is taken whole come first."""
    weight, first = F.lit(1.0), F.lit(False)
    scale = [f / f.max() if f.max() > 0 else f for f in factors]
    # about where the last drawn key will lie
    turn = plan.size / max(1e-300, float(plan.cells.mass(scale, 0).sum()))
    for d, f in enumerate(scale):
        at = F.get("codes", F.lit(d)) + 1
        weight = weight * F.element_at(F.array(*map(F.lit, f.tolist())), at)
        if sure[d].any():
            first = first | F.element_at(F.array(*map(F.lit, sure[d].tolist())), at)
    e = F.col("e") / F.greatest(weight, F.lit(1e-300))
    # in the same order, as a number in (0, 1): half of the range for rows that are sure to come
    key = e / (e + F.lit(max(turn, 1e-300)))
    return rows.withColumn("key", F.when(first, F.col("u") / 2).otherwise(0.5 + key / 2)).where(first | (weight > 0))


def _draw_margins(base: DataFrame, plan: Plan, seed: str) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, codes) of the rows drawn for a plan with several margins, and how many each category has."""
    u = uniform(seed, F.lit(plan.name), "id")
    rows = table(plan.rows(base).select("id", "codes", u.alias("u"), (-F.log(u)).alias("e")), "sample-rows-keyed")
    free = [np.concatenate([[0], plan.cells.mass([np.append(0.0, np.ones(len(m))) for m in plan.want], d)[1:]]) for d, m in enumerate(plan.want)]
    goal, floor, sure = [], [], []
    for d, (want, least) in enumerate(zip(plan.want, plan.least)):
        there = {v: int(n) for v, n in zip(want, free[d][1:])}
        quota = quotas(plan.size, want, least, there)
        goal.append(np.array([0.0, *quota.values()]))
        floor.append(np.array([0.0, *(min(least[v], there[v]) for v in want)]))
        sure.append(np.array([False, *(0 < there[v] <= least[v] for v in want)]))
    target, best = [g / max(1.0, g.sum()) for g in goal], None
    for _ in range(DRAWS):
        factors = rake_factors(plan.cells, target)
        drawn = smallest(_keys(rows, plan, factors, sure).withColumn("_k", F.lit(plan.size)).withColumn("_g", F.lit(0)), ["_g"], "key", "_k", "id").select("id", "codes")
        drawn = table(drawn, "sample-drawn")
        have = _margins(drawn, plan)
        lacking = sum(float(np.maximum(f - h, 0).sum()) for f, h in zip(floor, have))
        off = sum(float(np.abs(g - h).sum()) for g, h in zip(goal, have))
        if best is None or (lacking, off) < best[0]:
            best = ((lacking, off), drawn, have)
        if not lacking and all((np.abs(g - h) <= 1 + NEAR * g).all() for g, h in zip(goal, have)):
            break
        for d, (g, h, f) in enumerate(zip(goal, have, floor)):
            ask = np.where(h < f, np.maximum(g, f + np.sqrt(f - np.minimum(h, f))), g)
            step = np.sqrt(np.clip(np.divide(ask, np.maximum(h, 0.5)), 0.25, 4.0))  # half of the way, or it would swing
            new = np.where(target[d] > 0, target[d] * step, 0.0)
            target[d] = new / max(new.sum(), 1e-300)
    return best[1], best[2]


def _draw_quotas(base: DataFrame, plans: list[Plan], seed: str) -> tuple[DataFrame | None, dict[str, list[np.ndarray]]]:
    """(plan, id) of the rows drawn for plans with one margin: each category's quota by its smallest keys, all plans together.

    Within one category all weights are equal, so the weighted keys have the order of the plain ones.
    """
    if not plans:
        return None, {}
    spark = base.sparkSession
    quota = [(p.name, k, q) for p in plans for k, q in enumerate(quotas(p.size, p.want[0], p.least[0], p.there[0]).values(), 1)]
    have = {p.name: [np.array([0.0, *(q for name, _, q in quota if name == p.name)])] for p in plans}
    e = -F.log(uniform(seed, "plan", "id"))
    keyed = None
    for p in plans:
        own = p.rows(base).select("id", F.lit(p.name).alias("plan"), F.get("codes", F.lit(0)).alias("code"))
        keyed = own if keyed is None else keyed.unionByName(own)
    asked = spark.createDataFrame(quota, "plan string, code int, quota bigint")  # one row per target
    keyed = keyed.join(F.broadcast(asked), ["plan", "code"]).withColumn("key", e / (e + F.lit(1.0)))
    return smallest(table(keyed, "sample-keys"), ["plan", "code"], "key", "quota", "id").select("plan", "id"), have


REPORT = "plan string, field_name string, name string, available bigint, drawn bigint"


def samples(data: DataFrame, targets: DataFrame, seed: str = "7") -> tuple[DataFrame | None, DataFrame]:
    """Drawn rows (plan, id) and the report, one row per target.

    ``data``: id and category columns; an id that comes again counts once.  ``targets`` as in
    sample_targets.  Null and blank categories are none and are not drawn.  Empty data draw nothing
    and leave every target with a positive need open.  All plans go through the same few jobs.
    """
    spark = data.sparkSession
    rows = targets.where("plan is not null and field_name is not null").select("plan", "field_name", "category", category(F.col("category")).alias("name"), "target_share", "min_rows", "sample_rows").where("name is not null").collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.plan, r.field_name, r.category)):
        by.setdefault(r.plan, []).append(r)
    fields = sorted({r.field_name for r in rows})
    unknown = [f for f in fields if f not in data.columns]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    drawn, lines = None, []
    if by:
        base = table(data.where("id is not null").groupBy("id").agg(*[F.min(category(F.col(f))).alias(f) for f in fields]), "sample-rows")
        plans = [Plan(name, own, max(int(r.sample_rows or 0) for r in own)) for name, own in by.items()]
        for p in plans:
            p.count(base)
        drawn, have = _draw_quotas(base, [p for p in plans if len(p.fields) == 1], seed)
        for p in plans:
            if len(p.fields) > 1:
                rows, have[p.name] = _draw_margins(base, p, seed)
                rows = rows.select(F.lit(p.name).alias("plan"), "id")
                drawn = rows if drawn is None else drawn.unionByName(rows)
        lines = [(p.name, f, v, p.there[d][v], int(have[p.name][d][k])) for p in plans for d, f in enumerate(p.fields) for k, v in enumerate(p.want[d], 1)]
        drawn = table(drawn, "sample")
    report = spark.createDataFrame(lines, REPORT)
    need = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_rows"))
    report = targets.select("plan", "field_name", "category", category(F.col("category")).alias("name"), "target_share", "min_rows", "sample_rows").join(F.broadcast(report), ["plan", "field_name", "name"])
    share = F.try_divide(F.col("drawn").cast("double"), F.sum("drawn").over(Window.partitionBy("plan", "field_name"))) - F.col("target_share")
    return drawn, report.select("plan", "field_name", "category", "target_share", "min_rows", "sample_rows", "available", "drawn", need.alias("need"), (F.col("available") < need - 1e-9).alias("short"), share.alias("share_gap"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target for which the data have fewer rows than the plan needs of the category."""
    got = samples(read(spark, sf_dir, "dataset"), read(spark, sf_dir, "sample_targets"))[1]
    # the sample stays below what the target needs; that there are no more rows is checked on top
    return got.where("drawn < need and short").select("plan", "category")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with what there is, what is needed and what was drawn."""
    return samples(read(spark, sf_dir, "dataset"), read(spark, sf_dir, "sample_targets"))[1].select("plan", "field_name", "category", "target_share", "min_rows", "sample_rows", "available", "drawn", "short", F.round("share_gap", 6).alias("share_gap"))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn rows of each plan."""
    drawn, _ = samples(read(spark, sf_dir, "dataset"), read(spark, sf_dir, "sample_targets"))
    return drawn if drawn is not None else spark.createDataFrame([], "plan string, id string")


def p5_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All plans' targets as the margins of one sample of the smallest plan's size: what there is and what was drawn."""
    targets = read(spark, sf_dir, "sample_targets")
    size = targets.agg(F.min("sample_rows")).collect()[0][0]
    joint = targets.dropDuplicates(["field_name", "category"]).withColumn("plan", F.lit("joint")).withColumn("sample_rows", F.lit(size).cast("bigint"))
    return samples(read(spark, sf_dir, "dataset"), joint)[1].select("field_name", "category", "target_share", "min_rows", "available", "drawn", F.round("share_gap", 6).alias("share_gap"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_sample": p5_sample, "p5_joint": p5_joint}
_NAME = "nullif(trim(lower(regexp_replace({}, '[\\s\\x{{00a0}}]+', ' ', 'g'))), '')"
ORACLE = {
    "p5_found": f"""
WITH d AS (SELECT DISTINCT id, {_NAME.format('genre')} AS genre, {_NAME.format('speech_emotion')} AS speech_emotion, {_NAME.format('style')} AS style FROM dataset WHERE id IS NOT NULL),
c AS (SELECT 'genre' AS field_name, genre AS name, count(DISTINCT id) AS n FROM d GROUP BY ALL UNION ALL
      SELECT 'speech_emotion', speech_emotion, count(DISTINCT id) FROM d GROUP BY ALL UNION ALL SELECT 'style', style, count(DISTINCT id) FROM d GROUP BY ALL)
SELECT t.plan, t.category FROM sample_targets t LEFT JOIN c ON c.field_name = t.field_name AND c.name = {_NAME.format('t.category')}
WHERE coalesce(c.n, 0) < greatest(t.min_rows, t.target_share * t.sample_rows) - 1e-9"""
}
