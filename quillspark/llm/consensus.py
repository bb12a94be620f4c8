"""One score per item from several judges who disagree (problem 6).

Judges have confusion matrices, items have posteriors over the scores; both are estimated together
by expectation-maximisation (Dawid and Skene) with smoothed counts.  An item's votes are gathered
once; every round reads that table once, sends the judges' matrices to the tasks (their size is
judges x scores x scores) and shuffles one sum of that same size per task.  Where there are too many
judges to send their matrices, the same rounds go as joins: votes meet their judge's row of the
matrix, items their votes.  Agreement is measured apart from the model, corrected for chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.skew import lookup_join
from quillspark.operators.contracts import ordinals
from quillspark.session import table

#: Scores run from 1 to this.
TOP = 10
ROUNDS, SMOOTH, ENOUGH = 30, 0.5, 1e-4
#: Judges up to which the matrices are sent to the tasks (8 MB at this bound); above, they stay a table.
SENT_JUDGES = 10_000


def long_votes(results: DataFrame) -> DataFrame:
    """(index, modality, category, judge, score): each judge's valid score, once per item.

    ``results`` has index, modality, judge, received_at, judge_eval.  Of several results of a judge
    for one index and modality the last received counts; of one category spelled in several ways
    the smallest score.  Null evaluations and scores outside 1..10 are none.
    """
    rows = results.where("index is not null and modality is not null and judge is not null")
    scores = F.transform(F.map_entries("judge_eval"), lambda e: F.struct(F.btrim(F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]+", "_"), F.lit("_")).alias("category"), e["value"]["score"].cast("int").alias("score")))
    rows = rows.select("index", "modality", "judge", F.struct("received_at", scores.alias("scores")).alias("r")).groupBy("index", "modality", "judge").agg(F.max("r").alias("r"))
    one = rows.select("index", "modality", "judge", F.explode("r.scores").alias("e")).where(f"e.score between 1 and {TOP} and e.category <> ''")
    return one.groupBy("index", "modality", F.col("e.category").alias("category"), "judge").agg(F.min("e.score").alias("score"))


def _votes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = b.column("votes")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(col.offsets.to_numpy())
    return flat // TOP, flat % TOP, sizes


def _posterior(judge, score, sizes, prior, conf) -> np.ndarray:
    lp = conf[judge, :, score]
    starts = np.cumsum(sizes) - sizes
    ll = np.log(prior) + np.add.reduceat(lp, starts, axis=0)
    ll -= ll.max(axis=1, keepdims=True)
    p = np.exp(ll)
    return p / p.sum(axis=1, keepdims=True)


def _first(judge, score, sizes) -> np.ndarray:
    """Before the first round: each score as likely as it has votes, the middle vote a little more."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    p = np.zeros((len(sizes), TOP))
    np.add.at(p, (item, score), 1.0)
    order = np.lexsort((score, item))
    starts = np.cumsum(sizes) - sizes
    p[np.arange(len(sizes)), score[order][starts + (sizes - 1) // 2]] += 0.5
    return p / p.sum(axis=1, keepdims=True)


def _sums(params, judges: int):
    def run(batches):
        sums = np.zeros(TOP + judges * TOP * TOP)  # the prior and then the matrices
        prior, total = sums[:TOP], sums[TOP:].reshape(judges, TOP, TOP)
        for b in batches:
            if not b.num_rows:
                continue
            judge, score, sizes = _votes(b)
            p = _first(judge, score, sizes) if params is None else _posterior(judge, score, sizes, *params.value)
            prior += p.sum(axis=0)
            np.add.at(total, (judge, slice(None), score), np.repeat(p, sizes, axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([sums])], names=["sums"])

    return run


def fit(items: DataFrame, judges: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(prior, log of confusion[judge, true, given]) from items' votes, each vote judge x TOP + score - 1."""
    sc = items.sparkSession.sparkContext
    params, now = None, None
    for _ in range(rounds):
        got = items.select("votes").mapInArrow(_sums(params, judges), "sums array<double>")
        got = got.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros(TOP + judges * TOP * TOP)
        sums[got["at"].to_numpy()] = got["x"].to_numpy()
        prior, total = sums[:TOP], sums[TOP:].reshape(judges, TOP, TOP)
        prior = (prior + SMOOTH) / (prior + SMOOTH).sum()
        # what a judge gives, whatever the item, smooths the rows of which little is known
        given = total.sum(axis=1, keepdims=True) + 1.0 / TOP
        smooth = total + SMOOTH * TOP * given / given.sum(axis=2, keepdims=True)
        conf = np.log(smooth / smooth.sum(axis=2, keepdims=True))
        last, now = now, np.exp(conf)
        params = sc.broadcast((prior, conf))
        if last is not None and np.abs(now - last).max() < ENOUGH:
            break
    return params.value


SCORES = range(TOP)


def fit_table(items: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """((number, score, c0..c9), log prior): the same as fit() for any number of judges, by joins.

    A row holds the logarithms of confusion[judge, true, given = score] over all true scores.
    """
    votes = table(items.select("item", F.explode("votes").alias("v")).select("item", F.expr(f"v div {TOP}").alias("number"), F.expr(f"int(v % {TOP})").alias("score")), "consensus-long")
    many = [F.count_if(F.col("score") == k).alias(f"n{k}") for k in SCORES]
    first = votes.groupBy("item").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score")).alias("s"), *many)
    middle = F.element_at("s", F.expr("int((n - 1) div 2) + 1"))
    post = first.select("item", *[((F.col(f"n{k}") + F.when(middle == k, 0.5).otherwise(0.0)) / (F.col("n") + 0.5)).alias(f"p{k}") for k in SCORES])
    conf, now = None, None
    for _ in range(rounds):
        if conf is not None:
            post = posterior(votes, conf, prior)  # noqa: F821
        post = table(post, "consensus-posterior")
        mass = post.agg(*[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) + SMOOTH for k in SCORES]).collect()[0]
        prior = np.log(np.array(mass) / sum(mass)).tolist()
        total = votes.join(post, "item").groupBy("number", "score").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in SCORES])
        every = total.select("number").distinct().select("number", F.explode(F.array(*map(F.lit, SCORES))).alias("score"))
        total = every.join(total, ["number", "score"], "left").fillna(0.0)
        judge = Window.partitionBy("number")
        given = sum((F.col(f"p{k}") for k in SCORES[1:]), F.col("p0")) + 1.0 / TOP
        total = total.withColumn("given", given).withColumn("add", SMOOTH * TOP * F.col("given") / F.sum("given").over(judge))
        total = total.select("number", "score", *[(F.col(f"p{k}") + F.col("add")).alias(f"p{k}") for k in SCORES])
        last, now = now, table(total.select("number", "score", *[F.log(F.col(f"p{k}") / F.sum(f"p{k}").over(judge)).alias(f"c{k}") for k in SCORES]), "consensus-matrices")
        conf = now
        if last is not None:
            gap = now.join(last.select("number", "score", *[F.col(f"c{k}").alias(f"d{k}") for k in SCORES]), ["number", "score"])
            most = gap.agg(F.max(F.greatest(*[F.abs(F.exp(f"c{k}") - F.exp(f"d{k}")) for k in SCORES]))).collect()[0][0]
            if most is None or most < ENOUGH:
                break
    return conf, prior


def posterior(votes: DataFrame, conf: DataFrame, prior: list[float]) -> DataFrame:
    """(item, p0..p9) of each item from the rows of its votes' judges."""
    met = lookup_join(votes, conf, ["number", "score"], F.col("item"))
    sums = met.groupBy("item").agg(*[(F.sum(f"c{k}") + F.lit(prior[k])).alias(f"l{k}") for k in SCORES])
    top = F.greatest(*[F.col(f"l{k}") for k in SCORES])
    sums = sums.select("item", *[F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in SCORES])
    whole = sum((F.col(f"e{k}") for k in SCORES[1:]), F.col("e0"))
    return sums.select("item", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in SCORES])


class Model:
    """The fitted judges and the gathered items."""

    def __init__(self, votes: DataFrame, rounds: int = ROUNDS):
        self.votes = votes = table(votes, "consensus-votes")
        names = votes.select("judge").distinct()
        self.many = names.count()
        self.sent = self.many <= SENT_JUDGES
        if self.sent:
            self.number = votes.sparkSession.createDataFrame([(j, n) for n, j in enumerate(sorted(r.judge for r in names.collect()))], "judge string, number bigint")
        else:
            self.number = table(ordinals(names, ["judge"], "number"), "consensus-judges")
        coded = lookup_join(votes, self.number, "judge", F.col("index"), rows=self.many).withColumn("vote", F.col("number") * TOP + F.col("score") - 1)
        items = coded.groupBy("index", "modality", "category").agg(F.sort_array(F.collect_list("vote")).alias("votes")).withColumn("item", F.monotonically_increasing_id())
        self.items = table(items, "consensus-items")
        if self.many and self.sent:
            self.prior, self.conf = fit(self.items, self.many, rounds)
        elif self.many:
            self.matrices, self.log_prior = fit_table(self.items, rounds)

    def consensus(self) -> DataFrame:
        """(index, modality, category, score, confidence, n_scores, n_different) per item."""
        schema = "index bigint, modality string, category string, score int, confidence double, n_scores int, n_different int"
        if not self.many:
            return self.items.sparkSession.createDataFrame([], schema)
        if not self.sent:
            votes = self.items.select("item", F.explode("votes").alias("v")).select("item", F.expr(f"v div {TOP}").alias("number"), F.expr(f"int(v % {TOP})").alias("score"))
            p = F.array(*[f"p{k}" for k in SCORES])
            best = posterior(votes, self.matrices, self.log_prior).select("item", F.array_max(p).alias("confidence"), F.array_position(p, F.array_max(p)).cast("int").alias("score"))
            different = F.size(F.array_distinct(F.transform("votes", lambda v: v % TOP)))
            return self.items.join(best, "item").select("index", "modality", "category", "score", "confidence", F.size("votes").alias("n_scores"), different.alias("n_different"))
        params = self.items.sparkSession.sparkContext.broadcast((self.prior, self.conf))

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                judge, score, sizes = _votes(b)
                p = _posterior(judge, score, sizes, *params.value)
                starts = np.cumsum(sizes) - sizes
                seen = np.zeros((len(sizes), TOP), bool)
                seen[np.repeat(np.arange(len(sizes)), sizes), score] = True
                yield pa.RecordBatch.from_arrays(
                    [b.column("index"), b.column("modality"), b.column("category"), pa.array((p.argmax(axis=1) + 1).astype(np.int32)), pa.array(p.max(axis=1)), pa.array(sizes.astype(np.int32)), pa.array(seen.sum(axis=1).astype(np.int32))],
                    names=["index", "modality", "category", "score", "confidence", "n_scores", "n_different"],
                )

        return self.items.drop("item").mapInArrow(run, schema)

    def reliability(self) -> DataFrame:
        """(judge, n_scores, exact, near, bias): how a judge's scores follow the consensus, by the fitted matrices.

        exact and near are the chances to give the true score, and one at most one off; bias is the mean difference.
        """
        spark = self.items.sparkSession
        counts = self.votes.groupBy("judge").agg(F.count("*").alias("n_scores")).join(self.number, "judge")
        if not self.many:
            return counts.select("judge", "n_scores", *[F.lit(0.0).alias(c) for c in ("exact", "near", "bias")])
        if self.sent:
            w = self.prior[None, :, None] * np.exp(self.conf)
            off = np.arange(TOP)[None, :] - np.arange(TOP)[:, None]
            rows = [(n, float(x[off == 0].sum()), float(x[np.abs(off) <= 1].sum()), float((x * off).sum())) for n, x in enumerate(w)]
            told = spark.createDataFrame(rows, "number bigint, exact double, near double, bias double")
        else:
            true = np.exp(self.log_prior).tolist()
            w = [F.exp(f"c{k}") * true[k] for k in SCORES]
            zero = F.lit(0.0)
            exact = sum((F.when(F.col("score") == k, w[k]).otherwise(zero) for k in SCORES), zero)
            near = sum((F.when(F.abs(F.col("score") - k) <= 1, w[k]).otherwise(zero) for k in SCORES), zero)
            bias = sum((w[k] * (F.col("score") - k) for k in SCORES), zero)
            told = self.matrices.groupBy("number").agg(F.sum(exact).alias("exact"), F.sum(near).alias("near"), F.sum(bias).alias("bias"))
        return counts.join(told, "number").select("judge", "n_scores", "exact", "near", "bias")


def agreement(votes: DataFrame) -> DataFrame:
    """(modality, category, n_items, n_scores, observed, expected, kappa): agreement of the judges, corrected for chance.

    observed is the chance that two scores of one item are equal, expected that two scores of the
    group are (Krippendorff's nominal alpha).  Items with one score are left out; where all scores
    of a group are equal kappa is null.
    """
    cells = votes.groupBy("modality", "category", "index", "score").agg(F.count("*").alias("c"))
    items = cells.groupBy("modality", "category", "index").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m >= 2")
    group = items.groupBy("modality", "category").agg(F.count("*").alias("n_items"), F.sum("m").alias("n_scores"), F.sum(F.col("same") / (F.col("m") - 1)).alias("s"))
    marg = cells.join(items.select("modality", "category", "index"), ["modality", "category", "index"]).groupBy("modality", "category", "score").agg(F.sum("c").alias("n"))
    chance = marg.groupBy("modality", "category").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("e"))
    observed = F.col("s") / F.col("n_scores")
    expected = F.col("e") / (F.col("n_scores") * (F.col("n_scores") - 1))
    return group.join(chance, ["modality", "category"]).select("modality", "category", "n_items", "n_scores", observed.alias("observed"), expected.alias("expected"), F.try_divide(observed - expected, 1 - expected).alias("kappa"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only the scores of the evaluations are read, not the rationales
    return spark.read.schema("index bigint, modality string, judge string, received_at timestamp_ntz, judge_eval map<string, struct<score: int>>").parquet(f"{sf_dir}/judge_results.parquet")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus score of each item with at least three valid scores that are not all equal."""
    return Model(long_votes(_results(spark, sf_dir))).consensus().where("n_scores >= 3 and n_different > 1").select("index", "modality", "category", "score")


def p6_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How reliable each judge is."""
    return Model(long_votes(_results(spark, sf_dir))).reliability().select("judge", "n_scores", *[F.round(c, 4).alias(c) for c in ("exact", "near", "bias")])


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the judges agree, by modality and category."""
    got = agreement(long_votes(_results(spark, sf_dir)))
    return got.select("modality", "category", "n_items", "n_scores", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


QUERIES = {"p6_found": p6_found, "p6_judges": p6_judges, "p6_agreement": p6_agreement}
ORACLE = {
    "p6_agreement": """
WITH r AS (SELECT index, modality, judge, judge_eval FROM judge_results WHERE index IS NOT NULL AND modality IS NOT NULL AND judge IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY index, modality, judge ORDER BY received_at DESC) = 1),
k AS (SELECT index, modality, judge, unnest(map_keys(judge_eval)) AS key, unnest(map_values(judge_eval)) AS v FROM r),
v AS (SELECT modality, trim(regexp_replace(lower(key), '[^a-z0-9]+', '_', 'g'), '_') AS category, index, judge, min(v.score) AS score
      FROM k WHERE v.score BETWEEN 1 AND 10 GROUP BY ALL),
c AS (SELECT modality, category, index, score, count(*) AS c FROM v WHERE category <> '' GROUP BY ALL),
i AS (SELECT modality, category, index, sum(c) AS m, sum(c * (c - 1)) AS same FROM c GROUP BY ALL HAVING sum(c) >= 2),
g AS (SELECT modality, category, count(*) AS n_items, sum(m) AS n_scores, sum(same / (m - 1)) / sum(m) AS observed FROM i GROUP BY ALL),
n AS (SELECT modality, category, score, sum(c) AS n FROM c JOIN i USING (modality, category, index) GROUP BY ALL),
e AS (SELECT modality, category, sum(n * (n - 1)) AS e FROM n GROUP BY ALL)
SELECT modality, category, n_items, CAST(n_scores AS BIGINT) AS n_scores, round(observed, 6) AS observed, round(e / (n_scores * (n_scores - 1)), 6) AS expected,
       round((observed - e / (n_scores * (n_scores - 1))) / nullif(1 - e / (n_scores * (n_scores - 1)), 0), 6) AS kappa
FROM g JOIN e USING (modality, category)"""
}
