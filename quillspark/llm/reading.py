"""Reading level of page texts (problem 1).

A page's coverage rank is the size of the smallest frequency-ranked vocabulary that covers a fixed
share of its words; together with sentence length it is calibrated against pages of known level.
Words are counted over the whole corpus; names, i.e. words that are nearly always capitalised, are
no vocabulary.  The calibration is fitted on at most MOST_LABELS labelled rows and applied as a
SQL expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.skew import lookup_join
from quillspark.session import read, table

#: Shares of a page's words whose coverage rank is taken.
SHARES = (0.5, 0.7, 0.8, 0.9, 0.95)
#: A word is a name if at least this share of it is capitalised in texts of mixed case.
NAME_SHARE = 0.9
#: Labelled rows that are used to fit the calibration, the smallest keys first; a stated bound.
MOST_LABELS = 20_000
RIDGE = 0.3

WORD = r"[\p{L}]+(?:['’][\p{L}]+)?"
FEATURES = [*(f"cover_{int(100 * s)}" for s in SHARES), "sentence_mean", "sentence_max", "commas_a_sentence", "commas_a_word", "word_length"]


def _clean(text: Column) -> Column:
    t = F.regexp_replace(text, r"<[^<>]{0,40}>", " ")
    t = F.regexp_replace(t, r"&(?:nbsp|#160);", " ")
    t = F.regexp_replace(t, r"&(?:#39|apos|rsquo|lsquo);", "'")
    t = F.regexp_replace(t, r"&(?:quot|ldquo|rdquo|#34);", '"')
    return F.regexp_replace(F.regexp_replace(t, r"&(?:[A-Za-z]{2,8}|#\d{1,7});", " "), " ", " ")


def parsed(texts: DataFrame) -> DataFrame:
    """Every column of ``texts`` but t, and of the text t: its words, whether capitals tell names in it (mix), and FEATURES but coverage.

    A text without a word has sentences of length 1.  A text is read once and never leaves its row.
    """
    keep = [c for c in texts.columns if c != "t"]
    sentences = F.filter(F.transform(F.split("t", r"[.!?]+"), lambda s: F.regexp_count(s, F.lit(WORD))), lambda n: n > 0)
    letters, upper = F.regexp_count("t", F.lit(r"\p{L}")), F.regexp_count("t", F.lit(r"\p{Lu}"))
    t = texts.withColumn("t", _clean(F.col("t")))
    t = t.select(*keep, sentences.alias("s"), F.regexp_extract_all("t", F.lit(WORD), 0).alias("words"), letters.alias("letters"), upper.alias("upper"), F.regexp_count("t", F.lit(",")).alias("commas"), F.regexp_count("t", F.lit(";")).alias("semis"))
    total, many = F.size("words"), F.size("s")
    return t.select(
        *keep, "words", ((F.col("upper") > 0) & (F.col("upper") < 0.3 * F.col("letters"))).alias("mix"),
        F.log(F.greatest(F.lit(1.0), F.coalesce(F.try_divide(total, many), F.lit(1.0)))).alias("sentence_mean"), F.log(F.coalesce(F.array_max("s"), F.lit(1)).cast("double")).alias("sentence_max"),
        F.coalesce(F.try_divide("commas", many), F.lit(0.0)).alias("commas_a_sentence"), F.coalesce(F.try_divide(F.col("commas") + F.col("semis"), total), F.lit(0.0)).alias("commas_a_word"),
        F.coalesce(F.try_divide(F.length(F.array_join("words", "")), total), F.lit(0.0)).alias("word_length"),
    )


def word_counts(read_: DataFrame) -> DataFrame:
    """(w, n, mixed, caps): lower-case words of parsed texts; caps only of texts in mixed case. Counted before anything is shuffled."""
    one = F.when(F.col("mix"), 1).otherwise(0)
    w = read_.select("mix", F.explode("words").alias("raw"))
    return w.groupBy(F.lower("raw").alias("w")).agg(F.count("*").alias("n"), F.sum(one).alias("mixed"), F.sum(F.when(F.col("raw").rlike(r"^\p{Lu}"), one).otherwise(0)).alias("caps"))


def page_words(texts: DataFrame) -> DataFrame:
    """word_counts() of texts (m, t)."""
    return word_counts(parsed(texts))


IS_NAME = f"mixed > 0 and caps >= {NAME_SHARE} * mixed"


def vocabulary(words: DataFrame) -> DataFrame:
    """(w, rank): words by frequency over all texts, names left out; words as frequent share a rank.

    The rank is one more than the number of words that are more frequent.  It is a running sum over the
    table of frequencies (at most the square root of twice all words), in parts by powers of two.
    """
    kept = table(words.where(f"not ({IS_NAME})").select("w", "n"), "reading-words")
    counts = kept.groupBy("n").agg(F.count("*").alias("words")).withColumn("part", F.floor(F.log2("n")))
    # one row per power of two, so 64 at most
    parts = counts.groupBy("part").agg(F.sum("words").alias("of_part")).withColumn("above", F.coalesce(F.sum("of_part").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = F.sum("words").over(Window.partitionBy("part").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = table(counts.join(F.broadcast(parts), "part").select("n", (F.col("above") + F.coalesce(before, F.lit(0)) + 1).alias("rank")), "reading-frequencies")
    return lookup_join(kept, ranks, "n", F.col("w")).select("w", "rank")


def coverage(read_: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """(m, cover_...): for each share of a text's words the rank that covers it; texts without a word that counts have no row.

    ``places`` has (w, rank), rank 0 for names, and other words have rank ``most``.
    """
    words = read_.select("m", F.explode("words").alias("w")).withColumn("w", F.lower("w"))
    placed = lookup_join(words, places, "w", F.col("m"), how="left").select("m", F.coalesce("rank", F.lit(most)).alias("rank")).where("rank > 0")
    lists = placed.groupBy("m").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    return lists.select("m", *[F.element_at("r", F.ceil(F.size("r") * s).cast("int")).alias(c) for s, c in zip(SHARES, FEATURES)])


def features(read_: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """(m, FEATURES...) of parsed texts; a text without a word that counts has coverage rank 1."""
    cover = coverage(read_, places, most).select("m", *[F.log(c).alias(c) for c in FEATURES[: len(SHARES)]])
    return read_.drop("words", "mix").join(cover, "m", "left").select("m", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES])


def _terms(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, np.clip(x, -3, 3) ** 2])


def fit(x: np.ndarray, level: np.ndarray) -> dict:
    """For each level above the lowest, a ridge logistic model of 'this level or above'."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = _terms((x - mean) / sd)
    out = {"mean": mean.tolist(), "sd": sd.tolist(), "weights": {}}
    for k in sorted(set(level.tolist()))[1:]:
        y, w = (level >= k).astype(float), np.zeros(a.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w)), a.T @ (p - y) + RIDGE * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        out["weights"][int(k)] = w.tolist()
    return out


def level_columns(model: dict) -> tuple[Column, Column]:
    """The level (int) and the expected level (double) as SQL expressions over FEATURES."""
    z = [(F.col(c) - m) / s for c, m, s in zip(FEATURES, model["mean"], model["sd"])]
    z2 = [F.pow(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), v)), F.lit(2.0)) for v in z]
    lowest = min(model["weights"]) - 1
    level, score = F.lit(lowest), F.lit(float(lowest))
    for k, w in model["weights"].items():
        lin = F.lit(w[0])
        for weight, term in zip(w[1:], z + z2):
            lin = lin + weight * term
        # levels need not be neighbours; each step is taken where its own model says so
        level, score = level + F.when(lin >= 0, 1).otherwise(0), score + 1 / (1 + F.exp(-lin))
    return level.cast("int"), score


def _clean_texts(df: DataFrame, c: str, *more: Column) -> DataFrame:
    return df.select(F.unhex(F.md5(F.col(c))).alias("m"), F.col(c).cast("string").alias("t"), *more).where("t is not null and trim(regexp_replace(t, '[\\\\s\\u00a0]+', ' ')) <> ''")


def _texts(pages: DataFrame, text: str) -> DataFrame:
    return table(parsed(_clean_texts(pages, text).groupBy("m").agg(F.first("t").alias("t"))), "reading-texts")


def _places(texts: DataFrame) -> tuple[DataFrame, int]:
    """(w, rank) of all words, 0 for names, and the rank after the last."""
    words = table(word_counts(texts), "reading-counts")
    places = table(vocabulary(words).unionByName(words.where(IS_NAME).select("w", F.lit(0).cast("bigint").alias("rank"))), "reading-ranks")
    return places, places.agg(F.coalesce(F.max("rank"), F.lit(0)) + 1).collect()[0][0]


def levels(pages: DataFrame, labels: DataFrame, text: str = "text", label_text: str = "text", label: str = "level") -> DataFrame:
    """(m, level, score) for each different text of ``pages``; m is md5 of the text.

    Null and blank texts have no level.  Equal texts count once.  Needs at least two levels among
    the labelled rows; without any the result is empty.
    """
    return _levels(pages, labels, text, label_text, label).withColumn("m", F.lower(F.hex("m")))


def _levels(pages: DataFrame, labels: DataFrame, text: str = "text", label_text: str = "text", label: str = "level") -> DataFrame:
    """levels() with m as bytes."""
    texts = _texts(pages, text)
    known = labels.orderBy(F.md5(F.col(label_text))).limit(MOST_LABELS)
    known = table(parsed(_clean_texts(known, label_text, F.col(label).cast("int").alias("level")).where("level is not null").groupBy("m").agg(F.first("t").alias("t"), F.max("level").alias("level"))), "reading-labels")
    places, most = _places(texts)
    rows = features(known.drop("level"), places, most).join(known.select("m", "level"), "m").select(*FEATURES, "level").collect()
    data = np.array([list(r) for r in rows], dtype=float).reshape(-1, len(FEATURES) + 1)
    if len(set(data[:, -1].tolist())) < 2:
        return texts.select("m", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("score")).where("false")
    level, score = level_columns(fit(data[:, :-1], data[:, -1].astype(int)))
    return features(texts, places, most).select("m", level.alias("level"), score.alias("score"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = read(spark, sf_dir, "dataset")
    return data.where("id is not null").select("id", F.expr("stack(2, 'current', current_text, 'next', next_text) as (page, text)"))


def page_levels(spark: SparkSession, sf_dir: str, least: int | None = None) -> DataFrame:
    """(id, page, level, score) of every page text, or of those of level ``least`` or above."""
    pages = _pages(spark, sf_dir)
    got = _levels(pages, read(spark, sf_dir, "reading_labels"))
    got = table(got if least is None else got.where(F.col("level") >= least), "reading-levels")
    placed = lookup_join(pages.select("id", "page", F.unhex(F.md5("text")).alias("m")).where("m is not null"), got, "m", F.col("id"))
    return placed.groupBy("id", "page").agg(F.max("level").alias("level"), F.max("score").alias("score"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page text of level 4 or 5."""
    return page_levels(spark, sf_dir, 4).select("id", "page")


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by source and level."""
    got = page_levels(spark, sf_dir).select(F.split("id", "/")[0].alias("source"), "level")
    return got.groupBy("source", "level").agg(F.count("*").alias("pages"))


def p1_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the pages with its rank, 0 for names."""
    return _places(_texts(_pages(spark, sf_dir), "text"))[0]


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage ranks of each different page text."""
    texts = _texts(_pages(spark, sf_dir), "text")
    return coverage(texts, *_places(texts)).withColumn("m", F.lower(F.hex("m")))


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_vocabulary": p1_vocabulary, "p1_coverage": p1_coverage}
_SQL_CLEAN = "text"
for _pattern, _by in ((r"<[^<>]{0,40}>", " "), (r"&(?:nbsp|#160);", " "), (r"&(?:#39|apos|rsquo|lsquo);", "''"), (r"&(?:quot|ldquo|rdquo|#34);", '"'), (r"&(?:[A-Za-z]{2,8}|#\d{1,7});", " "), ("\u00a0", " ")):
    _SQL_CLEAN = f"regexp_replace({_SQL_CLEAN}, '{_pattern}', '{_by}', 'g')"
_SQL_WORDS = f"""t AS (SELECT DISTINCT text FROM (SELECT current_text AS text FROM dataset WHERE id IS NOT NULL UNION ALL SELECT next_text FROM dataset WHERE id IS NOT NULL) WHERE trim(regexp_replace(text, '[\\s\\x{{a0}}]+', ' ', 'g')) <> ''),
c AS (SELECT md5(text) AS m, {_SQL_CLEAN} AS t FROM t), l AS (SELECT m, t, len(regexp_extract_all(t, '\\p{{L}}')) AS l, len(regexp_extract_all(t, '\\p{{Lu}}')) AS u FROM c),
w AS (SELECT m, u > 0 AND u < 0.3 * l AS mix, unnest(regexp_extract_all(t, '[\\p{{L}}]+(?:[''’][\\p{{L}}]+)?')) AS raw FROM l),
g AS (SELECT lower(raw) AS w, count(*) AS n, sum(mix::INT) AS mixed, sum((mix AND regexp_matches(raw, '^\\p{{Lu}}'))::INT) AS caps FROM w GROUP BY 1),
v AS (SELECT w, rank() OVER (ORDER BY n DESC) AS rank FROM g WHERE NOT (mixed > 0 AND caps >= {NAME_SHARE} * mixed) UNION ALL SELECT w, 0 FROM g WHERE mixed > 0 AND caps >= {NAME_SHARE} * mixed)"""
_SQL_COVERS = ", ".join(f"r[ceil(len(r) * {s}::DOUBLE)::INT] AS {c}" for s, c in zip(SHARES, FEATURES))
ORACLE = {
    "p1_vocabulary": f"WITH {_SQL_WORDS} SELECT w, rank FROM v",
    "p1_coverage": f"WITH {_SQL_WORDS}, r AS (SELECT m, list(rank ORDER BY rank) AS r FROM w JOIN v ON v.w = lower(raw) WHERE rank > 0 GROUP BY m) SELECT m, {_SQL_COVERS} FROM r",
}
