"""Queries over judged records and speech attributes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import judgejson as J
from quillspark.operators import labels as L
from quillspark.operators import scores as S
from quillspark.plans.registry import registry
from quillspark.session import read

QUERIES, ORACLE, query = registry()


def results(spark, sf):
    """Judge results, each result_id once."""
    return read(spark, sf, "judge_results").where("result_id is not null").dropDuplicates(["result_id"])


def scored(spark, sf):
    """What scores need of the judge results: of the evaluations the scores, not the rationales."""
    schema = "result_id bigint, index bigint, modality string, stage int, judge string, judge_eval map<string, struct<score: int>>"
    return spark.read.schema(schema).parquet(f"{sf}/judge_results.parquet")


_R = "r AS (SELECT * FROM judge_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY received_at) = 1)"
_CATS = "c(modality, category) AS (VALUES " + ", ".join(f"('{m}', '{c}')" for m, cs in J.CATEGORIES.items() for c in cs) + ")"
_LONG = f"{_R}, {_CATS}, l AS (SELECT r.result_id, r.index, r.modality, r.stage, r.judge, r.source, c.category, CASE WHEN r.judge_eval[c.category].score BETWEEN 1 AND 10 THEN r.judge_eval[c.category].score END AS score FROM r JOIN c USING (modality))"


@query("zero_filled_mean", f"WITH {_LONG} SELECT modality, judge, category, round(avg(coalesce(score, 0)), 9) AS average, count(*) FILTER (score IS NULL) AS zero_filled_count, round(avg(score), 9) AS valid_average FROM l GROUP BY ALL")
def zero_filled_mean(spark, sf):
    g = S.long_scores(scored(spark, sf)).groupBy("modality", "judge", "category").agg(*S.zero_filled("score"))
    return g.select("modality", "judge", "category", F.round("average", 9).alias("average"), "zero_filled_count", F.round("valid_average", 9).alias("valid_average"))


@query("category_score_average", f"WITH {_LONG}, m AS (SELECT modality, stage, result_id, avg(coalesce(score, 0)) AS mean, bool_or(score IS NULL) AS lacks FROM l GROUP BY ALL) SELECT stage, modality, count(*) AS record_count, round(avg(mean), 9) AS average, count(*) FILTER (lacks) AS zero_filled_record_count FROM m GROUP BY ALL")
def category_score_average(spark, sf):
    return S.judge_average(S.long_scores(scored(spark, sf)), "stage", "modality").withColumn("average", F.round("average", 9))


@query("stage_table", f"WITH {_LONG}, m AS (SELECT modality, stage, result_id, avg(coalesce(score, 0)) AS mean FROM l GROUP BY ALL), a AS (SELECT stage, modality, avg(mean) AS average FROM m GROUP BY ALL) SELECT stage, " + ", ".join(f"round(max(average) FILTER (modality = '{m}'), 9) AS judge_{m}" for m in J.CATEGORIES) + " FROM a GROUP BY stage")
def stage_table(spark, sf):
    t = S.stage_table(S.long_scores(scored(spark, sf)))
    return t.select("stage", *[F.round(c, 9).alias(c) for c in t.columns[1:]])


@query("stage_table_aux", f"WITH {_R} SELECT DISTINCT stage, CASE WHEN stage = 1 THEN (SELECT round(avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0 END), 9) FROM documents) END AS aux FROM r")
def stage_table_aux(spark, sf):
    """A metric of the first stage only beside all stages."""
    v = read(spark, sf, "documents").agg(F.round(F.avg(F.when(F.col("n_chars") > 200, 1.0).otherwise(0.0)), 9)).first()[0]
    return S.with_aux(results(spark, sf).select("stage").distinct(), {"aux": v})


@query("repair_requests", f"WITH {_R} SELECT result_id, 2 AS n, contains(raw_response, 'score') AS has_score FROM r WHERE status = 'parse_error' AND raw_response IS NOT NULL AND final_parse_error IS NOT NULL")
def repair_requests(spark, sf):
    d = results(spark, sf).where("status = 'parse_error' and raw_response is not null and final_parse_error is not null")
    m = J.repair_request("raw_response", "final_parse_error", "modality")
    return d.select("result_id", "raw_response", m.alias("m")).select("result_id", F.size("m").alias("n"), F.contains(F.substring_index(F.get("m", F.lit(1))["content"], "Response: ", -1), F.lit("score")).alias("has_score"))


@query("stage_table_text", f"WITH {_LONG}, m AS (SELECT modality, stage, result_id, avg(coalesce(score, 0)) AS mean FROM l GROUP BY ALL), a AS (SELECT stage, modality, avg(mean) AS average FROM m GROUP BY ALL), t AS (SELECT stage, " + ", ".join(f"coalesce(printf('%.3f', max(average) FILTER (modality = '{m}')), '') AS c_{m}" for m in J.CATEGORIES) + " FROM a GROUP BY stage) SELECT '| ' || stage || ' | ' || c_text || ' | ' || c_image || ' | ' || c_speech || ' | ' || c_joint || ' |' AS line FROM t")
def stage_table_text(spark, sf):
    t = S.stage_table(S.long_scores(scored(spark, sf)))
    return t.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col("stage").cast("string"), *[S.formatted(c, 3) for c in t.columns[1:]]), F.lit(" |")).alias("line"))


@query("status_histogram", f"WITH {_R} SELECT coalesce(source, 'unknown') AS source, coalesce(parse_status, 'unknown') AS parse_status, count(*) AS n FROM r GROUP BY ALL")
def status_histogram(spark, sf):
    d = results(spark, sf).withColumn("source", F.coalesce("source", F.lit("unknown")))
    return S.histogram(d, "parse_status", "source")


@query("attempts_summary", f"WITH {_R}, p AS (SELECT index, modality, count(*) AS attempts, bool_or(status = 'ok') AS ok FROM r GROUP BY ALL) SELECT count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (ok AND attempts = 1) AS first_try, round(avg(attempts), 9) AS mean_attempts, max(attempts) AS max_attempts FROM p")
def attempts_summary(spark, sf):
    return S.attempts(results(spark, sf), "index", "modality", ok=F.col("status") == "ok").withColumn("mean_attempts", F.round("mean_attempts", 9))


@query("quality_gate", f"WITH {_R}, g AS (SELECT modality, judge, count(*) AS eligible, count(*) FILTER (inference_status = 'runtime_error') AS runtime_errors, count(*) FILTER (inference_status = 'ok' AND status = 'parse_error') AS unresolved FROM r WHERE coalesce(inference_status NOT IN ('skipped', 'dry_run_ok', 'dry_run_missing'), true) GROUP BY ALL) SELECT modality, judge, eligible, runtime_errors, unresolved, runtime_errors / eligible AS runtime_rate, unresolved / eligible AS parse_rate, (runtime_errors + unresolved) / eligible AS unresolved_rate, runtime_errors / eligible < 0.01 AS rate_gate, runtime_errors + unresolved = 0 AS zero_gate, runtime_errors / eligible < 0.01 AS passed FROM g")
def quality_gate(spark, sf):
    return S.quality_gate(results(spark, sf), "modality", "judge", max_rate=0.01)


@query("judge_response_parse")
def judge_response_parse(spark, sf):
    """Every raw response read again by the tolerant reader."""
    d = results(spark, sf).select("result_id", "modality", J.parse_column("raw_response", "modality").alias("p"))
    return d.select("result_id", "modality", "p.*")


@query("judge_parse_summary")
def judge_parse_summary(spark, sf):
    d = results(spark, sf).select("modality", "parse_status", J.parse_column("raw_response", "modality").alias("p"))
    return d.groupBy("modality", F.col("parse_status").alias("recorded"), F.col("p.parse_status").alias("parsed")).agg(F.count("*").alias("n"))


@query("repair_states")
def repair_states(spark, sf):
    """Unresolved records after a repair: here the responses themselves with what is missing at the end."""
    d = results(spark, sf).select("result_id", "modality", J.parse_column("raw_response", "modality").alias("record"), F.when(F.col("result_id") % 5 == 0, F.lit('{"unrecoverable": true}')).otherwise(F.concat("raw_response", F.lit('"}}'))).alias("repair"))
    return d.select("result_id", J.repair_column(F.col("record"), F.col("repair"), "modality").alias("r")).select("result_id", "r.status", "r.parse_status", "r.repair_status", "r.parse_method")


@query("props_json_parse", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json_parse(spark, sf):
    return read(spark, sf, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')").alias("k"))


def _attributes(spark, sf):
    """Each index's first speaker row by id as candidate (null where typed off-list), the dataset row as truth."""
    m = read(spark, sf, "speaker_metadata").where("speaker_id is not null and index is not null")
    first = m.groupBy("index").agg(F.min_by(F.struct(*L.FIELDS), F.struct("speaker_id", "received_at")).alias("candidate"))
    d = read(spark, sf, "dataset").where("index is not null and id is not null").groupBy("index", "id").agg(F.min(F.struct(*[F.col(f"speech_{f}").alias(f) for f in L.FIELDS])).alias("truth"))
    return d.join(first, "index", "left").withColumn("present", F.col("candidate").isNotNull())


_ATTR = "c AS (SELECT index, emotion, speed, pitch, gender FROM speaker_metadata WHERE speaker_id IS NOT NULL AND index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index ORDER BY speaker_id, received_at) = 1), t AS (SELECT DISTINCT index, id, speech_emotion, speech_speed, speech_pitch, speech_gender FROM dataset WHERE index IS NOT NULL AND id IS NOT NULL)"
_N = lambda c: f"coalesce(lower(regexp_replace({c}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), '')"
_M = ", ".join(f"c.index IS NOT NULL AND {_N('c.' + f)} = {_N('t.speech_' + f)} AS {f}" for f in L.FIELDS)


@query("attribute_accuracy", f"WITH {_ATTR}, m AS (SELECT t.index, {_M} FROM t LEFT JOIN c ON c.index = t.index), n AS (SELECT count(DISTINCT index) AS n FROM dataset) SELECT " + ", ".join(f"round(count(*) FILTER ({f}) / max(n), 9) AS {f}_accuracy" for f in L.FIELDS) + ", round(sum((emotion::INT + speed::INT + pitch::INT + gender::INT) / 4) / max(n), 9) AS item_accuracy, round(count(*) FILTER (emotion AND speed AND pitch AND gender) / max(n), 9) AS exact_accuracy, count(*) AS written FROM m, n")
def attribute_accuracy(spark, sf):
    d = _attributes(spark, sf)
    expected = read(spark, sf, "dataset").agg(F.count_distinct("index").alias("expected"))
    m = d.select("index", *L.matches("candidate", "truth", F.col("present"))).crossJoin(F.broadcast(expected))  # one row
    got = L.accuracy(m, F.max("expected"))
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns[:-1]], "written")


@query("class_frequency", f"WITH {_ATTR}, j AS (SELECT c.index IS NOT NULL AS present, " + ", ".join(f"{_N('c.' + f)} AS c_{f}, {_N('t.speech_' + f)} AS t_{f}" for f in L.FIELDS) + " FROM t LEFT JOIN c ON c.index = t.index), u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, 'candidate' AS side, CASE WHEN present THEN c_{f} END AS label FROM j UNION ALL SELECT '{f}', 'ground_truth', t_{f} FROM j UNION ALL SELECT '{f}', 'correct_candidate', CASE WHEN present AND c_{f} = t_{f} THEN c_{f} END FROM j" for f in L.FIELDS) + ") SELECT field, side, label, count(*) AS n FROM u WHERE label <> '' GROUP BY ALL")
def class_frequency(spark, sf):
    return L.frequencies(_attributes(spark, sf), "candidate", "truth", F.col("present"))


@query("conditional_bins", "SELECT l_returnflag, speed, pitch, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_quantity / 10 < 2.6 THEN 'slow' WHEN l_quantity / 10 > 4.7 THEN 'fast' ELSE 'normal' END AS speed, CASE WHEN h < lo THEN 'low' WHEN h > hi THEN 'high' ELSE 'normal' END AS pitch FROM (SELECT *, l_extendedprice / 100 AS h, CASE l_returnflag WHEN 'A' THEN 110 WHEN 'R' THEN 165 ELSE 145 END AS lo, CASE l_returnflag WHEN 'A' THEN 170 WHEN 'R' THEN 255 ELSE 220 END AS hi FROM lineitem)) GROUP BY ALL")
def conditional_bins(spark, sf):
    gender = F.when(F.col("l_returnflag") == "A", "Man").when(F.col("l_returnflag") == "R", " F ").otherwise("child")
    d = read(spark, sf, "lineitem").select("l_returnflag", L.speed_class(F.col("l_quantity") / 10).alias("speed"), L.pitch_class(F.col("l_extendedprice") / 100, gender).alias("pitch"))
    return d.groupBy("l_returnflag", "speed", "pitch").agg(F.count("*").alias("n"))


@query("pitch_summary", "SELECT user_id, CASE WHEN count(value) >= 5 THEN round(quantile_cont(value, 0.5), 6) END AS median_f0, CASE WHEN count(value) >= 5 THEN round(avg(value), 6) END AS mean_f0, CASE WHEN count(value) >= 5 THEN round(count(value) / count(*), 6) ELSE 0 END AS voiced_ratio FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events) GROUP BY user_id")
def pitch_summary(spark, sf):
    d = read(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("f0"))
    g = d.groupBy("user_id").agg(*L.pitch_summary("f0"))
    return g.select("user_id", *[F.round(c, 6).alias(c) for c in g.columns[1:]])


@query("speech_rates", "WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value AS stop FROM events WHERE value > 0 AND event_type <> 'error'), g AS (SELECT user_id, count(*) AS n, max(stop) - min(start) AS span FROM s GROUP BY user_id), a AS (SELECT user_id, count(*) AS words FROM events GROUP BY user_id) SELECT a.user_id, round(coalesce(n / greatest(span, 1e-6), words / 100.0), 6) AS rate FROM a LEFT JOIN g USING (user_id)")
def speech_rates(spark, sf):
    d = read(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    chunk = F.struct(at.alias("start"), (at + F.col("value")).alias("end"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("text"))
    g = d.groupBy("user_id").agg(F.collect_list(chunk).alias("chunks"), F.count("*").alias("words"))
    return g.select("user_id", F.round(L.speech_rate(F.col("chunks"), F.col("words"), F.lit(100.0)), 6).alias("rate"))


@query("aux_metric_summary", "SELECT source, round(sum(coalesce(v, 0)) / count(*), 9) AS average, count(v) AS valid, count(*) FILTER (v IS NULL) AS zero_filled FROM (SELECT source, CASE WHEN n_chars > 200 THEN n_chars / 1000.0 END AS v FROM documents) GROUP BY source")
def aux_metric_summary(spark, sf):
    v = F.when(F.col("n_chars") > 200, F.col("n_chars") / 1000.0)
    return read(spark, sf, "documents").groupBy("source").agg(F.round(F.sum(F.coalesce(v, F.lit(0.0))) / F.count("*"), 9).alias("average"), F.count(v).alias("valid"), F.count_if(v.isNull()).alias("zero_filled"))


@query("safe_mean", "SELECT event_type, round(avg(v) FILTER (isfinite(v)), 9) AS mean FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM events) GROUP BY event_type")
def safe_mean(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(S.finite(v)), 9).alias("mean"))


@query("best_attempt", f"WITH {_R} SELECT index, modality, result_id, status FROM r WHERE index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index, modality ORDER BY (status = 'ok') DESC, CASE parse_status WHEN 'direct' THEN 2 WHEN 'normalized' THEN 1 ELSE 0 END DESC, result_id) = 1")
def best_attempt(spark, sf):
    """The first good result, or else the one that came furthest; the earliest of equals."""
    rank = F.when(F.col("parse_status") == "direct", 2).when(F.col("parse_status") == "normalized", 1).otherwise(0)
    best = F.struct((F.coalesce(F.col("status") == "ok", F.lit(False))).cast("int"), rank, -F.col("result_id"))
    # an aggregate keeps one row a group on the way; a window would sort each group
    g = results(spark, sf).where("index is not null").groupBy("index", "modality").agg(F.max_by(F.struct("result_id", "status"), best).alias("b"))
    return g.select("index", "modality", "b.*")


@query("modality_failures", f"WITH {_R} SELECT modality, affected, count(*) AS n FROM (SELECT modality, unnest(CASE modality WHEN 'joint' THEN ['text', 'image', 'speech'] ELSE [modality] END) AS affected FROM r WHERE status <> 'ok') GROUP BY ALL")
def modality_failures(spark, sf):
    """Failed records against every modality they touch; those of no single one touch all three."""
    touched = F.when(F.col("modality") == "joint", F.array(F.lit("text"), F.lit("image"), F.lit("speech"))).otherwise(F.array("modality"))
    return results(spark, sf).where("status <> 'ok'").select("modality", F.explode(touched).alias("affected")).groupBy("modality", "affected").agg(F.count("*").alias("n"))


@query("wide_completeness", f"WITH {_R} SELECT index, list_sort(list_filter(['text', 'image', 'speech'], lambda x: NOT list_contains(coalesce(list(DISTINCT modality) FILTER (status = 'ok'), []), x))) AS missing FROM r WHERE index IS NOT NULL GROUP BY index")
def wide_completeness(spark, sf):
    """Which of the three modalities an index lacks a good result of."""
    d = results(spark, sf).where("index is not null")
    have = F.collect_set(F.when(F.col("status") == "ok", F.col("modality")))
    return d.groupBy("index").agg(have.alias("have")).select("index", F.sort_array(F.array_except(F.array(F.lit("text"), F.lit("image"), F.lit("speech")), "have")).alias("missing"))


@query("adapter_lookup", f"WITH {_R} SELECT r.result_id, j.family, j.stage AS judge_stage FROM r LEFT JOIN judges j ON lower(j.judge) = lower(upper(r.judge))")
def adapter_lookup(spark, sf):
    """Judges by their case-folded name; the registry is small and its size is known."""
    reg = read(spark, sf, "judges").select(F.lower("judge").alias("k"), "family", F.col("stage").alias("judge_stage"))
    return results(spark, sf).select("result_id", F.lower(F.upper("judge")).alias("k")).join(F.broadcast(reg), "k", "left").drop("k")


@query("last_status_window", f"WITH {_R} SELECT index, result_id, lag(status) OVER (PARTITION BY index, modality ORDER BY finished_at, result_id) AS before FROM r")
def last_status_window(spark, sf):
    w = Window.partitionBy("index", "modality").orderBy("finished_at", "result_id")
    return results(spark, sf).select("index", "result_id", F.lag("status").over(w).alias("before"))
