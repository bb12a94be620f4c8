"""Queries over sequences, probabilities and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.tokencount import token_counts
from quillspark.operators import probability as P
from quillspark.operators import sequence as Q
from quillspark.operators import vectors as V
from quillspark.plans.registry import registry
from quillspark.session import read

QUERIES, ORACLE, query = registry()
_EMO = ["neutral", "happy", "sad", "angry"]


def _vec(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


@query("event_runs", "WITH o AS (SELECT user_id, event_type, row_number() OVER w AS p, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum((p = 1 OR event_type IS DISTINCT FROM b)::INT) OVER (PARTITION BY user_id ORDER BY p) AS run FROM o) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(p) AS start, max(p) AS \"end\", count(*) AS n FROM r GROUP BY user_id, run")
def event_runs(spark, sf):
    return Q.runs(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("run_length_tokens", "WITH o AS (SELECT l_orderkey, l_returnflag, row_number() OVER w AS p, lag(l_returnflag) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT l_orderkey, coalesce(list(l_returnflag ORDER BY p) FILTER ((p = 1 OR l_returnflag <> b) AND l_returnflag <> 'N'), []) AS tokens FROM o GROUP BY l_orderkey")
def run_length_tokens(spark, sf):
    d = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda s: s["l_returnflag"]).alias("t"))
    return d.select("l_orderkey", Q.run_length(F.col("t"), F.lit("N")).alias("tokens"))


@query("sliding_windows", "WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, len(range(0, len(v) - 16 + 1, 8)) AS windows, round(list_sum(v[(len(range(0, len(v) - 16 + 1, 8)) - 1) * 8 + 1 : (len(range(0, len(v) - 16 + 1, 8)) - 1) * 8 + 16]), 6) AS last_sum FROM d")
def sliding_windows(spark, sf):
    d = _vec(spark, sf).select("vec_id", Q.sliding(F.col("v"), 16, 8).alias("w"))
    return d.select("vec_id", F.size("w").alias("windows"), F.round(F.aggregate(F.element_at("w", -1), F.lit(0.0), lambda a, x: a + x), 6).alias("last_sum"))


@query("fixed_segments", "WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, least(ceil(len(v) / 20.0), 3)::INT AS segments, round(list_sum(v[41:60]), 6) AS third_sum FROM d")
def fixed_segments(spark, sf):
    d = _vec(spark, sf).select("vec_id", Q.segments(F.col("v"), 20, 3).alias("w"))
    return d.select("vec_id", F.size("w").alias("segments"), F.round(F.aggregate(F.get("w", F.lit(2)), F.lit(0.0), lambda a, x: a + x), 6).alias("third_sum"))


@query("sliding_window_counts", "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 90 MINUTE]) AS w, event_type FROM events) GROUP BY ALL")
def sliding_window_counts(spark, sf):
    return read(spark, sf, "events").groupBy(F.window("ts", "3 hours", "90 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@query("pack_documents", "WITH RECURSIVE o AS (SELECT lang_, doc_id, n_chars AS n, row_number() OVER (PARTITION BY lang_ ORDER BY doc_id) AS p FROM (SELECT coalesce(lang, '?') AS lang_, * FROM documents) WHERE n_chars <= 4096), k AS (SELECT lang_, doc_id, n, p, 0::BIGINT AS pack, 0::BIGINT AS fill FROM o WHERE p = 1 UNION ALL SELECT o.lang_, o.doc_id, o.n, o.p, CASE WHEN k.fill + k.n + o.n > 4096 THEN k.pack + 1 ELSE k.pack END, CASE WHEN k.fill + k.n + o.n > 4096 THEN 0 ELSE k.fill + k.n END FROM k JOIN o ON o.lang_ = k.lang_ AND o.p = k.p + 1) SELECT lang_ AS lang, doc_id, n AS n_chars, pack, fill AS \"at\" FROM k QUALIFY pack < max(pack) OVER (PARTITION BY lang_)")
def pack_documents(spark, sf):
    d = read(spark, sf, "documents").withColumn("lang", F.coalesce("lang", F.lit("?")))
    return Q.pack(d, ["lang"], ["doc_id"], "doc_id", "n_chars", 4096)


@query("pack_tokens")
def pack_tokens(spark, sf):
    """Documents packed by their token counts, the unfinished sequences too."""
    d = token_counts(read(spark, sf, "documents").withColumn("lang", F.coalesce("lang", F.lit("?"))), ["lang", "doc_id"], "text")
    return Q.pack(d, ["lang"], ["doc_id"], "doc_id", "tokens", 2048, emit_tail=True)


@query("finished_packs", "WITH d AS (SELECT o_custkey, list(o_orderkey::BIGINT ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, (t[:-2] || [0 for x in range(24)])[1:16] AS tokens, ((t || [t[1]])[2:len(t)] || [-100 for x in range(24)])[1:16] AS labels, [0, 16] AS cu_seq_lens, list_sum([CASE WHEN x = -100 THEN 0 ELSE 1 END for x in ((t || [t[1]])[2:len(t)] || [-100 for x in range(24)])[1:16]])::INT AS loss FROM d WHERE len(t) >= 2")
def finished_packs(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))).alias("t")).where("size(t) >= 2")
    f = d.select("o_custkey", Q.finished(F.col("t"), F.col("t"), F.array(F.size("t")), 16, 0, -100).alias("f"))
    return f.select("o_custkey", "f.tokens", "f.labels", "f.cu_seq_lens", F.aggregate("f.loss_mask", F.lit(0.0), lambda a, x: a + x).cast("int").alias("loss"))


@query("fixed_length_tokens", "WITH d AS (SELECT o_custkey, list(o_orderkey::BIGINT ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, (t || [7 for x in range(8)])[1:8] AS tokens, list_position(t, t[2]) AS first_eos FROM d")
def fixed_length_tokens(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))).alias("t"))
    return d.select("o_custkey", Q.fixed(F.col("t"), 8, 7).alias("tokens"), F.when(F.size("t") > 1, F.array_position("t", F.get("t", F.lit(1)))).alias("first_eos"))


@query("decoded_codes", "WITH d AS (SELECT o_custkey, list(o_orderkey::BIGINT % 50 ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey), e AS (SELECT o_custkey, list_transform(list_filter(CASE WHEN list_position(t, 3) > 0 THEN t[1 : list_position(t, 3) - 1] ELSE t END, lambda x: x >= 10 AND x < 40), lambda x: x - 10) AS c FROM d) SELECT o_custkey, CASE WHEN len(c) >= 2 THEN c END AS codes FROM e")
def decoded_codes(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))), lambda x: x % 50).alias("t"))
    return d.select("o_custkey", Q.decoded(F.col("t"), 3, 10, 30, 2).alias("codes"))


@query("tag_expansion", "WITH d AS (SELECT o_custkey, list(o_orderkey::BIGINT % 5 ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, flatten(list_transform(t, lambda x: CASE WHEN x = 2 THEN [100, 101, 101, 101, 102] ELSE [x] END)) AS tokens, len(list_filter(t, lambda x: x = 2)) AS tags FROM d")
def tag_expansion(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))), lambda x: x % 5).alias("t"))
    e = d.select("o_custkey", Q.expanded(F.col("t"), 2, 100, 101, 102, 3).alias("e"))
    return e.select("o_custkey", "e.tokens", F.size("e.offsets").alias("tags"))


@query("segment_spans", "SELECT o_orderkey, n AS prompt_end, n + m AS total FROM (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'N')::INT AS n, count(*) FILTER (l_returnflag <> 'N')::INT AS m FROM lineitem GROUP BY l_orderkey)")
def segment_spans(spark, sf):
    d = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("b"))
    s = Q.spans(F.array(F.struct(F.lit("prompt").alias("name"), F.col("a").alias("tokens")), F.struct(F.lit("answer").alias("name"), F.col("b").alias("tokens"))))
    return d.select("o_orderkey", s.alias("s")).select("o_orderkey", F.get("s.spans", F.lit(0))["end"].alias("prompt_end"), F.size("s.tokens").alias("total"))


@query("eos_and_masks")
def eos_and_masks(spark, sf):
    """Seeded: end marks appended and places masked; the same in every run."""
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))).alias("t"))
    u = F.pmod(F.xxhash64("o_custkey"), F.lit(1000)) / 1000.0
    return d.select("o_custkey", Q.eos_filled(F.col("t"), -1, u).alias("with_eos"), Q.masked(F.col("t"), F.col("o_custkey"), -2, 0.1, 0.5).alias("masked"))


@query("chunks", "SELECT o_custkey, o_orderkey, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4)::BIGINT AS chunk FROM orders")
def chunks(spark, sf):
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", Q.chunk_number(["o_orderkey"], 4, ["o_custkey"]).alias("chunk"))


@query("list_chunks", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS chunk FROM documents")
def list_chunks(spark, sf):
    return Q.chunked(read(spark, sf, "documents").select("doc_id"), ["doc_id"], 16)


@query("resume_skip", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 3")
def resume_skip(spark, sf):
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", (Q.chunk_number(["o_orderkey"], 1, ["o_custkey"]) + 1).alias("n")).where("n > 3").drop("n")


@query("mix_sources", "SELECT source, count(*) AS n, count(DISTINCT k) AS different FROM (SELECT 0 AS source, p_partkey AS k FROM part, range(2) UNION ALL SELECT 0, p FROM (SELECT p_partkey AS p FROM part ORDER BY 1 LIMIT (SELECT (count(*) * 2.5)::INT - 2 * count(*) FROM part)) UNION ALL SELECT 1, s FROM (SELECT s_suppkey AS s FROM supplier LIMIT 30)) GROUP BY source")
def mix_sources(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    supp = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    m = Q.shuffled_mix([(part, 2.5, 10**9), (supp, 0, 5), (supp, 1.0, 30)], "k", 42)
    return m.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("k").alias("different"))


@query("prob_normalize_argmax", "WITH p AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: greatest(x::DOUBLE, 0)) AS p FROM embeddings) SELECT vec_id, list_transform(CASE WHEN list_sum(p) > 0 THEN list_transform(p, lambda x: x / list_sum(p)) ELSE [0.25::DOUBLE, 0.25, 0.25, 0.25] END, lambda x: round(x, 6)) AS p, ['neutral', 'happy', 'sad', 'angry'][list_position(p, list_max(p))] AS label FROM p")
def prob_normalize_argmax(spark, sf):
    d = _vec(spark, sf).select("vec_id", P.normalized(F.slice("v", 1, 4)).alias("p"))
    return d.select("vec_id", F.transform("p", lambda x: F.round(x, 6)).alias("p"), P.argmax(F.col("p"), _EMO).alias("label"))


@query("ensemble_average", "WITH l AS (SELECT label, i AS place, vec_id % 3 + 1 AS w, greatest(embedding[i]::DOUBLE, 0) AS p FROM embeddings, range(1, 5) t(i)), a AS (SELECT label, place, sum(p * w) / sum(w) AS v FROM l GROUP BY ALL) SELECT label, place::INT AS place, round(v / sum(v) OVER (PARTITION BY label), 6) AS p FROM a")
def ensemble_average(spark, sf):
    d = _vec(spark, sf).select("label", (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode(F.slice("v", 1, 4)).alias("place", "p")).withColumn("p", F.greatest("p", F.lit(0.0))).withColumn("place", F.col("place") + 1)
    return P.weighted_average(d, ["label"], "place", "p", "w").select("label", "place", F.round("p", 6).alias("p"))


@query("top_k", "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 1)) AS v FROM embeddings) SELECT vec_id, len(list_filter(v, lambda x: x >= list_reverse_sort(v)[5]))::INT AS kept FROM d")
def top_k(spark, sf):
    d = _vec(spark, sf).select("vec_id", P.top_k(F.transform("v", lambda x: F.round(x, 1)), 5).alias("k"))
    return d.select("vec_id", F.size(F.filter("k", lambda x: x)).alias("kept"))


@query("top_p", "WITH l AS (SELECT vec_id, i, exp(embedding[i]::DOUBLE) AS e FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding)), p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM l), c AS (SELECT vec_id, i, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS UNBOUNDED PRECEDING) AS c FROM p) SELECT vec_id, count(*)::INT AS kept, min(i)::INT AS first_place FROM c WHERE c - p <= 0.5 GROUP BY vec_id")
def top_p(spark, sf):
    d = P.top_p(_vec(spark, sf).select("vec_id", "v"), "vec_id", "v", 0.5)
    return d.groupBy("vec_id").agg(F.count("*").cast("int").alias("kept"), (F.min("place") + 1).alias("first_place"))


@query("confidence", "WITH l AS (SELECT vec_id, i, exp(embedding[i]::DOUBLE) AS e FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding)), p AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM l), o AS (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC) AS r FROM p) SELECT vec_id, round(max(p), 6) AS top1, round(max(p) - max(p) FILTER (r = 2), 6) AS margin, round(sum(p * ln(p + 1e-10)), 6) AS neg_entropy FROM o GROUP BY vec_id")
def confidence(spark, sf):
    d = P.confidence(_vec(spark, sf).select("vec_id", "v"), "vec_id", "v")
    return d.select("vec_id", *[F.round(x, 6).alias(x) for x in ("top1", "margin", "neg_entropy")])


@query("commit_step", "WITH o AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem WHERE l_returnflag <> 'A') SELECT l_orderkey, l_linenumber FROM o WHERE r <= ceil(n / 3.0)")
def commit_step(spark, sf):
    d = read(spark, sf, "lineitem").withColumn("done", F.col("l_returnflag") == "A")
    return P.commit_step(d, ["l_orderkey"], "l_linenumber", "l_extendedprice", "done", 1, 4).select("l_orderkey", "l_linenumber")


@query("best_resolution", "WITH o(n, w, h) AS (VALUES (0, 336, 672), (1, 672, 336), (2, 672, 672), (3, 1008, 336)), d AS (SELECT p_partkey, p_size * 20 AS ow, p_partkey % 89 * 10 + 50 AS oh FROM part), e AS (SELECT p_partkey, n, w, h, least(floor(ow * least(w / ow, h / oh)) * floor(oh * least(w / ow, h / oh)), ow * oh) AS eff FROM d, o) SELECT p_partkey, w AS width, h AS height FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY eff DESC, w * h - eff, n) = 1")
def best_resolution(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", P.best_resolution((F.col("p_size") * 20).cast("double"), (F.col("p_partkey") % 89 * 10 + 50).cast("double"), [(336, 672), (672, 336), (672, 672), (1008, 336)]).alias("b"))
    return d.select("p_partkey", "b.width", "b.height")


@query("cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    d = _vec(spark, sf)
    b = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return d.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 4).alias("cosine"))


@query("cosine_neighbors", "SELECT a.vec_id AS query, b.vec_id AS key, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) <= 10")
def cosine_neighbors(spark, sf):
    """Every row whose id is divisible by 100, against all rows."""
    d = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return V.nearest(d, d.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "key", F.round("cosine", 4).alias("cosine"))


@query("greedy_match_f1", "WITH e AS (SELECT (vec_id // 8)::BIGINT AS g, vec_id % 2 AS s, vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT x.g, x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS c FROM e x JOIN e y ON x.g = y.g AND x.s = 0 AND y.s = 1), p AS (SELECT g, avg(c) AS p FROM (SELECT g, a, max(c) AS c FROM m GROUP BY ALL) GROUP BY g), r AS (SELECT g, avg(c) AS r FROM (SELECT g, b, max(c) AS c FROM m GROUP BY ALL) GROUP BY g) SELECT g, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM p JOIN r USING (g)")
def greedy_match_f1(spark, sf):
    """Best-match precision, recall and F1 between the vectors of neighbouring labels."""
    d = read(spark, sf, "embeddings").select((F.floor(F.col("vec_id") / 8)).alias("g"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "vec_id")
    g = d.groupBy("g").agg(F.collect_list(F.when(F.col("vec_id") % 2 == 0, F.col("v"))).alias("a"), F.collect_list(F.when(F.col("vec_id") % 2 == 1, F.col("v"))).alias("b")).where("size(a) > 0 and size(b) > 0")
    return g.select("g", V.greedy_match(F.col("a"), F.col("b")).alias("m")).select("g", *[F.round(f"m.{x}", 6).alias(x) for x in ("precision", "recall", "f1")])
