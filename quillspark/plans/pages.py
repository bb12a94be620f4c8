"""Queries over canonical records, generated answers and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import generation as G
from quillspark.functions import text as T
from quillspark.operators import audio as A
from quillspark.operators import labels as L
from quillspark.operators import pages as O
from quillspark.operators import probability as P
from quillspark.operators import prompts as R
from quillspark.plans.registry import registry
from quillspark.session import read

QUERIES, ORACLE, query = registry()


def _index(spark, sf):
    return read(spark, sf, "dataset").where("id is not null").dropDuplicates(["id"])


@query("canonical_records")
def canonical_records(spark, sf):
    return O.canonical(_index(spark, sf), "/data")


@query("public_views")
def public_views(spark, sf):
    return O.public_view(_index(spark, sf))


@query("view_equality", "SELECT DISTINCT id, id LIKE '%a%' AS has_sample, id LIKE '%a%' AS equal FROM dataset WHERE id IS NOT NULL")
def view_equality(spark, sf):
    """Views against samples written from them; some ids have none."""
    v = O.public_view(_index(spark, sf))
    s = v.select("id", F.to_json(F.struct(*v.columns)).alias("body")).where("id like '%a%'")
    return O.disagreements(v, s)


@query("record_identity", "SELECT index AS dataset_index, coalesce(id, 'unknown') AS id, coalesce(source, 'unknown') AS source, coalesce(book, 'unknown') AS book FROM judge_results")
def record_identity(spark, sf):
    return O.public(O.identity(read(spark, sf, "judge_results")).withColumn("_internal", F.lit(1)))


@query("media_presence", "SELECT doc_id, lang IS NOT NULL AS one, lang IS NOT NULL AND source IS NOT NULL AND written_at IS NOT NULL AS all_three, text IS NOT NULL AND length(text) > 500 AS long FROM documents")
def media_presence(spark, sf):
    """Lists of one and three media, and one that is empty for short texts."""
    three = F.array("lang", "source", F.col("written_at").cast("string"))
    some = F.when(F.length("text") > 500, F.array("text")).otherwise(F.array().cast("array<string>"))
    return read(spark, sf, "documents").select("doc_id", O.present(F.array("lang")).alias("one"), O.present(three).alias("all_three"), O.present(some).alias("long"))


@query("media_prefixes", "SELECT doc_id, CASE source WHEN 'judge-notes' THEN '/n/' WHEN 'long-tales' THEN '/t/' ELSE '' END || kind AS first FROM documents")
def media_prefixes(spark, sf):
    pre = spark.createDataFrame([("judge-notes", "/n/"), ("long-tales", "/t/")], "source string, prefix string")
    d = read(spark, sf, "documents").select("doc_id", "source", F.array("kind").alias("images"))
    return O.prefixed(d, ["images"], pre).select("doc_id", F.get("images", F.lit(0)).alias("first"))


@query("http_urls", "SELECT DISTINCT id, 'http://h/x/' || replace(url_encode(sample_path), '%2F', '/') AS url FROM dataset WHERE id IS NOT NULL AND sample_path IS NOT NULL")
def http_urls(spark, sf):
    return _index(spark, sf).where("sample_path is not null").select("id", O.http_url(F.lit("http://h/x//"), "sample_path").alias("url"))


@query("unwrapped_metadata", "WITH s AS (SELECT sample_path, arg_max(body, written_at) AS body FROM sample_files GROUP BY sample_path) SELECT sample_path, CASE WHEN json_valid(body) THEN coalesce(body->'$.metadata.metadata', body->'$.metadata')->>'topic' END AS topic FROM s")
def unwrapped_metadata(spark, sf):
    """The topic of each sample, in however many wrappers."""
    v = F.try_parse_json("body")
    d = read(spark, sf, "sample_files").groupBy("sample_path").agg(F.max_by("body", "written_at").alias("body"))
    return d.select("sample_path", F.try_variant_get(O.unwrapped(F.try_variant_get(v, "$.metadata", "variant"), "metadata"), "$.topic", "string").alias("topic"))


@query("true_attributes", """WITH s AS (SELECT sample_path, arg_max(body, written_at) AS body FROM sample_files GROUP BY sample_path),
p AS (SELECT sample_path, CASE WHEN json_valid(body) THEN body->'$.speech_metadata_next_page.parsed' END AS p FROM s),
k AS (SELECT sample_path, p, unnest(CASE WHEN json_type(p) = 'OBJECT' THEN json_keys(p) ELSE [] END) AS key FROM p),
e AS (SELECT sample_path, coalesce(try_cast(nullif(regexp_extract(key, '_([0-9]+)$', 1), '') AS INT), -1) AS n, json_extract(p, '$."' || key || '"') AS v FROM k WHERE regexp_matches(key, '^speaker(_[0-9]+)?$')),
b AS (SELECT *, row_number() OVER (PARTITION BY sample_path ORDER BY coalesce(trim(v->>'$.line'), '') = '', n) AS r FROM e WHERE json_type(v) = 'OBJECT')
SELECT s.sample_path, v->>'$.name' AS name, v->>'$.line' AS line, v->>'$.emotion' AS emotion, v->>'$.speed' AS speed, v->>'$.pitch' AS pitch, v->>'$.gender' AS gender FROM s LEFT JOIN b ON b.sample_path IS NOT DISTINCT FROM s.sample_path AND r = 1""")
def true_attributes(spark, sf):
    """The speaker that counts of each sample."""
    d = read(spark, sf, "sample_files").groupBy("sample_path").agg(F.max_by("body", "written_at").alias("body"))
    speaker = "struct<name:string,line:string,emotion:string,speed:string,pitch:string,gender:string>"
    parsed = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("body"), "$.speech_metadata_next_page.parsed", "variant")), f"map<string,{speaker}>")
    return d.select("sample_path", O.true_attributes(parsed).alias("s")).select("sample_path", "s.*")


_FLAT = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("answer_parse_all", f"""WITH d AS (SELECT DISTINCT id, coalesce(length(id) % 2 = 0, false) AS plain, {_FLAT('scene')} AS n, {_FLAT('ambient_sound')} AS s FROM dataset)
SELECT DISTINCT id, CASE WHEN n IS NOT NULL THEN n WHEN plain THEN coalesce(s, '') WHEN s IS NULL THEN '{{}}' ELSE '{{"speech":}}' END AS narration, CASE WHEN s IS NOT NULL THEN s WHEN plain THEN '' ELSE coalesce(n, '') END AS speech FROM d""")
def answer_parse_all(spark, sf):
    """Labelled answers, as JSON for every other id length, over all rows.

    The SQL knows null parts; that quotes, braces and colons inside the parts are read rightly is tested against a plain loop.
    """
    d = read(spark, sf, "dataset")
    plain = F.concat_ws("\n", F.concat(F.lit("Narration: "), "scene"), F.concat(F.lit("Speech: "), "ambient_sound"))
    as_json = F.to_json(F.struct(F.col("scene").alias("narration"), F.col("ambient_sound").alias("speech")))
    r = G.narration_speech_column(F.when(F.length("id") % 2 == 0, plain).otherwise(as_json))
    return d.select("id", r.alias("r")).select("id", "r.narration", "r.speech").distinct()


@query("first_pairs", "SELECT doc_id, 'a ' || kind AS narration, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'second' END AS speech FROM (SELECT doc_id, kind, trim(source) AS source FROM documents WHERE kind IS NOT NULL AND source IS NOT NULL)")
def first_pairs(spark, sf):
    d = read(spark, sf, "documents").where("kind is not null and source is not null")
    t = F.concat(F.lit("## **NARRATION:**\na "), "kind", F.lit("\nSPEECH: "), F.when(F.col("doc_id") % 2 == 0, F.trim("source")).otherwise("(sighs)"), F.lit("\nNARRATION: other\nSPEECH: second"))
    return d.select("doc_id", G.first_pair_column(t).alias("r")).select("doc_id", "r.narration", "r.speech")


@query("page_answers", "SELECT doc_id, kind AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE book END AS quote, 'Narrator' AS name, 'neutral' AS emotion, CASE WHEN doc_id % 3 = 0 THEN 'no speech line' END AS error FROM documents WHERE kind IS NOT NULL AND book IS NOT NULL")
def page_answers(spark, sf):
    """Pages as JSON inside prose, some without a spoken line."""
    d = read(spark, sf, "documents").where("kind is not null and book is not null")
    body = F.to_json(F.struct(F.col("kind").alias("text"), F.struct(F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("book")).alias("line"), F.lit(" ").alias("name")).alias("speaker")).alias("speech_metadata")))
    return d.select("doc_id", G.page_column(F.concat(F.lit("Sure, here: "), body, F.lit(" Done."))).alias("p")).select("doc_id", "p.text", "p.quote", "p.name", "p.emotion", "p.error")


@query("plan_defaults", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN kind ELSE 'go on' END AS narration, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'character' END AS speaker, 'Let''s keep going.' AS speech FROM (SELECT doc_id, kind, trim(source) AS source FROM documents WHERE trim(kind) <> '' AND trim(source) <> '')")
def plan_defaults(spark, sf):
    d = read(spark, sf, "documents").where("trim(kind) <> '' and trim(source) <> ''")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("NARRATION: "), "kind", F.lit("\nSPEAKER: "), F.trim("source"))).otherwise("nothing of use")
    return d.select("doc_id", G.plan_with_defaults(t, F.lit("go on")).alias("p")).select("doc_id", "p.narration", "p.speaker", "p.speech")


@query("unit_round_trip", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)::BIGINT[] AS units, list(o_orderkey ORDER BY o_orderkey)[1 : count(*) // 2 * 2 : 2]::BIGINT[] AS first_layer FROM orders GROUP BY o_custkey")
def unit_round_trip(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))).alias("t"))
    d = d.select("o_custkey", G.units_of(G.unit_text(F.col("t"), "u", "<s>", "</s>"), "u").alias("units"))
    return d.select("o_custkey", "units", F.get(G.codebooks(F.col("units"), 2, 100), F.lit(0)).alias("first_layer"))


@query("instruction_choice", "SELECT count(*) AS n, 3 AS different FROM documents")
def instruction_choice(spark, sf):
    """One of three templates for each row by its hash."""
    d = read(spark, sf, "documents").select(R.pick(["say", "tell", "write"], "doc_id", seed=3).alias("t"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("t").cast("int").alias("different"))


@query("question_templates", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 15 THEN 'choice: ' WHEN p_size BETWEEN 16 AND 30 THEN 'order: ' ELSE 'open: ' END || p_name AS prompt FROM part")
def question_templates(spark, sf):
    t = F.when(F.col("p_size").between(1, 15), R.render("choice: {q}", q="p_name")).when(F.col("p_size").between(16, 30), R.render("order: {q}", q="p_name")).otherwise(R.render("open: {q}", q="p_name"))
    return read(spark, sf, "part").select("p_partkey", t.alias("prompt"))


@query("collated_batches", "WITH d AS (SELECT o_custkey, l, max(len(l)) OVER (PARTITION BY b) AS m, b FROM (SELECT o_custkey, o_custkey % 50 AS b, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)) SELECT b::BIGINT AS b, count(*)::INT AS rows, max(m)::INT AS width, (sum(m) - sum(len(l)))::BIGINT AS padding FROM d GROUP BY b")
def collated_batches(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))).alias("t"))
    g = d.groupBy((F.col("o_custkey") % 50).cast("bigint").alias("b")).agg(F.collect_list("t").alias("r")).select("b", O.collated(F.col("r"), -1).alias("c"))
    return g.select("b", F.size("c").alias("rows"), F.size(F.get("c", F.lit(0))).alias("width"), F.aggregate("c", F.lit(0).cast("bigint"), lambda a, r: a + F.size(F.filter(r, lambda x: x == -1))).alias("padding"))


@query("speech_durations", "WITH d AS (SELECT vec_id, i // 8 AS f, sum(CASE WHEN i % 3 = 0 THEN 0 ELSE embedding[i + 1]::DOUBLE * (1 + i // 8) END ** 2) AS e FROM embeddings, range(0, 64) t(i) GROUP BY ALL), m AS (SELECT vec_id, max(e) * 0.1 AS floor FROM d GROUP BY vec_id) SELECT vec_id, count(*) FILTER (e > 0 AND e >= floor) * 8 / 16.0 AS seconds FROM d JOIN m USING (vec_id) GROUP BY vec_id")
def speech_durations(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(i % 3 == 0, 0.0).otherwise(x.cast("double") * (1 + F.floor(i / 8)))).alias("s"))
    return d.select("vec_id", A.speech_seconds(F.col("s"), 16, 8, 8, 10.0).alias("seconds"))


@query("signal_crops", "SELECT vec_id, 20 AS width, round(list_sum(embedding[1:20]::DOUBLE[]), 6) AS head FROM embeddings")
def signal_crops(spark, sf):
    d = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    u = F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000.0
    return d.select("vec_id", F.size(A.crop(F.col("s"), 20, u)).alias("width"), F.round(F.aggregate(A.crop(F.col("s"), 20), F.lit(0.0), lambda a, x: a + x), 6).alias("head"))


@query("canonical_emotions", "WITH l AS (SELECT s.index, CASE lower(trim(emotion)) WHEN 'neutral' THEN 'neutral' WHEN 'happy' THEN 'happy' WHEN 'joy' THEN 'happy' WHEN 'hap' THEN 'happy' WHEN 'sad' THEN 'sad' WHEN 'sadness' THEN 'sad' WHEN 'angry' THEN 'angry' WHEN 'anger' THEN 'angry' WHEN 'ang' THEN 'angry' WHEN 'neu' THEN 'neutral' END AS e FROM (SELECT DISTINCT speaker_id, index, regexp_replace(emotion, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') AS emotion FROM speaker_metadata WHERE index IS NOT NULL) s) SELECT index, round(coalesce(count(*) FILTER (e = 'neutral') / nullif(count(e), 0), 0.25), 6) AS neutral, round(coalesce(count(*) FILTER (e = 'angry') / nullif(count(e), 0), 0.25), 6) AS angry FROM l GROUP BY index")
def canonical_emotions(spark, sf):
    """Labels of several models as mass over four canonical ones; uniform where none is known."""
    m = read(spark, sf, "speaker_metadata").where("index is not null").select("speaker_id", "index", "emotion").distinct()
    g = m.groupBy("index").agg(F.collect_list(F.struct(F.col("emotion").alias("label"), F.lit(1.0).alias("p"))).alias("s"))
    p = g.select("index", A.label_mass(F.col("s"), T.EMOTIONS, ["neutral", "happy", "sad", "angry"]).alias("p"))
    return p.select("index", F.round(F.get("p", F.lit(0)), 6).alias("neutral"), F.round(F.get("p", F.lit(3)), 6).alias("angry"))


@query("attribute_pipeline", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding[1:4], lambda x: abs(x::DOUBLE)) AS p, CASE WHEN coalesce(embedding[6], 0) >= coalesce(embedding[5], 0) THEN 'male' ELSE 'female' END AS gender FROM embeddings) SELECT vec_id, ['neutral', 'happy', 'sad', 'angry'][list_position(p, list_max(p))] AS emotion, CASE WHEN abs(v[7]) * 40 < 2.6 THEN 'slow' WHEN abs(v[7]) * 40 > 4.7 THEN 'fast' ELSE 'normal' END AS speed, CASE WHEN abs(v[8]) * 2000 < CASE gender WHEN 'male' THEN 110 ELSE 165 END THEN 'low' WHEN abs(v[8]) * 2000 > CASE gender WHEN 'male' THEN 170 ELSE 255 END THEN 'high' ELSE 'normal' END AS pitch, gender FROM e")
def attribute_pipeline(spark, sf):
    """Emotion, speed, pitch and gender of each vector read as a signal: ensemble, bins and decisions together."""
    d = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = P.normalized(F.transform(F.slice("v", 1, 4), lambda x: F.abs(x)))
    gender = L.gender_of(F.get("v", F.lit(4)), F.get("v", F.lit(5)))
    return d.select("vec_id", P.argmax(p, ["neutral", "happy", "sad", "angry"]).alias("emotion"), L.speed_class(F.abs(F.get("v", F.lit(6))) * 40).alias("speed"), L.pitch_class(F.abs(F.get("v", F.lit(7))) * 2000, gender).alias("pitch"), gender.alias("gender"))


@query("pinned_commits", "SELECT doc_id, kind <> 'narration' AS pinned FROM documents WHERE text IS NOT NULL AND kind IS NOT NULL")
def pinned_commits(spark, sf):
    d = read(spark, sf, "documents").where("text is not null and kind is not null")
    return d.select("doc_id", O.commit_hash(F.when(F.col("kind") != "narration", F.sha1("text")).otherwise(F.upper(F.sha1("text")))).alias("pinned"))


@query("source_counters", "SELECT source, count(*) AS processed, count(*) FILTER (n_chars <= 1000) AS fit, count(*) FILTER (n_chars > 1000) AS too_long, sum(n_chars)::BIGINT AS total, count(DISTINCT book) AS books FROM documents GROUP BY source")
def source_counters(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("processed"), F.count_if(F.col("n_chars") <= 1000).alias("fit"), F.count_if(F.col("n_chars") > 1000).alias("too_long"), F.sum("n_chars").alias("total"), F.count_distinct("book").alias("books"))
