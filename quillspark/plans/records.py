"""Queries over sources, contracts, candidates, prompts, caches and the model boundary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.judgejson import CATEGORIES
from quillspark.operators import cache as C
from quillspark.operators import candidates as D
from quillspark.operators import contracts as K
from quillspark.operators import inference as I
from quillspark.operators import nested as N
from quillspark.operators import prompts as R
from quillspark.plans.registry import registry
from quillspark.plans.texts import sql_strip
from quillspark.session import read, shared_dir
from quillspark.sources import readers, sinks
from quillspark.streaming import status

QUERIES, ORACLE, query = registry()
_BLANK = lambda c: f"coalesce({sql_strip(c)}, '') = ''"
_SRC = ["panelnest", "talecorner", "leafshelf"]


def _index(spark, sf):
    """The index, each id once."""
    return read(spark, sf, "dataset").where("id is not null").dropDuplicates(["id"])


@query("prompt_columns", "SELECT " + ", ".join(readers.PROMPT_COLUMNS) + " FROM dataset")
def prompt_columns(spark, sf):
    """Only what a model may see is read."""
    return readers.index_table(spark, f"{sf}/dataset.parquet", readers.PROMPT_COLUMNS, positions=False)


@query("index_positions", "SELECT count(*) AS n, min(file_row_number) AS first, max(file_row_number) AS last, count(DISTINCT file_row_number) AS different FROM (SELECT row_number() OVER () - 1 AS file_row_number FROM dataset)")
def index_positions(spark, sf):
    d = readers.index_table(spark, f"{sf}/dataset.parquet", ["id"])
    return K.ordinals(d, ["file", "row_index"]).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("different"))


@query("range_select", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def range_select(spark, sf):
    d = K.ordinals(read(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return K.between(d, "ordinal", 100, 400, 50).select("doc_id")


@query("range_inclusive", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 11 OFFSET 20")
def range_inclusive(spark, sf):
    return K.inclusive(K.ordinals(read(spark, sf, "documents").select("doc_id"), ["doc_id"]), "ordinal", 20, 30).select("doc_id")


@query("dataset_contract", "WITH d AS (SELECT * FROM dataset) SELECT count(*) AS rows, count(DISTINCT id) AS keys, count(*) FILTER (id IS DISTINCT FROM source || '/' || book || '/' || from_key || '__' || to_key) AS id_mismatch, count(*) FILTER (" + " OR ".join(_BLANK(c) for c in K.REQUIRED) + ") AS blank_required FROM d")
def dataset_contract(spark, sf):
    return K.check(read(spark, sf, "dataset")).select("rows", "keys", "id_mismatch", "blank_required")


@query("unsafe_paths", "SELECT id, sample_path FROM dataset WHERE sample_path IS NULL OR starts_with(replace(sample_path, chr(92), '/'), '/')")
def unsafe_paths(spark, sf):
    return read(spark, sf, "dataset").where(K.path_problem("sample_path").isNotNull()).select("id", "sample_path")


_OBJECTS = lambda c: f"coalesce(CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN len(list_filter(json_extract({c}, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0 ELSE false END, false)"
_PATH = lambda c: f"regexp_replace(regexp_replace(trim({c}), '[\\\\/]+', '/', 'g'), '^(\\./)+', '')"


@query("json_object_lists", f"SELECT DISTINCT id, {_OBJECTS('condition_characters')} AS condition_ok, {_OBJECTS('book_characters')} AS book_ok FROM dataset")
def json_object_lists(spark, sf):
    """Which character columns are strict JSON lists of objects."""
    return read(spark, sf, "dataset").select("id", K.is_object_list("condition_characters").alias("condition_ok"), K.is_object_list("book_characters").alias("book_ok")).distinct()


@query("blank_fields", "SELECT id, field FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS field FROM dataset WHERE {_BLANK(c)}" for c in K.REQUIRED) + " UNION ALL " + " UNION ALL ".join(f"SELECT id, '{c}' FROM dataset WHERE {c} IS NULL" for c in K.OPTIONAL) + ")")
def blank_fields(spark, sf):
    return K.blank_fields(read(spark, sf, "dataset"), "id").withColumnRenamed("column", "field")


@query("source_histogram_gap", "WITH h AS (SELECT source, count(*) AS n FROM dataset GROUP BY source), e(source, expected) AS (VALUES ('panelnest', 1), ('talecorner', 2), ('leafshelf', 3)) SELECT source, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected FROM h FULL JOIN e USING (source) WHERE coalesce(n, 0) <> coalesce(expected, 0)")
def source_histogram_gap(spark, sf):
    return K.histogram_gap(read(spark, sf, "dataset"), "source", dict(zip(_SRC, (1, 2, 3))))


@query("sentinel_rows", "SELECT n::BIGINT AS doc_id, expected, kind FROM (VALUES (1001, 'narration'), (1002, 'x'), (-5, 'y')) v(n, expected) LEFT JOIN documents ON doc_id = n WHERE expected IS DISTINCT FROM kind")
def sentinel_rows(spark, sf):
    return K.sentinels(read(spark, sf, "documents"), "doc_id", "kind", {1001: "narration", 1002: "x", -5: "y"})


@query("expected_vs_actual", "WITH j AS (SELECT DISTINCT index FROM judge_results WHERE modality = 'joint' AND index IS NOT NULL), d AS (SELECT DISTINCT index FROM dataset) SELECT index, CASE WHEN j.index IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM (SELECT coalesce(j.index, d.index) AS index, j.index AS a, d.index AS b FROM j FULL JOIN d ON j.index = d.index) x LEFT JOIN j USING (index) WHERE a IS NULL OR b IS NULL")
def expected_vs_actual(spark, sf):
    return K.set_difference(read(spark, sf, "judge_results").where("modality = 'joint' and index is not null"), read(spark, sf, "dataset"), "index")


@query("missing_candidates", "SELECT DISTINCT d.index FROM dataset d WHERE NOT EXISTS (SELECT 1 FROM speaker_metadata s WHERE s.index = d.index)")
def missing_candidates(spark, sf):
    return read(spark, sf, "dataset").select("index").distinct().join(read(spark, sf, "speaker_metadata"), "index", "left_anti")


@query("name_sets", "SELECT (SELECT list_sort(list(DISTINCT kind)) FROM documents) AS kinds, list_sort(list_filter((SELECT list(DISTINCT kind) FROM documents), lambda x: x NOT IN ('narration', 'poem'))) AS unexpected, ['poem'] AS missing, ['narration'] AS shared")
def name_sets(spark, sf):
    k = read(spark, sf, "documents").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    want = F.array(F.lit("narration"), F.lit("poem"))
    return k.select("kinds", F.array_sort(F.array_except("kinds", want)).alias("unexpected"), F.array_except(want, "kinds").alias("missing"), F.array_intersect("kinds", want).alias("shared"))


@query("targeted_repair")
def targeted_repair(spark, sf):
    """Characters without an empty speech_intent, and of how many it was taken."""
    d = _index(spark, sf).select("id", F.from_json("condition_characters", "array<map<string,string>>").alias("c")).where("c is not null")
    return d.select("id", K.dropped_empty(F.col("c"), "speech_intent").alias("characters"), F.size(F.filter("c", lambda m: F.try_element_at(m, F.lit("speech_intent")) == "")).alias("repaired"))


@query("repair_counts", "SELECT DISTINCT id, CASE WHEN json_valid(condition_characters) AND json_type(condition_characters) = 'ARRAY' THEN len(list_filter(json_extract_string(condition_characters, '$[*].speech_intent'), lambda x: x = '')) ELSE 0 END::INT AS empty FROM dataset WHERE id IS NOT NULL")
def repair_counts(spark, sf):
    """Of each row how many characters a repair would change; it takes place where that is one."""
    d = _index(spark, sf).withColumn("c", F.from_json("condition_characters", "array<map<string,string>>"))
    return K.repair_problems(d, "id", "c", "speech_intent").select("id", "empty")


@query("file_problems", f"""WITH s AS (SELECT {_PATH('sample_path')} AS path, max(octet_length(encode(body))) AS n FROM sample_files WHERE sample_path IS NOT NULL GROUP BY 1)
SELECT DISTINCT d.id, 'sample_path' AS column, CASE WHEN coalesce(trim(d.sample_path), '') = '' THEN 'blank' WHEN replace(d.sample_path, chr(92), '/') LIKE '/%' THEN 'absolute' WHEN s.path IS NULL THEN 'missing' ELSE 'empty' END AS problem
FROM dataset d LEFT JOIN s ON s.path = {_PATH('d.sample_path')} WHERE d.id IS NOT NULL AND (coalesce(trim(d.sample_path), '') = '' OR replace(d.sample_path, chr(92), '/') LIKE '/%' OR s.path IS NULL OR coalesce(s.n, 0) = 0)""")
def file_problems(spark, sf):
    """Index rows whose sample file is not where the path says, or empty."""
    files = read(spark, sf, "sample_files").where("sample_path is not null").select(F.col("sample_path").alias("path"), F.octet_length("body").alias("length"))
    return K.file_problems(_index(spark, sf), "id", ["sample_path"], files)


@query("listing_totals", "SELECT count(*)::BIGINT AS files, count(DISTINCT sample_path) AS names, (SELECT sum(n)::BIGINT FROM (SELECT max(octet_length(encode(body))) AS n FROM sample_files WHERE sample_path IS NOT NULL GROUP BY sample_path)) AS bytes FROM sample_files WHERE sample_path IS NOT NULL")
def listing_totals(spark, sf):
    d = read(spark, sf, "sample_files").where("sample_path is not null").select(F.col("sample_path").alias("name"), F.octet_length("body").cast("bigint").alias("size"))
    return readers.totals(d)


@query("shard_totals", "SELECT count(*) AS tensors, count(DISTINCT o_custkey) AS shards, (SELECT sum(floor(c_acctbal))::BIGINT FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 10 > 0) AS bytes, count(DISTINCT o_custkey) FILTER (o_custkey % 10 = 0) AS missing FROM orders")
def shard_totals(spark, sf):
    """Tensors in shards and the files of nine shards in ten."""
    index = read(spark, sf, "orders").select(F.col("o_orderkey").alias("tensor"), F.col("o_custkey").alias("shard"))
    files = read(spark, sf, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("name"), F.floor("c_acctbal").alias("length"))
    return readers.shard_totals(index, files)


@query("fetch_plan", "SELECT c_custkey AS name, 1000::BIGINT AS size, CASE WHEN n = 1000 THEN 'done' WHEN n > 0 AND n < 1000 THEN 'partial' ELSE 'absent' END AS status, CASE WHEN n > 0 AND n < 1000 THEN n ELSE 0 END::BIGINT AS offset FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey % 1100) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def fetch_plan(spark, sf):
    """Files that are there, there in part or not, with the place where each goes on."""
    wanted = read(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.lit(1000).cast("bigint").alias("size"))
    have = read(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 1100).cast("bigint").alias("length"))
    return readers.to_fetch(wanted, have)


@query("nested_entries", "SELECT DISTINCT id, CASE WHEN current_image <> '' THEN '/data/' || current_image ELSE current_image END AS image_path, current_text AS text, genre FROM dataset WHERE id IS NOT NULL")
def nested_entries(spark, sf):
    """Rows as nested entries with absolute paths; an empty path stays empty."""
    p = lambda c: F.when(F.col(c) != "", F.concat(F.lit("/data/"), F.col(c))).otherwise(F.col(c))
    d = _index(spark, sf).select("id", F.struct(p("current_image").alias("image_path"), F.col("current_text").alias("text")).alias("current_page"), F.struct(F.struct("genre", "topic", "style").alias("metadata")).alias("metadata"))
    return d.select("id", "current_page.image_path", "current_page.text", "metadata.metadata.genre")


@query("sample_equality", f"WITH s AS (SELECT path, arg_max(body, written_at) AS body FROM (SELECT {_PATH('sample_path')} AS path, body, written_at FROM sample_files WHERE sample_path IS NOT NULL) GROUP BY path), d AS (SELECT DISTINCT id, source, book, from_key, {_PATH('sample_path')} AS path FROM dataset WHERE id IS NOT NULL AND sample_path IS NOT NULL) SELECT id, body IS NOT NULL AS has_file, coalesce(CASE WHEN json_valid(body) THEN body->>'$.id' = id AND body->>'$.source' = source AND body->>'$.book' = book AND body->>'$.prev_key' = from_key END, false) AS agrees FROM d LEFT JOIN s USING (path)")
def sample_equality(spark, sf):
    """Index rows against their sample files: identity fields that agree. Files that don't parse don't agree."""
    d = _index(spark, sf).where("sample_path is not null").select("id", "source", "book", "from_key", N.canonical_path(F.col("sample_path")).alias("path"))
    s = read(spark, sf, "sample_files").where("sample_path is not null").groupBy(N.canonical_path(F.col("sample_path")).alias("path")).agg(F.max_by("body", "written_at").alias("body"))
    v = F.try_parse_json("body")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    j = d.join(s, "path", "left").withColumn("_id", get("id"))
    return j.select("id", F.col("body").isNotNull().alias("has_file"), F.coalesce((F.col("_id") == F.col("id")) & (get("source") == F.col("source")) & (get("book") == F.col("book")) & (get("prev_key") == F.col("from_key")), F.lit(False)).alias("agrees"))


@query("ground_truth_lines", f"WITH s AS (SELECT path, arg_max(body, written_at) AS body FROM (SELECT {_PATH('sample_path')} AS path, body, written_at FROM sample_files WHERE sample_path IS NOT NULL) GROUP BY path), p AS (SELECT path, CASE WHEN json_valid(body) THEN body->'$.speech_metadata_next_page.parsed' END AS p FROM s), k AS (SELECT path, p, unnest(json_keys(p)) AS k FROM p WHERE json_type(p) = 'OBJECT'), n AS (SELECT path, string_agg(trim(p->k->>'line'), ' ' ORDER BY regexp_extract(k, '[0-9]+$')::INT) AS lines FROM k WHERE regexp_matches(k, '^speaker_[0-9]+$') GROUP BY path) SELECT path, coalesce(nullif(trim(p->'speaker'->>'line'), ''), nullif(lines, ''), '') AS line FROM p LEFT JOIN n USING (path)")
def ground_truth_lines(spark, sf):
    """The spoken line of each sample: one speaker's, else all numbered speakers' in order."""
    s = read(spark, sf, "sample_files").where("sample_path is not null").groupBy(N.canonical_path(F.col("sample_path")).alias("path")).agg(F.max_by("body", "written_at").alias("body"))
    v = F.try_parse_json("body")
    parsed = F.try_variant_get(v, "$.speech_metadata_next_page.parsed", "map<string, variant>")
    one = F.try_variant_get(v, "$.speech_metadata_next_page.parsed.speaker.line", "string")
    numbered = F.filter(F.map_entries(parsed), lambda e: e["key"].rlike(r"^speaker_\d+$"))
    ordered = F.array_sort(F.transform(numbered, lambda e: F.struct(F.regexp_extract(e["key"], r"(\d+)$", 1).cast("int").alias("n"), F.try_variant_get(e["value"], "$.line", "string").alias("line"))))
    lines = F.array_join(F.transform(F.filter(ordered, lambda x: ~T.blank(x["line"])), lambda x: T.strip(x["line"])), " ")
    return s.select("path", F.coalesce(F.when(~T.blank(one), T.strip(one)), F.nullif(lines, F.lit("")), F.lit("")).alias("line"))


def _listing(spark, sf):
    """File names made from orders: for each of 1500 indices some files in a modality's folder."""
    o = read(spark, sf, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("generated.txt", "prompt.txt", "page_", "text_", "missing.txt", "notes.txt")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    name = F.when(kind.isin("page_", "text_"), F.concat(kind, (F.col("o_orderkey") % 120).cast("string"), F.lit(".txt"))).otherwise(kind)
    return o.select(F.concat(F.lit("results/text/"), F.col("o_custkey").cast("string"), F.lit("/"), name).alias("path"), F.when(F.col("o_orderkey") % 6 == 4, " gone ").when(F.col("o_orderkey") % 60 == 0, " ").otherwise("a page").alias("content")).distinct()


_LIST = "f AS (SELECT DISTINCT o_custkey AS i, CASE o_orderkey % 6 WHEN 0 THEN 'generated.txt' WHEN 1 THEN 'prompt.txt' WHEN 2 THEN 'page_' || o_orderkey % 120 || '.txt' WHEN 3 THEN 'text_' || o_orderkey % 120 || '.txt' WHEN 4 THEN 'missing.txt' ELSE 'notes.txt' END AS name, o_orderkey % 6 AS k, o_orderkey % 120 AS n FROM orders)"


@query("first_candidate_per_key", f"WITH {_LIST}, r AS (SELECT i, name FROM f WHERE k IN (0, 2, 3, 5) QUALIFY row_number() OVER (PARTITION BY i ORDER BY CASE k WHEN 0 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 11 END, CASE WHEN k IN (2, 3) THEN n END) = 1), m AS (SELECT DISTINCT i FROM f WHERE k = 4) SELECT c_custkey AS dataset_index, r.name AS file_name, CASE WHEN r.name IS NULL THEN CASE WHEN m.i IS NULL THEN 'text candidate not found' ELSE 'gone' END END AS reason FROM customer LEFT JOIN r ON r.i = c_custkey LEFT JOIN m ON m.i = c_custkey")
def first_candidate_per_key(spark, sf):
    files = D.listing(_listing(spark, sf))
    wanted = read(spark, sf, "customer").select(F.lit("text").alias("modality"), F.col("c_custkey").cast("bigint").alias("dataset_index"))
    r = D.resolve(files, wanted)
    return r.select("dataset_index", "file_name", F.when(F.col("status") == "missing", F.col("missing_reason")).alias("reason"))


@query("candidate_statuses", "WITH f AS (SELECT DISTINCT o_custkey AS i, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 6 IN (2, 3) THEN o_orderkey % 120 END AS n, CASE WHEN o_orderkey % 6 = 4 THEN ' gone ' WHEN o_orderkey % 60 = 0 THEN ' ' ELSE 'a page' END AS content FROM orders), c AS (SELECT i, content, count(*) OVER (PARTITION BY i) AS names, row_number() OVER (PARTITION BY i ORDER BY CASE k WHEN 0 THEN 0 WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 11 END, n, content) AS r FROM f WHERE k IN (0, 2, 3, 5)) SELECT CASE WHEN i IS NULL THEN 'missing' WHEN trim(content) = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n, sum(coalesce(names, 0))::BIGINT AS names FROM customer LEFT JOIN c ON i = c_custkey AND r = 1 GROUP BY 1")
def candidate_statuses(spark, sf):
    wanted = read(spark, sf, "customer").select(F.lit("text").alias("modality"), F.col("c_custkey").cast("bigint").alias("dataset_index"))
    return D.resolve(D.listing(_listing(spark, sf)), wanted).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("all_names")).alias("names"))


@query("numeric_folders", "SELECT DISTINCT o_custkey::BIGINT AS dataset_index FROM orders")
def numeric_folders(spark, sf):
    return readers.numbered(_listing(spark, sf))


@query("result_attach", "SELECT d.index, CASE WHEN s.n IS NULL THEN 'skipped' ELSE 'ok' END AS inference_status, s.n FROM (SELECT DISTINCT index FROM dataset) d LEFT JOIN (SELECT index, count(DISTINCT speaker_id)::VARCHAR AS n FROM speaker_metadata GROUP BY index) s USING (index)")
def result_attach(spark, sf):
    s = read(spark, sf, "speaker_metadata").where("index is not null").groupBy("index").agg(F.count_distinct("speaker_id").cast("string").alias("raw_response"))
    s = s.select(F.col("index").alias("key"), "raw_response", F.lit("ok").alias("inference_status"), F.lit(None).cast("string").alias("error"))
    return I.attach(read(spark, sf, "dataset").select("index").distinct(), s, "index").select("index", "inference_status", F.col("raw_response").alias("n"))


@query("model_batches", "SELECT doc_id AS key, CASE WHEN contains(kind, 'note') THEN NULL ELSE upper(kind) END AS raw_response, CASE WHEN contains(kind, 'note') THEN 'error' ELSE 'ok' END AS inference_status FROM documents")
def model_batches(spark, sf):
    """A model that fails on some items: their batch is tried item by item."""
    return I.run(read(spark, sf, "documents"), I.echo_adapter("note"), "doc_id", "kind").select("key", "raw_response", "inference_status")


@query("dry_run_rows", "SELECT speaker_id, CASE WHEN name IS NOT NULL THEN 'dry_run_ok' ELSE 'dry_run_missing' END AS status FROM speaker_metadata")
def dry_run_rows(spark, sf):
    d = read(spark, sf, "speaker_metadata").withColumn("present", F.col("name").isNotNull())
    return I.dry_run(d, "present").select("speaker_id", "status")


@query("model_routing", "SELECT result_id, CASE WHEN contains(lower(judge), 'dune') THEN 'a' WHEN contains(lower(judge), 'e-') THEN 'b' ELSE 'other' END AS route FROM judge_results")
def model_routing(spark, sf):
    return read(spark, sf, "judge_results").select("result_id", I.routed("judge", [("DUNE", "a"), ("e-", "b")], "other").alias("route"))


@query("condition_prompts")
def condition_prompts(spark, sf):
    """Prompts of each row: what the page has to show, the voices, the story, and the whole request."""
    d = _index(spark, sf).withColumn("people", F.from_json("condition_characters", "array<struct<name:string,emotion:string,action:string,speech_intent:string,visibility:string>>")).withColumn("names", F.transform(F.from_json("book_characters", "array<struct<name:string>>"), lambda p: p["name"]))
    people = F.coalesce("people", F.array().cast("array<struct<name:string,emotion:string,action:string,speech_intent:string,visibility:string>>"))
    meta = R.metadata_line(F.col("topic"), F.col("genre"), F.col("style"), F.coalesce("names", F.array().cast("array<string>")))
    short = F.transform(people, lambda p: F.struct(p["name"].alias("name"), p["emotion"].alias("emotion"), p["action"].alias("action")))
    d = d.select("id", "current_text", R.condition_text(F.col("scene"), F.col("text_instruction"), F.col("ambient_sound"), short).alias("condition"), R.speech_condition(people, F.col("ambient_sound")).alias("voices"), meta.alias("meta"))
    return d.select("id", "condition", "voices", R.render("Story: {title} ({kind}), with {characters}.\nThe page before:\n{page}\nThe page to write:\n{condition}", title=F.col("meta.title"), kind=F.col("meta.kind"), characters=F.col("meta.characters"), page="current_text", condition="condition").alias("prompt"))


@query("request_messages", "SELECT DISTINCT id, 'Score: ' || coalesce(next_text, '') AS content, 2 AS n FROM dataset WHERE id IS NOT NULL")
def request_messages(spark, sf):
    m = F.array(R.message("system", F.lit("You judge pages.")), R.message("user", R.render("Score: {page}", page="next_text")))
    return _index(spark, sf).select("id", m.alias("m")).select("id", F.get("m", F.lit(1))["content"].alias("content"), F.size("m").alias("n"))


@query("voice_descriptions", "SELECT speaker_id, coalesce(name, 'default') || ': ' || CASE lower(trim(emotion)) WHEN 'angry' THEN 'angry and tense' WHEN 'happy' THEN 'cheerful and upbeat' WHEN 'sad' THEN 'sad and soft' ELSE 'calm and neutral' END || ', ' || CASE lower(trim(speed)) WHEN 'slow' THEN 'slow' WHEN 'fast' THEN 'slightly fast' ELSE 'moderate' END || ' pace, ' || CASE lower(trim(pitch)) WHEN 'low' THEN 'low' WHEN 'high' THEN 'slightly high' ELSE 'moderate' END || ' pitch' AS description FROM (SELECT speaker_id, name, " + ", ".join(f"{sql_strip(c)} AS {c}" for c in ("emotion", "speed", "pitch")) + " FROM speaker_metadata)")
def voice_descriptions(spark, sf):
    return read(spark, sf, "speaker_metadata").select("speaker_id", R.voice_description(F.coalesce("name", F.lit("default")), F.col("emotion"), F.col("speed"), F.col("pitch")).alias("description"))


@query("chat_render", "WITH t AS (SELECT o_custkey, o_orderpriority AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, 'S' || chr(10) || string_agg(CASE WHEN i % 2 = 0 THEN 'U: ' || m || '<e>' || chr(10) ELSE 'A: ' || m || '<f>' || CASE WHEN i <> n - 1 THEN chr(10) ELSE '' END END, '' ORDER BY i) || CASE WHEN max(n) % 2 = 1 THEN 'A:' ELSE '' END AS prompt FROM t GROUP BY o_custkey")
def chat_render(spark, sf):
    return R.chat(read(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority", "S", ("U", "A"), ("<e>", "<f>"))


@query("chat_messages", "WITH t AS (SELECT o_custkey, o_orderpriority AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_custkey, count(*)::INT + 1 AS n, count(*) FILTER (i % 2 = 1)::INT AS answers, arg_max(m, i) AS last FROM t GROUP BY o_custkey")
def chat_messages(spark, sf):
    m = R.messages(read(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority", "S")
    return m.select("o_custkey", F.size("messages").alias("n"), F.size(F.filter("messages", lambda x: x["role"] == "assistant")).alias("answers"), F.element_at("messages", -1)["content"].alias("last"))


@query("message_parts", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN ['image', 'text', 'audio'] ELSE ['text', 'audio', 'video'] END AS kinds, (length(text) - length(replace(text, ' the ', '')))::INT // 5 - CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS gap FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL")
def message_parts(spark, sf):
    """Parts put in order, and how many places of a text (here one word) have no image."""
    p = lambda k: F.struct(F.lit(k).alias("type"))
    d = read(spark, sf, "documents").where("text is not null and n_chars is not null")
    d = d.select("doc_id", "text", F.when(F.col("n_chars") % 2 == 0, F.array(p("text"), p("audio"), p("image"))).otherwise(F.array(p("video"), p("audio"), p("text"))).alias("c"))
    return d.select("doc_id", F.transform(R.reordered(F.col("c")), lambda x: x["type"]).alias("kinds"), R.placeholder_gap(F.col("text"), " the ", F.col("c"), "image").alias("gap"))


@query("content_key", "SELECT doc_id, sha256('{\"kind\": ' || to_json(kind) || ', \"n\": ' || to_json(n_chars::VARCHAR) || '}') AS key, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL AND kind IS NOT NULL AND n_chars IS NOT NULL")
def content_key(spark, sf):
    d = read(spark, sf, "documents").where("text is not null and kind is not null and n_chars is not null")
    return d.select("doc_id", C.canonical_key(n="n_chars", kind="kind").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("json_keys")
def json_keys(spark, sf):
    return read(spark, sf, "sample_files").groupBy("sample_path").agg(F.max_by("body", "written_at").alias("body")).select("sample_path", C.json_key(F.col("body")).alias("key"))


@query("cache_lookup", "WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) SELECT o_orderkey, coalesce(n >= 3, false) AS hit FROM orders LEFT JOIN s ON l_orderkey = o_orderkey")
def cache_lookup(spark, sf):
    stored = read(spark, sf, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.lookup(read(spark, sf, "orders").select("o_orderkey"), stored, "o_orderkey", 3)


@query("cache_hit_ratio", "WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT o_orderstatus, coalesce(n >= 3, false) AS hit FROM orders LEFT JOIN s ON l_orderkey = o_orderkey) SELECT o_orderstatus, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 9) AS ratio FROM h GROUP BY 1")
def cache_hit_ratio(spark, sf):
    stored = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.hit_ratio(C.lookup(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), stored, "o_orderkey", 3), "o_orderstatus").withColumn("ratio", F.round("ratio", 9))


@query("cache_additions", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def cache_additions(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return C.additions(o, o.where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("retry_backoff", "SELECT event_id, least(60.0, 10.0 * pow(2.0, event_id % 5)) AS seconds FROM events")
def retry_backoff(spark, sf):
    return read(spark, sf, "events").select("event_id", C.backoff(F.col("event_id") % 5).alias("seconds"))


@query("file_digests")
def file_digests(spark, sf):
    """Digests of the small tables' own files."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{sf}/nation.parquet", f"{sf}/region.parquet", f"{sf}/judges.parquet"])
    return C.file_digests(d).select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name"), "length", "sha256", "blob_sha1", readers.media_kind(F.unhex(F.lit("89504E470D0A1A0A0000000D"))).alias("kind"))


@query("category_signatures", "SELECT key, list_sort(list(DISTINCT modality)) AS modalities FROM (VALUES " + ", ".join(f"('{m}', '{c}')" for m, cs in CATEGORIES.items() for c in cs) + ") v(modality, key) GROUP BY key")
def category_signatures(spark, sf):
    rows = [(m, c) for m, cs in CATEGORIES.items() for c in cs]
    return spark.createDataFrame(rows, "modality string, key string").groupBy("key").agg(F.array_sort(F.collect_set("modality")).alias("modalities"))


@query("raw_speech_fallback", "SELECT o_custkey, CASE WHEN min(o_orderkey) % 3 = 2 THEN NULL ELSE 'line ' || min(o_orderkey) END AS line, CASE WHEN min(o_orderkey) % 3 = 2 THEN NULL WHEN min(o_orderkey) % 3 = 0 THEN 'Ann' ELSE 'Narrator' END AS name FROM orders GROUP BY o_custkey")
def raw_speech_fallback(spark, sf):
    """Raw answers with metadata, with a quote only, and with neither; the first file counts."""
    k = F.col("o_orderkey").cast("string")
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"text": "t", "speech_metadata": {"speaker": {"name": "Ann", "line": "line '), k, F.lit('"}}}'))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"text": "t", "quote": "line '), k, F.lit('"}'))).otherwise('{"text": "t"}')
    d = read(spark, sf, "orders").select("o_custkey", F.concat(F.lpad(k, 12, "0"), F.lit(".json")).alias("path"), body.alias("content"))
    return readers.raw_speech(d, "o_custkey").select("o_custkey", "line", "name")


@query("artifact_checks", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN CASE WHEN n_chars % 3 = 1 THEN NULL ELSE 'empty' END WHEN n_chars % 3 = 0 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'blank' WHEN n_chars % 3 = 2 THEN 'format' END AS problem FROM documents WHERE n_chars IS NOT NULL")
def artifact_checks(spark, sf):
    """Texts as text files, behind an image's first bytes, and as a speech file."""
    k, own = F.col("n_chars") % 3, F.col("text").cast("binary")
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D")), F.coalesce(own, F.unhex(F.lit(""))))
    m = F.when(k == 0, "text").when(k == 1, "image").otherwise("speech")
    return read(spark, sf, "documents").where("n_chars is not null").select("doc_id", readers.artifact_problem(m, F.when(k == 1, png).otherwise(own)).alias("problem"))


@query("sample_pipeline", "SELECT doc_id, upper('a page ' || doc_id) AS narration, upper('say ' || doc_id) AS speech, CASE WHEN doc_id % 10 = 0 THEN ['image'] ELSE [] END AS failed FROM documents")
def sample_pipeline(spark, sf):
    """Plans, images and voices of a test model that cannot draw every tenth sample."""
    n = F.col("doc_id").cast("string")
    p = F.concat(F.lit("narration: a page "), n, F.lit("\nspeech: say "), n, F.lit("\nimage_prompt: "), F.when(F.col("doc_id") % 10 == 0, "nothing").otherwise("a hill"))
    d = read(spark, sf, "documents").select("doc_id", p.alias("prompt"))
    return I.pipeline(d, "doc_id", "prompt", I.echo_adapter(), I.echo_adapter("NOTHING"), I.echo_adapter()).select("doc_id", "narration", "speech", "failed")


@query("chat_pairs", "WITH t AS (SELECT o_custkey, o_orderpriority AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_custkey, i // 2 AS pair, max(m) FILTER (i % 2 = 0) AS asked, max(m) FILTER (i % 2 = 1) AS answered FROM t GROUP BY ALL")
def chat_pairs(spark, sf):
    return R.pairs(read(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority")


@query("directed_messages", "SELECT doc_id, CASE WHEN lang IS NOT NULL THEN lang || chr(10) || 'No thinking.' ELSE 'No thinking.' END AS system, 2 + (book IS NOT NULL)::INT AS n, coalesce(text, '') AS asked FROM documents")
def directed_messages(spark, sf):
    """A directive at the end of a system message that is there, or as one of its own."""
    some = lambda r, c: F.when(F.col(c).isNotNull(), F.array(R.message(r, F.col(c)))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    m = F.concat(some("system", "lang"), F.array(R.message("user", F.coalesce("text", F.lit("")))), some("assistant", "book"))
    d = read(spark, sf, "documents").select("doc_id", R.with_directive(m, "No thinking.").alias("m"))
    return d.select("doc_id", F.get("m", F.lit(0))["content"].alias("system"), F.size("m").alias("n"), F.get("m", F.lit(1))["content"].alias("asked"))


@query("partial_rows", "SELECT count(*) FILTER (n IN (0, 3)) AS whole, count(*) FILTER (n IN (1, 2)) AS partial FROM (SELECT (CASE WHEN current_text IS NULL THEN 0 ELSE 1 END) + (CASE WHEN next_text IS NULL THEN 0 ELSE 1 END) + (CASE WHEN sample_path IS NULL THEN 0 ELSE 1 END) AS n FROM dataset)")
def partial_rows(spark, sf):
    good, bad = sinks.split_partial(read(spark, sf, "dataset"), ["current_text", "next_text", "sample_path"])
    return good.agg(F.count("*").alias("whole")).crossJoin(bad.agg(F.count("*").alias("partial")))  # one row each


@query("source_preview", "WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row, count(*) OVER (PARTITION BY source) AS total FROM documents WHERE source IS NOT NULL) SELECT * FROM d WHERE row <= 3")
def source_preview(spark, sf):
    return sinks.preview(read(spark, sf, "documents").where("source is not null").select("source", "doc_id"), "source", "doc_id", 3)


@query("round_trip_sinks", "SELECT count(*) AS manifest_rows, count(DISTINCT kind) AS published, 0::BIGINT AS published_again FROM documents")
def round_trip_sinks(spark, sf):
    """A manifest written and read; rows published once, and nothing the second time."""
    at = f"{shared_dir(spark)}/sinks-{uuid.uuid4().hex}"
    d = read(spark, sf, "documents").select("doc_id", "kind")
    sinks.write_manifest(d, f"{at}/manifest", 2, {"root": sf})
    n = sinks.read_manifest(spark, f"{at}/manifest", 2).count()
    first, again = (sinks.publish(d, f"{at}/kinds", "kind", "doc_id") for _ in range(2))
    return spark.createDataFrame([(n, first, again)], "manifest_rows bigint, published bigint, published_again bigint")


@query("stream_window_counts", "SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 90 MINUTE]) AS w, event_type, value FROM events) GROUP BY ALL")
def stream_window_counts(spark, sf):
    """The event log as a stream of files, counted in sliding windows; nothing here is late."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = read(spark, sf, "events")
    s = status.event_stream(spark, f"{sf}/events.parquet*", table.schema)
    got = status.collected(status.windowed_counts(s), f"counts_{uuid.uuid4().hex}", "complete", at)
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_runs", "WITH o AS (SELECT user_id, event_type, row_number() OVER w AS p, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum((p = 1 OR event_type IS DISTINCT FROM b)::INT) OVER (PARTITION BY user_id ORDER BY p) AS run FROM o), g AS (SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run) SELECT user_id, event_type, n FROM g QUALIFY run < max(run) OVER (PARTITION BY user_id)")
def stream_runs(spark, sf):
    """Runs of equal events per user, given when they end: arbitrary state by user.

    The files of a table are in no order of time, so they are taken in one trigger.
    """
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = read(spark, sf, "events")
    s = status.event_stream(spark, f"{sf}/events.parquet*", table.schema, None)
    return status.collected(status.runs(s), f"runs_{uuid.uuid4().hex}", "append", at)
