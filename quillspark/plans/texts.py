"""Queries over text functions, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.registry import registry
from quillspark.session import read

QUERIES, ORACLE, query = registry()

_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}+', ' ', 'g'), ' ')"


@query("whitespace_clean", f"SELECT doc_id, {sql_strip('text')} AS stripped, {sql_collapse('text')} AS collapsed, coalesce({sql_strip('text')}, '') = '' AS is_blank FROM documents")
def whitespace_clean(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.strip("text").alias("stripped"), T.collapse("text").alias("collapsed"), T.blank("text").alias("is_blank"))


@query("label_normalize", f"SELECT speaker_id, coalesce(lower({sql_strip('emotion')}), '') AS emotion, coalesce(lower({sql_strip('gender')}), '') AS gender, CASE coalesce(lower({sql_strip('emotion')}), '') WHEN 'neu' THEN 'neutral' WHEN 'neutral' THEN 'neutral' WHEN 'ang' THEN 'angry' WHEN 'anger' THEN 'angry' WHEN 'angry' THEN 'angry' WHEN 'hap' THEN 'happy' WHEN 'happy' THEN 'happy' WHEN 'joy' THEN 'happy' WHEN 'sad' THEN 'sad' WHEN 'sadness' THEN 'sad' END AS canonical_emotion, CASE coalesce(lower({sql_strip('gender')}), '') WHEN 'm' THEN 'male' WHEN 'male' THEN 'male' WHEN 'man' THEN 'male' WHEN 'f' THEN 'female' WHEN 'female' THEN 'female' WHEN 'woman' THEN 'female' END AS canonical_gender FROM speaker_metadata")
def label_normalize(spark, sf):
    d = read(spark, sf, "speaker_metadata")
    return d.select("speaker_id", T.label("emotion").alias("emotion"), T.label("gender").alias("gender"), T.lookup("emotion", T.EMOTIONS).alias("canonical_emotion"), T.lookup("gender", T.GENDERS).alias("canonical_gender"))


@query("key_signatures", "SELECT k AS key, regexp_replace(lower(k), '[^a-z0-9]', '', 'g') AS signature, count(*) AS n FROM (SELECT unnest(map_keys(judge_eval)) AS k FROM judge_results) GROUP BY ALL")
def key_signatures(spark, sf):
    keys = read(spark, sf, "judge_results").select(F.explode(F.map_keys("judge_eval")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).select("key", T.key_signature("key").alias("signature"), "n")


@query("strip_wrapping_quotes")
def strip_wrapping_quotes(spark, sf):
    return read(spark, sf, "dataset").select("id", T.strip_quotes("current_text").alias("all_pairs"), T.strip_quotes_once("current_text").alias("one_pair"), T.non_empty_or("current_text", "(none)").alias("or_default")).distinct()


@query("first_quoted_span")
def first_quoted_span(spark, sf):
    return read(spark, sf, "dataset").select("id", T.first_quoted("current_text").alias("quote")).distinct()


@query("ensure_quote_in_text")
def ensure_quote_in_text(spark, sf):
    return read(spark, sf, "dataset").where("next_text is not null and speech_utterance is not null").select("id", T.ensure_quote("next_text", "speech_utterance").alias("page")).distinct()


@query("double_quoted_spans", "SELECT doc_id, len(regexp_extract_all(text, '\"([^\"]+)\"', 1)) AS spans, coalesce(regexp_extract_all(text, '\"([^\"]+)\"', 1)[1], '') AS first_span FROM documents WHERE text IS NOT NULL")
def double_quoted_spans(spark, sf):
    d = read(spark, sf, "documents").where("text is not null")
    spans = T.between_all("text", '"', '"')
    d = d.select("doc_id", F.regexp_extract_all("text", F.lit('"([^"]+)"'), 1).alias("s"), spans.alias("t"))
    return d.select("doc_id", F.size("s").alias("spans"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first_span"))


@query("clean_values", f"SELECT doc_id, {sql_collapse(chr(39).join(['trim(trim(' + sql_strip('text') + ', ', chr(34), '), ', chr(39) * 2, ')']))} AS cleaned FROM documents WHERE text IS NOT NULL")
def clean_values(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", T.clean_value("text").alias("cleaned"))


_CLEAN = lambda c: sql_collapse("trim(trim(" + sql_strip(c) + ", '\"'), '''')")
_FIELD = lambda name: _CLEAN(f"coalesce(v[list_position(k, '{name}') + 1], '')")


@query("plan_field_extract_all", f"""WITH p AS (SELECT DISTINCT id, concat_ws(chr(10), 'NARRATION: ' || next_text, 'SPEAKER: ' || speech_speaker, 'speech : ' || speech_utterance) AS t FROM dataset),
l AS (SELECT id, list_transform(regexp_extract_all(t, '(?im)^{_WS}*([a-z_]+){_WS}*:', 1), lambda x: lower(x)) AS k, string_split_regex(t, '(?im)^{_WS}*[a-z_]+{_WS}*:') AS v FROM p)
SELECT DISTINCT id, {_FIELD('speaker')} AS speaker, {_FIELD('narration')} AS narration, {_FIELD('speech')} AS speech FROM l""")
def plan_field_extract_all(spark, sf):
    """Fields written as a labelled plan and read back from it: what is null has no line in its plan, and labels inside the fields end them."""
    plan = F.concat_ws("\n", F.concat(F.lit("NARRATION: "), "next_text"), F.concat(F.lit("SPEAKER: "), "speech_speaker"), F.concat(F.lit("speech : "), "speech_utterance"))
    got = T.plan_fields(plan)
    return read(spark, sf, "dataset").select("id", got["speaker"].alias("speaker"), got["narration"].alias("narration"), got["speech"].alias("speech")).distinct()


@query("strip_meta_lead", f"""SELECT doc_id, CASE WHEN lead THEN trim(substr(t, length(first) + 1)) ELSE t END AS text FROM (SELECT doc_id, t, first, first <> '' AND (starts_with(lower(first), 'write a sentence') OR starts_with(lower(first), 'here is the narration')) AS lead FROM (SELECT doc_id, t, regexp_extract(t, '^(?:[^.!?]|[.!?][^ .!?])*[.!?]+ ') AS first FROM (SELECT doc_id, {sql_collapse("CASE doc_id % 3 WHEN 0 THEN 'Here is the narration for it. ' WHEN 1 THEN 'Write a sentence! ' ELSE '' END || text")} AS t FROM documents WHERE text IS NOT NULL)))""")
def strip_meta_lead(spark, sf):
    d = read(spark, sf, "documents").where("text is not null")
    lead = F.when(F.col("doc_id") % 3 == 0, "Here is the narration for it. ").when(F.col("doc_id") % 3 == 1, "Write a sentence! ").otherwise("")
    return d.select("doc_id", T.strip_meta_lead(F.concat(lead, "text")).alias("text"))


@query("tag_segments", "SELECT doc_id, regexp_extract_all(t, '<sos>([^<]*)<eos>', 1) AS segments, trim(regexp_replace(regexp_replace(t, '<sos>[^<]*<eos>', ' ', 'g'), '\\s+', ' ', 'g')) AS rest, regexp_extract(t, '<sos>([^<]*)<eos>', 1) AS first_segment, regexp_extract(t, '.*<sos>([^<]*)<eos>', 1) AS last_segment FROM (SELECT doc_id, kind || '<sos>' || source || '<eos>' || coalesce(lang, '') || '<sos>' || book || '<eos> .' AS t FROM documents WHERE source IS NOT NULL AND book IS NOT NULL)")
def tag_segments(spark, sf):
    d = read(spark, sf, "documents").where("source is not null and book is not null")
    d = d.select("doc_id", F.concat("kind", F.lit("<sos>"), "source", F.lit("<eos>"), F.coalesce("lang", F.lit("")), F.lit("<sos>"), "book", F.lit("<eos> .")).alias("t"))
    a, b = "<sos>", "<eos>"
    return d.select("doc_id", T.between_all("t", a, b).alias("segments"), T.without_between("t", [(a, b)]).alias("rest"), T.between_first("t", a, b).alias("first_segment"), T.between_last("t", a, b).alias("last_segment"))


@query("assistant_payload", "SELECT doc_id, trim(regexp_replace(CASE WHEN n_chars % 2 = 0 THEN text ELSE book END, '^\\s+', '')) AS payload FROM documents WHERE book IS NOT NULL AND text IS NOT NULL AND n_chars IS NOT NULL")
def assistant_payload(spark, sf):
    """The last of two answers with an end mark, or what follows an only mark."""
    d = read(spark, sf, "documents").where("book is not null and text is not null and n_chars is not null")
    t = F.concat(F.lit("[ANSWER]: "), "book", F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("<eom>x[ANSWER] : "), "text", F.lit("<eom> tail"))).otherwise(F.lit("")))
    return d.select("doc_id", T.last_payload(t, "[ANSWER]", "<eom>").alias("payload"))


@query("speech_text_normalize")
def speech_text_normalize(spark, sf):
    return read(spark, sf, "speaker_metadata").select("speaker_id", T.speech_text("line").alias("spoken")).distinct()


@query("strip_think_blocks", f"SELECT doc_id, CASE WHEN n_chars % 3 = 2 THEN '' ELSE coalesce({sql_strip('text')}, '') END AS answer, CASE WHEN n_chars % 3 = 0 THEN 'a' || chr(10) || coalesce(lang, '') ELSE coalesce(nullif({sql_strip('book')}, ''), '') END AS thought FROM documents WHERE n_chars IS NOT NULL")
def strip_think_blocks(spark, sf):
    """Texts behind a think block, before one that is left open, and inside one; and what was thought."""
    d = read(spark, sf, "documents").where("n_chars is not null").withColumn("t", F.coalesce("text", F.lit(""))).withColumn("b", F.coalesce("book", F.lit("")))
    k = F.col("n_chars") % 3
    t = F.when(k == 0, F.concat(F.lit("<think>a\n"), F.coalesce("lang", F.lit("")), F.lit("x</think>  "), "t")).when(k == 1, F.concat("t", F.lit(" <think>"), "b")).otherwise(F.concat(F.lit("<think>"), "b"))
    return d.select("doc_id", T.strip_think(t).alias("answer"), F.when(k == 0, F.regexp_replace(T.reasoning(t), "x$", "")).otherwise(T.reasoning(t)).alias("thought"))


@query("line_decoration", "SELECT doc_id, trim(kind) AS plain, true AS speakable, trim(book) AS first_line FROM documents WHERE book IS NOT NULL")
def line_decoration(spark, sf):
    d = read(spark, sf, "documents").where("book is not null")
    t = F.concat(F.lit("## **"), "kind", F.lit("** "))
    return d.select("doc_id", T.strip_decoration(t).alias("plain"), T.speakable(F.concat("kind", F.lit(" (aloud)"))).alias("speakable"), T.first_line(F.concat(F.lit("\n  \n\""), "book", F.lit("\"\nmore"))).alias("first_line"))


@query("abnormal_image_prompts", "SELECT DISTINCT id, p = '' OR lower(p) IN ('...', 'null', 'none', '<t2i>', 'dummy', 'a', 'an') OR len(list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '')) < 6 OR (q <> '' AND lower(p) = q) OR regexp_matches(p, '^[\"“''‘]') OR regexp_matches(lower(p), '^(?:oh|i''m|i am|he said|she said|rabbit said|the rabbit said)') OR regexp_matches(p, '[{}\\[\\]]') OR contains(p, ' + ') OR contains(p, '\": \"') OR NOT regexp_matches(lower(p), 'illustration|scene|background|lighting|storybook|style|character|indoor|outdoor|warm|colorful|expression|pose|detailed|rabbit|animal|forest|room|garden|moonlight|composition') AS abnormal FROM (SELECT id, trim(coalesce(scene, '')) AS p, lower(trim(coalesce(speech_utterance, ''))) AS q FROM dataset)")
def abnormal_image_prompts(spark, sf):
    return read(spark, sf, "dataset").select("id", T.abnormal_prompt("scene", "speech_utterance").alias("abnormal")).distinct()


@query("enum_defaults", "SELECT speaker_id, CASE WHEN emotion IN ('angry', 'happy', 'neutral', 'sad') THEN emotion ELSE 'neutral' END AS emotion, CASE WHEN speed IN ('normal', 'slow', 'fast') THEN speed ELSE 'normal' END AS speed, CASE WHEN pitch IN ('normal', 'high', 'low') THEN pitch ELSE 'normal' END AS pitch, CASE WHEN gender IN ('male', 'female') THEN gender ELSE 'female' END AS gender FROM speaker_metadata")
def enum_defaults(spark, sf):
    d = read(spark, sf, "speaker_metadata")
    return d.select("speaker_id", T.enum_or("emotion", ("angry", "happy", "neutral", "sad"), "neutral").alias("emotion"), T.enum_or("speed", ("normal", "slow", "fast"), "normal").alias("speed"), T.enum_or("pitch", ("normal", "high", "low"), "normal").alias("pitch"), T.enum_or("gender", ("male", "female"), "female").alias("gender"))


@query("voice_pick", "SELECT name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(name), ''), lambda d: (strpos('0123456789abcdef', d) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 3) AS voice FROM (SELECT DISTINCT name FROM speaker_metadata WHERE name IS NOT NULL)")
def voice_pick(spark, sf):
    return read(spark, sf, "speaker_metadata").where("name is not null").select("name").distinct().select("name", T.voice_number("name", 3).alias("voice"))


@query("natural_sort_first", "SELECT o_custkey, min(f) FILTER (WHERE true) AS lexical_first, arg_min(f, n) AS natural_first FROM (SELECT o_custkey, 'page_' || (o_orderkey % 211)::VARCHAR || '.txt' AS f, o_orderkey % 211 AS n FROM orders) GROUP BY o_custkey")
def natural_sort_first(spark, sf):
    d = read(spark, sf, "orders").select("o_custkey", F.concat(F.lit("page_"), (F.col("o_orderkey") % 211).cast("string"), F.lit(".txt")).alias("f"))
    return d.groupBy("o_custkey").agg(F.min("f").alias("lexical_first"), F.min_by("f", T.natural_key("f")).alias("natural_first"))


@query("base64_sizes", "SELECT doc_id, (4 * ((octet_length(encode(text)) + 2) // 3))::BIGINT AS size, length(to_base64(encode(text)))::BIGINT AS measured FROM documents WHERE text IS NOT NULL")
def base64_sizes(spark, sf):
    d = read(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", T.base64_size(F.octet_length("text")).alias("size"), F.length(F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")).cast("bigint").alias("measured"))


@query("fit_sizes", "SELECT p_partkey, CASE WHEN tw / w < th / h THEN tw ELSE least(ceil(w * (th / h)), tw) END::BIGINT AS width, CASE WHEN tw / w < th / h THEN least(ceil(h * (tw / w)), th) ELSE th END::BIGINT AS height FROM (SELECT p_partkey, p_size::DOUBLE AS w, (p_partkey % 97 + 1)::DOUBLE AS h, 336.0::DOUBLE AS tw, 672.0::DOUBLE AS th FROM part)")
def fit_sizes(spark, sf):
    d = read(spark, sf, "part")
    s = T.fit_size(F.col("p_size").cast("double"), (F.col("p_partkey") % 97 + 1).cast("double"), F.lit(336.0), F.lit(672.0))
    return d.select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))
