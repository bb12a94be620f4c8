"""Queries over stated cases: near-JSON, quotes, transcripts, media files, decoding; each with its expected rows as SQL."""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import functions as F

from quillspark.functions import judgejson as J
from quillspark.functions import text as T
from quillspark.operators import prompts as R
from quillspark.operators import sequence as Q
from quillspark.plans.registry import registry
from quillspark.session import read
from quillspark.sources import readers

QUERIES, ORACLE, query = registry()


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) v({columns})"


# ---- near-JSON: what a judge may write, and what it is read as

_GOOD = {c: {"score": n + 5, "rationale": f"because of part {n}"} for n, c in enumerate(J.CATEGORIES["text"])}
_TEXT = json.dumps(_GOOD)
_NAMES = J.CATEGORIES["text"]

#: (name, response, parse_status, scores of the four categories or None, rationale of the second).
JUDGED = [
    ("exact", _TEXT, "direct", "5,6,7,8", "because of part 1"),
    ("indented", json.dumps(_GOOD, indent=3), "direct", "5,6,7,8", "because of part 1"),
    ("other order", json.dumps(dict(reversed(_GOOD.items()))), "direct", "5,6,7,8", "because of part 1"),
    ("space around", f"\n  {_TEXT} \n", "direct", "5,6,7,8", "because of part 1"),
    ("last brace lost", _TEXT[:-1], "normalized", "5,6,7,8", "because of part 1"),
    ("two braces lost", _TEXT[:-2], "normalized", "5,6,7,8", "because of part 1"),
    ("cut in a string", _TEXT[:-6], "unresolved", None, None),
    ("cut before a value", _TEXT[: _TEXT.rindex(":")], "unresolved", None, None),
    ("inner quotes", _TEXT.replace("because of part 1", 'she said "go, now" and left'), "normalized", "5,6,7,8", 'she said "go, now" and left'),
    ("inner quotes at the end", _TEXT.replace("because of part 1", 'the line is "run"'), "normalized", "5,6,7,8", 'the line is "run"'),
    ("escaped quotes", _TEXT.replace("because of part 1", 'the line is \\"run\\"'), "direct", "5,6,7,8", 'the line is "run"'),
    ("fenced", f"```json\n{_TEXT}\n```", "normalized", "5,6,7,8", "because of part 1"),
    ("fenced with words", f"Here it is:\n```\n{_TEXT}\n```\nDone.", "normalized", "5,6,7,8", "because of part 1"),
    ("inside prose", f"My view: {_TEXT} That is all.", "normalized", "5,6,7,8", "because of part 1"),
    ("python literals", str(_GOOD), "normalized", "5,6,7,8", "because of part 1"),
    ("typographic quotes", _TEXT.replace('"', "”"), "normalized", "5,6,7,8", "because of part 1"),
    ("trailing commas", _TEXT.replace("}", ",}"), "normalized", "5,6,7,8", "because of part 1"),
    ("wrapped", json.dumps({"result": [_GOOD]}), "normalized", "5,6,7,8", "because of part 1"),
    ("extra key", json.dumps(_GOOD | {"overall": 7}), "normalized", "5,6,7,8", "because of part 1"),
    ("keys spelled otherwise", _TEXT.replace("natural_flow_from", "Natural Flow-From"), "normalized", "5,6,7,8", "because of part 1"),
    ("misspelled key", _TEXT.replace('"satisfaction_of', '"atisfaction_of'), "normalized", "5,6,7,8", "because of part 1"),
    ("rating and reason", _TEXT.replace('"score"', '"rating"').replace('"rationale"', '"reason"'), "normalized", "5,6,7,8", "because of part 1"),
    ("score as text", _TEXT.replace('"score": 6', '"score": "6"'), "normalized", "5,6,7,8", "because of part 1"),
    ("score as a float", _TEXT.replace('"score": 6', '"score": 6.0'), "normalized", "5,6,7,8", "because of part 1"),
    ("score of 10", _TEXT.replace('"score": 6', '"score": 10'), "direct", "5,10,7,8", "because of part 1"),
    ("score and a half", _TEXT.replace('"score": 6', '"score": 6.5'), "unresolved", None, None),
    ("score true", _TEXT.replace('"score": 6', '"score": true'), "unresolved", None, None),
    ("score 0", _TEXT.replace('"score": 6', '"score": 0'), "unresolved", None, None),
    ("score 11", _TEXT.replace('"score": 6', '"score": 11'), "unresolved", None, None),
    ("score null", _TEXT.replace('"score": 6', '"score": null'), "unresolved", None, None),
    ("blank rationale", _TEXT.replace("because of part 1", " "), "unresolved", None, None),
    ("a category lost", json.dumps({k: v for k, v in _GOOD.items() if k != _NAMES[1]}), "unresolved", None, None),
    ("a list of numbers", "[5, 6, 7, 8]", "unresolved", None, None),
    ("prose", "I would give it a five.", "unresolved", None, None),
    ("blank", "  \n", "unresolved", None, None),
    ("empty", "", "unresolved", None, None),
    ("null", None, "unresolved", None, None),
]


@query("judge_json_cases", _values("name, status, parse_status, scores, rationale", [(n, "parse_error" if p == "unresolved" else "ok", p, s, r) for n, _, p, s, r in JUDGED]))
def judge_json_cases(spark, sf):
    """The tolerant reader over stated responses: status, scores and one rationale of each."""
    d = spark.createDataFrame([(n, t) for n, t, *_ in JUDGED], "name string, raw string")
    p = d.select("name", J.parse_column("raw", F.lit("text")).alias("p"))
    scores = F.when(F.col("p.judge_eval").isNotNull(), F.array_join(F.array(*[F.try_element_at("p.judge_eval", F.lit(c))["score"].cast("string") for c in _NAMES]), ","))
    return p.select("name", "p.status", "p.parse_status", scores.alias("scores"), F.try_element_at("p.judge_eval", F.lit(_NAMES[1]))["rationale"].alias("rationale"))


#: (name, record's response, repair's answer, status, parse_status, repair_status).
REPAIRED = [
    ("good before", _TEXT, _TEXT, "ok", "direct", "not_needed"),
    ("repaired", "five", _TEXT, "ok", "repaired", "succeeded"),
    ("repaired near-JSON", "five", _TEXT[:-1], "ok", "repaired", "succeeded"),
    ("given up", "five", '{"unrecoverable": true}', "parse_error", "unresolved", "unrecoverable"),
    ("no better", "five", "six", "parse_error", "unresolved", "failed"),
    ("not asked", "five", None, "parse_error", "unresolved", "pending"),
]


@query("repair_cases", _values("name, status, parse_status, repair_status", [(n, *x) for n, _, _, *x in REPAIRED]))
def repair_cases(spark, sf):
    """Records after the answers of a repair."""
    d = spark.createDataFrame([x[:3] for x in REPAIRED], "name string, raw string, repair string")
    d = d.select("name", J.parse_column("raw", F.lit("text")).alias("record"), "repair")
    return d.select("name", J.repair_column(F.col("record"), F.col("repair"), F.lit("text")).alias("r")).select("name", "r.status", "r.parse_status", "r.repair_status")


@query("repair_pass_cases", _values("name, status, parse_status, repair_status", [("direct", "ok", "direct", "not_needed"), ("mended", "ok", "repaired", "succeeded"), ("beyond repair", "parse_error", "unresolved", "unrecoverable"), ("no help", "parse_error", "unresolved", "failed"), ("empty", "parse_error", "unresolved", "pending"), ("model fails", "parse_error", "unresolved", "pending")]))
def repair_pass_cases(spark, sf):
    """A repair model from request to record: a model for tests that knows what to answer."""
    from quillspark.operators import inference as I

    rows = [(1, "direct", _TEXT), (2, "mended", "mend: five"), (3, "beyond repair", "lost"), (4, "no help", "odd: five"), (5, "empty", " "), (6, "model fails", "raise")]
    good = _TEXT

    def make():
        def model(items: list) -> list[str]:
            if any("Response: raise" in x for x in items):
                raise RuntimeError("cannot answer")
            return [good if "Response: mend" in x else '{"unrecoverable": true}' if "Response: lost" in x else "five" for x in items]

        return model

    d = spark.createDataFrame(rows, "k bigint, name string, raw string").withColumn("modality", F.lit("text"))
    d = d.withColumn("record", J.parse_column("raw", "modality"))
    got = I.repair_pass(d, I.Adapter("mender", "Mender-1", "text", ("text",), make), "k", "raw", "modality")
    return got.select("name", "record.status", "record.parse_status", "record.repair_status")


#: (answer, JSON object, how it was read).
EFFORTS = [
    ('{"a": 1}', '{"a": 1}', "whole"),
    ('```json\n{"a": 1}\n```', '{"a": 1}', "fenced"),
    ('Sure: {"a": {"b": 1}} done', '{"a": {"b": 1}}', "outer"),
    ("{'a': True,}", '{"a": true}', "tolerant"),
    ('{"a": "x", "b": [1, 2', '{"a": "x", "b": [1, 2]}', "tolerant"),
    ('{"a": "cut o', None, "none"),
    ("[1, 2]", None, "none"),
    ("nothing", None, "none"),
    (None, None, "none"),
]


@query("best_effort_cases", _values("n, json, how", [(n, *x[1:]) for n, x in enumerate(EFFORTS)]))
def best_effort_cases(spark, sf):
    from quillspark.functions import generation as G

    d = spark.createDataFrame([(n, x[0]) for n, x in enumerate(EFFORTS)], "n int, t string")
    return d.select("n", G.best_effort_column("t").alias("r")).select("n", "r.json", "r.how")


@query("judge_requests", "SELECT DISTINCT id, CASE WHEN trim(coalesce(current_text, '')) = '' THEN '' ELSE '## Current page' || chr(10) || trim(regexp_replace(current_text, '^\\s+|\\s+$', '', 'g')) || chr(10) || chr(10) END || '## Scene' || chr(10) || trim(scene) AS asked, true AS has_form FROM dataset WHERE id IS NOT NULL AND trim(coalesce(scene, '')) <> ''")
def judge_requests(spark, sf):
    """What a judge is asked about each page, of any modality in turn."""
    d = read(spark, sf, "dataset").where("id is not null and trim(coalesce(scene, '')) <> ''").dropDuplicates(["id"])
    kinds = F.array(*map(F.lit, J.CATEGORIES))
    m = R.judge_request(F.element_at(kinds, (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")), {"Current page": "current_text", "Scene": "scene"})
    return d.select("id", m.alias("m")).select("id", F.get("m", F.lit(1))["content"].alias("asked"), F.contains(F.get("m", F.lit(0))["content"], F.lit("alignment_with_metadata")).alias("has_form"))


# ---- quotes

#: (text, all pairs off, one straight pair off, first quoted span).
QUOTED = [
    ("plain", "plain", "plain", ""),
    ('"one"', "one", "one", "one"),
    ("'one'", "one", "one", "one"),
    ("“one”", "one", "“one”", "one"),
    ("「one」", "one", "「one」", "one"),
    ("『 one 』", "one", "『 one 』", "one"),
    ('"\'“one”\'"', "one", "'“one”'", "one"),
    ('" \' one \' "', "one", "' one '", "one"),
    ('"""""""""one"""""""""', "one", '""""""""one""""""""', "one"),
    ('"one', '"one', '"one', ""),
    ('one"', 'one"', 'one"', ""),
    ('"', '"', '"', ""),
    ('""', "", "", ""),
    ('She said "go" and "stay".', 'She said "go" and "stay".', 'She said "go" and "stay".', "go"),
    ("It's Ann's 'own' one", "It's Ann's 'own' one", "It's Ann's 'own' one", "own"),
    ("‘don’t go’ he said", "‘don’t go’ he said", "‘don’t go’ he said", "don’t go"),
    ("don't, can't", "don't, can't", "don't, can't", ""),
    ('a \\"b\\" "c"', 'a \\"b\\" "c"', 'a \\"b\\" "c"', 'b\\"'),
    ("  spaced  ", "spaced", "spaced", ""),
    ("", "", "", ""),
    (None, "", "", ""),
]


@query("quote_cases", _values("n, all_pairs, one_pair, quote", [(n, *x[1:]) for n, x in enumerate(QUOTED)]))
def quote_cases(spark, sf):
    d = spark.createDataFrame([(n, x[0]) for n, x in enumerate(QUOTED)], "n int, t string")
    return d.select("n", T.strip_quotes("t").alias("all_pairs"), T.strip_quotes_once("t").alias("one_pair"), T.first_quoted("t").alias("quote"))


#: (text, quote, the text with the quote in it).
SPOKEN_IN = [
    ('He said "go".', "go", 'He said "go".'),
    ('He said "go".', "stay", 'He said "stay".'),
    ("He said “go” twice “go”.", "stay", 'He said "stay" twice “go”.'),
    ("He left.", "stay", 'He left. "stay"'),
    ("He left", "'stay'", 'He left. "stay"'),
    ("He'll leave!", "“stay”", 'He\'ll leave! "stay"'),
]


@query("ensure_quote_cases", _values("n, page", [(n, x[2]) for n, x in enumerate(SPOKEN_IN)]))
def ensure_quote_cases(spark, sf):
    d = spark.createDataFrame([(n, *x[:2]) for n, x in enumerate(SPOKEN_IN)], "n int, t string, q string")
    return d.select("n", T.ensure_quote("t", "q").alias("page"))


_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


@query("wrapping_quotes", f"""WITH RECURSIVE d AS (SELECT DISTINCT id, coalesce(speech_utterance, '') AS own FROM dataset WHERE id IS NOT NULL),
q AS (SELECT id, own, {_STRIP("'\"“' || own || '” \"'")} AS t, 0 AS k FROM d UNION ALL
SELECT id, own, {_STRIP("substr(t, 2, length(t) - 2)")}, k + 1 FROM q WHERE length(t) >= 2 AND regexp_matches(t, '(?s)^(?:".*"|''.*''|“.*”|‘.*’|「.*」|『.*』)$'))
SELECT id, own, arg_max(t, k) AS all_pairs, CASE WHEN length(u) >= 2 AND regexp_matches(u, '(?s)^(?:".*"|''.*'')$') THEN {_STRIP("substr(u, 2, length(u) - 2)")} ELSE u END AS one_pair
FROM q JOIN (SELECT id, own, {_STRIP('own')} AS u FROM d) USING (id, own) GROUP BY id, own, u""")
def wrapping_quotes(spark, sf):
    """Every utterance with two more pairs around it, all pairs taken off; and its own straight pair alone."""
    d = read(spark, sf, "dataset").where("id is not null").select("id", F.coalesce("speech_utterance", F.lit("")).alias("own")).distinct()
    return d.select("id", "own", T.strip_quotes(F.concat(F.lit('"“'), "own", F.lit('” "'))).alias("all_pairs"), T.strip_quotes_once("own").alias("one_pair"))


# ---- transcripts

#: (transcript, as it is compared, the same with misread characters repaired and folded to ASCII).
SPOKEN = [
    ("I'm here, don't go!", "i am here, do not go", "i am here, do not go"),
    ("[door] Um, (softly) hello", ", hello", ", hello"),
    ("It costs 1,250.50 dollars.", "it costs 1250.50 dollars", "it costs 1250.50 dollars"),
    ("100% of $5", "100% of $5", "100% of $5"),
    ("Café “naïve”", "café naïve", "cafe naive"),
    ("CafÃ© now", "cafã now", "cafe now"),
    ("It’s  late…", "its late", "it is late"),
    ("", "", ""),
    (None, "", ""),
]


@query("transcript_cases", _values("n, spoken, plain", [(n, *x[1:]) for n, x in enumerate(SPOKEN)]))
def transcript_cases(spark, sf):
    d = spark.createDataFrame([(n, x[0]) for n, x in enumerate(SPOKEN)], "n int, t string")
    return d.select("n", T.speech_text("t").alias("spoken"), T.speech_text("t", ascii=True).alias("plain"))


#: (answer, its reasoning field, answer without reasoning, reasoning).
THOUGHT = [
    ("<think>a\nb</think> yes", None, "yes", "a\nb"),
    ("<think>a</think>no<think>b</think>", "", "no", "a\nb"),
    ("yes <think>never closed", None, "yes", "never closed"),
    ("yes", "because", "yes", "because"),
    ("<think>a</think>yes", " given ", "yes", "given"),
    ("yes</think>", None, "yes", ""),
    (None, None, "", ""),
]


@query("reasoning_cases", _values("n, answer, thought", [(n, *x[2:]) for n, x in enumerate(THOUGHT)]))
def reasoning_cases(spark, sf):
    d = spark.createDataFrame([(n, *x[:2]) for n, x in enumerate(THOUGHT)], "n int, t string, r string")
    return d.select("n", T.strip_think("t").alias("answer"), T.reasoning("t", "r").alias("thought"))


@query("flattened_answers", "SELECT result_id, CASE WHEN result_id % 4 = 0 THEN NULL WHEN coalesce(trim(regexp_replace(raw_response, '[\\s\\x{a0}]+', ' ', 'g')), '') = '' AND coalesce(trim(status), '') = '' THEN NULL ELSE true END AS ok, CASE WHEN result_id % 4 = 0 THEN 'stopped at the limit of 512 tokens' WHEN coalesce(trim(regexp_replace(raw_response, '[\\s\\x{a0}]+', ' ', 'g')), '') = '' AND coalesce(trim(status), '') = '' THEN 'empty answer' END AS error FROM (SELECT DISTINCT result_id, raw_response, status FROM judge_results)")
def flattened_answers(spark, sf):
    """Responses as messages: their parts joined, those that stopped for their length as errors."""
    d = read(spark, sf, "judge_results").select("result_id", "raw_response", "status").distinct()
    none = F.lit(None).cast("string")
    text = R.flattened(F.col("raw_response"), none, F.col("status"), none)
    r = R.answer_or_error(text, F.when(F.col("result_id") % 4 == 0, "length").otherwise("stop"), F.lit(512))
    return d.select("result_id", r.alias("r")).select("result_id", F.when(F.col("r.text").isNotNull(), True).alias("ok"), F.col("r.error").alias("error"))


# ---- media


def _wav(frames: int, rate: int = 16000, channels: int = 1, bits: int = 16, extra: bytes = b"", lost: int = 0) -> bytes:
    size = channels * bits // 8
    data = bytes(frames * size)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * size, size, bits) + extra + b"data" + struct.pack("<I", len(data)) + data
    return (b"RIFF" + struct.pack("<I", len(body)) + body)[: -lost or None]


def _png(width: int, height: int, lost: int = 0, wrong: bool = False) -> bytes:
    chunk = lambda name, d: struct.pack(">I", len(d)) + name + d + struct.pack(">I", zlib.crc32(name + d) ^ (1 if wrong and name == b"IHDR" else 0))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes((width + 1) * height))) + chunk(b"IEND", b"")
    return raw[: -lost or None]


#: (name, modality, content, problem, width or frames, height or rate).
MEDIA = [
    ("png", "image", _png(3, 2), None, 3, 2),
    ("png cut", "image", _png(3, 2, lost=5), "image", 3, 2),
    ("png header damaged", "image", _png(3, 2, wrong=True), "image", 3, 2),
    ("png head alone", "image", _png(3, 2)[:12], "image", None, None),
    ("wav", "speech", _wav(800), None, 800, 16000),
    ("wav stereo", "speech", _wav(50, 8000, 2, 8), None, 50, 8000),
    ("wav with a list before its data", "speech", _wav(80, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"), None, 80, 16000),
    ("wav cut", "speech", _wav(800, lost=400), None, 600, 16000),
    ("wav empty", "speech", _wav(0), "frames", 0, 16000),
    ("wav head alone", "speech", _wav(10)[:12], "frames", None, None),
    ("nothing", "image", b"", None, None, None),
    ("null", "speech", None, None, None, None),
]


@query("media_cases", _values("name, problem, first_size, second_size", [(n, p, a, b) for n, _, _, p, a, b in MEDIA]))
def media_cases(spark, sf):
    """PNG and WAV files read by their chunks."""
    d = spark.createDataFrame([x[:3] for x in MEDIA], "name string, modality string, content binary")
    w, p = readers.wav_facts("content"), readers.png_facts("content")
    return d.select("name", readers.broken_media("modality", "content").alias("problem"), F.coalesce(p["width"], w["frames"]).alias("first_size"), F.coalesce(p["height"], w["rate"]).alias("second_size"))


# ---- decoding and sequences


@query("constrained_tokens", "SELECT o_custkey, max_by(o_orderkey, (o_totalprice, -o_orderkey)) FILTER (o_orderkey % 3 = 0 OR o_orderkey = 1)::BIGINT AS o_orderkey FROM orders GROUP BY o_custkey")
def constrained_tokens(spark, sf):
    """Of each step's candidates the best that the vocabulary allows."""
    o = read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice")
    v = o.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "<|unit_").otherwise("<|word_"), F.col("o_orderkey").cast("string"), F.lit("|>")).alias("name"))
    return Q.constrained(o, ["o_custkey"], "o_orderkey", "o_totalprice", Q.allowed(v, "name", "o_orderkey", "<|unit_", end=1))


@query("padded_prompts", "WITH t AS (SELECT o_custkey, list(o_orderkey::BIGINT ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN len(t) <= 16 THEN list_concat([7::BIGINT], list_concat(list_resize([]::BIGINT[], 16 - len(t), 0), list_concat(t, [9::BIGINT]))) END AS tokens, CASE WHEN len(t) <= 16 THEN len(t) + 2 END AS attended, CASE WHEN len(t) <= 16 THEN 1 + 16 - len(t) END AS start, len(t) > 16 AS too_long FROM t")
def padded_prompts(spark, sf):
    d = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("bigint"))).alias("t"))
    one = lambda k: F.array(F.lit(k).cast("bigint"))
    p = Q.padded_prompt(one(7), F.col("t"), 16, 0, one(9))
    return d.select("o_custkey", p.alias("p")).select("o_custkey", "p.tokens", F.size(F.filter("p.attention", lambda x: x == 1)).alias("attended"), "p.start", "p.too_long").withColumn("attended", F.when(F.col("tokens").isNotNull(), F.col("attended")))


@query("shared_packs")
def shared_packs(spark, sf):
    """Documents of all sources in two open sequences, and what each source gave to them."""
    d = read(spark, sf, "documents").select(F.lit(0).alias("g"), "doc_id", F.coalesce("source", F.lit("?")).alias("source"), "n_chars")
    p = Q.pack_shared(d, ["g"], ["doc_id"], "doc_id", "n_chars", 4096, 2, "source", emit_tail=True)
    return Q.pack_statistics(d, p, "source", "n_chars", 4096)


@query("natural_names", "SELECT name, row_number() OVER (ORDER BY repeat('0', 40 - length(d)) || d, z DESC) AS place FROM (SELECT lpad('', (o_orderkey % 4)::INT, '0') || o_orderkey || '00000000000000000000' || o_custkey || '.txt' AS name, o_orderkey || '00000000000000000000' || o_custkey AS d, lpad('', (o_orderkey % 4)::INT, '0') AS z FROM orders)")
def natural_names(spark, sf):
    """Names with numbers of more than twenty digits in their natural order."""
    from quillspark.operators.contracts import ordinals

    zeros = F.lpad(F.lit(""), (F.col("o_orderkey") % 4).cast("int"), F.lit("0"))
    d = read(spark, sf, "orders").select(F.concat(zeros, F.col("o_orderkey").cast("string"), F.lit("0" * 20), F.col("o_custkey").cast("string"), F.lit(".txt")).alias("name"))
    return ordinals(d.withColumn("k", T.natural_key("name")), ["k", "name"], "place").select("name", (F.col("place") + 1).alias("place"))
