"""Packing with several open sequences, runs over batch borders, repairs, listings, media, decoding and tables' life."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import skew
from quillspark.functions import text as T
from quillspark.operators import contracts as K
from quillspark.operators import sequence as Q
from quillspark.plans import corpora, records
from quillspark.sources import readers
from quillspark.streaming import status


@pytest.mark.parametrize("name", sorted(set(corpora.QUERIES) & set(corpora.ORACLE) - {"wrapping_quotes", "flattened_answers", "constrained_tokens", "padded_prompts", "natural_names", "judge_requests"}))
def test_stated_cases(spark, name):
    import duckdb

    from tests.test_entry import plain

    df = corpora.QUERIES[name](spark, "")
    cur = duckdb.sql(corpora.ORACLE[name])
    order = [cur.columns.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)


def packed(rows, most, buffers):
    """A plain loop over one group: (key, pack, at) of all rows."""
    fills, numbers, out, following = [0] * buffers, list(range(buffers)), [], buffers
    for key, n in rows:
        if n is None or n > most:
            continue
        k = fills.index(min(fills))
        if fills[k] + n > most:
            k = fills.index(max(fills))
            fills[k], numbers[k], following = 0, following, following + 1
        out.append((key, numbers[k], fills[k]))
        fills[k] += n
    return out


@pytest.mark.parametrize("buffers", [1, 2, 5])
def test_shared_packs_equal_a_plain_loop(spark, buffers):
    r = random.Random(buffers)
    rows = [(g, k, r.choice(["a", "b"]), r.choice([None, 5000, *range(1, 900)])) for g in ("x", "y") for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k bigint, source string, n int").repartition(3)
    got = Q.pack_shared(df, ["g"], ["k"], "k", "n", 1000, buffers, "source", emit_tail=True)
    want = {(g, *x) for g in ("x", "y") for x in packed([(k, n) for h, k, _, n in rows if h == g], 1000, buffers)}
    assert {(x.g, x.k, x.pack, x["at"]) for x in got.collect()} == want
    open_ = {(x.g, x.pack) for x in got.select("g", "pack").distinct().collect()} - {(x.g, x.pack) for x in Q.pack_shared(df, ["g"], ["k"], "k", "n", 1000, buffers).select("g", "pack").distinct().collect()}
    assert len(open_) == 2 * buffers
    one = df.where("g = 'x'")
    stats = {x.source: x for x in Q.pack_statistics(one, got.where("g = 'x'"), "source", "n", 1000, buffers).collect()}
    assert sum(x.joint for x in stats.values()) == sum(1 for x in want if x[0] == "x" and x[3] == 0 and x[2] >= buffers)
    assert sum(x.unjoint for x in stats.values()) == sum(1 for h, _, _, n in rows if h == "x" and n is not None and n <= 1000)
    assert Q.pack_shared(df.where("false"), ["g"], ["k"], "k", "n", 1000).count() == 0


def runs_of(values):
    return [(v, len(list(g))) for v, g in itertools.groupby(values)]


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_over_batch_borders(spark, tiny_batches):
    r = random.Random(5)
    rows = [("hot" if k < 300 else r.choice(["u", "v", None]), k, r.choice(["a", "a", "a", "b", None])) for k in range(420)]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    got = {}
    for x in Q.runs(df, ["g"], ["k"], "v").orderBy("g", "run").collect():
        got.setdefault(x.g, []).append((x.v, x.n))
    assert got == {g: runs_of([v for h, _, v in rows if h == g]) for g in ("hot", "u", "v", None)}


def test_streamed_runs_in_order_over_batches(spark, tmp_path, tiny_batches):
    """One trigger with far more rows of a user than an Arrow batch holds, in any order; the next goes on with the open run."""
    r = random.Random(6)
    events = [(k, k % 3, r.choice(["x", "x", "y"])) for k in range(600)]
    schema = "event_id bigint, user_id bigint, event_type string, ts bigint"
    for n, part in enumerate((events[:450], events[450:])):
        part = r.sample(part, len(part))
        spark.createDataFrame([(k, u, t, k) for k, u, t in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        for f in os.listdir(f"{tmp_path}/in/{n}"):
            if f.endswith(".parquet"):
                os.utime(f"{tmp_path}/in/{n}/{f}", (1_700_000_000 + n * 100,) * 2)
    s = status.event_stream(spark, f"{tmp_path}/in/*", schema, files_a_trigger=1)
    got = {}
    for x in status.collected(status.runs(s), f"runs_{random.randrange(10**9)}", "append", f"{tmp_path}/c").collect():
        got.setdefault(x.user_id, []).append((x.event_type, x.n))
    assert {u: sorted(x) for u, x in got.items()} == {u: sorted(runs_of([t for _, v, t in events if v == u])[:-1]) for u in range(3)}


def test_streamed_runs_of_many_files_go_to_files(spark, tmp_path):
    """Users whose rows lie in twelve files in no order of time; the result is in files, not with the driver."""
    r = random.Random(8)
    events = [(k, k % 5, r.choice(["x", "x", "y"]), k) for k in range(600)]
    for n in range(12):
        spark.createDataFrame(events[-1 - n :: -12], "event_id bigint, user_id bigint, event_type string, ts bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    df = records.QUERIES["stream_runs"](spark, str(tmp_path))
    assert df.columns == ["user_id", "event_type", "n"] and df.inputFiles()
    got = {}
    for x in df.collect():
        got.setdefault(x.user_id, []).append((x.event_type, x.n))
    assert {u: sorted(x) for u, x in got.items()} == {u: sorted(runs_of([t for _, v, t, _ in events if v == u])[:-1]) for u in range(5)}


def test_last_runs_come_after_a_silence(spark, tmp_path):
    import time

    schema = "event_id bigint, user_id bigint, event_type string, ts bigint"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    put(0, [(1, 1, "x", 1), (2, 1, "x", 2), (3, 1, "y", 3)])
    s = status.event_stream(spark, f"{tmp_path}/in/*", schema)
    name = f"quiet_{random.randrange(10**9)}"
    q = status.runs(s, "1 second").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        ends = time.time() + 60
        while time.time() < ends and spark.table(name).count() < 2:
            time.sleep(0.5)
        assert sorted(map(tuple, spark.table(name).collect())) == [(1, "x", 2), (1, "y", 1)]
    finally:
        q.stop()


def test_targeted_repair(spark):
    rows = [("a", [{"name": "A", "speech_intent": ""}, {"name": "B", "speech_intent": "x"}]), ("b", [{"name": "A", "speech_intent": ""}, {"name": "B", "speech_intent": ""}]), ("c", [{"name": "A"}]), ("d", None), ("e", [{"speech_intent": ""}])]
    df = spark.createDataFrame(rows, "id string, c array<map<string,string>>")
    got = {x.id: x.c for x in K.targeted_repair(df, "id", "c", "speech_intent", ["a", "e"]).collect()}
    assert got["a"] == [{"name": "A"}, {"name": "B", "speech_intent": "x"}] and got["e"] == [{}] and got["b"] == rows[1][1] and got["d"] is None
    for ids, said in ((["b"], "2 objects"), (["c"], "0 objects"), (["z"], "no row"), (["d"], "0 objects")):
        with pytest.raises(K.ContractError, match=said):
            K.targeted_repair(df, "id", "c", "speech_intent", ids)
    with pytest.raises(K.ContractError, match="2 rows"):
        K.targeted_repair(df.unionByName(df), "id", "c", "speech_intent", ["a"])


def test_paths_and_trees(spark):
    files = spark.createDataFrame([("/root/x/a.png", 5), ("/root/x/b.png", 0), ("/root/x/d/c.txt", 3)], "path string, length bigint")
    df = spark.createDataFrame([("1", "a.png", ".//d\\c.txt"), ("2", "b.png", None), ("3", "/abs", "../up"), ("4", "no.png", "a.png")], "id string, p string, q string")
    got = {(x.id, x.column): x.problem for x in K.file_problems(df, "id", ["p", "q"], files, "/root/x").collect()}
    assert got == {("2", "p"): "empty", ("2", "q"): "blank", ("3", "p"): "absolute", ("3", "q"): "escape", ("4", "p"): "missing"}
    tree = spark.createDataFrame([("a/1.txt",), ("a/x.tmp",), ("b",)], "path string")
    assert {(x.path, x.problem) for x in K.tree_problems(tree, ["a/*.txt", "b"], ["b"]).collect()} == {("a/x.tmp", "unexpected"), ("b", "link")}


def test_listings(spark):
    names = ["data/a.parquet", "data/b.json", "README"]
    remote = spark.createDataFrame([(n, 10, "s", None) for n in names], "name string, size bigint, sha256 string, blob_sha1 string")
    assert {x.name for x in readers.selected(remote, ["data/*"]).collect()} == set(names[:2]) and readers.selected(remote).count() == 3
    for bad in (("../x", 1, "s", None), ("/x", 1, "s", None), ("a\\b", 1, "s", None), ("x", None, "s", None), ("x", 1, None, None)):
        with pytest.raises(ValueError):
            readers.selected(remote.unionByName(spark.createDataFrame([bad], remote.schema)))
    have = spark.createDataFrame([("data/a.parquet", 10), ("data/b.json", 4), ("README", 40)], "name string, length bigint")
    assert {(x.name, x.status, x.offset) for x in readers.to_fetch(remote, have).collect()} == {("data/a.parquet", "done", 0), ("data/b.json", "partial", 4), ("README", "absent", 0)}
    assert tuple(readers.totals(remote.unionByName(remote)).first()) == (6, 3, 30)
    index = spark.createDataFrame([("t1", "data/a.parquet"), ("t2", "data/a.parquet"), ("t3", "lost")], "tensor string, shard string")
    assert tuple(readers.shard_totals(index, have).first()) == (3, 2, 10, 1)


def test_lines_and_manifests(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"a": {k}}}\n\n' for k in range(50)) + "oops\n")
    got = readers.numbered_lines(spark, f"{tmp_path}/a.jsonl", "a int").orderBy("ordinal").collect()
    assert [x.ordinal for x in got] == list(range(51)) and [x.a for x in got] == [*range(50), None] and got[50].raw == "oops"
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "dataset": {"root": "r", "record_count": 2}, "records": [{"id": "a"}, {"id": "b"}]}))
    assert [x.id for x in readers.by_suffix(spark, f"{tmp_path}/m.json").orderBy("position").collect()] == ["a", "b"]
    assert readers.records(spark, f"{tmp_path}/m.json", 1, "r").count() == 2
    spark.createDataFrame([tuple("x" * len(readers.INDEX))], ", ".join(f"{c} string" for c in readers.INDEX)).write.parquet(f"{tmp_path}/set/data")
    assert readers.records(spark, f"{tmp_path}/set").count() == 1


def test_shrink_steps(spark):
    d = spark.createDataFrame([(1000, 800, 10), (1000, 800, 10_000)], "w int, h int, n bigint")
    small, big = (x[0] for x in d.select(readers.shrink_steps(F.col("w"), F.col("h"), F.col("n"), 5_000)).collect())
    assert [tuple(s) for s in small] == [(1000, 800, 95)]
    assert [s.quality for s in big[:5]] == [95, 80, 65, 50, 35] and tuple(big[5]) == (750, 600, 35) and min(min(s.width, s.height) for s in big) >= 64


def test_decoding(spark):
    v = spark.createDataFrame([(5, "<|u_0|>"), (6, "<|u_1|>"), (7, "word"), (None, "<|u_2|>"), (9, None)], "t bigint, name string")
    assert {tuple(x) for x in Q.allowed(v, "name", "t", "<|u_", 2).collect()} == {(5, 0), (6, 1), (2, None)}
    with pytest.raises(ValueError):
        Q.allowed(v, "name", "t", "<|image_")
    d = spark.createDataFrame([([1, 2, 3], [9]), ([1], [8, 9, 10]), ([], [7])], "t array<bigint>, f array<bigint>")
    assert [x[0] for x in d.select(Q.forced(F.col("t"), F.col("f"), 0)).collect()] == [[9, 2, 3], [8, 9, 10], [7]]


def test_quotes_and_numbers_have_no_limit(spark):
    d = spark.createDataFrame([('"' * n + "one" + '"' * n, n) for n in (1, 7, 40)], "t string, n int")
    assert {x[0] for x in d.select(T.strip_quotes("t")).collect()} == {"one"}
    names = [f"f{'0' * (k % 3)}{10**25 + k}.txt" for k in range(5)] + ["f9.txt", "f10.txt", "f010b.txt"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.n for x in d.orderBy(T.natural_key("n")).collect()] == ["f9.txt", "f10.txt", "f010b.txt", *names[:5]]


def test_prompt_faults(spark):
    d = spark.createDataFrame([("", ""), ("a", ""), ("A warm forest with a rabbit and a pond", "x"), ("She said the garden is a warm place", ""), ('{"a": "forest"}', ""), ("one two three four five six seven", "")], "p string, q string")
    assert [x[0] for x in d.select(T.prompt_faults("p", "q")).collect()] == [["empty", "short", "unseen"], ["stand_in", "short", "unseen"], [], ["spoken"], ["short", "data"], ["unseen"]]


def test_dispatch_by_family(spark):
    from quillspark.operators import inference as I

    df = spark.createDataFrame([(1, "a", "echo"), (2, "b", "vision"), (3, "c", None)], "k bigint, p string, f string")
    got = {x.key: (x.raw_response, x.error) for x in I.dispatch(df, {"echo": I.echo_adapter()}, "k", "p", "f").collect()}
    assert got == {1: ("A", None), 2: (None, "no model of family vision"), 3: (None, "no model of family null")}
    with pytest.raises(ValueError):
        I.dispatch(df, {"omni": I.echo_adapter()}, "k", "p", "f")


def test_scopes_delete_their_tables(spark):
    with session.scope(spark):
        t = session.table(spark.range(5), "gone")
        at = t.inputFiles()[0].rsplit("/", 1)[0]
        assert t.count() == 5 and readers.exists(spark, at)
    assert not readers.exists(spark, at)


@pytest.mark.parametrize("rows", [0, 1000])
def test_counted_join(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
    left = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(300)], "h bigint, d bigint")
    right = left.groupBy("h").agg(F.count("*").alias("n")).where("h <> 9").withColumn("x", F.col("h") * 2)
    got = skew.counted_join(left, right, "h", "n", F.col("d"), most=50)
    assert sorted(map(tuple, got.collect())) == sorted((h, d, 2 * h) for h, d in map(tuple, left.collect()) if h != 9)


def test_every_listed_module_loads_alone():
    import __spark_entry__ as entry

    assert len(entry.queries()) >= len(entry.oracle_sql()) > 100
