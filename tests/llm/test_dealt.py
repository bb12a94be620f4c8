"""Problems 1 and 3 to 9: results on small tables against plain brute force, and every odd input."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import canon, consensus, contain, cut, leaks, mixing, proportions, reading, recompress, spans

WORDS = "river stone lantern harbour puzzle velvet thunder market shadow copper ladder window garden silver meadow pocket engine feather bridge cellar".split()


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice([".", ",", ""]) if k % 7 == 6 else "") for k in range(n))


# ---- 9: shared spans


def common_span(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best


def test_spans_equal_brute_force(spark):
    r = random.Random(4)
    texts = [prose(k, 90) for k in range(14)]
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(260))  # one unbroken word
    texts += [texts[0][:150] + texts[1], "x" + texts[2][40:245] + "y" + prose(99), texts[3][100:299] + " z", long + " one", "two " + long[30:235], "a" * 250, "b" + "a" * 400, texts[5], texts[5]]
    rows = list(enumerate(texts))
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if common_span(a, b) >= 200}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(x) for x in spans.pairs(df).collect()}
    assert got == want and want
    rep = {x.doc_id: x for x in spans.report(df).collect()}
    assert {k for k, x in rep.items() if x.shared_chars} == {i for p in want for i in p}
    assert rep[21].class_size == 3 and rep[21].share == 1.0 and rep[22].class_id == 5
    assert rep[15].shared_chars == 205 and rep[15].partners == 1


def test_common_phrases_pair_nobody(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 5)
    foot = prose(77, 60)
    short, long = foot[:190], foot[:230]
    rows = [(k, prose(1000 + k, 40) + f" {k} " + short + f" {k}") for k in range(30)] + [(k, prose(2000 + k, 40) + f" {k} " + long + f" {k * 7}") for k in range(30, 45)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if common_span(a, b) >= 200}
    assert {tuple(x) for x in spans.pairs(df).collect()} == want and len(want) >= 15 * 14 // 2
    rep = {x.doc_id: x for x in spans.report(df).collect()}
    assert all((rep[k].shared_chars > 0) == any(k in p for p in want) for k in range(45)) and rep[40].partners >= 14


@pytest.mark.parametrize("hot", [3, 64])
def test_partners_are_the_links_of_each_text(spark, monkeypatch, hot):
    """Disjoint and overlapping hot passages, hot and cold ones in one text, and copies: the same above and below HOT."""
    monkeypatch.setattr(spans, "HOT", hot)
    one, two, three = prose(501, 60)[:240], prose(502, 60)[:240], prose(503, 60)[:240]
    parts = [[one]] * 6 + [[two]] * 5 + [[one, two]] * 2 + [[two, three]] + [[three]] * 2 + [[]]
    rows = [(k, " ".join([prose(3000 + k, 20), *(f"{x} {k} {prose(3100 + k, 5)}" for x in p)])) for k, p in enumerate(parts)]
    rows.append((50, rows[0][1]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = [(i, j) for (i, a), (j, b) in itertools.combinations(rows[:-1], 2) if common_span(a, b) >= 200]
    want = {k: sum(k in p for p in pairs) for k, _ in rows[:-1]}
    rep = {x.doc_id: x.partners for x in spans.report(df).collect()}
    assert rep == want | {50: want[0]} and want[11] == 13 and want[0] == 7 and want[13] == 9 and want[16] == 0
    shared = spans.Shared(df)
    links = shared.links().collect()
    assert {k: n for k, n in want.items() if n} == {k: sum(k in p for p in map(tuple, links)) for k in {i for p in links for i in p}}


def test_recompression_finds_spans_of_exactly_the_least_length():
    import pyarrow as pa

    from quillspark.functions.arrowtext import buffers

    r = random.Random(1)
    texts = [prose(k, 200) for k in range(40)]
    missed = 0
    for _ in range(150):
        a, b = r.sample(texts, 2)
        p, q = r.randrange(len(a) - 200), r.randrange(len(b))
        both = [a, b[:q] + a[p : p + 200] + b[q:]]
        data, offs = buffers(pa.array(both))
        s, z, n = recompress.first_symbols(data, offs)
        rows = np.searchsorted(offs, s, side="right") - 1
        _, _, name, row = recompress.seeds(*recompress.rounds(s, z, n, rows)[0], spans.SEED)
        missed += not set(name[row == 0]) & set(name[row == 1])
    assert missed == 0


def test_spans_odd_input(spark):
    schema = "doc_id bigint, text string, h string, w string, pos int, a string, t string"
    empty = spark.createDataFrame([], schema)
    assert spans.pairs(empty).count() == 0 and spans.report(empty).count() == 0
    t = prose(1)
    rows = [(1, None, "x", "x", 1, "x", "x"), (2, "", *"xx", 1, *"xx"), (3, t, *"xx", 1, *"xx"), (3, t, *"xx", 1, *"xx"), (None, t, *"xx", 1, *"xx"), (4, t, *"xx", 1, *"xx"), (5, (t + " ") * 300, *"xx", 1, *"xx")]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(x) for x in spans.pairs(df).collect()} == {(3, 4), (3, 5), (4, 5)}
    rep = {x.doc_id: x.shared_chars for x in spans.report(df).collect()}
    assert rep[1] == 0 and rep[2] == 0 and rep[3] == len(t) and set(rep) == {1, 2, 3, 4, 5}


# ---- 7: leaks


def test_leaks_equal_brute_force(spark):
    items = [(k, prose(100 + k, 60)) for k in range(6)] + [(6, "copper ladder")]
    noisy = items[1][1].upper().replace(" ", "  ")
    words = items[2][1].split()
    docs = [
        (1, prose(1) + " " + items[0][1] + " " + prose(2)),
        (2, "&ldquo;" + noisy + "&rdquo;"),
        (3, prose(3) + " " + " ".join(words[:36]) + " " + prose(4)),  # more than half
        (4, prose(5) + " " + " ".join(words[:18]) + " " + prose(6)),  # less than half
        (5, " ".join(items[3][1].split()[:20]) + " and then " + prose(7, 6) + " " + " ".join(items[3][1].split()[25:50])),  # two stretches
        (6, " ".join(w if k % 6 else w[:2] + " " + w[2:] for k, w in enumerate(items[4][1].split()))),  # broken words
        (7, prose(8, 4000)),
        (8, "a copper ladder stood"),
        (9, None),
        (10, ""),
    ]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in leaks.leaks(d, i).collect()}
    split = lambda t: [w.strip(".,;&") for w in (t or "").lower().replace("&ldquo;", " ").replace("&rdquo;", " ").split()]
    want = {(a, b) for a, t in docs for b, u in items[:6] if contain.share(split(u), split(t)) >= 0.5}
    want |= {(a, 6) for a, t in docs if " copper ladder " in f" {' '.join(split(t))} "}
    assert got == want
    assert {(1, 0), (2, 1), (3, 2), (5, 3), (6, 4), (8, 6)} <= got and (4, 2) not in got


def test_leaks_add_up_over_a_long_text(spark):
    """Two stretches of a third of an item each, in order, twenty item lengths apart; one of them alone is no case."""
    w = prose(300, 60).split()
    far = prose(301, 1200)
    docs = [(1, " ".join([prose(302, 30), *w[:20], far, *w[40:], prose(303, 30)])), (2, " ".join([prose(302, 30), *w[:20], far])), (3, " ".join([*w[40:], far, *w[:20]]))]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(0, " ".join(w))], "item_id bigint, text string")
    got = {x.doc_id: x.share for x in leaks.leaks(d, i).collect()}
    assert set(got) == {1} and 0.6 <= got[1] < 0.8


def test_leaks_of_short_items(spark):
    """Items of five to nineteen words: verbatim, and with half of their words in a row."""
    r = random.Random(12)
    items = [(n, " ".join(r.choices(WORDS, k=n))) for n in range(5, 20)]
    docs = [(n, f"before {prose(400 + n, 20)} Then: {t.upper()}! after") for n, t in items] + [(100 + n, f"{prose(500 + n, 20)} so {' '.join(t.split()[: (n + 2) // 2 + 1])} it") for n, t in items if n >= 10]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in leaks.leaks(d, i).collect()}
    split = lambda t: [w.strip(".,;!:") for w in t.lower().split()]
    want = {(a, b) for a, t in docs for b, u in items if contain.share(split(u), split(t)) >= 0.5 or f" {' '.join(split(u))} " in f" {' '.join(split(t))} "}
    assert got == want and {(n, n) for n, _ in items} | {(100 + n, n) for n, _ in items if n >= 10} <= got


def test_leaks_odd_input(spark):
    d = "doc_id bigint, text string, h string, item_id bigint, share double, words int"
    i = "item_id bigint, text string, doc_id bigint, h string"
    docs, items = spark.createDataFrame([], d), spark.createDataFrame([], i)
    assert leaks.leaks(docs, items).count() == 0
    t = prose(1, 40)
    docs2 = spark.createDataFrame([(1, t, "x", 9, 0.1, 1), (1, t, "x", 9, 0.1, 1), (2, None, "x", 9, 0.1, 1), (None, t, "x", 9, 0.1, 1)], d)
    items2 = spark.createDataFrame([(7, t, 5, "y"), (7, t, 5, "y"), (8, None, 5, "y"), (9, "", 5, "y"), (None, t, 5, "y")], i)
    assert leaks.leaks(docs2, items).count() == 0 and leaks.leaks(docs, items2).count() == 0
    assert [(x.doc_id, x.item_id, x.share) for x in leaks.leaks(docs2, items2).collect()] == [(1, 7, 1.0)]


# ---- 3: canonical values

REF = [("tone", "happy", ["joyful", "glad"]), ("tone", "sad", ["gloomy"]), ("tone", "neutral", []), ("pace", "slow", ["unhurried"]), ("pace", "fast", ["hurried"]), ("sex", "male", ["man"]), ("sex", "female", ["woman"])]


@pytest.mark.parametrize(
    "field, value, label",
    [
        ("tone", " Happy.", "happy"), ("tone", "hapyp", "happy"), ("tone", "a bit joyful", "happy"), ("tone", "happiness", "happy"), ("tone", "s-a-d", "sad"), ("tone", "sadder", "sad"), ("tone", "neut.", "neutral"), ("tone", "purple", "unmatched"),
        ("tone", "happy or sad", "unmatched"), ("tone", "?", "unmatched"), ("pace", "uunhurried", "slow"), ("pace", "quite hurried", "fast"), ("sex", "femmale", "female"), ("sex", "females", "female"), ("sex", "mlae", "male"), ("sex", "woamn", "female"), ("other", "x", "unmatched"),
    ],
)
def test_labels(field, value, label):
    names = [(n, lab) for f, lab, al in REF if f == field for n in (lab, *al)]
    assert canon.Matcher(names).label(value)[0] == label


def test_canon_odd_input(spark, monkeypatch):
    ref = spark.createDataFrame(REF, "field_name string, label string, aliases array<string>")
    v = "speaker_id bigint, field_name string, value string, label string, k string"
    rows = [(1, "tone", "happy", "a", "b"), (2, "tone", "glad", "a", "b"), (3, "tone", None, "a", "b"), (4, "tone", "", "a", "b"), (5, "tone", "  ", "a", "b"), (6, "tone", "glad", "a", "b"), (7, "sex", "x" * 5000, "a", "b"), (8, None, "glad", "a", "b")]
    values = spark.createDataFrame(rows, v).select("speaker_id", "field_name", "value")
    want = {(2, "happy"), (6, "happy"), (7, "unmatched")}
    got = {(x.speaker_id, x.label) for x in canon.mapped(values.where("field_name is not null"), ref).collect()}
    assert got == want
    assert canon.mapped(values.where("false"), ref).count() == 0
    assert {x.label for x in canon.mapped(values.where("speaker_id = 2"), ref.where("false")).collect()} == {"unmatched"}
    monkeypatch.setattr(canon, "BLOCK", 3)  # several automata give the same
    assert {(x.speaker_id, x.label) for x in canon.mapped(values.where("field_name is not null"), ref).collect()} == want


def test_canon_blocks_agree_on_overlapping_names(spark, monkeypatch):
    """Longest mentions and the most similar names win over all blocks, whatever block a name is in."""
    names = ["york", "new york", "new york city", "city", "city hall", "hall", "salt lake city", "lake", "green lake"]
    ref = spark.createDataFrame([("place", n, ["old " + n] if n == "york" else []) for n in names], "field_name string, label string, aliases array<string>")
    values = ["new york city hall", "yrk new cty", "in old york", "grene lake", "the salt lake city", "york city", "xyz", "salt laek", "hall of lake", "green lake hall", "new yorkk"]
    v = spark.createDataFrame([(k, "place", x) for k, x in enumerate(values)], "speaker_id bigint, field_name string, value string")
    whole = {x.value: (x.label, x.score) for x in canon.map_values(v, ref).collect()}
    matcher = canon.Matcher([(n, n) for n in names] + [("old york", "york")])
    assert whole == {x: matcher.label(x) for x in values}
    assert whole["yrk new cty"][0] == "new york city" and whole["in old york"][0] == "york" and whole["xyz"][0] == "unmatched" and whole["the salt lake city"][0] == "salt lake city"
    assert whole["new york city hall"][0] == "unmatched"  # new york city, and hall beside it
    for block in (1, 2, 4):
        monkeypatch.setattr(canon, "BLOCK", block)
        monkeypatch.setattr(canon, "VALUES", 1 + block)
        assert {x.value: (x.label, x.score) for x in canon.map_values(v, ref).collect()} == whole


def test_close_words_are_those_of_the_plain_comparison():
    r = random.Random(7)
    words = list(dict.fromkeys("".join(r.choice("abcdeilnorst") for _ in range(r.randint(1, 11))) for _ in range(400)))
    index = canon.Words(words)
    for _ in range(150):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 2)] = r.choice(["", "x", "ed", w[at] * 2])
            w = w or ["a"]
        w = "".join(w)
        assert dict(index.close(w)) == {k: c for k, x in enumerate(words) if (c := canon._closeness(w, x))}


# ---- 4: cut texts


def test_cut(spark):
    sentences = ["the reader stopped at the comma", "no object held every category", "the value is not a mapping", "a quote follows the word garden"]
    rows = [(k, "a", "e", "; ".join(random.Random(k).choices(sentences, k=1 + k % 3)) + ("." if k % 2 else "")) for k in range(400)]
    cases = {1000: "the value is not a mapp", 1001: "no object held every", 1002: "the reader stopped at the comma [...]", 1003: "the value is not a mapping; no object (held", 1004: "no object held every category;", 1005: "no object held every categ…"}
    whole = {2000: "no object held every category", 2001: "the value is not a mapping."}
    odd = {3000: None, 3001: "", 3002: " \n"}
    df = spark.createDataFrame(rows + [(k, "b", "e", v) for d in (cases, whole, odd) for k, v in d.items()] + [(1000, "b", "e", cases[1000])], "row bigint, source string, field_name string, value string")
    got = {x.row: x.why for x in cut.cut_values(df).collect() if x.cut}
    assert set(got) == set(cases)
    assert got[1000] == "word" and got[1002] == got[1005] == "mark"
    assert cut.cut_values(df.where("false")).count() == 0
    assert cut.cut_values(df.where("row >= 3000")).count() == 0


def test_cut_the_same_way_again_and_again(spark):
    """Many values grow the same cut ends: a word's beginning, with and without a mark, is no word, and no usual end."""
    clauses = ["the decoder stopped at offset 17 where a comma was expected", "two objects held tail_of_metadata; neither was complete", "the value of tail_of_metadata is not a mapping", "no object held every category"]
    ends = ["two objects held tail_of_meta", "two objects held tail_of_metadata", "the decoder stopped at of", "the value of tail_of_metadata is no"]
    rows = [(k, "a", "e", "; ".join(random.Random(k).choices(clauses, k=1 + k % 3)) + ("." if k % 2 else "")) for k in range(600)]
    rows += [(1000 + k, "b", "e", "the judge sent nothing") for k in range(40)]
    rows += [(2000 + k, "c", "e", f"{clauses[k % 3]}; {ends[k % 4]}") for k in range(32)]
    rows += [(3000 + k, "d", "e", f"{clauses[k % 3]}; {ends[0]}...") for k in range(8)]
    got = {x.row for x in cut.cut_values(spark.createDataFrame(rows, "row bigint, source string, field_name string, value string")).collect() if x.cut}
    assert got == {k for k, *_ in rows if k >= 2000}


def test_cut_structure():
    assert cut.look('{"a": {"b": "c."}')["opened"] and not cut.look('{"a": {"b": "c."}}')["opened"]
    assert cut.look("```json\n{}")["opened"] and cut.look("text\ufffd")["marked"] and not cut.look("all of it.")["marked"]


def test_cut_in_a_very_long_word(spark):
    """A token of 100,000 characters in the vocabulary, and a last word of 300 that is its beginning."""
    long = "".join(random.Random(2).choices("abcdefgh", k=100_000))
    rows = [(k, "a", "e", f"value {k} ends here as it should, token {long} stands inside of it.") for k in range(4)] + [(9, "a", "e", "value 9 ends, token " + long[:300]), (10, "a", "e", "value 10 ends, token qqq " + "z" * 300)]
    got = {x.row: x for x in cut.cut_values(spark.createDataFrame(rows, "row bigint, source string, field_name string, value string")).collect()}
    assert got[9].why == "word" and "trie" in got[9].evidence and "trie" not in got[10].evidence and not any(got[k].cut for k in range(4))


# ---- 6: consensus


def test_consensus_finds_the_reliable(spark):
    r = random.Random(3)
    votes, truth = [], {}
    for i in range(400):
        t = truth[i] = r.randint(2, 9)
        for j in ("good1", "good2", "good3"):
            votes.append((i, "text", "c", j, t if r.random() < 0.9 else min(10, t + 1)))
        votes.append((i, "text", "c", "always8", 8))
        votes.append((i, "text", "c", "random", r.randint(1, 10)))
    df = spark.createDataFrame(votes, "index bigint, modality string, category string, judge string, score int")
    m = consensus.Model(df)
    got = {x["index"]: x.score for x in m.consensus().collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 390
    rel = {x.judge: x.exact for x in m.reliability().collect()}
    assert min(rel[j] for j in ("good1", "good2", "good3")) > 0.8 > 0.3 > max(rel["always8"], rel["random"])


@pytest.mark.parametrize("rounds", [1, 4])
def test_consensus_by_joins_is_the_same(spark, monkeypatch, rounds):
    """Above the number of judges whose matrices are sent the rounds go as joins, with equal results."""
    r = random.Random(8)
    votes = [(i, m, "c", f"j{j}", min(10, max(1, 3 + i % 5 + r.choice([0, 0, 0, 1, -1, j % 3])))) for i in range(60) for m in ("text", "image") for j in range(7) if r.random() < 0.8]
    df = spark.createDataFrame(votes, "index bigint, modality string, category string, judge string, score int")
    sent = consensus.Model(df, rounds)
    monkeypatch.setattr(consensus, "SENT_JUDGES", 1)
    joined = consensus.Model(df, rounds)
    assert sent.sent and not joined.sent
    got, want = ({(x["index"], x.modality): x for x in m.consensus().collect()} for m in (joined, sent))
    assert set(got) == set(want) and all((got[k].score, got[k].n_scores, got[k].n_different) == (x.score, x.n_scores, x.n_different) and abs(got[k].confidence - x.confidence) < 1e-9 for k, x in want.items())
    got, want = ({x.judge: (x.n_scores, *(round(v, 8) for v in (x.exact, x.near, x.bias))) for x in m.reliability().collect()} for m in (joined, sent))
    assert got == want and len(want) == 7


def test_agreement_by_hand(spark):
    rows = [(1, "t", "c", "a", 5), (1, "t", "c", "b", 5), (2, "t", "c", "a", 6), (2, "t", "c", "b", 7), (3, "t", "c", "a", 6)]
    df = spark.createDataFrame(rows, "index bigint, modality string, category string, judge string, score int")
    x = consensus.agreement(df).collect()[0]
    assert (x.n_items, x.n_scores, x.observed) == (2, 4, 0.5) and abs(x.expected - 2 / 12) < 1e-12


def test_consensus_odd_input(spark):
    schema = "index bigint, modality string, judge string, received_at timestamp_ntz, judge_eval map<string,struct<score:int>>, score int"
    empty = spark.createDataFrame([], schema)
    m = consensus.Model(consensus.long_votes(empty))
    assert m.consensus().count() == 0 and m.reliability().count() == 0
    import datetime as dt

    a, b = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2)
    rows = [
        (1, "text", "j", a, {"A b": (3,)}, 1), (1, "text", "j", b, {"A b": (4,), "a-b": (9,), "x": (11,), "y": (None,), "": (5,)}, 1), (1, "text", "k", a, None, 1), (None, "text", "k", a, {"A b": (4,)}, 1), (1, None, "k", a, {"A b": (4,)}, 1), (1, "text", None, a, {"A b": (4,)}, 1),
    ]
    v = consensus.long_votes(spark.createDataFrame(rows, schema)).collect()
    assert [(x.category, x.score) for x in v] == [("a_b", 4)]


# ---- 5: proportions


def test_rake_meets_margins():
    counts = {("a", "x"): 60, ("a", "y"): 10, ("b", "x"): 5, ("b", "y"): 25}
    w = proportions.rake(counts, [{"a": 0.5, "b": 0.5}, {"x": 0.3, "y": 0.7}])
    mass = {c: n * w[c] for c, n in counts.items()}
    assert abs(mass["a", "x"] + mass["a", "y"] - 0.5) < 1e-6 and abs(mass["a", "x"] + mass["b", "x"] - 0.3) < 1e-6


def test_sample(spark):
    rows = [(f"i{k}", ["Big", " big ", "MID", "small", None, ""][0 if k < 600 else 1 if k < 620 else 2 if k < 900 else 3 if k < 912 else 4 if k < 950 else 5], "n") for k in range(1000)]
    data = spark.createDataFrame(rows + rows[:50], "id string, kind string, weight string")
    t = "plan string, field_name string, category string, target_share double, min_rows int, sample_rows bigint"
    targets = spark.createDataFrame([("p", "kind", "Big", 0.6, 10, 100), ("p", "kind", "Mid", 0.38, 10, 100), ("p", "kind", "Small", 0.01, 10, 100), ("p", "kind", "None", 0.01, 5, 100)], t)
    drawn, report = proportions.samples(data, targets)
    got = {r.category: r for r in report.collect()}
    assert {c: r.drawn for c, r in got.items()} == {"Big": 56, "Mid": 34, "Small": 10, "None": 0} or sum(r.drawn for r in got.values()) == 100
    assert got["Small"].drawn == 10 and got["None"].short and not got["Big"].short and got["Big"].available == 620
    ids = [r.id for r in drawn.collect()]
    assert len(ids) == len(set(ids)) == 100
    again, _ = proportions.samples(data, targets)
    assert sorted(ids) == sorted(r.id for r in again.collect())
    nothing, rep = proportions.samples(data.where("false"), targets)
    assert nothing.count() == 0 and all(r.short for r in rep.collect())
    none, rep = proportions.samples(data, targets.where("false"))
    assert none is None and rep.count() == 0


def test_sample_two_margins(spark):
    rows = [(f"i{k}", "a" if k % 3 else "b", "x" if k % 5 else "y") for k in range(3000)]
    data = spark.createDataFrame(rows, "id string, f string, g string")
    t = "plan string, field_name string, category string, target_share double, min_rows int, sample_rows bigint"
    targets = spark.createDataFrame([("p", "f", "a", 0.5, 0, 400), ("p", "f", "b", 0.5, 0, 400), ("p", "g", "x", 0.6, 0, 400), ("p", "g", "y", 0.4, 0, 400)], t)
    _, report = proportions.samples(data, targets)
    for r in report.collect():
        assert abs(r.drawn / 400 - r.target_share) < 0.06


@pytest.mark.parametrize("cells", [0, 1_000_000])
def test_sample_margins_with_minimums(spark, monkeypatch, cells):
    """Exactly the asked rows, every minimum that can be met, and shares at their targets; as a table of combinations too."""
    monkeypatch.setattr(proportions, "DRIVER_CELLS", cells)
    monkeypatch.setattr(proportions, "ROUNDS", 8)
    rows = [(f"i{k}", "b" if k % 50 == 0 else "c" if k % 200 == 7 else "a", "y" if k % 7 == 0 else "z" if k % 300 == 8 else "x") for k in range(3000)]
    data = spark.createDataFrame(rows, "id string, f string, g string")
    t = "plan string, field_name string, category string, target_share double, min_rows int, sample_rows bigint"
    targets = [("p", "f", "a", 0.93, 0, 400), ("p", "f", "b", 0.05, 40, 400), ("p", "f", "c", 0.02, 30, 400), ("p", "g", "x", 0.8, 0, 400), ("p", "g", "y", 0.19, 5, 400), ("p", "g", "z", 0.01, 12, 400)]
    drawn, report = proportions.samples(data, spark.createDataFrame(targets, t))
    got = {r.category: r for r in report.collect()}
    assert drawn.count() == 400 and sum(got[c].drawn for c in "abc") == sum(got[c].drawn for c in "xyz") == 400
    assert got["b"].drawn >= 40 and got["c"].drawn == got["c"].available == 15 and got["z"].drawn == got["z"].available == 8
    assert {c for c, r in got.items() if r.short} == {"c", "z"}
    assert abs(got["y"].drawn - 76) <= 3 and abs(got["b"].drawn - 40) <= 2


def test_combinations_are_counted_as_they_occur(spark):
    """Seven margins of ten categories: ten million possible combinations, few that occur."""
    rows = [(f"i{k}", *(f"v{(k + d) % 10}" for d in range(7))) for k in range(500)]
    data = spark.createDataFrame(rows, "id string, " + ", ".join(f"f{d} string" for d in range(7)))
    t = "plan string, field_name string, category string, target_share double, min_rows int, sample_rows bigint"
    targets = [("p", f"f{d}", f"v{v}", 0.1, 2, 100) for d in range(7) for v in range(10)]
    drawn, report = proportions.samples(data, spark.createDataFrame(targets, t))
    assert drawn.count() == 100 and all(9 <= r.drawn <= 11 and not r.short for r in report.collect())


# ---- 8: mixing


def test_knapsack_is_best():
    r = random.Random(2)
    for _ in range(40):
        lengths = r.sample(range(1, 40), 5)
        counts = [r.randint(1, 4) for _ in lengths]
        budget = r.randint(0, 150)
        best = max(s for s in (sum(a * n for a, n in zip(lengths, c)) for c in itertools.product(*(range(n + 1) for n in counts))) if s <= budget)
        used = mixing.knapsack(lengths, counts, budget)
        assert all(u <= n for u, n in zip(used, counts)) and sum(a * n for a, n in zip(lengths, used)) == best


def test_knapsack_of_many_lengths_stays_small():
    import tracemalloc

    r = random.Random(6)
    lengths = r.sample(range(1, 60_000), 30_000)
    tracemalloc.start()
    used = mixing.knapsack(lengths, [r.randint(1, 9) for _ in lengths], 131_072)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(a * n for a, n in zip(lengths, used)) == 131_072 and top < 50_000_000
    # even lengths never reach an odd budget: the search goes through all of them
    lengths = r.sample(range(2, 60_000, 2), 20_000)
    used = mixing.knapsack(lengths, [3] * 20_000, 131_071)
    assert sum(a * n for a, n in zip(lengths, used)) == 131_070


def test_plan_lengths_fills_budgets():
    r = random.Random(5)
    for _ in range(30):
        lengths = sorted(r.sample(range(1, 3000), 60))
        counts = [r.randint(1, 30) for _ in lengths]
        total = sum(a * n for a, n in zip(lengths, counts))
        repeats, budget = r.randint(1, 4), r.randint(1, 5 * total)
        passes, extra = mixing.plan_lengths(lengths, counts, budget, repeats)
        size = passes * total + sum(a * n for a, n in zip(lengths, extra))
        assert all(0 <= e <= n for e, n in zip(extra, counts)) and passes + any(extra) <= repeats
        assert size <= budget and (size == repeats * total or budget - size <= 3)
    assert mixing.plan_lengths([], [], 5, 2) == (0, []) and mixing.plan_lengths([3], [1], 0, 2) == (0, [0])


def test_plan_lengths_of_very_long_texts():
    assert mixing.plan_lengths([150_000], [10], 450_000 + 299_999, 1) == (0, [4])
    assert mixing.plan_lengths([150_000, 150_001], [1, 1], 299_999, 1)[1] in ([1, 0], [0, 1])
    r = random.Random(9)
    for _ in range(30):
        lengths = sorted(r.sample(range(70_000, 400_000), 8))
        counts = [r.randint(1, 4) for _ in lengths]
        budget = r.randint(1, sum(a * n for a, n in zip(lengths, counts)))
        passes, extra = mixing.plan_lengths(lengths, counts, budget, 1)
        left = budget - sum(a * (n * passes + e) for a, n, e in zip(lengths, counts, extra))
        assert left >= 0 and (passes or all(e <= n and (e == n or a > left) for a, n, e in zip(lengths, counts, extra)))


def test_mix(spark):
    docs = spark.createDataFrame([(k, prose(k, 20 + k % 30), " Tales" if k % 4 else "notes ", "x", 1) for k in range(200)] + [(500, None, "tales", "x", 1), (501, "", None, "x", 1), (1, prose(1, 21), " Tales", "x", 1)], "doc_id bigint, text string, source string, mix string, length int")
    t = "mix string, source string, target_share double, max_repeats int, budget_ratio double"
    targets = spark.createDataFrame([("m", "TALES", 0.5, 1, 0.5), ("m", "Notes", 0.4, 1, 1.0), ("m", "none", 0.1, 9, 0.5), ("n", "notes", 1.0, 3, 0.6)], t)
    m = mixing.Mix(docs, targets)
    rep = {(r.mix, r.source): r for r in m.report().collect()}
    assert {k for k, r in rep.items() if r.short} == {("m", "Notes"), ("m", "none")}
    assert rep["m", "TALES"].wanted - rep["m", "TALES"].size < 2 and rep["n", "notes"].wanted - rep["n", "notes"].size < 2
    used = m.documents().join(m.sized, "doc_id").groupBy("mix", "name").agg(F.sum(F.col("uses") * F.col("length")).alias("s"), F.max("uses").alias("u")).collect()
    assert {(r.mix, r.name): r.s for r in used} == {("m", "tales"): rep["m", "TALES"].size, ("m", "notes"): rep["m", "Notes"].size, ("n", "notes"): rep["n", "notes"].size}
    assert max(r.u for r in used) <= 3
    e = mixing.Mix(docs.where("false"), targets)
    assert e.documents().count() == 0 and not any(r.short for r in e.report().collect())


# ---- 1: reading level


def test_reading_level(spark):
    easy, hard = "the cat sat on a mat and ran to the dog".split(), "inexorable phenomenon notwithstanding bureaucratic reconciliation circumnavigated deliberation melancholy".split()
    r = random.Random(1)

    def page(level):
        if level == 1:
            return " ".join(" ".join(r.choices(easy, k=5)).capitalize() + "." for _ in range(6))
        return " ".join(" ".join(r.choices(easy + hard * 3, k=22)).capitalize() + "." for _ in range(3))

    pages = [(k, page(1 if k % 3 else 2)) for k in range(150)]
    labels = [(k, page(k % 2 + 1), k % 2 + 1) for k in range(60)]
    p = spark.createDataFrame(pages + [(900, None), (901, ""), (902, "  \n"), (903, "..."), (904, pages[0][1])], "id bigint, text string")
    lab = spark.createDataFrame(labels + [(999, None, 1), (998, "x", None)], "label_id bigint, text string, level int")
    got = {x.m: x.level for x in reading.levels(p, lab).collect()}
    import hashlib

    right = sum(got[hashlib.md5(t.encode()).hexdigest()] == (1 if k % 3 else 2) for k, t in pages)
    assert right >= 147 and hashlib.md5(b"...").hexdigest() in got and len(got) == len({t for _, t in pages}) + 1
    assert reading.levels(p.where("false"), lab).count() == 0
    assert reading.levels(p, lab.where("false")).count() == 0


def test_ranks_are_by_frequency(spark):
    texts = spark.createDataFrame([("1", "the the the cat cat dog owl Anna"), ("2", "So the Anna ran")], "m string, t string")
    words = reading.page_words(texts)
    ranks = {x.w: x["rank"] for x in reading.vocabulary(words).collect()}
    assert ranks["the"] == 1 and ranks["cat"] == 2 and ranks["dog"] == ranks["owl"] and "anna" not in ranks
