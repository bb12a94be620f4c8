"""Free-entered values mapped to a canonical list (problem 3).

1. A multi-pattern automaton over all labels and aliases finds the names that a value mentions as
   whole words (inflections included); the longest non-overlapping mentions win.
2. Values without a mention go to token-set similarity: words of the value and of a name are paired
   one to one by restricted edit distance, by abbreviation and by stem; a name's similarity is what
   its pairs are worth out of the words of both, and the most similar name wins.
3. What is left, or means two labels equally, is unmatched.

Only different values are matched; the result is looked up for the rows.  A reference of any length
goes in blocks of names: each gives all mentions and its most similar names, and what overlaps or
wins is decided over all blocks, so the result does not depend on the blocks.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.skew import lookup_join
from quillspark.session import read, table

UNMATCHED = "unmatched"
#: Names (labels and aliases) in one automaton, and different values that one task matches with it.
BLOCK, VALUES = 50_000, 50_000
#: Endings after which a mention still counts as the whole word. Fixed values.
ENDINGS = ("", "s", "ly", "er", "est", "ish", "ness", "ed", "y", "fully")
#: Endings taken off to compare stems, longest first. Fixed values.
STEMS = ("iness", "ness", "fully", "iest", "ily", "ier", "ish", "est", "ful", "ly", "er", "ed", "y", "s")

_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][-. ]){2,}[^\W\d_](?![^\W_])")


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting one; more than ``most`` is ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, prior = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if prior is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prior[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


def stem(word: str) -> str:
    for end in STEMS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def _allowed(word: str, name: str) -> int:
    short = min(len(word), len(name))
    return 0 if short < 3 else 1 if short < 5 else 2 if short < 9 else 3


def _closeness(word: str, name: str) -> float:
    """How surely a word means a name: 1 the same, 0 not at all."""
    if word == name:
        return 1.0
    most = _allowed(word, name)
    d = distance(word, name, most)
    if d <= most and (min(len(word), len(name)) > 3 or len(word) != len(name) or sorted(word) == sorted(name)):
        return 1.0 - d / (max(len(word), len(name)) + 1)
    if len(word) >= 3 and name.startswith(word):
        return 0.6 + 0.1 * len(word) / len(name)
    if len(stem(word)) >= 3 and stem(word) == stem(name):
        return 0.55
    return 0.0


class Words:
    """The different words of many names, to be found by whatever is close to them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.letters = np.array([self._letters(w) for w in words], np.uint64)
        self.order = sorted(range(len(words)), key=words.__getitem__)
        self.sorted = [words[k] for k in self.order]
        self.stems: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            self.stems.setdefault(stem(w), []).append(k)

    @staticmethod
    def _letters(word: str) -> int:
        out = 0
        for c in word:
            out |= 1 << (ord(c) & 63)
        return out

    def close(self, word: str) -> list[tuple[int, float]]:
        """(word, closeness) of every word that _closeness() tells apart from 0.

        An edit changes which letters a word has by two at most, so words whose letters differ by more than
        twice the edits allowed are left out before any is compared; the rest share a beginning or a stem.
        """
        short = np.minimum(self.sizes, len(word))
        most = np.select([short < 3, short < 5, short < 9], [0, 1, 2], 3)
        near = np.abs(self.sizes - len(word)) <= most
        near[near] = np.bitwise_count(self.letters[near] ^ np.uint64(self._letters(word))) <= 2 * most[near]
        found = set(np.flatnonzero(near).tolist())
        at = bisect.bisect_left(self.sorted, word)
        while at < len(self.sorted) and self.sorted[at].startswith(word):
            found.add(self.order[at])
            at += 1
        found.update(self.stems.get(stem(word), ()))
        return [(k, c) for k in found if (c := _closeness(word, self.words[k]))]


class Matcher:
    """Names of one field: what a value mentions, and which names are most similar to it."""

    def __init__(self, names: list[tuple[str, str]]):
        import ahocorasick

        self.names: dict[str, set[str]] = {}
        for name, label in names:
            if name and name.strip():
                self.names.setdefault(" ".join(name.lower().split()), set()).add(label)
        self.auto = ahocorasick.Automaton()
        for name in self.names:
            self.auto.add_word(name, name)
        if self.names:
            self.auto.make_automaton()
        self.parts = {name: name.split() for name in self.names}
        words = list(dict.fromkeys(w for ws in self.parts.values() for w in ws))
        self.words = Words(words)
        number = {w: k for k, w in enumerate(words)}
        self.of: list[list[str]] = [[] for _ in words]
        for name, ws in self.parts.items():
            for w in set(ws):
                self.of[number[w]].append(name)
        self.seen: dict[str, list[tuple[int, float]]] = {}

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of every name that stands in the text as a whole word, overlapping ones too."""
        found = []
        for end, name in self.auto.iter(text) if self.names else ():
            start = end - len(name) + 1
            if start and text[start - 1].isalpha():
                continue
            tail = _LETTERS.match(text, end + 1)
            ending = tail.group() if tail else ""
            if name[-1] == ending[:1] and ending[1:] in ("er", "est", "ed", "ish"):  # a doubled last letter
                ending = ending[1:]
            if ending in ENDINGS:
                found.append((start, end, name))
        return found

    def similar(self, text: str) -> tuple[float, set[str]]:
        """The highest token-set similarity that a name has with the text, and the labels that reach it."""
        words = list(dict.fromkeys(_LETTERS.findall(text)))
        pairs: dict[str, list[tuple[float, str, str]]] = {}
        for word in words:
            if word not in self.seen:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                self.seen[word] = self.words.close(word)
            for k, c in self.seen[word]:
                for name in self.of[k]:
                    pairs.setdefault(name, []).append((-c, word, self.words.words[k]))
        top, labels = 0.0, set()
        for name, own in pairs.items():
            used, worth = set(), 0.0
            for c, word, part in sorted(own):  # the surest pairs first, each word once
                if (0, word) not in used and (1, part) not in used:
                    used |= {(0, word), (1, part)}
                    worth -= c
            s = round(2 * worth / (len(set(self.parts[name])) + len(words)), 12)
            if s > top:
                top, labels = s, set(self.names[name])
            elif s == top:
                labels |= self.names[name]
        return top, labels

    def look(self, value: str) -> tuple[list[tuple[int, int, str]], float, list[str]]:
        """All mentions as (start, end, label), and without one the highest similarity with its labels."""
        text = " ".join(value.lower().replace("\u00a0", " ").split())
        text = _SPELLED.sub(lambda m: re.sub(r"[-. ]", "", m.group()), text)
        found = [(a, b, label) for a, b, name in self.mentions(text) for label in sorted(self.names[name])]
        top, labels = (0.0, set()) if found else self.similar(text)
        return found, top, sorted(labels)

    def label(self, value: str) -> tuple[str, float]:
        """(label, score) of a value when these are all names: the same as map_values() says."""
        found, top, labels = self.look(value)
        taken: list[tuple[int, int, str]] = []
        for a, b, name in sorted(found, key=lambda m: (m[0] - m[1], m[0], m[2])):
            if all(b < x or a > y or (a, b) == (x, y) for x, y, _ in taken):
                taken.append((a, b, name))
        if taken:
            top, labels = 2.0, sorted({name for _, _, name in taken})
        return (labels[0], top) if len(labels) == 1 else (UNMATCHED, top)


MENTIONS = "mentions array<struct<size:int,start:int,stop:int,label:string>>"


def _match(values: pa.Table, names: pa.Table) -> pa.Table:
    """One block of one field's names against some of the field's values."""
    matcher = Matcher(list(zip(names["name"].to_pylist(), names["label"].to_pylist())))
    got = [matcher.look(v) for v in values["value"].to_pylist()]
    kind = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string())]))
    found = [[{"size": a - b, "start": a, "stop": b, "label": label} for a, b, label in m] for m, _, _ in got]
    return pa.table({"field_name": values["field_name"], "value": values["value"], "mentions": pa.array(found, kind), "score": pa.array([s for _, s, _ in got], pa.float64()), "labels": pa.array([x for _, _, x in got], pa.list_(pa.string()))})


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(field_name, value, label, score) for each different (field_name, value).

    ``reference`` has field_name, label, aliases.  Null and blank values are left out.  A field
    without reference entries has only unmatched values.  A mention scores 2, else the score is the
    similarity (0 to 1).
    """
    different = table(values.select("field_name", "value").where(r"value is not null and trim(regexp_replace(value, '\\p{Z}+', ' ')) <> ''").distinct(), "canon-values")
    names = table(reference.select("field_name", "label", F.explode(F.array_append(F.coalesce("aliases", F.array()), F.col("label"))).alias("name")).where("name is not null and label is not null").distinct(), "canon-names")
    blocks, parts = max(1, -(-names.count() // BLOCK)), max(1, -(-different.count() // VALUES))
    # every part of the values meets every block of its field's names
    v = different.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    n = names.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    by = ["field_name", "block", "part"]
    got = v.groupBy(*by).cogroup(n.groupBy(*by)).applyInArrow(_match, f"field_name string, value string, {MENTIONS}, score double, labels array<string>")
    if blocks > 1:
        flat = lambda c: F.flatten(F.collect_list(c))
        best = F.max("score").over(Window.partitionBy("field_name", "value"))
        got = got.withColumn("top", best).groupBy("field_name", "value").agg(flat("mentions").alias("mentions"), F.max("top").alias("score"), F.array_distinct(flat(F.when(F.col("score") == F.col("top"), F.col("labels")).otherwise(F.array().cast("array<string>")))).alias("labels"))
    # of overlapping mentions the longest, of equal ones the first
    clash = lambda a, m: F.exists(a, lambda t: (t["start"] <= m["stop"]) & (t["stop"] >= m["start"]) & ~((t["start"] == m["start"]) & (t["stop"] == m["stop"])))
    taken = F.aggregate(F.array_sort("mentions"), F.array().cast(MENTIONS.split(" ", 1)[1]), lambda a, m: F.when(clash(a, m), a).otherwise(F.concat(a, F.array(m))))
    told = F.array_distinct(F.transform(taken, lambda m: m["label"]))
    got = got.select("field_name", "value", told.alias("told"), "score", "labels")
    means = F.when(F.size("told") > 0, F.col("told")).otherwise(F.col("labels"))
    return got.select("field_name", "value", F.when(F.size(means) == 1, means[0]).otherwise(UNMATCHED).alias("label"), F.when(F.size("told") > 0, 2.0).otherwise(F.col("score")).alias("score"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = read(spark, sf_dir, "speaker_metadata").where("speaker_id is not null")
    return data.select("speaker_id", "system", F.expr("stack(4, 'emotion', emotion, 'speed', speed, 'pitch', pitch, 'gender', gender) as (field_name, value)"))


def mapped(values: DataFrame, reference: DataFrame) -> DataFrame:
    """The rows of ``values`` (field_name, value and others) whose value is no label itself, with label and score."""
    labels = reference.select("field_name", F.col("label").alias("value")).distinct()
    key = F.concat_ws("\0", "field_name", "value")
    # different values only, so that none is held by many rows
    rest = values.select("field_name", "value").distinct().join(labels, ["field_name", "value"], "left_anti")
    got = table(map_values(rest, reference).select(key.alias("k"), "label", "score"), "canon")
    return lookup_join(values.withColumn("k", key), got, "k", F.monotonically_increasing_id()).drop("k")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed value that is no label itself, with the label it means."""
    return mapped(_values(spark, sf_dir), read(spark, sf_dir, "label_reference")).select("speaker_id", "field_name", "label").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean none of their field's labels, and how many rows of how many systems have them."""
    got = mapped(_values(spark, sf_dir), read(spark, sf_dir, "label_reference")).where(F.col("label") == UNMATCHED)
    return got.groupBy("field_name", "value").agg(F.count_distinct("speaker_id").alias("n_rows"), F.count_distinct("system").alias("n_systems"))


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
ORACLE: dict[str, str] = {}
