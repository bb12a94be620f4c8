"""Nested JSON in string columns as flat, linked tables (problem 2).

The texts of a batch are indexed together (functions/jsonindex.py); lists are then found by whole
array steps: from the roots to their members by name, through whatever they are wrapped in.  A
text that is itself JSON inside a JSON string is indexed again, all such texts of a batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.arrowtext import slices
from quillspark.functions.jsonindex import ARRAY, OBJECT, SCALAR, STRING, Index
from quillspark.session import read

_NUMBER = re.compile(r"\d+")
_SPEAKER = re.compile(r"speaker[\s_-]*(\d*)", re.I)

ROW = "array<struct<list_name:string,char_pos:int,kind:string,item_pos:int,item_value:string>>"


def _again(ix: Index, nodes: np.ndarray) -> tuple[Index, np.ndarray]:
    """The JSON that string values hold, and the root of each (-1 where it is none)."""
    sub = Index(pa.array(ix.text(nodes), pa.large_string()))
    return sub, sub.root


def _ranked(owner: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each element among those of its owner, by ``order``."""
    by = np.lexsort((order, owner))
    out = np.empty(len(owner), np.int64)
    same = owner[by]
    head = np.flatnonzero(np.append(True, same[1:] != same[:-1])) if len(by) else np.zeros(0, np.int64)
    out[by] = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
    return out


def _numbers(names: list[str], pattern: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Which names match as a whole, and the number in each (0 where there is none)."""
    ok, num = np.zeros(len(names), bool), np.zeros(len(names), np.float64)
    seen: dict[str, tuple[bool, float]] = {}
    for i, name in enumerate(names):
        got = seen.get(name)
        if got is None:
            m = pattern.fullmatch(name)
            digits = (m.group(m.lastindex) if m.lastindex else m.group()) if m else ""
            got = seen[name] = (m is not None, float(digits) if digits else 0.0)
        ok[i], num[i] = got
    return ok, num


def elements(ix: Index, nodes: np.ndarray, owner: np.ndarray, record: str, keyed: re.Pattern = _NUMBER, inner: bool = False) -> Iterator[tuple[Index, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, values, owners, places): the elements of the list that each node holds, whatever it is wrapped in.

    An array is a list.  An object is a list of one if it has a member ``record``, a list in
    numeric order if all its names match ``keyed``, and else whatever list its only member or its
    only member that is an array, object or string holds.  A string is what its JSON holds; with
    ``inner``, a string or number that is no JSON container is a list of one.  null holds nothing.
    """
    some = ~ix.null(nodes)
    nodes, owner = nodes[some], owner[some]
    kind = ix.kind[nodes]

    text = kind == STRING
    if text.any():
        sub, root = _again(ix, nodes[text])
        whole = (root >= 0) & (sub.kind[root] != SCALAR)
        if inner:
            lone = ~whole
            yield ix, nodes[text][lone], owner[text][lone], np.zeros(int(lone.sum()), np.int64)
        if whole.any():
            yield from elements(sub, root[whole], owner[text][whole], record, keyed, inner)
    if inner and (kind == SCALAR).any():
        lone = kind == SCALAR
        yield ix, nodes[lone], owner[lone], np.zeros(int(lone.sum()), np.int64)

    at = np.flatnonzero(kind == ARRAY)
    if len(at):
        got, of = ix.members(nodes[at])
        size = np.bincount(of, minlength=len(at))
        nested = (size[of] == 1) & (ix.kind[got] == ARRAY)  # a list whose only element is a list
        yield ix, got[~nested], owner[at][of[~nested]], ix.place[got[~nested]]
        if nested.any():
            yield from elements(ix, got[nested], owner[at][of[nested]], record, keyed, inner)

    at = np.flatnonzero(kind == OBJECT)
    if len(at):
        objects, own = nodes[at], owner[at]
        is_record = ix.get(objects, record) >= 0
        yield ix, objects[is_record], own[is_record], np.zeros(int(is_record.sum()), np.int64)
        got, of = ix.members(objects)
        rest = ~is_record[of]
        got, of = got[rest], of[rest]
        if len(got):
            match, num = _numbers(ix.names(got), keyed)
            total, hits = np.bincount(of, minlength=len(at)), np.bincount(of, weights=match, minlength=len(at))
            placed = (hits == total)[of]
            if placed.any():
                lists = placed & (ix.kind[got] == ARRAY) & (total[of] == 1)
                one = placed & ~lists
                yield ix, got[one], own[of[one]], _ranked(of[one], num[one])
                if lists.any():
                    yield from elements(ix, got[lists], own[of[lists]], record, keyed, inner)
            wrap = ~placed & (ix.kind[got] != SCALAR)
            heavy = ~placed & np.isin(ix.kind[got], (ARRAY, OBJECT))
            nw, nh = np.bincount(of[wrap], minlength=len(at)), np.bincount(of[heavy], minlength=len(at))
            into = np.where(nh[of] == 1, heavy, wrap & (nw[of] == 1))
            if into.any():
                yield from elements(ix, got[into], own[of[into]], record, keyed, inner)


class Rows:
    """Collects (row, list_name, char_pos, kind, item_pos, item_value)."""

    def __init__(self):
        self.row, self.name, self.char, self.kind, self.item, self.value = [], [], [], [], [], []

    def add(self, row: np.ndarray, name: str, char: np.ndarray, kind: str, item: np.ndarray, value: list):
        self.row.append(row)
        self.char.append(char)
        self.item.append(item)
        self.name += [name] * len(row)
        self.kind += [kind] * len(row)
        self.value += value

    def lists(self, rows: int) -> pa.Array:
        """One list of structs for each of ``rows`` rows."""
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        row = join(self.row)
        order = pa.array(np.argsort(row, kind="stable"))
        cols = [pa.array(self.name, pa.string()), pa.array(join(self.char).astype(np.int32)), pa.array(self.kind, pa.string()), pa.array(join(self.item).astype(np.int32)), pa.array(self.value, pa.string())]
        struct = pa.StructArray.from_arrays([c.take(order) for c in cols], names=["list_name", "char_pos", "kind", "item_pos", "item_value"])
        offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offs), struct)


def _characters(out: Rows, texts: pa.Array, base: int, name: str) -> None:
    ix = Index(texts)
    good = np.flatnonzero(ix.root >= 0)
    for sub, got, row, place in elements(ix, ix.root[good], good, "name"):
        people = sub.kind[got] == OBJECT
        got, row, place = got[people], row[people], place[people]
        out.add(base + row, name, place, "character", np.zeros(len(got), np.int64), sub.text(sub.get(got, "name")))
        for key, kind, record in (("personality", "trait", "\0"), ("relations", "relation", "to"), ("holds", "holding", "\0")):
            held = sub.get(got, key)
            has = np.flatnonzero(held >= 0)
            for low, item, of, pos in elements(sub, held[has], has, record, inner=True):
                if kind == "relation":
                    to = low.get(item, "to")
                    item = np.where(to >= 0, to, np.where(low.kind[item] == OBJECT, -1, item))
                value = low.text(item)
                keep = np.array([v is not None for v in value], bool)
                out.add(base + row[of[keep]], name, place[of[keep]], kind, pos[keep], [v for v in value if v is not None])


def _open(ix: Index, nodes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[Index, np.ndarray, np.ndarray]]:
    """Objects that nodes are, or that the JSON in their strings is."""
    while len(nodes):
        is_object = (nodes >= 0) & (ix.kind[nodes] == OBJECT)
        yield ix, nodes[is_object], owner[is_object]
        text = (nodes >= 0) & (ix.kind[nodes] == STRING)
        if not text.any():
            return
        ix, root = _again(ix, nodes[text])
        owner = owner[text][root >= 0]
        nodes = root[root >= 0]


def _path(ix: Index, nodes: np.ndarray, owner: np.ndarray, path: list[str]) -> Iterator[tuple[Index, np.ndarray, np.ndarray]]:
    """The values at ``path`` below nodes; members may be JSON in strings."""
    for sub, objects, own in _open(ix, nodes, owner):
        got = sub.get(objects, path[0])
        has = got >= 0
        if len(path) == 1:
            yield sub, got[has], own[has]
        elif has.any():
            yield from _path(sub, got[has], own[has], path[1:])


def _sample(out: Rows, texts: pa.Array, base: int) -> None:
    ix = Index(texts)
    good = np.flatnonzero(ix.root >= 0)
    for top, objects, row in _open(ix, ix.root[good], good):
        for sub, held, own in _path(top, objects, row, ["next_page_condition", "condition_json", "characters"]):
            for low, got, of, place in elements(sub, held, own, "name"):
                people = low.kind[got] == OBJECT
                got, of, place = got[people], of[people], place[people]
                zero = np.zeros(len(got), np.int64)
                out.add(base + of, "sample_characters", place, "character", zero, low.text(low.get(got, "name")))
                for where, node, who in _path(low, got, np.arange(len(got)), ["state", "place", "name"]):
                    some = ~where.null(node)
                    node, who = node[some], who[some]
                    out.add(base + of[who], "sample_characters", place[who], "place", np.zeros(len(who), np.int64), where.text(node))
        meta = top.get(objects, "speech_metadata_next_page")
        for sub, speech, own in _open(top, meta, row):
            parsed, raw = sub.get(speech, "parsed"), sub.get(speech, "raw")
            source = np.where(sub.null(parsed), raw, parsed)
            has = source >= 0
            for low, got, of, place in elements(sub, source[has], own[has], "name", _SPEAKER):
                people = low.kind[got] == OBJECT
                got, of, place = got[people], of[people], place[people]
                out.add(base + of, "speakers", place, "speaker", np.zeros(len(got), np.int64), low.text(low.get(got, "name")))


def _worker(fill):
    """A mapInArrow function: the first column is the key, the others the texts that ``fill`` takes."""

    def run(batches):
        for b in batches:
            rows = Rows()
            for c in range(1, b.num_columns):
                for at, part in slices(b.column(c)):
                    fill(rows, part, at, b.schema.names[c])
            yield pa.RecordBatch.from_arrays([b.column(0), rows.lists(b.num_rows)], names=["key", "rows"])

    return run


def character_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, rows): for each row of ``df`` the members of its JSON character lists.

    Null, blank and malformed texts have no rows; other columns are ignored.
    """
    picked = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("string").alias(c) for c in columns])
    return picked.mapInArrow(_worker(lambda rows, part, at, name: _characters(rows, part, at, name)), f"key string, rows {ROW}")


def sample_rows(df: DataFrame, path: str, body: str, at: str) -> DataFrame:
    """(key, at, rows): the speakers and characters of each version of a sample file, by its canonical path and time (null without a column ``at``)."""
    time = F.col(at).cast("timestamp_ntz") if at in df.columns else F.lit(None).cast("timestamp_ntz")
    picked = df.where(F.col(path).isNotNull()).select(canonical_path(F.col(path)).alias("key"), time.cast("string").alias("at"), F.col(body).cast("string").alias("body"))
    # key and time go through the index as one text
    one = picked.select(F.to_json(F.struct("key", "at")).alias("key"), "body").mapInArrow(_worker(lambda rows, part, at, name: _sample(rows, part, at)), f"key string, rows {ROW}")
    return one.select(F.from_json("key", "key string, at string").alias("k"), "rows").select("k.key", "k.at", "rows")


def canonical_path(path: Column) -> Column:
    """A path with single forward slashes and no leading ``./``; blank is null."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    return F.nullif(F.regexp_replace(p, r"^(\./)+|(?<=/)(\./)+", ""), F.lit(""))


def flat_members(rows: DataFrame) -> DataFrame:
    """One row per list member; a key that comes again with the same content counts once."""
    return rows.groupBy("key").agg(F.first("rows").alias("rows")).select(F.col("key").alias("id"), F.inline("rows"))


def linked(dataset: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, list_name, char_pos, kind, item_pos, item_value) of all nested lists below each dataset id.

    (id, list_name, char_pos) links a member to its character or speaker, id to the dataset row.
    Null ids, null paths, paths that name no file, files without a row and malformed JSON give
    nothing; empty tables give an empty result.
    """
    ids = dataset.where("id is not null")
    own = flat_members(character_rows(ids, "id", ["condition_characters", "book_characters"]))
    files = sample_rows(samples, "sample_path", "body", "written_at").groupBy("key").agg(F.max_by("rows", F.struct("at", F.size("rows"))).alias("rows"))
    paths = ids.where("sample_path is not null").select(F.col("id").cast("string").alias("id"), canonical_path(F.col("sample_path")).alias("key")).distinct()
    return own.unionByName(paths.join(files, "key").select("id", F.inline("rows")))


def _nodes(batches):
    for b in batches:
        for at, part in slices(b.column(1)):
            ix = Index(part)
            got = np.flatnonzero(ix.is_value)
            number = np.full(len(ix.kind) + 1, -1, np.int64)
            first = np.searchsorted(ix.row[got], np.arange(len(part)))
            number[got] = np.arange(len(got)) - first[ix.row[got]]
            parent = number[np.where(ix.parent[got] < 0, len(ix.kind), ix.parent[got])]
            named = ix.key_at[got] >= 0
            names = np.full(len(got), None, object)
            names[named] = ix.names(got[named])
            leaf = ix.kind[got] >= STRING
            text = np.full(len(got), None, object)
            text[leaf] = ix.text(got[leaf])
            kinds = np.array(["object", "array", "string", "scalar"], object)[ix.kind[got]]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at + ix.row[got])), pa.array(number[got].astype(np.int32)), pa.array(np.where(parent < 0, 0, parent).astype(np.int32), mask=parent < 0), pa.array(ix.level[got].astype(np.int32)),
                    pa.array(ix.place[got].astype(np.int32)), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(text, pa.string()),
                ],
                names=["key", "node", "parent", "depth", "place", "name", "kind", "value"],
            )


def nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, node, parent, depth, place, name, kind, value): every value of a JSON column as a linked row.

    node numbers the values of a text in its order, parent is null for the root; value is a
    string's text or a number as written, null for containers and null.  Malformed and null
    texts have no rows.
    """
    picked = df.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(column).cast("string").alias("t"))
    return picked.mapInArrow(_nodes, "key string, node int, parent int, depth int, place int, name string, kind string, value string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object and list member below a dataset id."""
    return linked(read(spark, sf_dir, "dataset"), read(spark, sf_dir, "sample_files"))


def all_nodes(dataset: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, document, node, parent, ...): nodes() of each row's two character lists and of its sample file, the version written last.

    document is the column or ``sample``; (id, document) names a text, whose values its parents link.
    """
    rows = dataset.where("id is not null")
    lists = ["condition_characters", "book_characters"]
    one = rows.groupBy("id").agg(*[F.min(c).alias(c) for c in lists])
    time = F.col("written_at").cast("timestamp_ntz") if "written_at" in samples.columns else F.lit(None).cast("timestamp_ntz")
    files = samples.where("sample_path is not null").groupBy(canonical_path(F.col("sample_path")).alias("key")).agg(F.max_by("body", F.struct(time.alias("at"), F.length("body").alias("n"))).alias("body"))
    paths = rows.where("sample_path is not null").select("id", canonical_path(F.col("sample_path")).alias("key")).distinct()
    out = nodes(paths.join(files, "key"), "id", "body").withColumn("document", F.lit("sample"))
    for c in lists:
        out = out.unionByName(nodes(one, "id", c).withColumn("document", F.lit(c)))
    return out.withColumnRenamed("key", "id")


def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the two columns and of the sample files as one linked table."""
    return all_nodes(read(spark, sf_dir, "dataset"), read(spark, sf_dir, "sample_files"))


QUERIES = {"p2_found": p2_found, "p2_nodes": p2_nodes}
ORACLE: dict[str, str] = {}
