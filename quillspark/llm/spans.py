"""Long exact spans shared between records (problem 9).

1. Recompression rounds (see recompress.py) name token runs and pairs of every text; a seed is
   the shortest run of neighbouring high-level symbols of SEED bytes or more.  A span of LEAST
   equal characters gives both texts the same seed, whatever stands around it.
2. Seeds that two different texts share place exact windows of LEAST - STEP characters at every
   STEP-th offset before the seed; equal windows are joined.
3. The STEP characters on each side of two equal windows verify the span exactly.  Windows that many
   texts have are first narrowed to exact spans, so a phrase just under LEAST pairs nobody.

Exact copies of a text are one class and go through this once; they come back as members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.arrowtext import buffers, signed, slices
from quillspark.functions.skew import counted_join
from quillspark.llm import recompress
from quillspark.session import read, table

#: Characters that make a case, and bytes of a seed.
LEAST, SEED = 200, 64
#: Distance between the windows of a seed.
STEP = 40
#: Rows of one window above which texts meet by exact windows only.
HOT = 64
#: Tasks that the texts of one hot span are spread over when they are paired.
SALTS = 16
#: Rows (8 bytes each) up to which the list of texts is broadcast; above, both sides are shuffled.
BROADCAST_ROWS = 500_000


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, class_id): each text's class of exact copies, named by its smallest key.

    Null and empty texts are in no class.  A class may hold any share of all rows: the smallest
    key is found by a partial aggregate, and only fingerprints (128 bits) and keys are shuffled.
    """
    named = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.unhex(F.md5(F.col(text).cast("string"))).alias("m"), F.length(text).alias("n")).where("doc_id is not null and n > 0").select("doc_id", "m")
    return named.join(named.groupBy("m").agg(F.min("doc_id").alias("class_id")), "m").select("doc_id", "class_id").distinct()


def _seed_rows(seed: int):
    def run(batches):
        for b in batches:
            for at, part in slices(b.column(1)):
                data, offs = buffers(part)
                starts, sizes, names = recompress.first_symbols(data, offs)
                rows = np.searchsorted(offs, starts, side="right") - 1
                symbols, (mark, mark_name, mark_row) = recompress.rounds(starts, sizes, names, rows)
                where, size, name, row = recompress.seeds(*symbols, seed)
                where, size, name, row = np.append(where, mark), np.append(size, np.zeros(len(mark), size.dtype)), np.append(name, mark_name), np.append(row, mark_row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(name)), b.column(0).take(pa.array(at + row)), pa.array((where - offs[row]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["h", "doc_id", "pos", "size"]
                )

    return run


def seed_table(texts: DataFrame, seed: int = SEED) -> DataFrame:
    """(h, doc_id, pos, size): the seeds of each text (doc_id, t); pos and size in bytes."""
    return texts.mapInArrow(_seed_rows(seed), "h bigint, doc_id bigint, pos int, size int")


def _window_rows(least: int, step: int):
    def run(batches):
        import xxhash

        long = least - step
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, seeds in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("seeds").to_pylist()):
                raw = text.encode()
                plain = len(raw) == len(text)
                # for each byte its character; one more for the end
                chars = None if plain else np.append(np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1, len(text))
                done = set()
                for s in seeds:
                    p = s["pos"] if plain else int(chars[s["pos"]])
                    end = s["pos"] + s["size"]
                    e = end if plain else int(chars[end - 1]) + 1 if s["size"] else p
                    for w in range(p, max(-1, e - least - 1), -step):
                        if w in done or w + long > len(text):
                            continue
                        done.add(w)
                        out[0].append(xxhash.xxh3_64_intdigest(text[w : w + long]) - (1 << 63))
                        out[1].append(doc)
                        out[2].append(w)
                        out[3].append(text[max(0, w - step) : w])
                        out[4].append(text[w + long : w + long + step])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["w", "doc_id", "pos", "before", "after"])

    return run


def _common(a: str, b: str, step: int, end: bool) -> str:
    """SQL for the length of the common prefix (or suffix) of two strings of at most ``step`` characters."""
    cut = "right" if end else "left"
    return f"case when {a} = {b} then length({a}) else size(filter(sequence(1, {step}), k -> k <= least(length({a}), length({b})) and {cut}({a}, k) = {cut}({b}, k))) end"


class Shared:
    """What texts share: windows that at least two different texts have.

    Windows of at most HOT rows are joined text by text and their ends compared.  A window of more
    rows may be a phrase a little shorter than a span; there each text's LEAST-character windows
    around it are named exactly (by the window and what stands before and after), so that only
    texts that do share a span meet.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED, step: int = STEP):
        self.least, self.step = least, step
        self.cls = table(classes(docs, key, text), "span-classes")
        copies = self.cls.where("doc_id <> class_id").select("doc_id")
        texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).where(F.length("t") >= least)
        texts = texts.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "doc_id", "left_anti")
        found = table(seed_table(texts, seed), "span-seeds")
        shared = table(found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("h", "rows"), "span-shared-seeds")
        per_doc = table(counted_join(found, shared, "h", "rows", F.col("doc_id")).groupBy("doc_id").agg(F.collect_set(F.struct("pos", "size")).alias("seeds")), "span-shared")
        wanted = per_doc if per_doc.count() > BROADCAST_ROWS // 50 else F.broadcast(per_doc)
        windows = table(texts.join(wanted, "doc_id").mapInArrow(_window_rows(least, step), "w bigint, doc_id bigint, pos int, before string, after string"), "span-windows")
        sizes = windows.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("w", "n", F.col("n").alias("rows"))
        self.windows = table(counted_join(windows, table(sizes, "span-window-sizes"), "w", "rows", F.col("doc_id")), "span-common")

    def cold(self) -> DataFrame:
        """(a, b, a_from, a_to, b_from, b_to): verified equal spans of two texts, a < b, one row per window."""
        own = self.windows.where(F.col("n") <= HOT)
        a = own.select("w", F.col("doc_id").alias("a"), F.col("pos").alias("pa"), F.col("before").alias("ba"), F.col("after").alias("fa"))
        b = own.select("w", F.col("doc_id").alias("b"), F.col("pos").alias("pb"), F.col("before").alias("bb"), F.col("after").alias("fb"))
        met = a.join(b, "w").where("a < b")
        ext = met.withColumn("l", F.expr(_common("ba", "bb", self.step, True))).withColumn("r", F.expr(_common("fa", "fb", self.step, False))).where(f"l + r >= {self.step}")
        long = self.least - self.step
        return ext.selectExpr("a", "b", "pa - l as a_from", f"pa + {long} + r as a_to", "pb - l as b_from", f"pb + {long} + r as b_to")

    def hot(self) -> DataFrame:
        """(x, doc_id, lo, n): exact LEAST-character windows that several texts have, by name, text and first character."""
        s = self.step
        own = self.windows.where(F.col("n") > HOT).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(s)))).where(f"length(before) >= j and length(after) >= {s} - j")
        exact = own.select(F.expr(f"xxhash64(w, j, right(before, j), left(after, {s} - j))").alias("x"), "doc_id", F.expr("pos - j").alias("lo"))
        many = exact.groupBy("x").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count_distinct("doc_id").alias("n"), F.count("*").alias("rows")).where("a < b").select("x", "n", "rows")
        return counted_join(exact, table(many, "span-exact"), "x", "rows", F.col("doc_id"))

    def links(self) -> DataFrame:
        """(a, b): different texts that share a span, by their class names, a < b."""
        x = self.hot().select("x", "doc_id").distinct()
        # a span that many texts have gives as many pairs as they have; its texts are spread over SALTS tasks
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
        met = x.select("x", F.col("doc_id").alias("a"), spread).join(x.select("x", F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["x", "salt"]).where("a < b")
        return self.cold().select("a", "b").unionByName(met.select("a", "b")).distinct()


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b): every two documents that share ``least`` consecutive characters, copies included.

    Null, empty and shorter texts have none; repeated rows of a key are one; other columns are
    ignored; an empty table has no pairs.
    """
    shared = Shared(docs, key, text, least)
    x = shared.cls.select(F.col("class_id").alias("a"), F.col("doc_id").alias("x"))
    y = shared.cls.select(F.col("class_id").alias("b"), F.col("doc_id").alias("y"))
    between = shared.links().join(x, "a").join(y, "b").select("x", "y")
    big = docs.select(F.col(key).cast("bigint").alias("a"), F.length(text).alias("n")).where(f"n >= {least}").select("a").distinct()
    within = x.join(big, "a").join(y.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def partners(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """(class_id, partners): with how many other texts each one shares a span; ``cold`` has (a, b), ``hot`` (x, doc_id).

    The same as counting links() by text, but texts with the same set of hot spans are one row: each
    distinct set counts the texts of the sets that it meets.  A cold link is counted where the sets of its
    two texts don't meet.
    """
    hot = hot.select("x", "doc_id").distinct()
    # spans that the same texts have are one; sets are told by 128 bits, as texts are
    alike = hot.groupBy("x").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("u"), F.sum(F.xxhash64(F.lit(1), "doc_id").cast("decimal(38,0)")).alias("v"))
    spans = hot.join(alike.groupBy("n", "u", "v").agg(F.min("x").alias("x")).select("x"), "x")
    owned = table(spans.groupBy("doc_id").agg(F.sort_array(F.collect_set("x")).alias("xs")).withColumn("m", F.md5(F.array_join(F.col("xs").cast("array<string>"), ","))), "span-sets")
    sets = owned.groupBy("m").agg(F.min("doc_id").alias("s"), F.count("*").alias("n"), F.first("xs").alias("xs"))
    sets = table(sets, "span-sets-distinct")
    has = sets.select("s", "n", F.explode("xs").alias("x"))
    met = table(has.select("x", "s").join(has.select("x", F.col("s").alias("t"), "n"), "x").select("s", "t", "n").distinct(), "span-sets-met")
    member = owned.join(sets.select("m", "s"), "m").select("doc_id", "s")
    many = member.join(met.groupBy("s").agg((F.sum("n") - 1).alias("n")), "s").select(F.col("doc_id").alias("class_id"), "n")
    links = cold.select("a", "b").distinct()
    links = links.join(member.select(F.col("doc_id").alias("a"), "s"), "a", "left").join(member.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), "b", "left")
    links = links.join(met.select("s", "t"), ["s", "t"], "left_anti")
    few = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n"))
    return many.unionByName(few).groupBy("class_id").agg(F.sum("n").alias("partners"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: class_id, class_size, n_chars, shared_chars, share, partners.

    shared_chars are the characters inside spans that stand in another document too; a document
    with an exact copy is shared as a whole.  partners counts other classes that it shares a span
    with, each once, however many texts have the span.  Copies are told by class_size.
    """
    shared = Shared(docs, key, text, least)
    cls, found, hot = shared.cls, table(shared.cold(), "spans"), table(shared.hot(), "spans-hot")
    own = found.selectExpr("a as class_id", "a_from as lo", "a_to as hi").unionByName(found.selectExpr("b as class_id", "b_from as lo", "b_to as hi"))
    all_ = own.unionByName(hot.selectExpr("doc_id as class_id", "lo", f"lo + {least} as hi"))
    # the union of the intervals, by the running end of those before
    order = Window.partitionBy("class_id").orderBy("lo", "hi")
    ended = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = all_.groupBy("class_id", "lo").agg(F.max("hi").alias("hi")).withColumn("past", F.coalesce(ended, F.lit(0)))
    covered = fresh.groupBy("class_id").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "past"))).alias("covered"))
    linked = partners(found, hot)
    sizes = cls.groupBy("class_id").agg(F.count("*").alias("class_size"))
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n_chars")).where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    out = docs.join(cls, "doc_id", "left").join(sizes, "class_id", "left").join(covered, "class_id", "left").join(linked, "class_id", "left")
    chars = F.when((F.col("class_size") > 1) & (F.col("n_chars") >= least), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), chars.cast("bigint").alias("shared_chars"),
        F.coalesce(F.try_divide(chars.cast("double"), F.col("n_chars")), F.lit(0.0)).alias("share"), F.coalesce("partners", F.lit(0)).alias("partners"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of documents that share at least 200 consecutive characters exactly."""
    return pairs(read(spark, sf_dir, "documents"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document how much of it stands verbatim in another."""
    return report(read(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_report": p9_report}
ORACLE = {
    # every window of 200 characters of every text, by a 64-bit hash
    "p9_found": """
WITH d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200 GROUP BY doc_id),
i AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d),
w AS (SELECT DISTINCT doc_id, hash(substring(text, i, 200)) AS h FROM i)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id"""
}
