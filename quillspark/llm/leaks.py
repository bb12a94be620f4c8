"""Evaluation passages inside a training corpus (problem 7).

Prefix-filtered set join over word shingles:

1. every item becomes its set of five-word shingles; a Bloom filter of bounded size over them
   lets the one pass over the corpus emit only shingles that some item may have;
2. an item's shingles are ordered by rarity in the corpus, and only the prefix that every
   document with enough of them must meet is joined;
3. hits are bounded by position: a document is a candidate for an item if enough of the
   item's prefix stands within a window of the item's size;
4. each candidate's text is looked through for the item word by word, then compared with it over
   item-sized windows, and as a whole if none of them holds enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.arrowtext import buffers, fold, shingles, signed, slices, span_hashes, tokens
from quillspark.functions.skew import counted_join, lookup_join
from quillspark.session import read, table

#: Words in a shingle.
K = 5
#: Items of fewer words are looked for by shorter shingles too, and those.
BRIEF, BRIEF_K = 20, 3
#: The least share of an item's shingles that a case is taken to keep unchanged.
LEAST = 0.10
#: The share of an item's words that makes a case.
SHARE = 0.5
#: Bits of the filter: 2 ** MOST_BITS is its proven bound (32 MB).
MOST_BITS = 28
#: Where in a 64-bit hash the filter's probes begin; each takes MOST_BITS at most.
PROBES = (0, 12, 24, 36)
#: Bytes of passages up to which they are broadcast, to the candidates and then to the texts, and parts of one document's list of candidates.
BROADCAST_BYTES, PARTS = 32 << 20, 16
#: Keys (8 bytes each) of documents with candidates up to which they are broadcast to the corpus; above, both are shuffled.
BROADCAST_ROWS = 200_000


def _shingle_rows(ids: pa.Array, texts: pa.Array, k: int, keep=None) -> Iterator[pa.RecordBatch]:
    for at, part in slices(texts):
        data, offs = buffers(fold(part))
        starts, ends, rows = tokens(data, offs)
        name, first = shingles(span_hashes(data, starts, ends), rows, k)
        if keep is not None and len(name):
            ok = keep(name)
            name, first = name[ok], first[ok]
        row = rows[first] if len(first) else np.zeros(0, np.int64)
        begin = np.searchsorted(rows, np.arange(len(part)))
        words = np.bincount(rows, minlength=len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(name)), ids.take(pa.array(at + row)), pa.array((first - begin[row]).astype(np.int32)), pa.array(words[row].astype(np.int32))],
            names=["h", "id", "pos", "words"],
        )


def text_shingles(df: DataFrame, key: str, text: str, k: int = K, bitmap: np.ndarray | None = None) -> DataFrame:
    """(h, id, pos, words): the shingles of each text, all or only those that ``bitmap`` may hold.

    Null and empty texts, and texts under ``k`` words, have none.  Whole texts are read.
    """
    shared = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        keep = None
        if shared is not None:
            bits = shared.value
            mask = np.uint64(len(bits) * 64 - 1)

            def keep(name):
                at = np.arange(len(name))
                for shift in PROBES:  # each probe sees what the ones before let through
                    slot = (name[at] >> np.uint64(shift)) & mask
                    at = at[(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
                return at

        for b in batches:
            if b.num_rows:
                yield from _shingle_rows(b.column(0), b.column(1), k, keep)

    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).where("id is not null and t is not null").mapInArrow(run, "h bigint, id bigint, pos int, words int")


def bloom(hashes: DataFrame, many: int) -> np.ndarray:
    """A bitmap over the column h with about 16 bits a value, never more than 2 ** MOST_BITS bits.

    It is built in Spark slot by slot; what reaches the driver is the bitmap, whatever the rows.
    """
    bits = 1 << min(MOST_BITS, max(16, int(many * 16).bit_length()))
    slots = hashes.select(F.explode(F.array(*[F.shiftrightunsigned("h", k).bitwiseAND(F.lit(bits - 1)) for k in PROBES])).alias("s"))
    got = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy().astype(np.int64)] = got["b"].to_numpy().view(np.uint64)
    return out


def candidates(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, k: int = K, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, hits, lo, hi): documents that may hold enough of an item, and where.

    Items under ``k`` words have no shingle of that size; _short() finds them.
    """
    own = table(text_shingles(items, item_key, item_text, k).groupBy("id", "h").agg(F.min("pos").alias("ipos"), F.max("words").alias("words")).withColumnRenamed("id", "item_id"), "leak-items")
    many = own.count()
    hits = table(text_shingles(docs, doc_key, doc_text, k, bloom(own.select("h"), many)).select("h", F.col("id").alias("doc_id"), "pos"), "leak-hits")
    seen = table(hits.groupBy("h").agg(F.count("*").alias("df")), "leak-seen")
    w = Window.partitionBy("item_id")
    ranked = (
        own.join(seen, "h")  # a shingle has at most one row an item
        .withColumn("rank", F.row_number().over(w.orderBy("df", "h")))
        .join(own.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")
        # the rarest come first; shingles the corpus lacks are rarer still and stand before them
        .withColumn("absent", F.col("n") - F.max("rank").over(w))
        .withColumn("need", F.least(F.col("n"), F.greatest(F.lit(2), F.ceil(F.col("n") * least))))
        .withColumn("half", F.greatest(F.lit(1), F.floor(F.col("need") / 2)))
        .where(F.col("rank") + F.col("absent") <= F.col("n") - F.col("need") + F.col("half"))
    )
    ranked = table(ranked.select("h", "item_id", "words", "half", "df"), "leak-prefixes")
    met = counted_join(hits, ranked, "h", "df", F.col("doc_id"))
    # positions fall into windows of twice the item's words, and two neighbouring windows count together; a shingle
    # that a window repeats counts again, which only lets more texts through to the comparison
    # (one exchange by document and item serves the windows, their neighbours and the result)
    placed = met.repartition("doc_id", "item_id").groupBy("doc_id", "item_id", F.floor(F.col("pos") / (F.col("words") * 2)).alias("win")).agg(F.count("*").alias("hits"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("half").alias("half"), F.first("words").alias("words"))
    last = Window.partitionBy("doc_id", "item_id").orderBy("win")
    joins = F.lag("win").over(last) == F.col("win") - 1
    placed = placed.withColumn("both", F.col("hits") + F.when(joins, F.lag("hits").over(last)).otherwise(0)).withColumn("lo", F.when(joins, F.lag("lo").over(last)).otherwise(F.col("lo")))
    return placed.where("both >= half").groupBy("doc_id", "item_id").agg(F.max("both").alias("hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("words").alias("words"))


def _short(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """(doc_id, item_id, share 1.0): items under ``k`` words that a document has as a whole phrase."""
    out = None
    sizes = text_shingles(items, "item_id", "i", 1).where(F.col("words") < k).select("words").distinct().collect()  # k - 1 rows at most
    for n in sorted(r.words for r in sizes):
        own = table(text_shingles(items, "item_id", "i", n).where(F.col("words") == n).select("h", F.col("id").alias("item_id")).distinct(), "leak-short")
        hit = text_shingles(docs, "doc_id", "t", n, bloom(own.select("h"), own.count())).select("h", F.col("id").alias("doc_id")).distinct()
        got = lookup_join(hit, own, "h", F.col("doc_id")).select("doc_id", "item_id", F.lit(1.0).alias("share"))
        out = got if out is None else out.unionByName(got)
    return out


def _verify(least: float):
    def run(batches):
        yield from _shares(batches, least)

    return run


def _shares(batches, least: float):
    import re

    from quillspark.llm.contain import share

    word = re.compile(r"[^\W_]+")
    for b in batches:
        text, own = fold(b.column("t")).to_pylist(), b.column("own")
        key, item, lo, hi = own.flatten().flatten()  # of the lists, of their structs
        item, lo, hi = fold(item).to_pylist(), lo.to_pylist(), hi.to_pylist()
        sizes = np.diff(own.offsets.to_numpy())
        got, k = [], 0
        for n, many in enumerate(sizes):
            all_ = word.findall(text[n])
            for j in range(k, k + many):
                passage = word.findall(item[j])
                size = len(passage)
                at, end = max(0, lo[j] - size), min(len(all_), hi[j] + K + size)
                if f" {' '.join(passage)} " in f" {' '.join(all_[at:end])} ":  # word for word
                    got.append(1.0)
                    continue
                best = 0.0
                while True:  # windows of four items, half overlapping; most cases lie in one with all their stretches
                    best = max(best, share(passage, all_[at : min(end, at + 4 * size)]))
                    if at + 4 * size >= end:
                        break
                    at += 2 * size
                if best < least and len(all_) > 4 * size:  # stretches further apart add up over the whole text
                    best = max(best, share(passage, all_))
                got.append(best)
            k += many
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), key, pa.array(got, pa.float64())], names=["doc_id", "item_id", "share"])


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share) for each document that holds at least ``share`` of an item's words in order.

    Null or empty texts on either side make no case; a key that comes twice counts once; other
    columns of the inputs are ignored, whatever their names.  Empty inputs give an empty result.
    Items under ``K`` words are matched as whole phrases.  Passages go to the candidates, not texts to
    the items: a text is moved once, by its own key, however many texts an item leaked into.
    """
    docs = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(doc_text).cast("string").alias("t"))
    items = table(items.select(F.col(item_key).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("i")).where("item_id is not null and i is not null").dropDuplicates(["item_id"]), "leak-passages")
    sizes = table(text_shingles(items, "item_id", "i", 1).groupBy(F.col("id").alias("item_id")).agg(F.max("words").alias("words")), "leak-sizes")
    brief = sizes.where(f"words >= {K} and words < {BRIEF}")
    found = candidates(docs, items, "doc_id", "t", "item_id", "i")
    if not brief.isEmpty():  # half of a short item may hold no five words in a row
        own = items.join(brief.select("item_id"), "item_id", "left_semi")
        found = found.unionByName(candidates(docs, own, "doc_id", "t", "item_id", "i", BRIEF_K)).groupBy("doc_id", "item_id").agg(F.max("hits").alias("hits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("words").alias("words"))
    found = table(found, "leak-candidates")
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("i")), F.lit(0))).collect()[0]
    told = lookup_join(found, items, "item_id", F.col("doc_id"), rows=many if size <= BROADCAST_BYTES else BROADCAST_ROWS + 1)
    lists = told.groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("item_id", "i", "lo", "hi")).alias("own"), F.sum(F.octet_length("i") + 24).alias("bytes"))
    lists = table(lists, "leak-lists")
    if (lists.agg(F.sum("bytes")).collect()[0][0] or 0) <= BROADCAST_BYTES:
        pairs = docs.join(F.broadcast(lists), "doc_id")
    else:
        ids = table(found.select("doc_id").distinct(), "leak-documents")
        pairs = docs.join(ids if ids.count() > BROADCAST_ROWS else F.broadcast(ids), "doc_id", "left_semi").join(lists, "doc_id")
    pairs = pairs.select("doc_id", "t", "own")
    got = pairs.mapInArrow(_verify(share), "doc_id bigint, item_id bigint, share double")
    short = _short(docs, items, K)
    got = got.where(F.col("share") >= share)
    return (got if short is None else got.unionByName(short)).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and held-out item where the document has at least half of the item's words in order."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "heldout_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked: how many documents hold each, and the largest share."""
    items = read(spark, sf_dir, "heldout_items")
    got = leaks(read(spark, sf_dir, "documents"), items).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("max_share"))
    return items.select("item_id", "origin").dropDuplicates(["item_id"]).join(got, "item_id", "left").select("item_id", "origin", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_share", F.lit(0.0)).alias("max_share"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLE: dict[str, str] = {}
