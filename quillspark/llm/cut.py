"""Texts that lost their end (problem 4).

Evidence is learned from all values and then combined for each:

* the vocabulary of a field, as a trie: a table of nodes, each a hash of a known word's beginning;
  a value whose last word is no known word but such a node was cut inside it, and likewise one whose
  last word never follows the word before it while longer words with this beginning do, and a last line
  that is a proper prefix of a line that values usually end with;
* how often a pair of words, or a word, stands before a full stop, a semicolon or the end; marks put in
  place of an end are taken off first, for what stands before them is no more a word than any other cut end;
* how often a field's values end with a sentence at all;
* brackets, fences, quotes and parentheses that stay open, and marks put in place of an end;
* lengths, in characters or bytes, at which a source's values pile up: its limit.

What grows with the number of values (how often cuts left the same beginning of a word) is held against what
else grows with it, never against a fixed number alone.  Every value is asked for every kind of evidence.  Texts
are read and word pairs counted batch by batch in Python: the same in Spark expressions takes twice the time
(explode, trims and wide keys per word).
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.skew import lookup_join
from quillspark.session import read, table

#: Marks that stand in place of a lost end. Fixed values.
MARK = re.compile(r"(?:\[\s*(?:\.\.\.|…)\s*\]|…|\.\.\.|<\s*(?:cut|truncated|snip)[^<>]*>|[(\[][^()\[\]]{0,30}\b(?:truncated|cut off|omitted)\b[^()\[\]]{0,30}[)\]]|�+)\s*$", re.I)
#: The kinds of evidence.
KINDS = ("mark", "open", "line", "trie", "sentence", "ending", "length")
#: A last line this short may be a line that values usually end with.
FOOTER = 40
#: A word or line is known from this many places on.
KNOWN = 3
#: And from this many for each place where a value breaks off behind it.
KNOWN_SHARE = 0.1
#: A last line, or a last word without a full stop, is usual if this share of a field's values has it, its digits aside.
USUAL = 0.002
#: An ending is unusual if fewer than this share of its word's occurrences end there.
SELDOM = 0.02
#: Longer words must have followed a word this often to say that a shorter one is a beginning of theirs.
LONGER = 20
#: Values end at a pair of words of which this share, or less, of the ends is there that its closing marks let expect ...
STRAY = 0.1
#: ... if so many are expected.
STRAY_LEAST = 20
#: A field whose values end with a sentence this often has hardly a complete one that doesn't.
MOSTLY = 0.9

_DIGITS = {ord(c): "#" for c in "0123456789"}
_CLOSERS = " \t\r\n\"'`}])"
_ENDED = re.compile(r"[.!?…”’\")\]]$|[.!?]['\"”’)\]]+$")


def mask(text: str) -> str:
    return text.lower().translate(_DIGITS)


def strip(token: str) -> str:
    """A word without the punctuation around it."""
    return token.strip("\"'`“”‘’.,;:!?()[]{}…")


def unmarked(text: str) -> str:
    """A text, without spaces behind it, without the mark at its end."""
    if not text.endswith(("]", "…", "...", ">", ")", "�")):
        return text
    found = MARK.search(text)
    return text[: found.start()] if found else text


def _apostrophes(text: str) -> int:
    """Quotation marks among the apostrophes of a plain text."""
    return len(re.findall(r"(?<![^\W_])'|'(?![^\W_])", text))


def look(value: str) -> dict:
    """What can be told of a value's end from itself."""
    text = value.rstrip()
    marked = unmarked(text) != text
    line = text.rsplit("\n", 1)[-1].strip() if "\n" in text else ""
    line = mask(line) if 0 < len(line) <= FOOTER and not any(c in line for c in '{}"') else ""
    braces = "{" in text
    opened = text.count("{") > text.count("}") or text.count("[") > text.count("]") or text.count("```") % 2 == 1 or text[-1:] in ",;:(["
    if not braces:
        opened = opened or text.count("(") > text.count(")") or _apostrophes(text) % 2 == 1 or text.count("“") > text.count("”")
    return {"marked": marked, "opened": opened, "line": line, "body": text, "space": text != value, "chars": len(value), "bytes": len(value.encode())}


def _tail(text: str) -> tuple[bool, str, str]:
    """Whether a text ends with a sentence, and its last two words."""
    inner = text.rstrip(_CLOSERS) if "{" in text else text.rstrip()
    words = inner.rsplit(None, 2)
    last = strip(mask(words[-1])) if words else ""
    before = strip(mask(words[-2])) if len(words) > 1 else ""
    ended = inner[-1:] in ".!?…”" if "{" in text else bool(re.search(r"[.!?…”]['\")\]]*$", inner))
    return ended, before, last


def _words(batches):
    """Counts of word pairs within a batch: before, word, how often, how often closed, last, last without being closed."""
    for b in batches:
        for field in set(b.column("field_name").to_pylist()):
            pairs: Counter = Counter()
            lasts: Counter = Counter()
            for f, value in zip(b.column("field_name").to_pylist(), b.column("value").to_pylist()):
                if f != field:
                    continue
                words = mask(unmarked(value.rstrip())).split()
                if not words:
                    continue
                pairs.update(zip(words, words[1:]))
                lasts[words[-2] if len(words) > 1 else "", words[-1]] += 1
            merged: dict = {}
            for (x, y), n in [*pairs.items(), *((k, 0) for k in lasts.keys() - pairs.keys())]:
                m = merged.setdefault((strip(x), strip(y)), [0, 0, 0, 0])
                final = lasts[x, y]
                n = n or final
                closed = y.rstrip("\"'`)]”").endswith((".", ";", "!", "?", "}"))
                m[0] += n
                m[1] += n * closed
                m[2] += final
                m[3] += final * (not closed)
            rows = [(field, x, y, *m) for (x, y), m in merged.items() if y]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["field_name", "before", "word", "n", "closed", "last", "open"])


def _ends(batches):
    for b in batches:
        looked = [look(v) for v in b.column("value").to_pylist()]
        tails = [_tail(x["body"]) for x in looked]
        bare = [_tail(x["body"].rsplit("\n", 1)[0]) if x["line"] else t for x, t in zip(looked, tails)]
        cols = [b.column("row"), b.column("source"), b.column("field_name")]
        cols += [pa.array([x[k] for x in looked], t) for k, t in (("marked", pa.bool_()), ("opened", pa.bool_()), ("line", pa.string()), ("space", pa.bool_()), ("chars", pa.int32()), ("bytes", pa.int32()))]
        cols += [pa.array([t[k] for t in tails], ty) for k, ty in ((0, pa.bool_()), (1, pa.string()), (2, pa.string()))]
        cols += [pa.array([t[0] for t in bare], pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["row", "source", "field_name", "marked", "opened", "line", "space", "chars", "bytes", "ended", "before", "word", "body_ended"])


ENDS = "row bigint, source string, field_name string, marked boolean, opened boolean, line string, space boolean, chars int, bytes int, ended boolean, before string, word string, body_ended boolean"


def nodes(words: DataFrame, lengths: list[int]) -> DataFrame:
    """(node): the inner nodes, at the given depths, of the trie over ``words`` (field_name, word).

    A node is a 64-bit hash of the beginning it stands for; a word has as many as there are depths
    that the last words reach, however long it is itself.
    """
    inner = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda k: k < F.length("word"))
    return words.select(F.explode(F.transform(inner, lambda k: F.xxhash64("field_name", F.substring(F.col("word"), F.lit(1), k)))).alias("node")).distinct()


def followers(pairs: DataFrame) -> DataFrame:
    """(follow, longer): how often longer words with the same beginning follow a word, for each pair that a value breaks off behind.

    ``pairs`` has field_name, before, word, seen and open; follow is the hash of field, word before and beginning.
    """
    depths = pairs.where("open > 0").groupBy("field_name", "before").agg(F.collect_set(F.length("word")).alias("depths"))
    inner = F.filter("depths", lambda k: k < F.length("word"))
    longer = pairs.where("seen > 0").join(depths, ["field_name", "before"]).select("field_name", "before", "word", "seen", F.explode(inner).alias("k"))
    return longer.groupBy(F.xxhash64("field_name", "before", F.substring("word", F.lit(1), F.col("k"))).alias("follow")).agg(F.sum("seen").alias("longer"))


def prefixes(words: DataFrame) -> DataFrame:
    """(field_name, prefix): the proper prefixes of ``words`` (field_name, word), which are short lines."""
    long = words.select("field_name", "word").where(F.length("word") > 1)
    return long.select("field_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("prefix")).distinct()


def limits(ends: DataFrame, size: str) -> DataFrame:
    """(source, field_name, size): lengths that at least 10 values have, and 6 times what those near them have."""
    n = ends.groupBy("source", "field_name", size).agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "field_name").orderBy(size).rangeBetween(-12, 12)
    around = (F.sum("n").over(near) - F.col("n")) / 24.0
    return n.withColumn("around", around).where("n >= 10 and n >= 6 * around").select("source", "field_name", size, F.lit(True).alias(f"at_{size}"))


def cut_values(values: DataFrame) -> DataFrame:
    """(row, source, field_name, cut, why, evidence): each value with whether it lost its end.

    ``values`` has row (key), source, field_name and value.  Null and blank values are left out; a
    row and field that come twice count once.  A field without a value that ends like another
    (an empty or tiny table) is judged by its own structure and marks alone.  evidence has every kind
    that speaks for a cut; why is the first that decides, and null where none does: a last word
    inside the trie and a length at a limit may be there without a cut.
    """
    values = values.where(r"row is not null and value is not null and trim(regexp_replace(value, '[\\s\\p{Z}]+', ' ')) <> ''").select(F.col("row").cast("bigint").alias("row"), F.coalesce("source", F.lit("")).alias("source"), "field_name", "value")
    ends = table(values.mapInArrow(_ends, ENDS).dropDuplicates(["row", "field_name"]), "cut-ends")
    pairs = values.select("field_name", "value").mapInArrow(_words, "field_name string, before string, word string, n bigint, closed bigint, last bigint, open bigint")
    counts = [F.sum(c).alias(c) for c in ("n", "closed", "last", "open")]
    seen = F.col("n") - F.col("last") + F.col("closed")
    pairs = table(pairs.groupBy("field_name", "before", "word").agg(*counts).withColumn("seen", seen), "cut-pairs")

    words = table(pairs.groupBy("field_name", "word").agg(*counts), "cut-words")
    # the same beginning of a word is left by many cuts of many values: seen elsewhere, it must be so often enough
    known = words.where((seen >= KNOWN) & (seen >= KNOWN_SHARE * F.col("open")))
    fields = ends.groupBy("field_name").agg(F.count("*").alias("values"), F.avg(F.col("body_ended").cast("double")).alias("ended_share"))
    fields = table(fields.join(words.groupBy("field_name").agg((F.sum("last") / F.nullif(F.sum("closed"), F.lit(0))).alias("ends_a_closing")), "field_name", "left"), "cut-fields")
    lines = lookup_join(ends.where("line <> ''").groupBy("field_name", F.col("line").alias("word")).agg(F.count("*").alias("n")), fields, "field_name", F.col("word"))
    usual = lines.where((F.col("n") >= KNOWN) & (F.col("n") >= USUAL * F.col("values"))).select("field_name", "word")
    usual = table(usual, "cut-lines")
    part = prefixes(usual)

    # what is known of each different ending
    last = table(ends.select("field_name", "before", "word").distinct(), "cut-lasts")
    lengths = sorted(r.n for r in last.select(F.length("word").alias("n")).where("n > 0").distinct().collect())
    last = (
        last.withColumn("node", F.xxhash64("field_name", "word"))
        .join(known.select("field_name", "word", F.lit(True).alias("known")), ["field_name", "word"], "left")
        .join(words.select("field_name", "word", *[F.col(c).alias(f"w_{c}") for c in ("n", "closed", "last", "open")]), ["field_name", "word"], "left")
        .join(nodes(known, lengths).withColumn("inside", F.lit(True)), "node", "left")
        .join(pairs.select("field_name", "before", "word", *[F.col(c).alias(f"p_{c}") for c in ("n", "closed", "last", "open", "seen")]), ["field_name", "before", "word"], "left")
        .withColumn("follow", F.xxhash64("field_name", "before", "word"))
        .join(followers(pairs), "follow", "left")
    )
    last = lookup_join(last, fields.select("field_name", "values", "ends_a_closing"), "field_name", F.col("word"))

    def natural(x: str):
        """Mostly last and in a good share of the values: such a word ends there by nature; cuts are spread over words."""
        return (F.col(f"{x}_last") >= 4) & (F.col(f"{x}_last") >= USUAL * F.col("values")) & (F.col(f"{x}_last") >= 0.6 * F.col(f"{x}_n"))

    def closing(x: str):
        """The share that is closed of those places where the value goes on or is closed."""
        return F.col(f"{x}_closed") / F.nullif(F.col(f"{x}_n") - F.col(f"{x}_open"), F.lit(0))

    rate = F.when(natural("p"), 1.0).when((F.col("p_n") >= 4) & (F.col("p_n") > F.col("p_open")), closing("p")).when(natural("w"), 1.0).otherwise(F.coalesce(closing("w"), F.lit(0.0)))
    seldom = ~((F.col("p_seen") >= KNOWN) & (F.col("p_seen") >= KNOWN_SHARE * F.col("p_open")))
    part_of_longer = seldom & (F.col("longer") >= LONGER) & (F.col("p_open") <= KNOWN_SHARE * F.col("longer"))
    inside = F.coalesce(F.col("inside") & F.col("known").isNull(), F.lit(False)) | F.coalesce(part_of_longer, F.lit(False))
    # closed again and again, but within the values: "two objects held x; neither was complete"
    expected = F.col("p_closed") * F.col("ends_a_closing")
    stray = F.coalesce((expected >= STRAY_LEAST) & (F.col("p_last") <= STRAY * expected), F.lit(False))
    last = table(last.select(F.concat_ws("\0", "field_name", "before", "word").alias("k"), inside.alias("trie"), rate.alias("rate"), stray.alias("stray")), "cut-last")
    line = ends.where("line <> ''").select("field_name", F.col("line").alias("word")).distinct()
    line = line.join(usual.withColumn("usual", F.lit(True)), ["field_name", "word"], "left").join(part.select("field_name", F.col("prefix").alias("word"), F.lit(True).alias("part")), ["field_name", "word"], "left")
    line = table(line.select(F.concat_ws("\0", "field_name", "word").alias("lk"), F.coalesce("usual", F.lit(False)).alias("usual"), F.coalesce("part", F.lit(False)).alias("part")), "cut-line")

    got = ends.withColumn("k", F.concat_ws("\0", "field_name", "before", "word")).withColumn("lk", F.when(F.col("line") != "", F.concat_ws("\0", "field_name", "line")))
    got = lookup_join(got, last, "k", F.col("row"))
    got = lookup_join(got, line, "lk", F.col("row"), how="left")
    for size in ("chars", "bytes"):
        got = lookup_join(got, table(limits(ends, size), "cut-limits"), ["source", "field_name", size], F.col("row"), how="left")
    got = lookup_join(got, fields, "field_name", F.col("row"))
    usual_, part_ = F.coalesce("usual", F.lit(False)), F.coalesce("part", F.lit(False))
    got = got.withColumn("open_end", ~usual_ & ~F.col("ended")).withColumn("length", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False)))
    open_end, trie, length = F.col("open_end"), F.col("trie"), F.col("length")
    line_, sentence, ending = part_ & ~usual_ & F.col("body_ended"), open_end & (F.col("ended_share") >= MOSTLY), open_end & ((F.col("rate") < SELDOM) | F.col("stray"))
    # a length at a limit decides together with anything that a complete value hardly has
    limit = length & (F.col("space") | (open_end & ((F.col("rate") < 0.2) | trie)))
    why = F.when(F.col("marked"), "mark").when(F.col("opened"), "open").when(line_, "line").when(open_end & trie, "word").when(sentence, "sentence").when(ending, "ending").when(limit, "length")
    kinds = (("mark", F.col("marked")), ("open", F.col("opened")), ("line", line_), ("trie", trie), ("sentence", sentence), ("ending", ending), ("length", length))
    evidence = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]))
    return got.select("row", "source", "field_name", why.isNotNull().alias("cut"), why.alias("why"), evidence.alias("evidence"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = read(spark, sf_dir, "judge_results")
    return data.select(F.col("result_id").alias("row"), F.col("judge").alias("source"), F.expr("stack(2, 'raw_response', raw_response, 'final_parse_error', final_parse_error) as (field_name, value)"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of raw_response or final_parse_error that lost its end."""
    return cut_values(_values(spark, sf_dir)).where("cut").select(F.col("row").alias("result_id"), "field_name")


def p4_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each judge's values are cut, and by what it was told."""
    got = cut_values(_values(spark, sf_dir))
    return got.groupBy(F.col("source").alias("judge"), "field_name").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_share"), *[F.count_if(F.col("cut") & F.array_contains("evidence", k)).alias(f"n_{k}") for k in KINDS])


QUERIES = {"p4_found": p4_found, "p4_judges": p4_judges}
ORACLE: dict[str, str] = {}
