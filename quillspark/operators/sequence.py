"""Sequences: runs, windows, packing, token arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _changes(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """For each row whether it differs from the one before in any column; null equals null; the first does."""
    out = np.zeros(len(pdf), bool)
    for c in columns:
        v = pdf[c]
        null = v.isna().to_numpy()
        out[1:] |= (v.to_numpy()[1:] != v.to_numpy()[:-1]) & ~(null[1:] & null[:-1])
    out[0] = True
    return out


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by..., run, value, start, end, n): maximal runs of equal values, 1-based places; null equals null.

    Rows are range-partitioned by group and order, so one group may lie in many partitions however
    large it is.  Each partition streams its rows into local runs; what joins at the borders is told
    from one row per partition and group.
    """
    from quillspark.session import table

    keep = list(dict.fromkeys([*by, *order, value]))
    d = df.select(*keep).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id()).select("_part", *by, value)
    types = {c: df.schema[c].dataType.simpleString() for c in keep}
    schema = "_part int, " + ", ".join(f"{c} {types[c]}" for c in by) + f", _k bigint, _v {types[value]}, _n bigint"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the open run, as one row
        for pdf in batches:
            if pdf.empty:
                continue
            fresh_group, fresh_run = _changes(pdf, ["_part", *by]), _changes(pdf, ["_part", *by, value])
            at = np.flatnonzero(fresh_run)
            got = pdf.iloc[at].rename(columns={value: "_v"})
            got = got.assign(_n=np.diff(np.append(at, len(pdf))), _g=np.cumsum(fresh_group)[at]).reset_index(drop=True)
            got["_k"] = got.groupby("_g").cumcount()
            for c in (*by, "_v"):
                got[c] = got[c].astype(object).where(got[c].notna(), None)
            if held is not None:
                both = pd.concat([held, got.iloc[:1]], ignore_index=True)
                if not _changes(both, ["_part", *by])[1]:  # the group goes on
                    on = not _changes(both, ["_v"])[1]
                    got.loc[got["_g"] == got["_g"].iloc[0], "_k"] += int(held["_k"].iloc[0]) + (0 if on else 1)
                    if on:
                        got.loc[0, "_n"] += int(held["_n"].iloc[0])
                        held = None
                if held is not None:
                    yield held[["_part", *by, "_k", "_v", "_n"]]
            held = got.iloc[-1:].reset_index(drop=True)
            yield got.iloc[:-1][["_part", *by, "_k", "_v", "_n"]]
        if held is not None:
            yield held[["_part", *by, "_k", "_v", "_n"]]

    parts = table(d.mapInPandas(local, schema), "runs")
    edges = parts.groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.sum("_n").alias("_rows"), F.min_by("_v", "_k").alias("_first"), F.max_by("_v", "_k").alias("_last"))
    w = Window.partitionBy(*by).orderBy("_part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_joins", (F.row_number().over(w) > 1) & F.lag("_last").over(w).eqNullSafe(F.col("_first")))
    edges = edges.withColumn("_gain", F.col("_c") - F.col("_joins").cast("int"))
    edges = edges.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), "_joins", F.coalesce(F.sum("_gain").over(before), F.lit(0)).alias("_off"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_at"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = Window.partitionBy("_part", *by).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.join(edges, same).withColumn("_end", F.col("_at") + F.sum("_n").over(inner))
    placed = placed.withColumn("run", F.col("_off") + F.col("_k") + 1 - F.col("_joins").cast("int"))
    return placed.groupBy(*by, "run").agg(F.first("_v").alias(value), (F.min(F.col("_end") - F.col("_n")) + 1).alias("start"), F.max("_end").alias("end"), F.sum("_n").alias("n"))


def run_length(values: Column, blank: Column) -> Column:
    """An array without repeated neighbours and then without blanks."""
    kept = F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))
    return F.filter(kept, lambda x: x != blank)


def sliding(values: Column, size: int, hop: int) -> Column:
    """Windows of ``size`` every ``hop`` values; a shorter array is one window, a rest at the end is dropped."""
    n = F.size(values)
    return F.when(n <= size, F.array(values)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(hop)), lambda s: F.slice(values, s + 1, F.lit(size))))


def segments(values: Column, size: int, most: int) -> Column:
    """At most ``most`` neighbouring parts of ``size`` values; the last may be shorter."""
    n = F.size(values)
    starts = F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), 1, most)
    return F.when(n == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(starts, lambda s: F.slice(values, s + 1, F.lit(size))))


def chunk_number(order: list[str], size: int, by: list[str]) -> Column:
    """0-based number of the fixed-size chunk that a row falls into within its (short) group."""
    return F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size)


def chunked(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Rows of one ordered list with the number of their fixed-size chunk, however long the list is."""
    from quillspark.operators.contracts import ordinals

    if size <= 0:
        raise ValueError("a chunk has one row at least")
    return ordinals(df, order, "_o").withColumn(name, F.floor(F.col("_o") / size)).drop("_o")


def pack(df: DataFrame, by: list[str], order: list[str], key: str, length: str, most: int, emit_tail: bool = False) -> DataFrame:
    """(by..., key, length, pack, at): rows packed in order into sequences of at most ``most``.

    A row that doesn't fit closes the sequence and starts the next.  Rows longer than ``most`` and
    of null length are dropped.  The last, unfinished sequence of a group is left out unless
    ``emit_tail``.  What fits depends on all rows before, so a group is one ordered stream of keys and
    lengths, sorted outside memory and streamed through in batches; only one open sequence is held.
    A group that is too large for one stream needs another column in ``by``, e.g. a shard.
    """
    cols = [*by, *order, key, length]
    d = df.select(*dict.fromkeys(cols)).where(f"{length} is not null and {length} <= {int(most)}").repartition(*by).sortWithinPartitions(*by, *order)
    keep = [*by, key, length]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", pack bigint, at bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fill, number, held = None, 0, 0, []

        def close():
            out = pd.DataFrame(held, columns=[*keep, "pack", "at"])
            held.clear()
            return out

        for pdf in batches:
            done = []
            for row in pdf[keep].itertuples(index=False, name=None):
                g, n = row[: len(by)], int(row[-1])
                if g != group:
                    if held and emit_tail:
                        done.append(close())
                    held.clear()
                    group, fill, number = g, 0, 0
                if fill + n > most:
                    done.append(close())
                    fill, number = 0, number + 1
                held.append((*row, number, fill))
                fill += n
            if done:
                yield pd.concat(done)
        if held and emit_tail:
            yield close()

    return d.mapInPandas(run, schema)


def pack_shared(df: DataFrame, by: list[str], order: list[str], key: str, length: str, most: int, buffers: int = 2, source: str | None = None, emit_tail: bool = False) -> DataFrame:
    """(by..., key, length, pack, at[, source]): rows of all sources packed in order with several open sequences.

    A row goes to the emptiest open sequence; where it doesn't fit, the fullest is closed and the row
    begins its successor.  Equally full ones are taken by their place.  Rows longer than ``most`` and
    of null length are dropped.  Sequences are numbered as they open; what is open at the end is left
    out unless ``emit_tail``.  As with pack() a group is one ordered stream; only the open sequences are held.
    """
    if buffers < 1:
        raise ValueError("at least one sequence is open")
    keep = [*by, key, length, *([source] if source else [])]
    d = df.select(*dict.fromkeys([*keep, *order])).where(f"{length} is not null and {length} <= {int(most)}").repartition(*by).sortWithinPartitions(*by, *order)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", pack bigint, at bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, open_, number = None, [], 0  # an open sequence: fill, number, rows
        close = lambda rows: pd.DataFrame(rows, columns=[*keep, "pack", "at"])
        for pdf in batches:
            done = []
            for row, n in zip(pdf[keep].itertuples(index=False, name=None), pdf[length].tolist()):
                g = row[: len(by)]
                if g != group:
                    if emit_tail:
                        done += [close(o[2]) for o in open_ if o[2]]
                    group, open_, number = g, [[0, k, []] for k in range(buffers)], buffers
                least = min(range(buffers), key=lambda k: open_[k][0])
                if open_[least][0] + n > most:
                    least = max(range(buffers), key=lambda k: open_[k][0])
                    done.append(close(open_[least][2]))
                    open_[least] = [0, number, []]
                    number += 1
                fill, at, rows = open_[least]
                rows.append((*row, at, fill))
                open_[least][0] = fill + n
            if done:
                yield pd.concat(done)
        if emit_tail and any(o[2] for o in open_):
            yield pd.concat([close(o[2]) for o in open_ if o[2]])

    return d.mapInPandas(run, schema)


def pack_statistics(rows: DataFrame, packed: DataFrame, source: str, length: str, most: int, buffers: int = 2) -> DataFrame:
    """(source, processed, unjoint, joint): rows that came, those that could be packed, and those that closed a sequence.

    ``packed`` is pack_shared() with its tail: the row that closes a sequence begins the next one.
    """
    came = rows.groupBy(source).agg(F.count("*").alias("processed"), F.count_if(F.col(length) <= most).alias("unjoint"))
    closed = packed.where(f"at = 0 and pack >= {buffers}").groupBy(source).agg(F.count("*").alias("joint"))
    return came.join(closed, source, "left").fillna({"joint": 0})


def finished(tokens: Column, labels: Column, sizes: Column, size: int, pad: int, ignore: int, shift: bool = True, reset: bool = True) -> Column:
    """A packed sequence as a struct: tokens, labels, position_ids, cu_seq_lens, loss_mask, max_seq_len.

    With ``shift`` labels are one ahead.  All arrays are padded or cut to ``size``; positions start
    anew for each sample with ``reset`` and go on through the padding.
    """
    drop = 1 if shift else 0
    t = F.slice(tokens, F.lit(1), F.size(tokens) - drop)
    lab = F.slice(labels, F.lit(1 + drop), F.size(labels) - drop)
    pos = F.flatten(F.transform(sizes, lambda n: F.sequence(F.lit(0), n - 1))) if reset else F.sequence(F.lit(0), F.size(tokens) - 1)
    pos = F.slice(pos, F.lit(1), F.size(tokens) - drop)
    lack = F.greatest(F.lit(size) - F.size(t), F.lit(0))
    fit = lambda x: F.slice(x, 1, size)
    more = F.when(lack > 0, F.transform(F.sequence(F.lit(1), F.greatest(lack, F.lit(1))), lambda k: F.element_at(pos, -1) + k)).otherwise(F.array().cast("array<int>"))
    labs = fit(F.concat(lab, F.array_repeat(F.lit(ignore).cast("bigint"), lack)))
    cuts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, x: a + x)))
    cu = F.concat(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.array(F.lit(size).cast("bigint")))
    longest = F.array_max(F.transform(F.sequence(F.lit(2), F.size(cu)), lambda k: F.element_at(cu, k) - F.element_at(cu, k - 1)))
    return F.struct(
        fit(F.concat(t, F.array_repeat(F.lit(pad).cast("bigint"), lack))).alias("tokens"), labs.alias("labels"), fit(F.concat(pos, more)).alias("position_ids"), cu.alias("cu_seq_lens"),
        F.transform(labs, lambda x: F.when(x == ignore, 0.0).otherwise(1.0)).alias("loss_mask"), longest.alias("max_seq_len"),
    )


def fixed(tokens: Column, size: int, fill: int) -> Column:
    """Cut or filled to ``size``."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(fill).cast("bigint"), size)), 1, size)


def eos_filled(tokens: Column, eos: int, draw: Column, most: int = 20) -> Column:
    """With 1..most end marks behind, by ``draw`` in [0, 1), if it has none."""
    n = (F.floor(draw * most) + 1).cast("int")
    return F.when(F.array_contains(tokens, F.lit(eos)), tokens).otherwise(F.concat(tokens, F.array_repeat(F.lit(eos).cast("bigint"), n)))


def decoded(tokens: Column, eos: int, base: int, codes: int, least: int) -> Column:
    """Codes before the first end mark that lie in [base, base + codes), base taken off; null if fewer than ``least``."""
    at = F.array_position(tokens, F.lit(eos))
    cut = F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int") - 1)).otherwise(tokens)
    got = F.transform(F.filter(cut, lambda x: (x >= base) & (x < base + codes)), lambda x: x - base)
    return F.when(F.size(got) >= least, got)


def expanded(tokens: Column, tag: int, start: int, context: int, end: int, many: int) -> Column:
    """Each tag as start, ``many`` context tokens and end, with the 0-based offsets of the context runs."""
    block = F.concat(F.array(F.lit(start).cast("bigint")), F.array_repeat(F.lit(context).cast("bigint"), many), F.array(F.lit(end).cast("bigint")))
    out = F.flatten(F.transform(tokens, lambda x: F.when(x == tag, block).otherwise(F.array(x))))
    places = F.filter(F.transform(tokens, lambda x, i: F.when(x == tag, i)), lambda i: i.isNotNull())
    offsets = F.transform(places, lambda p, k: p + k * (many + 1) + 1)
    return F.struct(out.alias("tokens"), offsets.alias("offsets"))


def spans(parts: Column) -> Column:
    """array<struct<name, tokens>> as one sequence: tokens, and each part's [start, end)."""
    sizes = F.transform(parts, lambda p: F.size(p["tokens"]))
    before = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x)
    where = F.transform(parts, lambda p, i: F.struct(p["name"].alias("name"), before(i).alias("start"), (before(i) + F.size(p["tokens"])).alias("end")))
    return F.struct(F.flatten(F.transform(parts, lambda p: p["tokens"])).alias("tokens"), where.alias("spans"))


def padded_prompt(prefix: Column, prompt: Column, size: int, pad: int, tail: Column) -> Column:
    """prefix, the prompt filled to ``size`` in front, and tail as one sequence: tokens, attention, start, end, too_long.

    attention is 0 on the padding and 1 elsewhere; [start, end) is where the prompt stands; a prompt
    over ``size`` gives null tokens and too_long.
    """
    lack = F.greatest(F.lit(size) - F.size(prompt), F.lit(0))
    ok = F.size(prompt) <= size
    tokens = F.concat(prefix, F.array_repeat(F.lit(pad).cast("bigint"), lack), prompt, tail)
    attention = F.concat(F.array_repeat(F.lit(1), F.size(prefix)), F.array_repeat(F.lit(0), lack), F.array_repeat(F.lit(1), F.size(prompt) + F.size(tail)))
    return F.struct(F.when(ok, tokens).alias("tokens"), F.when(ok, attention).alias("attention"), F.when(ok, F.size(prefix) + lack).alias("start"), F.when(ok, F.size(prefix) + F.lit(size)).alias("end"), (~ok).alias("too_long"))


def allowed(vocabulary: DataFrame, name: str, token: str, prefix: str, end: int | None = None) -> DataFrame:
    """(token, unit): the tokens that a decoder may choose: those named ``prefix`` and a number, and the end mark (unit null).

    ``vocabulary`` has a row per token.  One without any unit token is an error of the caller's; an empty one gives the end mark alone.
    """
    n = F.regexp_extract(name, rf"^{re.escape(prefix)}(\d+)\D*$", 1).try_cast("bigint")
    units = vocabulary.select(F.col(token).cast("bigint").alias("token"), n.alias("unit")).where("unit is not null and token is not null").distinct()
    if units.isEmpty() and not vocabulary.isEmpty():
        raise ValueError(f"no token is named {prefix}<number>")
    if end is None:
        return units
    return units.unionByName(units.sparkSession.createDataFrame([(end, None)], "token bigint, unit bigint"))


def constrained(scores: DataFrame, by: list[str], token: str, score: str, permitted: DataFrame) -> DataFrame:
    """(by..., token): of each step's candidates the best permitted one, ties to the smaller token; a step without any has null."""
    ok = permitted.select(F.col("token").alias(token)).distinct()
    best = scores.join(F.broadcast(ok) if ok.count() <= 200_000 else ok, token).groupBy(*by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(token)).alias("t"))).alias("b"))
    return scores.select(*by).distinct().join(best.select(*by, (-F.col("b.t")).alias(token)), by, "left")


def forced(tokens: Column, forced_: Column, pad: int) -> Column:
    """Tokens with a forced beginning in place of their own: as long as the longer of both, gaps filled with ``pad``."""
    n = F.greatest(F.size(tokens), F.size(forced_))
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.get(forced_, i), F.get(tokens, i), F.lit(pad).cast("bigint")))


def masked(tokens: Column, seed: Column, mask: int, low: float, high: float) -> Column:
    """Span masking: each place by a hash of seed and place, at a rate that the seed draws between low and high."""
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = low + (high - low) * unit(seed, F.lit("rate"))
    return F.transform(tokens, lambda x, i: F.when(unit(seed, i) < rate, F.lit(mask).cast("bigint")).otherwise(x))


def shuffled_mix(sources: list[tuple[DataFrame, float, int]], key: str, seed: int) -> DataFrame:
    """Sources together, each with its ordinal as ``source``: min(int(total x ratio), number) rows, repeated in turn where that is more than all.

    Rows are ordered by a hash of seed and key within a source; ratio or number 0 skips the source.
    Columns that a source lacks are null; a column ``id`` is dropped; without any source left None.
    """
    from quillspark.functions.sampling import smallest, uniform

    out = None
    for n, (df, ratio, number) in enumerate(x for x in sources if x[1] and x[2]):
        if out is None:  # sources without rows give their columns
            out = df.drop("id").withColumn("source", F.lit(n)).where("false")
        total = df.count()
        used = min(int(total * ratio), number)
        if not total or not used:
            continue
        d = df.drop("id").withColumn("source", F.lit(n)).withColumn("_u", uniform(str(seed), F.lit(n), key)).withColumn("_k", F.lit(used % total)).withColumn("_g", F.lit(0))
        whole = d.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(used // total)))).drop("_rep") if used >= total else d.where("false")
        got = whole.unionByName(smallest(d, ["_g"], "_u", "_k", key)).drop("_u", "_k", "_g")
        out = out.unionByName(got, allowMissingColumns=True)
    return out


