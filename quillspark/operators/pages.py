"""Index rows as the records that judges and generators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

PERSON = "array<map<string,string>>"
SPEAKER = {"name": "speech_speaker", "line": "speech_utterance", "emotion": "speech_emotion", "speed": "speech_speed", "pitch": "speech_pitch", "gender": "speech_gender"}


def rooted(path: Column | str, root: str) -> Column:
    """A path below root; an empty one stays empty."""
    p = T.col(path)
    return F.when(p != "", F.concat(F.lit(root.rstrip("/") + "/"), p)).otherwise(p)


def canonical(df: DataFrame, root: str) -> DataFrame:
    """The nested record of each index row: metadata, both pages, condition and speech."""
    people = lambda c: F.from_json(c, PERSON)
    speaker = F.struct(*[F.col(c).alias(n) for n, c in SPEAKER.items()])
    condition = F.struct(people("condition_characters").alias("characters"), F.col("scene"), F.col("text_instruction").alias("text content"), F.col("ambient_sound"))
    page = lambda p: F.struct(rooted(f"{p}_image", root).alias("image_path"), F.col(f"{p}_text").alias("text"), rooted(f"{p}_text_path", root).alias("text_path"))
    meta = F.struct("genre", "topic", "style", "narrative_tense", "narrative_perspective", people("book_characters").alias("characters"))
    return df.select(
        "id", "source", "book", F.col("from_key").alias("prev_key"), F.col("to_key").alias("next_key"), F.struct(meta.alias("metadata")).alias("metadata"), page("current").alias("current_page"),
        F.struct(condition.alias("condition_json"), F.to_json(condition).alias("condition_text")).alias("next_page_condition"), page("next").alias("next_page"),
        F.struct(F.to_json(F.struct(speaker.alias("speaker"))).alias("raw"), F.struct(speaker.alias("speaker")).alias("parsed")).alias("speech_metadata_next_page"),
    )


def public_view(df: DataFrame) -> DataFrame:
    """The public sample shape of each index row, paths relative as they are stored."""
    people = lambda c: F.from_json(c, PERSON)
    page = lambda p: F.struct(F.col(f"{p}_image").alias("image"), F.col(f"{p}_text").alias("text"), F.col(f"{p}_text_path").alias("text_path"))
    meta = F.struct("genre", "topic", "style", "narrative_tense", "narrative_perspective", people("book_characters").alias("characters"))
    speech = F.struct(F.col("speech_utterance").alias("utterance"), F.col("speech_speaker").alias("speaker"), *[F.col(f"speech_{k}").alias(k) for k in ("emotion", "speed", "pitch", "gender")])
    return df.select(
        "id", "source", "book", F.struct(F.col("from_key").alias("from"), F.col("to_key").alias("to")).alias("transition"), F.col("metadata_path").alias("book_metadata_path"), F.struct(page("current").alias("current_page"), meta.alias("book_metadata")).alias("input"),
        F.struct(people("condition_characters").alias("characters"), "scene", "text_instruction", "ambient_sound").alias("next_page_condition"), F.struct(page("next").alias("next_page"), speech.alias("speech")).alias("ground_truth"),
    )


def disagreements(view: DataFrame, samples: DataFrame, key: str = "id") -> DataFrame:
    """(key, has_sample, equal): each view against its sample's JSON (key, body), as values, not as text."""
    canon = lambda c: F.to_json(F.try_parse_json(c))  # noqa: E731 - variants sort their keys
    v = view.select(key, canon(F.to_json(F.struct(*[c for c in view.columns]))).alias("want"))
    s = samples.groupBy(key).agg(F.max("body").alias("body")).select(key, canon("body").alias("have"))
    j = v.join(s, key, "left")
    return j.select(key, F.col("have").isNotNull().alias("has_sample"), F.coalesce(F.col("want") == F.col("have"), F.lit(False)).alias("equal"))


def identity(df: DataFrame) -> DataFrame:
    """dataset_index, id, source and book, 'unknown' where null."""
    return df.select(F.col("index").alias("dataset_index"), *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("id", "source", "book")])


def public(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def present(media: Column | str) -> Column:
    """True for a list of media with at least one and no null."""
    m = T.col(media)
    return F.coalesce((F.size(m) > 0) & ~F.exists(m, lambda x: x.isNull()), F.lit(False))


def prefixed(df: DataFrame, media: list[str], prefixes: DataFrame) -> DataFrame:
    """Media paths with the prefix of their source; ``prefixes`` has source and prefix, one row per source."""
    from quillspark.functions.skew import lookup_join

    d = lookup_join(df, prefixes, "source", F.col(media[0]) if media else F.col("source"), how="left")
    put = lambda c: F.transform(F.col(c), lambda p: F.concat(F.coalesce("prefix", F.lit("")), p))
    return d.withColumns({c: put(c) for c in media}).drop("prefix")


def unwrapped(value: Column, *names: str) -> Column:
    """A variant without the wrappers of these names, or as it is."""
    for n in names:
        value = F.coalesce(F.try_variant_get(value, f"$.{n}", "variant"), value)
    return value


def http_url(base: Column | str, path: Column | str) -> Column:
    """A path below an HTTP(S) address, encoded except for its slashes; null if the base is no such address."""
    b = F.regexp_replace(T.col(base), "/+$", "")
    p = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.when(b.rlike(r"(?i)^https?://[^/\s]+"), F.concat(b, F.lit("/"), p))


def true_attributes(parsed: Column) -> Column:
    """name, line and labels of the speaker that counts: the one or the first numbered with a line, else the first.

    ``parsed`` is map<string, struct<name,line,emotion,speed,pitch,gender>>.
    """
    entries = F.filter(F.map_entries(parsed), lambda e: e["key"].rlike(r"^speaker(?:_\d+)?$") & e["value"].isNotNull())
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct(F.coalesce(F.regexp_extract(e["key"], r"_(\d+)$", 1).try_cast("int"), F.lit(-1)).alias("n"), e["value"].alias("v"))))
    spoken = F.filter(ranked, lambda r: ~T.blank(r["v"]["line"]))
    return F.coalesce(F.get(spoken, F.lit(0)), F.get(ranked, F.lit(0)))["v"]


def collated(rows: Column, pad: int) -> Column:
    """Arrays of different lengths as equally long ones, padded behind."""
    most = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(pad).cast("bigint"), most - F.size(r))))


def strict_schema(schema: dict) -> dict:
    """A JSON schema whose objects, at any depth, require all their properties and allow no others."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(v) for k, v in schema.items()}
    if out.get("type") == "object":
        out["additionalProperties"] = False
        out["required"] = list(out.get("properties", {}))
    return out


def response_schema(categories: list[str]) -> dict:
    """The JSON schema of a judge's answer."""
    one = {"type": "object", "properties": {"score": {"type": "integer", "minimum": 1, "maximum": 10}, "rationale": {"type": "string", "minLength": 1}}}
    return strict_schema({"type": "object", "properties": {c: one for c in categories}})


def commit_hash(c: Column | str) -> Column:
    """True for a full git commit name."""
    return T.col(c).rlike("^[0-9a-f]{40}$")
