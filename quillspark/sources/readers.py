"""Readers: index tables, manifests, JSON in its shapes, folders of files, unit files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All columns of an index row are strings; the order is that of the file. Fixed values.
INDEX = ["id", "source", "book", "from_key", "to_key", "current_image", "current_text", "current_text_path", "next_image", "next_text", "next_text_path", "genre", "topic", "style", "narrative_tense", "narrative_perspective", "scene", "text_instruction", "ambient_sound", "speech_utterance", "speech_speaker", "speech_emotion", "speech_speed", "speech_pitch", "speech_gender", "condition_characters", "book_characters", "sample_path", "metadata_path"]
INDEX_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in INDEX])
#: What a model may see of a row: no part of the page it has to make. Fixed values.
PROMPT_COLUMNS = ["id", "current_image", "current_text", "genre", "topic", "style", "narrative_tense", "narrative_perspective", "scene", "text_instruction", "ambient_sound", "condition_characters", "book_characters"]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def index_path(spark: SparkSession, root: str) -> str:
    """The Parquet file or folder itself, or the one under data/ of a dataset folder."""
    if root.rstrip("/").endswith(".parquet"):
        return root
    inside = f"{root.rstrip('/')}/data"
    return inside if exists(spark, inside) else root


def index_table(spark: SparkSession, path: str, columns: list[str] | None = None, positions: bool = True) -> DataFrame:
    """An index with its rows' places: file and row within the file; only ``columns`` are read.

    The place in a single file is the row's number; over several files see contracts.ordinals.
    """
    have = spark.read.parquet(path)
    lacking = [c for c in (columns or INDEX) if c not in have.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    d = have.select(*(columns or have.columns), *([F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index")] if positions else []))
    return d


def manifest(spark: SparkSession, path: str, version: int | None = None, root: str | None = None) -> DataFrame:
    """The records of a one-object manifest {schema_version, dataset, records}, checked and with their places."""
    m = spark.read.option("multiLine", True).json(path)
    head = m.select(*[F.col(c) if c in m.columns else F.lit(None).alias(c) for c in ("schema_version", "dataset")], F.size("records").alias("n")).first()
    if head is None or (version is not None and head.schema_version != version):
        raise ValueError(f"{path}: schema version is {None if head is None else head.schema_version}, not {version}")
    if root is not None and (head.dataset is None or head.dataset["root"] != root):
        raise ValueError(f"{path}: made for another dataset root")
    if head.dataset is not None and "record_count" in head.dataset and head.dataset["record_count"] != head.n:
        raise ValueError(f"{path}: {head.n} records, {head.dataset['record_count']} stated")
    return m.select(F.posexplode("records").alias("position", "r")).select("position", "r.*")


def is_manifest(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one object with schema_version and records; its beginning is enough to tell."""
    if path.rstrip("/").rsplit(".", 1)[-1].lower() != "json":
        return False
    head = spark.read.option("multiLine", True).option("samplingRatio", 1.0).json(path)
    return {"schema_version", "records"} <= set(head.columns)


def records(spark: SparkSession, path: str, version: int | None = None, root: str | None = None) -> DataFrame:
    """The records of a source: of a manifest, or else of an index table."""
    return manifest(spark, path, version, root) if is_manifest(spark, path) else index_table(spark, index_path(spark, path), positions=False)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, text: str = "raw") -> DataFrame:
    """JSON lines, blank ones skipped; a line that doesn't parse has nulls and keeps its text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.col("value").alias(text)).select("r.*", text)


def numbered_lines(spark: SparkSession, path: str, schema: T.StructType | str, text: str = "raw") -> DataFrame:
    """json_lines() with ``ordinal``, the 0-based place among the lines that are not blank, over all files in the order of their names.

    Places are told by file and place within the file's reading order; lines are counted per range first, so no task sees them all.
    """
    from quillspark.operators.contracts import ordinals

    # a text scan has no line number: within a file lines come in order, block by block
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    got = ordinals(lines, ["_file", "_block", "_at"], "ordinal")
    return got.select("ordinal", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.col("value").alias(text)).select("ordinal", "r.*", text)


def json_any(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON as lines, else as one array, else those lines that hold conversations or messages; None if nothing reads."""
    for options in ({}, {"multiLine": True}):
        try:
            d = spark.read.options(mode="FAILFAST", **options).json(path)
            if d.columns and d.columns != ["_corrupt_record"]:
                d.limit(1).collect()
                d.select(F.count("*")).collect()
                return d
        except Exception:  # noqa: S112 - not this shape; the next one is tried
            continue
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    keep = lines.where(F.try_variant_get(v, "$.conversations", "variant").isNotNull() | F.try_variant_get(v, "$.messages", "variant").isNotNull())
    if keep.isEmpty():
        return None
    return keep.select(F.from_json("value", F.schema_of_json(F.lit(keep.first().value))).alias("r")).select("r.*")


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """A table by the kind of file its name says."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if kind == "json":
        if is_manifest(spark, path):
            return manifest(spark, path)
        got = json_any(spark, path)
        if got is None:
            raise ValueError(f"{path} holds no table")
        return got
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    raise ValueError(f"no reader for .{kind}")


def files(spark: SparkSession, root: str, glob: str = "*", content: bool = True) -> DataFrame:
    """(path, length, modificationTime[, content]) of all files below a folder; without content none is read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return d if content else d.select("path", "length", "modificationTime")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text): whole files, stripped."""
    from quillspark.functions.text import strip

    d = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), strip("value").alias("text"))


def records_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of results; an absent file, or one that holds no array, has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=True)
    return raw.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("r")).select("r.*")


def numbered(listing: DataFrame, path: str = "path") -> DataFrame:
    """The different folder names that are numbers, as integers."""
    name = F.regexp_extract(path, r"/([0-9]+)/[^/]*$", 1)
    return listing.select(name.try_cast("bigint").alias("dataset_index")).where("dataset_index is not null").distinct()


def units(spark: SparkSession, path: str) -> DataFrame:
    """(name, units): a name, a tab and integers; what is no integer is dropped."""
    parts = F.split("value", "\t", 2)
    nums = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), r"\s+"), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    return spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(F.get(parts, F.lit(0)).alias("name"), nums.alias("units"))


def verified(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, ok): files of a listing (path, content) against stated name, size, and sha256 or git blob sha1."""
    from quillspark.operators.cache import file_digests

    have = file_digests(listing).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    j = wanted.join(have, "name", "left")
    good = (F.col("length") == F.col("size")) & F.coalesce(F.col("sha256") == F.col("want_sha256"), F.lit(True)) & F.coalesce(F.col("blob_sha1") == F.col("want_sha1"), F.lit(True))
    return j.select("name", F.coalesce(good, F.lit(False)).alias("ok"))


def selected(wanted: DataFrame, include: list[str] = ()) -> DataFrame:
    """(name, size, sha256, blob_sha1) of a remote listing that is to be fetched: names that meet any glob, all without one.

    An absolute name, one with '..' or a backslash, or a selected one without size or digest is an error.
    """
    from quillspark.operators.candidates import like

    pick = F.lit(not include)
    for g in include:
        pick = pick | F.col("name").rlike(like(g))
    d = wanted.withColumn("_unsafe", F.col("name").isNull() | F.col("name").startswith("/") | F.contains("name", F.lit("\\")) | F.array_contains(F.split("name", "/"), ".."))
    d = d.withColumn("_pick", pick & ~F.col("_unsafe")).withColumn("_bare", F.col("_pick") & (F.col("size").isNull() | (F.col("sha256").isNull() & F.col("blob_sha1").isNull())))
    unsafe, bare = d.agg(F.count_if("_unsafe"), F.count_if("_bare")).first()
    if unsafe or bare:
        raise ValueError(f"{unsafe} unsafe names, {bare} without size or digest")
    return d.where("_pick").select("name", "size", "sha256", "blob_sha1")


def to_fetch(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(name, size, status, offset): 'done' where the file is there with its size, else 'partial' with the bytes that are there, or 'absent'.

    ``have`` has name and length; a longer file than wanted starts anew.
    """
    j = wanted.join(have.groupBy("name").agg(F.max("length").alias("_have")), "name", "left")
    status = F.when(F.col("_have") == F.col("size"), "done").when((F.col("_have") > 0) & (F.col("_have") < F.col("size")), "partial").otherwise("absent")
    return j.select("name", "size", status.alias("status"), F.when(status == "partial", F.col("_have")).otherwise(0).cast("bigint").alias("offset"))


def totals(listing: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """One row: files, different files and bytes; a name that comes again counts once with its largest size."""
    one = listing.groupBy(name).agg(F.count("*").alias("_n"), F.max(size).alias("_size"))
    return one.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("files"), F.count("*").alias("names"), F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes"))


def shard_totals(index: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: tensors, different shards they lie in, their bytes, and shards without a file.

    ``index`` has tensor and shard; ``listing`` has name and length.
    """
    shards = index.where("shard is not null").groupBy("shard").agg(F.count_distinct("tensor").alias("_tensors"))
    j = shards.join(listing.groupBy(F.col("name").alias("shard")).agg(F.max("length").alias("_length")), "shard", "left")
    return j.agg(F.coalesce(F.sum("_tensors"), F.lit(0)).alias("tensors"), F.count("*").alias("shards"), F.coalesce(F.sum("_length"), F.lit(0)).alias("bytes"), F.count_if(F.col("_length").isNull()).alias("missing"))


def raw_speech(answers: DataFrame, by: str = "dataset_index", path: str = "path", content: str = "content") -> DataFrame:
    """(by, line, name, emotion, speed, pitch, gender) from the first raw answer (by path) of each sample.

    Speaker fields that an answer lacks are the defaults; a sample whose answer holds no speech line,
    neither in its metadata nor as its quote, has nulls.
    """
    from quillspark.functions.generation import page_column

    first = answers.where(F.col(path).endswith(".json")).groupBy(by).agg(F.min_by(content, path).alias("raw"))
    p = first.select(by, page_column("raw").alias("p"))
    spoken = F.col("p.quote").isNotNull()
    return p.select(by, F.col("p.quote").alias("line"), *[F.when(spoken, F.col(f"p.{c}")).alias(c) for c in ("name", "emotion", "speed", "pitch", "gender")])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _uint(c: Column, at: Column | int, size: int, little: bool) -> Column:
    """An unsigned number of ``size`` bytes at a 1-based place of a binary column; null beyond its end."""

    def number(digits):
        parts = [F.substring(digits, 2 * k + 1, 2) for k in range(size)]
        return F.when(F.length(digits) == 2 * size, F.conv(F.concat(*(reversed(parts) if little else parts)), 16, 10).cast("bigint"))

    return _let(F.hex(F.substring(c, F.lit(at) if isinstance(at, int) else at, F.lit(size))), number)


def wav_facts(content: Column | str) -> Column:
    """channels, rate, bits, frames and seconds of a PCM WAV file, by walking its chunks; null if it is none.

    frames count what the file holds, which may be less than its header says; a file without a data
    chunk among its first 32 has 0.
    """
    c = F.col(content) if isinstance(content, str) else content
    none = F.lit(None).cast("bigint")
    start = F.struct(F.lit(13).cast("bigint").alias("at"), none.alias("fmt"), none.alias("data"), none.alias("size"))

    def walk(s, _):
        def step(h):
            first = lambda name, now, value: F.when((h["name"] == name) & now.isNull(), value).otherwise(now)
            after = F.struct((s["at"] + 8 + h["size"] + h["size"] % 2).alias("at"), first("fmt ", s["fmt"], s["at"] + 8).alias("fmt"), first("data", s["data"], s["at"] + 8).alias("data"), first("data", s["size"], h["size"]).alias("size"))
            return F.when(h["size"].isNull(), s).otherwise(after)

        return _let(F.struct(F.substring(c, s["at"].cast("int"), F.lit(4)).cast("string").alias("name"), _uint(c, (s["at"] + 4).cast("int"), 4, True).alias("size")), step)

    def facts(w):
        at = lambda k: (w["fmt"] + k).cast("int")
        head = F.struct(_uint(c, at(2), 2, True).alias("channels"), _uint(c, at(4), 4, True).alias("rate"), _uint(c, at(14), 2, True).alias("bits"))
        held = F.least(w["size"], F.octet_length(c) - w["data"] + 1)

        def told(h):
            frames = F.coalesce(F.floor(F.try_divide(held, h["channels"] * F.ceil(h["bits"] / 8))), F.lit(0)).cast("bigint")
            ok = w["fmt"].isNotNull() & (h["channels"] > 0) & (h["rate"] > 0) & (h["bits"] > 0)
            return F.when(ok, F.struct(h["channels"].alias("channels"), h["rate"].alias("rate"), h["bits"].alias("bits"), frames.alias("frames"), (frames / h["rate"]).alias("seconds")))

        return _let(head, told)

    return F.when(media_kind(c) == "wav", _let(F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, walk), facts))


def png_facts(content: Column | str) -> Column:
    """width, height and whole of a PNG file; null if it is none. whole: header first, its checksum right, end mark last."""
    c = F.col(content) if isinstance(content, str) else content
    n = F.octet_length(c)
    width, height = _uint(c, 17, 4, False), _uint(c, 21, 4, False)
    header = (F.substring(c, F.lit(13), F.lit(4)).cast("string") == "IHDR") & (_uint(c, 9, 4, False) == 13) & (F.crc32(F.substring(c, F.lit(13), F.lit(17))) == _uint(c, 30, 4, False))
    ended = F.hex(F.substring(c, (n - 11).cast("int"), F.lit(12))) == "0000000049454E44AE426082"
    return F.when((media_kind(c) == "png") & (width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height"), F.coalesce(header & ended, F.lit(False)).alias("whole")))


def broken_media(modality: Column | str, content: Column | str) -> Column:
    """Why an artifact of the right format cannot be used: 'image' (no whole PNG), 'frames' (WAV without a frame); null if it can.

    Formats other than PNG and WAV are not looked into.
    """
    m = F.col(modality) if isinstance(modality, str) else modality
    c = F.col(content) if isinstance(content, str) else content
    kind = media_kind(c)
    return F.when((m == "image") & (kind == "png") & ~F.coalesce(png_facts(c)["whole"], F.lit(False)), "image").when((m == "speech") & (kind == "wav") & (F.coalesce(wav_facts(c)["frames"], F.lit(0)) == 0), "frames")


def shrink_steps(width: Column, height: Column, size: Column, most: int, quality: int = 95, least: int = 35) -> Column:
    """What a re-encoder is to try in turn until an image of ``size`` bytes fits ``most`` in base64: array of width, height, quality.

    Qualities go down by 15 to ``least``, then the sides by a quarter at a time down to 64 pixels; an
    image that fits has one step, its own size.  Encoding itself is the caller's.
    """
    step = lambda w, h, q: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), q.cast("int").alias("quality"))
    by_quality = F.transform(F.sequence(F.lit(quality), F.lit(least), F.lit(-15)), lambda q: step(width, height, q))
    scales = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.pow(F.lit(0.75), k))
    by_size = F.filter(F.transform(scales, lambda x: step(F.floor(width * x), F.floor(height * x), F.lit(least))), lambda s: (s["width"] >= 64) & (s["height"] >= 64))
    fits = (F.floor((size + 2) / 3) * 4) <= most
    return F.when(fits, F.array(step(width, height, F.lit(quality)))).otherwise(F.concat(by_quality, by_size))


def artifact_problem(modality: Column | str, content: Column | str) -> Column:
    """Why a file is no artifact of its modality: 'empty', 'blank' or 'format'; null if it is one."""
    m = F.col(modality) if isinstance(modality, str) else modality
    c = F.col(content) if isinstance(content, str) else content
    kind = media_kind(c)
    return (
        F.when(c.isNull() | (F.octet_length(c) == 0), "empty")
        .when((m == "text") & (F.trim(F.regexp_replace(F.decode(c, "UTF-8"), r"\s+", " ")) == ""), "blank")
        .when((m == "image") & ~F.coalesce(kind.isin("png", "jpeg"), F.lit(False)), "format")
        .when((m == "speech") & ~F.coalesce(kind.isin("wav", "flac", "ogg"), F.lit(False)), "format")
    )


#: First bytes that tell a format. Fixed values.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "wav": "52494646", "flac": "664C6143", "ogg": "4F676753"}


def media_kind(content: Column | str) -> Column:
    """The format of a file by its first bytes, null if unknown; WAV must say WAVE too."""
    c = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(c, F.lit(1), F.lit(12)))
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        hit = head.startswith(magic)
        out = F.when(hit & head.endswith("57415645") if kind == "wav" else hit, kind).otherwise(out)
    return out
