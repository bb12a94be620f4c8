"""The boundary to models: requests in, one result per request out, whatever happens in between.

A model is a function from a list of requests to a list of responses, made once per worker by an
adapter.  A batch that fails is tried item by item; errors that no item can cure end the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and message parts of errors after which a model is gone. Fixed values.
FATAL_NAMES = ("EngineDeadError", "EngineGenerateError", "ImportError", "ModuleNotFoundError", "OutOfMemoryError", "PromptAdapterError")
FATAL_PARTS = ("cannot re-initialize cuda in forked subprocess", "engine core initialization failed", "enginecore failed to start", "engine core failed to start", "engine is dead", "engine has died", "workerproc failed", "cuda out of memory", "failed to apply required model chat template kwargs", "failed to apply prompt replacement")


@dataclass(frozen=True)
class Adapter:
    """How a model is made and what it may judge."""

    key: str
    model_name: str
    family: str
    modalities: tuple[str, ...]
    make: Callable[[], Callable[[list[dict]], list[str]]] = field(repr=False, compare=False, default=None)


class Registry:
    """Adapters by key and by case-folded model name; both must be unique."""

    def __init__(self, adapters: list[Adapter]):
        self.by_key: dict[str, Adapter] = {}
        self.by_name: dict[str, Adapter] = {}
        for a in adapters:
            for table, k in ((self.by_key, a.key), (self.by_name, a.model_name.casefold())):
                if k in table:
                    raise ValueError(f"{k!r} is registered twice")
                table[k] = a

    def named(self, name: str) -> Adapter:
        try:
            return self.by_name[name.casefold()]
        except KeyError:
            raise ValueError(f"no adapter for model {name!r}") from None

    def assigned(self, stages: dict[int, dict[str, str]]) -> dict[tuple[int, str], Adapter]:
        """The adapter of each (stage, modality); each must be able to judge it."""
        out = {}
        for stage, row in stages.items():
            for modality, key in row.items():
                a = self.by_key.get(key)
                if a is None or modality not in a.modalities:
                    raise ValueError(f"stage {stage}: {key!r} cannot judge {modality}")
                out[stage, modality] = a
        return out


def fatal(error: BaseException | None) -> bool:
    """Whether an error, or one that caused it, means that the model is gone."""
    while error is not None:
        if type(error).__name__ in FATAL_NAMES or any(p in str(error).lower() for p in FATAL_PARTS):
            return True
        error = error.__cause__ or error.__context__
    return False


RESULT = "key bigint, raw_response string, inference_status string, error string"


def run(requests: DataFrame, adapter: Adapter, key: str, request: str, batch: int = 16) -> DataFrame:
    """(key, raw_response, inference_status, error), one row per request; a short answer leaves an error row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            rows = []
            model = model or adapter.make()
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                items = part[request].tolist()
                try:
                    got = [(r, None) for r in model(items)]
                except Exception as e:
                    if fatal(e):
                        raise
                    got = []
                    for item in items:
                        try:
                            got.append((model([item])[0], None))
                        except Exception as one:
                            if fatal(one):
                                raise
                            got.append((None, f"{type(one).__name__}: {one}"))
                got += [(None, "no response for this request")] * (len(items) - len(got))
                rows += [(k, r, "ok" if e is None else "error", e) for k, (r, e) in zip(part[key], got)]
            yield pd.DataFrame(rows, columns=["key", "raw_response", "inference_status", "error"])

    return requests.select(key, request).mapInPandas(work, RESULT)


def pipeline(samples: DataFrame, key: str, prompt: str, plan: Adapter, image: Adapter, speech: Adapter) -> DataFrame:
    """(key, narration, image, speech, failed): a plan for each sample, then an image and a voice from what it says.

    The plan is a labelled text; a sample whose plan fails has neither, and ``failed`` names the
    modalities that a sample lacks.
    """
    from quillspark.functions.generation import plan_with_defaults
    from quillspark.session import table

    got = run(samples, plan, key, prompt).select(F.col("key").alias(key), F.when(F.col("inference_status") == "ok", F.col("raw_response")).alias("raw"))
    plans = table(got.withColumn("p", plan_with_defaults(F.col("raw"), F.lit(""))).select(key, F.when(F.col("raw").isNotNull(), F.col("p.narration")).alias("narration"), F.coalesce(F.nullif("p.image_prompt", F.lit("")), "p.narration").alias("scene"), "p.speech"), "plans")
    good = plans.where("narration is not null")
    made = lambda a, c, name: run(good, a, key, c).select(F.col("key").alias(key), F.when(F.col("inference_status") == "ok", F.col("raw_response")).alias(name))
    out = plans.select(key, "narration").join(made(image, "scene", "image"), key, "left").join(made(speech, "speech", "speech"), key, "left")
    lacks = [F.when(F.col(c).isNull(), F.lit(m)) for c, m in (("narration", "text"), ("image", "image"), ("speech", "speech"))]
    return out.withColumn("failed", F.array_compact(F.array(*lacks)))


#: Families of models and what each takes beside a request's text. Fixed values.
FAMILIES = {"text": (), "vision": ("image",), "audio": ("audio",), "omni": ("image", "audio"), "speech": ("voice",), "echo": ()}


def dispatch(requests: DataFrame, adapters: dict[str, Adapter], key: str, request: str, family: str, batch: int = 16) -> DataFrame:
    """(key, raw_response, inference_status, error): each request by the adapter of its family; unknown families are error rows."""
    for name, a in adapters.items():
        if name not in FAMILIES or a.family != name:
            raise ValueError(f"{a.key!r} is no adapter of family {name!r}")
    out = requests.where(~F.coalesce(F.col(family).isin(list(adapters)), F.lit(False))).select(F.col(key).cast("bigint").alias("key"), F.lit(None).cast("string").alias("raw_response"), F.lit("error").alias("inference_status"), F.concat(F.lit("no model of family "), F.coalesce(F.col(family), F.lit("null"))).alias("error"))
    for name, a in adapters.items():
        out = out.unionByName(run(requests.where(F.col(family) == name), a, key, request, batch))
    return out


def repair_pass(results: DataFrame, adapter: Adapter, key: str, raw: str, modality: str, record: str = "record", batch: int = 16) -> DataFrame:
    """``results`` with ``record`` after one pass of a repair model over the records that did not parse.

    ``record`` is what judgejson.parse_column gives.  Only open records with a response become requests;
    an answer that fails or is missing leaves its record as it is.  ``key`` is unique.
    """
    from quillspark.functions import judgejson as J

    open_ = results.where((F.col(f"{record}.status") == "parse_error") & (F.trim(F.coalesce(raw, F.lit(""))) != ""))
    ask = open_.select(F.col(key).cast("bigint").alias(key), F.to_json(J.repair_request(raw, F.col(f"{record}.final_parse_error"), modality)).alias("_request"))
    answers = run(ask, adapter, key, "_request", batch).select(F.col("key").alias(key), F.when(F.col("inference_status") == "ok", F.col("raw_response")).alias("_answer"))
    joined = results.join(answers, key, "left")
    return joined.withColumn(record, J.repair_column(F.col(record), F.col("_answer"), modality)).drop("_answer")


def attach(records: DataFrame, results: DataFrame, key: str, reason: str = "Candidate artifact is unavailable.") -> DataFrame:
    """Every record with its result; records without one are skipped, for the reason given."""
    r = results.select(F.col("key").alias(key), "raw_response", "inference_status", "error")
    d = records.join(r, key, "left")
    return d.withColumn("inference_status", F.coalesce("inference_status", F.lit("skipped"))).withColumn("reason", F.when(F.col("inference_status") == "skipped", F.lit(reason)).otherwise(F.col("error"))).drop("error")


def dry_run(records: DataFrame, present: str) -> DataFrame:
    """What a run would do: dry_run_ok where the candidate is there, else dry_run_missing."""
    s = F.when(F.coalesce(F.col(present), F.lit(False)), "dry_run_ok").otherwise("dry_run_missing")
    return records.withColumn("status", s).withColumn("inference_status", s).withColumn("parse_status", F.lit("not_attempted")).withColumn("repair_status", F.lit("not_eligible"))


def routed(name: str, rules: list[tuple[str, str]], default: str):
    """The value of the first rule whose part a model name has, ignoring case."""
    out = F.lit(default)
    for part, value in reversed(rules):
        out = F.when(F.contains(F.lower(F.col(name)), F.lit(part.lower())), value).otherwise(out)
    return out


def echo_adapter(fail_on: str = "") -> Adapter:
    """A model for tests: gives each prompt back in capitals, fails on those that contain ``fail_on``."""

    def make():
        def model(items: list) -> list[str]:
            if fail_on and any(fail_on in str(x) for x in items):
                raise RuntimeError("cannot answer")
            return [str(x).upper() for x in items]

        return model

    return Adapter("echo", "Echo-1", "echo", ("text", "image", "speech", "joint"), make)
