"""Rendered prompts and conversations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def render(template: str, **fields: Column | str) -> Column:
    """A template with {name} places; a field of null is ''. Braces that name no field stay."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) in fields:
            parts += [F.lit(template[at : m.start()]), F.coalesce(T.col(fields[m.group(1)]).cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def metadata_line(topic: Column, genre: Column, style: Column, names: Column, most: int = 5) -> Column:
    """title, kind and the first names of a story, with stand-ins for what is blank."""
    named = F.array_join(F.slice(F.filter(names, lambda n: ~T.blank(n)), 1, most), ", ")
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    return F.struct(F.coalesce(some(topic), F.lit("Unknown title")).alias("title"), F.coalesce(some(genre, style), F.lit("children's story")).alias("kind"), F.coalesce(some(named), F.lit("Unknown characters")).alias("characters"))


def condition_text(scene: Column, goal: Column, ambient: Column, people: Column, most: int = 3) -> Column:
    """What a page has to show, one line each for what is there; people are structs of name, emotion, action."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    one = lambda p: F.concat(F.coalesce(p["name"], F.lit("Unknown")), F.when(F.coalesce(p["emotion"], F.lit("")) != "", F.concat(F.lit(" feeling "), p["emotion"])).otherwise(""), F.when(F.coalesce(p["action"], F.lit("")) != "", F.concat(F.lit(", "), p["action"])).otherwise(""))
    bits = F.array_join(F.transform(F.slice(F.coalesce(people, F.array().cast("array<struct<name:string,emotion:string,action:string>>")), 1, most), one), "; ")
    text = F.concat_ws("\n", line("Scene: ", scene), line("Narrative goal: ", goal), line("Ambient mood: ", ambient), line("Character states: ", bits))
    return F.when(text == "", "Continue the story naturally.").otherwise(text)


def speech_condition(people: Column, ambient: Column) -> Column:
    """One line per character with what is known of them, and the ambient sound."""
    keys = ("emotion", "speech_intent", "action", "visibility")
    one = lambda p: F.concat_ws("; ", F.concat(F.lit("- "), F.coalesce(p["name"], F.lit("Unknown"))), *[F.when(F.coalesce(p[k], F.lit("")) != "", F.concat(F.lit(f"{k}: "), p[k])) for k in keys])
    return F.concat_ws("\n", F.array_join(F.transform(people, one), "\n"), F.when(F.coalesce(ambient, F.lit("")) != "", F.concat(F.lit("- ambient sound: "), ambient)))


def judge_request(modality: Column | str, sections: dict[str, Column | str]) -> Column:
    """The messages that ask a judge for the scores of a modality's four categories: the form first, then each section under its name.

    Sections that are null or blank are left out; an unknown modality has null.  The wording is this library's own.
    """
    import json

    from quillspark.functions.judgejson import CATEGORIES

    form = {m: json.dumps({c: {"score": "<integer 1-10>", "rationale": "<one or two sentences>"} for c in cs}) for m, cs in CATEGORIES.items()}
    forms = F.create_map(*[F.lit(x) for kv in form.items() for x in kv])
    form_ = F.try_element_at(forms, T.col(modality))
    system = F.concat(F.lit("You judge one generated story page. Score each category from 1 (poor) to 10 (excellent) and say why.\nAnswer with this JSON object and nothing else:\n"), form_)
    body = F.concat_ws("\n\n", *[F.when(~T.blank(c), F.concat(F.lit(f"## {name}\n"), T.strip(c))) for name, c in sections.items()])
    return F.when(form_.isNotNull(), F.array(message("system", system), message("user", body)))


#: How a label sounds when it is described. Fixed values.
VOICE = {
    "emotion": {"angry": "angry and tense", "happy": "cheerful and upbeat", "neutral": "calm and neutral", "sad": "sad and soft"},
    "speed": {"slow": "slow", "normal": "moderate", "fast": "slightly fast"},
    "pitch": {"low": "low", "normal": "moderate", "high": "slightly high"},
}


def voice_description(voice: Column, emotion: Column, speed: Column, pitch: Column) -> Column:
    """A voice in words; labels off the lists sound calm and moderate."""
    say = lambda c, k, d: F.coalesce(T.lookup(c, VOICE[k]), F.lit(d))
    return F.concat(voice, F.lit(": "), say(emotion, "emotion", "calm and neutral"), F.lit(", "), say(speed, "speed", "moderate"), F.lit(" pace, "), say(pitch, "pitch", "moderate"), F.lit(" pitch"))


def chat(df: DataFrame, by: list[str], turn: str, text: str, system: str, roles: tuple[str, str], seps: tuple[str, str], prefix: str = "") -> DataFrame:
    """(by..., prompt): turns in order under alternating roles, closed by their separators.

    Blank texts leave an open role; after a last turn of the first role the second is opened, with
    ``prefix`` as its beginning.
    """
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("m")))).alias("turns"))
    n = F.size("turns")

    def one(x, i):
        role = F.when(i % 2 == 0, roles[0]).otherwise(roles[1])
        sep = F.when(i % 2 == 0, seps[0] + "\n").otherwise(F.concat(F.lit(seps[1]), F.when(i != n - 1, "\n").otherwise("")))
        return F.when(F.coalesce(x["m"], F.lit("")) != "", F.concat(role, F.lit(": "), x["m"], sep)).otherwise(F.concat(role, F.lit(":")))

    body = F.array_join(F.transform("turns", one), "")
    open_ = F.when(n % 2 == 1, F.lit(roles[1] + ":" + (" " + prefix if prefix else ""))).otherwise("")
    return g.select(*by, F.concat(F.lit(system + "\n"), body, open_).alias("prompt"))


def messages(df: DataFrame, by: list[str], turn: str, text: str, system: str) -> DataFrame:
    """(by..., messages): a system message and the turns as user and assistant messages in order; open turns left out."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("m")))).alias("turns"))
    all_ = F.transform("turns", lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x["m"].alias("content")))
    return g.select(*by, F.concat(F.array(message("system", F.lit(system))), F.filter(all_, lambda m: m["content"].isNotNull())).alias("messages"))


def with_directive(messages_: Column, directive: str) -> Column:
    """Messages whose system message ends with a directive; one is put in front where there is none."""
    own = F.exists(messages_, lambda m: m["role"] == "system")
    put = F.transform(messages_, lambda m: F.when(m["role"] == "system", F.struct(m["role"].alias("role"), F.concat_ws("\n", m["content"], F.lit(directive)).alias("content"))).otherwise(m))
    return F.when(own, put).otherwise(F.concat(F.array(message("system", F.lit(directive))), messages_))


def pairs(df: DataFrame, by: list[str], turn: str, text: str) -> DataFrame:
    """(by..., pair, asked, answered): turns two by two; a last question without answer has null."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*by).orderBy(turn)) - 1
    d = df.select(*by, text, n.alias("_n")).withColumn("pair", F.floor(F.col("_n") / 2))
    pick = lambda k: F.max(F.when(F.col("_n") % 2 == k, F.col(text)))
    return d.groupBy(*by, "pair").agg(pick(0).alias("asked"), pick(1).alias("answered"))


def reordered(content: Column) -> Column:
    """Message parts with images first, then text, then audio; other kinds last, each in its order."""
    kinds = ("image", "text", "audio")

    def of(kind: str) -> Column:
        return F.filter(content, lambda p: p["type"] == kind)

    return F.concat(*[of(k) for k in kinds], F.filter(content, lambda p: ~p["type"].isin(*kinds)))


def placeholder_gap(prompt: Column, mark: str, content: Column, kind: str) -> Column:
    """Marks in a rendered prompt less the parts of that kind; 0 if they agree."""
    return F.regexp_count(prompt, F.lit(re.escape(mark))) - F.size(F.filter(content, lambda p: p["type"] == kind))


def indented(c: Column) -> Column:
    """A value as prompt text: a string as it is, else JSON."""
    return F.to_json(c, {"pretty": "true"})


def pick(options: list[str], *keys: Column | str, seed: int = 0) -> Column:
    """One of the options by a hash of the keys: the same in every run."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(len(options))) + 1).cast("int"))


def flattened(content: Column, reasoning: Column, refusal: Column, calls: Column) -> Column:
    """The parts of an answer's message that say anything, joined by lines: content, reasoning, refusal, tool calls (JSON); '' if none does."""
    return F.concat_ws("\n", *[F.when(~T.blank(c), T.strip(c)) for c in (content, reasoning, refusal, calls)])


def answer_or_error(text: Column, finish_reason: Column, most: Column) -> Column:
    """text and error of an answer: one that stopped for its length is an error that says at how many tokens, as is a blank one."""
    cut = F.coalesce(F.lower(finish_reason) == "length", F.lit(False))
    error = F.when(cut, F.concat(F.lit("stopped at the limit of "), F.coalesce(most.cast("string"), F.lit("unknown")), F.lit(" tokens"))).when(T.blank(text), "empty answer")
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))
