"""Pages out of models' answers: labelled, JSON, quoted or plain."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.judgejson import readings

#: What a speaker is unless an answer says otherwise. Fixed values.
SPEAKER = {"name": "Narrator", "emotion": "neutral", "speed": "normal", "pitch": "normal", "gender": "female"}

#: What a plan without speech says. Fixed value.
STOCK_SPEECH = "Let's keep going."

_QUOTED = re.compile(r'"([^"]+)"|“([^”]+)”|\'([^\']+)\'')
_LABELLED = {"narration": re.compile(r"(?is)(?:^|\n)\s*narration\s*:\s*(.+?)(?=(?:\n\s*speech\s*:)|\Z)"), "speech": re.compile(r"(?is)(?:^|\n)\s*speech\s*:\s*(.+?)\s*$")}
_LEAD = re.compile(r"^\s*(?:narration|speech)\s*:\s*", re.I)


def _flat(text: str) -> str:
    return " ".join(text.split())


def _one_pair(text: str) -> str:
    text = text.strip()
    return text[1:-1].strip() if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'" else text


def narration_and_speech(answer: str | None) -> tuple[str, str]:
    """(narration, speech) of one answer.

    Labels count before JSON members; without either the last quoted span is the speech and the
    first line the narration.  A narration doesn't repeat the quoted speech.  An empty answer gives
    two empty texts.
    """
    text = answer or ""
    found = {"narration": "", "speech": ""}
    for value in readings(text) if "{" in text else ():
        if isinstance(value, dict):
            for key, names in (("narration", ("narration",)), ("speech", ("speech", "speech_text"))):
                got = next((value[n] for n in names if isinstance(value.get(n), str)), "")
                found[key] = found[key] or _flat(got)
            break
    # a narration ends at the next speech, the first speech at the end of the answer
    for key, label in _LABELLED.items():
        if m := label.search(text):
            found[key] = _flat(m.group(1))
    spans = [_flat("".join(s)) for s in _QUOTED.findall(text) if "".join(s).strip()]
    if not found["speech"] and spans:
        found["speech"] = spans[-1]
    lines = [x for x in (_flat(_LEAD.sub("", line)) for line in text.splitlines()) if x]
    if not found["narration"] and lines:
        found["narration"] = lines[0]
        if len(lines) > 1 and not found["speech"]:
            found["speech"] = lines[1]
    narration, speech = _one_pair(found["narration"]), _one_pair(found["speech"])
    narration = _flat(narration)
    head, *rest = re.split(r"(?<=[.!?])\s+", narration, maxsplit=1)
    if rest and head.lower().startswith(T.META_OPENINGS):
        narration = rest[0]
    if speech and narration:
        narration = _flat(narration.replace(f'"{speech}"', "").replace(f"“{speech}”", ""))
    return narration or _flat(text), speech


def first_pair(answer: str | None) -> tuple[str, str]:
    """The first NARRATION and SPEECH of an answer in lines; a label may stand alone above its text.

    Of several speeches the first that can be spoken.  Without any label the first two lines.
    """
    mark = re.compile(r"^(narration|speech)\s*:?\s*\**\s*:?\s*", re.I)
    bare = lambda s: re.sub(r"^[\s>#*\-•–—`_]+|[\s*_`]+$", "", s).replace("**", "").strip()
    lines = [x for x in map(bare, (answer or "").splitlines()) if x]
    got: dict[str, list[str]] = {"narration": [], "speech": []}
    label, held = None, ""
    for line in [*lines, "speech:"]:  # a last label closes the open one
        m = mark.match(line)
        if m:
            if label and held:
                got[label].append(held)
            label, held = m.group(1).lower(), _flat(bare(line[m.end() :]))
        elif label and not held:
            held = _flat(line)
    speech = next((s for s in got["speech"] if not re.match(r"(?s)^[(\[].*[)\]]$", s.strip())), got["speech"][0] if got["speech"] else "")
    if not got["narration"] and not got["speech"]:
        return (_flat(lines[0]) if lines else "", _flat(lines[1]) if len(lines) > 1 else "")
    return (got["narration"][0] if got["narration"] else "", speech)


def _pairs(parse):
    @F.pandas_udf("struct<narration:string,speech:string>")
    def run(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(a) for a in answers], columns=["narration", "speech"])

    return run


def narration_speech_column(answer: Column | str) -> Column:
    return _pairs(narration_and_speech)(answer)


def first_pair_column(answer: Column | str) -> Column:
    return _pairs(first_pair)(answer)


def page(answer: str | None) -> dict:
    """text, image_prompt, quote and speaker fields of an answer that holds a page as JSON anywhere; error if none does."""
    out = dict.fromkeys(("text", "image_prompt", "quote", *SPEAKER, "error"))
    last = "no JSON object"
    for value in readings(answer or ""):
        if not isinstance(value, dict):
            continue
        text = value.get("text")
        if not isinstance(text, str) or not text.strip():
            last = "no text"
            continue
        meta = value.get("speech_metadata")
        if isinstance(meta, str):
            meta = next((v for v in readings(meta) if isinstance(v, dict)), None)
        speaker = meta.get("speaker") if isinstance(meta, dict) and isinstance(meta.get("speaker"), dict) else {}
        line = next((x for x in (speaker.get("line"), value.get("quote")) if isinstance(x, str) and x.strip()), None)
        out.update({k: speaker[k].strip() if isinstance(speaker.get(k), str) and speaker[k].strip() else d for k, d in SPEAKER.items()})
        out.update(text=text.strip(), image_prompt=flat_prompt(value.get("t2i")), quote=line.strip() if line else None, error=None if line else "no speech line")
        return out
    return out | {"error": last}


def flat_prompt(value) -> str:
    """An image prompt of any shape as one line: lists joined by spaces, objects as named parts."""
    if value is None:
        return ""
    if isinstance(value, str):
        return _flat(value)
    if isinstance(value, list):
        return " ".join(str(x).strip() for x in value if str(x).strip())
    if isinstance(value, dict):
        parts = []
        for k, v in value.items():
            inner = ", ".join(f"{a}: {b}" for a, b in v.items() if isinstance(b, (str, int, float))) if isinstance(v, dict) else v if isinstance(v, (str, int, float)) else None
            if inner not in (None, ""):
                parts.append(f"{k}: {inner}")
        return "; ".join(parts)
    return str(value).strip()


def best_effort(answer: str | None) -> tuple[str | None, str]:
    """(JSON object, how): the first object that reads, the strictest way first: whole, fenced, outer, tolerant; (None, 'none') if none does.

    outer is from the first opening to the last closing brace; tolerant bends JSON's rules as judgejson.Reader does.
    """
    text = (answer or "").strip()
    fence = re.search(r"(?is)```(?:json)?\s*(.*?)\s*```", text)
    at, end = text.find("{"), text.rfind("}")
    for how, part in (("whole", text), ("fenced", fence.group(1) if fence else ""), ("outer", text[at : end + 1] if 0 <= at < end else "")):
        try:
            got = json.loads(part)
        except ValueError:
            continue
        if isinstance(got, dict):
            return json.dumps(got, ensure_ascii=False), how
    got = next((v for v in readings(text) if isinstance(v, dict)), None)
    return (None, "none") if got is None else (json.dumps(got, ensure_ascii=False), "tolerant")


def best_effort_column(answer: Column | str) -> Column:
    @F.pandas_udf("struct<json:string,how:string>")
    def run(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_effort(a) for a in answers], columns=["json", "how"])

    return run(answer)


PAGE = "struct<text:string,image_prompt:string,quote:string,name:string,emotion:string,speed:string,pitch:string,gender:string,error:string>"


def page_column(answer: Column | str) -> Column:
    @F.pandas_udf(PAGE)
    def run(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page(a) for a in answers], columns=["text", "image_prompt", "quote", *SPEAKER, "error"])

    return run(answer)


def plan_with_defaults(answer: Column, instruction: Column) -> Column:
    """The labelled plan, with the instruction or the raw answer as narration and stock words where speech is missing."""
    p = T.plan_fields(answer)
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    return F.struct(some(p["narration"], T.clean_value(instruction), T.clean_value(answer)).alias("narration"), some(p["speaker"], F.lit("character")).alias("speaker"), some(p["speech"], F.lit(STOCK_SPEECH)).alias("speech"), p["image_prompt"].alias("image_prompt"))


def unit_text(units: Column, prefix: str, start: str, end: str) -> Column:
    """Discrete units as marked text."""
    return F.concat(F.lit(start), F.array_join(F.transform(units, lambda u: F.concat(F.lit(f"<{prefix}"), u.cast("string"), F.lit(">"))), ""), F.lit(end))


def units_of(text: Column | str, prefix: str) -> Column:
    """The units in marked text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<{re.escape(prefix)}(\d+)>"), 1), lambda x: x.cast("bigint"))


def codebooks(units: Column, layers: int, size: int) -> Column:
    """Frames of ``layers`` offset codes as one array per layer, offsets taken off; an unfinished frame is dropped."""
    whole = F.floor(F.size(units) / layers).cast("int") * layers
    kept = F.filter(units, lambda u, i: i < whole)

    def layer(k: int) -> Column:
        return F.transform(F.filter(kept, lambda u, i: i % layers == k), lambda u: u - k * size)

    return F.array(*[layer(k) for k in range(layers)])
