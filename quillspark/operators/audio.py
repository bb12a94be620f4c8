"""Signals as arrays: frames, loudness, speech duration, crops, label mass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T


def frames(samples: Column, size: int, hop: int) -> Column:
    """Neighbouring frames of ``size`` values, padded with 0 so that all values are in one."""
    n = F.size(samples)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(hop))
    return F.transform(starts, lambda s: F.slice(samples, s + 1, F.lit(size)))


def energy(frame: Column) -> Column:
    return F.aggregate(frame, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def loud(samples: Column, size: int, hop: int, top_db: float = 30.0) -> Column:
    """Which frames are within ``top_db`` of the loudest; none is where all are silent."""
    e = F.transform(frames(samples, size, hop), energy)
    floor = F.array_max(e) * (10.0 ** (-top_db / 10.0))
    return F.transform(e, lambda x: (x > 0) & (x >= floor))


def speech_seconds(samples: Column, rate: int, size: int, hop: int, top_db: float = 30.0) -> Column:
    """Seconds of loud frames, 1e-6 at least; the whole length where none is loud, 0 for no samples."""
    many = F.size(F.filter(loud(samples, size, hop, top_db), lambda x: x))
    return F.when(F.size(samples) == 0, 0.0).when(many == 0, F.size(samples) / float(rate)).otherwise(F.greatest(F.least(many * (hop / rate), F.size(samples) / float(rate)), F.lit(1e-6)))


def trimmed(samples: Column, size: int, hop: int, top_db: float = 30.0) -> Column:
    """Without the silent frames at both ends; a silent signal stays."""
    marks = loud(samples, size, hop, top_db)
    places = F.filter(F.transform(marks, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    first, last = F.array_min(places), F.array_max(places)
    return F.when(F.size(places) > 0, F.slice(samples, first * hop + 1, (last - first) * hop + size)).otherwise(samples)


def crop(samples: Column, size: int, draw: Column | None = None) -> Column:
    """``size`` values from the start, or from where ``draw`` in [0, 1) says; a shorter signal as it is."""
    room = F.greatest(F.size(samples) - size, F.lit(0))
    at = F.floor((draw if draw is not None else F.lit(0.0)) * (room + 1)).cast("int")
    return F.slice(samples, at + 1, F.lit(size))


def label_mass(scores: Column, table: dict[str, str], labels: list[str]) -> Column:
    """array<struct<label, p>> as the mass of each canonical label in the declared order, divided by the sum."""
    def mass(name: str) -> Column:
        return F.aggregate(F.filter(scores, lambda s: T.lookup(s["label"], table) == name), F.lit(0.0), lambda a, s: a + s["p"])

    from quillspark.operators.probability import normalized

    return normalized(F.array(*[mass(n) for n in labels]))
