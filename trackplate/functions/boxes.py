"""Box geometry and score-vector column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def norm_key(c: Column) -> Column:
    """Class names compare without case and with single inner blanks."""
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def box_size(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """sqrt(w * h), negative sides count as 0."""
    zero = F.lit(0.0)
    return F.sqrt(F.greatest(zero, F.col(x2) - F.col(x1)) * F.greatest(zero, F.col(y2) - F.col(y1)))


def _inter(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    h = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def _area(a: str) -> Column:
    return (F.col(f"{a}.x2") - F.col(f"{a}.x1")) * (F.col(f"{a}.y2") - F.col(f"{a}.y1"))


def covered_fraction(box: str, other: str) -> Column:
    """Share of `box`'s own area inside `other` (struct columns)."""
    return _inter(box, other) / F.greatest(F.lit(EPS), _area(box))


def iou(a: str, b: str) -> Column:
    i = _inter(a, b)
    return i / (_area(a) + _area(b) - i + F.lit(EPS))


def class_option(cls: Column, conf: Mapping[str, float | None], fallback: float | None = None) -> Column:
    """Per-class setting with a `_default` entry; unknown classes take the fallback."""
    table = {" ".join(k.strip().lower().split()): v for k, v in conf.items() if v is not None}
    default = table.pop("_default", fallback)
    picked = F.lit(None).cast("double")
    if table:
        pairs = [F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))]
        picked = F.try_element_at(F.create_map(*pairs), norm_key(cls))
    return picked if default is None else F.coalesce(picked, F.lit(float(default)))


def score_probs(scores: Column) -> Column:
    """Scores over their sum (a zero sum divides by 1)."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, v: s + v)
    return F.transform(scores, lambda v: v / F.when(total == 0, F.lit(1.0)).otherwise(total))


def entropy(probs: Column) -> Column:
    """Entropy in nats over the positive entries."""
    return F.aggregate(F.filter(probs, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.ln(p))


def best_class(scores: Column, names: Sequence[str], refs: Mapping[str, float], alpha: float,
               excluded: Sequence[str] = ()) -> Column:
    """Struct (name, raw) maximising raw / ref^alpha over eligible classes; first wins ties."""
    def key(s):
        return " ".join(s.strip().lower().split())

    ref = {key(k): v for k, v in refs.items() if not k.startswith("_") and v > 0}
    skip = {key(e) for e in excluded}
    options = []
    for i, n in enumerate(names):
        if key(n) in skip:
            continue
        raw = F.get(scores, F.lit(i))
        options.append(F.struct((raw / F.lit(ref.get(key(n), 1.0) ** alpha)).alias("w"), F.lit(-i).alias("i"),
                                F.lit(n).alias("name"), raw.alias("raw")))
    return F.array_max(F.array(*options))
