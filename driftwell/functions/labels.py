"""Small expressions and driver-side helpers around results: titles, bands, label places, schema trimming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay_title(retrieval: Column, reliability: Column) -> Column:
    """Which of the two decays a condition has."""
    return (
        F.when((retrieval < 1) & (reliability < 1), F.lit("decay"))
        .when(retrieval < 1, F.lit("retrieval decay only"))
        .when(reliability < 1, F.lit("reliability decay only"))
        .otherwise(F.lit("no decay"))
    )


def band(mean: Column, sd: Column) -> tuple[Column, Column]:
    """Mean less and plus a deviation, cut to [0, 1]; NaN stays NaN."""
    low, high = mean - sd, mean + sd
    keep = F.isnan(low)
    return F.when(keep, low).otherwise(F.greatest(F.lit(0.0), low)), F.when(keep, high).otherwise(F.least(F.lit(1.0), high))


def resource_type(model: Column, prefixes: dict[str, str], other: str) -> Column:
    """The type of the first prefix a model id starts with."""
    out = None
    for prefix, kind in prefixes.items():
        hit = F.startswith(model, F.lit(prefix))
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def spread(places: list[float], gap: float, low: float, high: float) -> list[float]:
    """Label places at least ``gap`` apart in the order given by size: pushed up from below, then down from ``high``."""
    order = sorted(range(len(places)), key=lambda i: (places[i], i))
    at = [max(low, places[i]) for i in order]
    for k in range(1, len(at)):
        at[k] = max(at[k], at[k - 1] + gap)
    ceiling = high
    for k in range(len(at) - 1, -1, -1):
        at[k] = min(at[k], ceiling)
        ceiling = at[k] - gap
    out = [0.0] * len(places)
    for k, i in enumerate(order):
        out[i] = at[k]
    return out


def without_keywords(schema, drop: Iterable[str]):
    """A JSON schema without some keywords at any depth; properties that bear such a name stay."""
    names = set(drop)
    if isinstance(schema, list):
        return [without_keywords(x, names) for x in schema]
    if not isinstance(schema, dict):
        return schema
    return {
        k: {p: without_keywords(s, names) for p, s in v.items()} if k == "properties" and isinstance(v, dict) else without_keywords(v, names)
        for k, v in schema.items()
        if k not in names
    }
