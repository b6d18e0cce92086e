"""``where`` filters: small objects that become one boolean column each.

``where`` maps dot paths to filters; properties are joined by AND, and so are ``and``, ``or``, ``not`` with them. With
``strict_compat`` a logical key ends the map it stands in, and its siblings are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import geo
from ..functions.text import Tokenizer
from ..schema import Schema, SchemaType
from ..types import Algorithm, DistanceUnit, GeoPoint


@dataclass(frozen=True)
class Filter:
    op: str
    value: Any = None


def eq(v) -> Filter:
    return Filter("eq", v)


def gt(v) -> Filter:
    return Filter("gt", v)


def gte(v) -> Filter:
    return Filter("gte", v)


def lt(v) -> Filter:
    return Filter("lt", v)


def lte(v) -> Filter:
    return Filter("lte", v)


def between(low, high) -> Filter:
    return Filter("between", (low, high))


def in_(values: Sequence) -> Filter:
    return Filter("in", tuple(values))


def nin(values: Sequence) -> Filter:
    return Filter("nin", tuple(values))


def contains_all(values: Sequence) -> Filter:
    return Filter("containsAll", tuple(values))


def contains_any(values: Sequence) -> Filter:
    return Filter("containsAny", tuple(values))


@dataclass(frozen=True)
class Radius:
    centre: GeoPoint
    radius: float
    unit: DistanceUnit
    inside: bool
    precise: bool


@dataclass(frozen=True)
class Polygon:
    points: tuple[GeoPoint, ...]
    inside: bool
    precise: bool


def geo_radius(lat: float, lon: float, radius: float, unit: DistanceUnit | str = "m", inside: bool = True, high_precision: bool = False) -> Filter:
    return Filter("geoRadius", Radius(GeoPoint(lat, lon), radius, DistanceUnit(unit), inside, high_precision))


def geo_polygon(points: Sequence[GeoPoint], inside: bool = True, high_precision: bool = False) -> Filter:
    return Filter("geoPolygon", Polygon(tuple(points), inside, high_precision))


def and_(*maps: Mapping) -> dict:
    return {"and": list(maps)}


def or_(*maps: Mapping) -> dict:
    return {"or": list(maps)}


def not_(where: Mapping) -> dict:
    return {"not": where}


_COMPARE = {
    "eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "between": lambda c, v: c.between(v[0], v[1]),
}


def distance(lat: Column, lon: Column, to: GeoPoint, precise: bool) -> Column:
    return (geo.vincenty if precise else geo.haversine)(lat, lon, to.lat, to.lon)


class WhereBuilder:
    """Turns ``where`` maps into columns. ``tokens``: token column of a text property (a stored one, where an index has it)."""

    def __init__(self, schema: Schema, tokenizer: Tokenizer, algorithm: Algorithm, spark, tokens=None, strict_compat: bool = False):
        self.schema, self.tokenizer, self.algorithm, self.spark = schema, tokenizer, algorithm, spark
        self.tokens = tokens or (lambda path: tokenizer.column(F.col(path), path))
        self.strict = strict_compat

    def build(self, where: Mapping) -> Column:
        """A column that is never null."""
        parts, logical = [], []
        for key, value in where.items():
            if key in ("and", "or"):
                subs = [self.build(m) for m in value]
                whole = reduce((lambda a, b: a & b) if key == "and" else (lambda a, b: a | b), subs) if subs else F.lit(False)
                logical.append(whole)
            elif key == "not":
                logical.append(~self.build(value))
            else:
                parts.append(F.coalesce(self.one(key, value), F.lit(False)))
            if self.strict and logical:
                return logical[0]
        parts += logical
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def one(self, path: str, f: Filter) -> Column:
        if not self.schema.has(path):
            raise QueryError(f"unknown property {path!r}")
        if not isinstance(f, Filter):
            raise QueryError(f"{path}: a filter is expected")
        kind, c = self.schema.type_at(path), F.col(path)
        bad = QueryError(f"{path}: {f.op} doesn't fit {kind.value}")
        if kind in (SchemaType.BOOLEAN, SchemaType.BOOLEAN_ARRAY):
            if f.op != "eq":
                raise bad
            return F.array_contains(c, f.value) if kind.is_array else c == F.lit(f.value)
        if kind in (SchemaType.NUMBER, SchemaType.NUMBER_ARRAY):
            if f.op not in _COMPARE:
                raise bad
            test = _COMPARE[f.op]
            return F.exists(c, lambda x: test(x, f.value)) if kind.is_array else test(c, f.value)
        if kind is SchemaType.ENUM:
            values = [f.value] if f.op == "eq" else f.value
            if f.op in ("eq", "in"):
                return c.isin(*map(str, values)) if values else F.lit(False)
            if f.op == "nin":
                return c.isNotNull() & ~c.isin(*map(str, values)) if values else c.isNotNull()
            raise bad
        if kind is SchemaType.ENUM_ARRAY:
            if f.op not in ("containsAll", "containsAny"):
                raise bad
            if not f.value:
                return F.lit(False)
            want = F.array(*(F.lit(str(v)) for v in f.value))
            return F.arrays_overlap(c, want) if f.op == "containsAny" else c.isNotNull() & (F.size(F.array_except(want, c)) == 0)
        if kind is SchemaType.GEOPOINT:
            lat, lon = c["lat"], c["lon"]
            if f.op == "geoRadius":
                r = f.value
                metres = r.radius * r.unit.metres
                d = distance(lat, lon, r.centre, r.precise)
                if r.inside:
                    ok = d <= metres
                    return geo.box(lat, lon, r.centre, metres) & ~F.isnan(d) & ok
                return ~F.isnan(d) & (d > metres)
            if f.op == "geoPolygon":
                ok = geo.in_polygon(lat, lon, f.value.points)
                return c.isNotNull() & (ok if f.value.inside else ~ok)
            raise bad
        # text: whole tokens, by the property's own tokenizer
        if self.algorithm is Algorithm.PT15:
            raise QueryError(f"{path}: text filters don't work with PT15")
        if f.op not in ("eq", "in"):
            raise bad
        if f.op == "eq":
            tokens = self.tokenizer.tokenize(self.spark, str(f.value), path)
        else:
            tokens = [t[0] for v in f.value if isinstance(v, str) and (t := self.tokenizer.tokenize(self.spark, v, path))]
        if not tokens:
            return F.lit(False)
        want = F.array(*(F.lit(t) for t in tokens))
        own = F.flatten(F.transform(c, lambda x: self.tokenizer.column(x, path))) if kind.is_array else self.tokens(path)
        return F.arrays_overlap(own, want)


def geo_only(where: Mapping, schema: Schema) -> tuple[str, Filter] | None:
    """The one geographic filter of a search that has nothing else."""
    if len(where) != 1:
        return None
    ((path, f),) = where.items()
    if isinstance(f, Filter) and f.op in ("geoRadius", "geoPolygon") and schema.has(path):
        return path, f
    return None
