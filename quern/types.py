"""Values that searches take and give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class GeoPoint:
    lat: float
    lon: float


class Algorithm(str, Enum):
    BM25 = "bm25"
    QPS = "qps"
    PT15 = "pt15"


class SearchMode(str, Enum):
    """Kept for completeness of the surface; ``threshold`` decides how many terms must match."""

    MATCH_ALL = "matchAll"
    MATCH_ANY = "matchAny"
    PREFIX = "prefix"


class SortOrder(str, Enum):
    ASC = "asc"
    DESC = "desc"


class FacetSorting(str, Enum):
    ASC = "asc"
    DESC = "desc"


class DistanceUnit(str, Enum):
    """Lengths in metres by :attr:`metres`."""

    CM = "cm"
    M = "m"
    KM = "km"
    MI = "mi"
    YD = "yd"
    FT = "ft"

    @property
    def metres(self) -> float:
        return {"cm": 0.01, "m": 1.0, "km": 1000.0, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048}[self.value]


@dataclass(frozen=True)
class BM25Params:
    k: float = 1.2
    b: float = 0.75
    d: float = 0.5


@dataclass(frozen=True)
class SortBy:
    field: str
    order: SortOrder = SortOrder.ASC


@dataclass(frozen=True)
class NumberFacetRange:
    from_: float
    to: float

    @property
    def label(self) -> str:
        return f"{self.from_}-{self.to}"


@dataclass(frozen=True)
class FacetConfig:
    """``limit`` is the end of the slice that ``offset`` begins, for string fields alone."""

    limit: int = 10
    offset: int = 0
    sort: FacetSorting = FacetSorting.DESC
    ranges: tuple[NumberFacetRange, ...] = ()


@dataclass(frozen=True)
class GroupReduce:
    """An ordered fold over each group's hits: ``reducer(values, accumulator, hit, index)``."""

    reducer: Callable[[tuple, Any, dict, int], Any]
    initial: Callable[[int], Any]
    schema: str


@dataclass(frozen=True)
class GroupBy:
    properties: tuple[str, ...]
    limit: int | None = None
    reduce: GroupReduce | None = None

    @staticmethod
    def field(name: str, limit: int | None = None, reduce: GroupReduce | None = None) -> GroupBy:
        return GroupBy((name,), limit, reduce)


@dataclass
class FacetResult:
    """``values``: ``value, count``; ``count``: number of values before slicing, as a one-row frame."""

    values: DataFrame
    count: DataFrame


@dataclass
class SearchResult:
    """Frames of one search; nothing runs before an action. ``hits``: ``rank, id, score`` and the document's fields."""

    hits: DataFrame
    count: DataFrame
    facets: dict[str, FacetResult] = field(default_factory=dict)
    groups: DataFrame | None = None

    def total(self) -> int:
        return int(self.count.first()[0])

    def run(self) -> tuple[list, float]:
        """The hits as rows, and the seconds that they took."""
        import time

        began = time.perf_counter()
        return self.hits.collect(), time.perf_counter() - began
