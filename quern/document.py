"""Typed access to one fetched document (a Row or a mapping) by dot path."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType
from typing import Any

from pyspark.sql import Row

from .errors import DocumentValidationError
from .types import GeoPoint

_MISSING = object()


class Document:
    """``get_*`` raise for a missing or mistyped value, ``try_*`` give None."""

    def __init__(self, source: Row | Mapping):
        self._data = source.asDict(recursive=True) if isinstance(source, Row) else dict(source)

    def _find(self, path: str) -> Any:
        at: Any = self._data
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return _MISSING
            at = at[part]
        return _MISSING if at is None else at

    def _get(self, path: str, test, what: str) -> Any:
        value = self._find(path)
        if value is _MISSING or not test(value):
            raise DocumentValidationError(f"{path}: {what} expected", path)
        return value

    def _try(self, path: str, test) -> Any:
        value = self._find(path)
        return value if value is not _MISSING and test(value) else None

    def get_string(self, path: str) -> str:
        return self._get(path, _is_string, "a string")

    def get_number(self, path: str) -> float:
        return self._get(path, _is_number, "a number")

    def get_bool(self, path: str) -> bool:
        return self._get(path, _is_bool, "a boolean")

    def get_string_list(self, path: str) -> list[str]:
        return self._get(path, lambda v: isinstance(v, list) and all(map(_is_string, v)), "a list of strings")

    def get_number_list(self, path: str) -> list[float]:
        return self._get(path, lambda v: isinstance(v, list) and all(map(_is_number, v)), "a list of numbers")

    def get_geo_point(self, path: str) -> GeoPoint:
        v = self._get(path, lambda v: isinstance(v, GeoPoint) or (isinstance(v, Mapping) and {"lat", "lon"} <= v.keys()), "a point")
        return v if isinstance(v, GeoPoint) else GeoPoint(v["lat"], v["lon"])

    def get_nested(self, path: str) -> Document:
        return Document(self._get(path, lambda v: isinstance(v, Mapping), "nested fields"))

    def try_string(self, path: str) -> str | None:
        return self._try(path, _is_string)

    def try_number(self, path: str) -> float | None:
        return self._try(path, _is_number)

    def try_bool(self, path: str) -> bool | None:
        return self._try(path, _is_bool)

    def to_map(self) -> Mapping:
        return MappingProxyType(self._data)


def _is_string(v: Any) -> bool:
    return isinstance(v, str)


def _is_number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _is_bool(v: Any) -> bool:
    return isinstance(v, bool)
