"""Declared schemas: leaf types, nesting, dot paths, and validation of rows as columns."""

from __future__ import annotations

import json
from collections.abc import Mapping
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DocumentValidationError, SchemaValidationError, SerializationError


class SchemaType(str, Enum):
    STRING = "string"
    NUMBER = "number"
    BOOLEAN = "boolean"
    ENUM = "enum"
    GEOPOINT = "geopoint"
    STRING_ARRAY = "string[]"
    NUMBER_ARRAY = "number[]"
    BOOLEAN_ARRAY = "boolean[]"
    ENUM_ARRAY = "enum[]"

    @property
    def is_array(self) -> bool:
        return self.value.endswith("[]")

    @property
    def spark(self) -> T.DataType:
        one = {
            "string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "enum": T.StringType(),
            "geopoint": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
        }[self.value.removesuffix("[]")]
        return T.ArrayType(one) if self.is_array else one


SORTABLE = {SchemaType.STRING, SchemaType.NUMBER, SchemaType.BOOLEAN}
GROUPABLE = SORTABLE


class Schema:
    """A tree of fields: ``{"title": "string", "meta": {"rating": "number"}}``."""

    def __init__(self, fields: Mapping):
        self.fields = self._read(fields, "")
        self._types = dict(self._walk(self.fields, ""))

    @classmethod
    def _read(cls, fields: Mapping, at: str) -> dict:
        if not fields:
            raise SchemaValidationError(f"no fields in {at or 'the schema'}")
        out = {}
        for name, kind in fields.items():
            if not name or "." in name:
                raise SchemaValidationError(f"bad field name {name!r}")
            if isinstance(kind, Mapping):
                out[name] = cls._read(kind, f"{at}{name}")
            else:
                try:
                    out[name] = SchemaType(kind)
                except ValueError:
                    raise SchemaValidationError(f"{at}{name}: unknown type {kind!r}") from None
        return out

    @classmethod
    def _walk(cls, fields: dict, at: str):
        for name, kind in fields.items():
            if isinstance(kind, dict):
                yield from cls._walk(kind, f"{at}{name}.")
            else:
                yield f"{at}{name}", kind

    @property
    def paths(self) -> list[str]:
        """Dot paths of all leaves, depth first, as declared."""
        return list(self._types)

    def type_at(self, path: str) -> SchemaType:
        found: dict | SchemaType = self.fields
        for part in path.split("."):
            if not isinstance(found, dict):
                raise SchemaValidationError(f"{path}: passes through a leaf")
            if part not in found:
                raise SchemaValidationError(f"{path}: unknown field")
            found = found[part]
        if isinstance(found, dict):
            raise SchemaValidationError(f"{path}: nested, not a leaf")
        return found

    def has(self, path: str) -> bool:
        return path in self._types

    def paths_of(self, *kinds: SchemaType) -> list[str]:
        return [p for p, k in self._types.items() if k in kinds]

    def struct(self, fields: dict | None = None) -> T.StructType:
        fields = self.fields if fields is None else fields
        return T.StructType([T.StructField(n, self.struct(k) if isinstance(k, dict) else k.spark) for n, k in fields.items()])

    # -- JSON -----------------------------------------------------------------
    def to_json(self) -> str:
        walk = lambda f: {n: {"nested": walk(k)} if isinstance(k, dict) else {"type": k.value} for n, k in f.items()}
        return json.dumps(walk(self.fields))

    @staticmethod
    def from_json(text: str) -> Schema:
        def walk(f):
            if not isinstance(f, dict):
                raise SerializationError("a schema must be an object")
            out = {}
            for n, k in f.items():
                if not isinstance(k, dict) or len(k.keys() & {"type", "nested"}) != 1:
                    raise SerializationError(f"{n}: needs a type or nested fields")
                out[n] = walk(k["nested"]) if "nested" in k else k["type"]
            return out

        try:
            return Schema(walk(json.loads(text)))
        except json.JSONDecodeError as e:
            raise SerializationError(f"not JSON: {e}") from e

    # -- validation -----------------------------------------------------------
    def _fits(self, kind: SchemaType, have: T.DataType) -> bool:
        if isinstance(have, T.NullType):
            return True
        if kind.is_array:
            return isinstance(have, T.ArrayType) and self._fits(SchemaType(kind.value[:-2]), have.elementType)
        if kind is SchemaType.NUMBER:
            return isinstance(have, T.NumericType)
        if kind is SchemaType.BOOLEAN:
            return isinstance(have, T.BooleanType)
        if kind is SchemaType.GEOPOINT:
            return isinstance(have, T.StructType) and {"lat", "lon"} <= set(have.names) and all(isinstance(have[n].dataType, T.NumericType) for n in ("lat", "lon"))
        if kind is SchemaType.ENUM:
            return isinstance(have, (T.StringType, T.NumericType))
        return isinstance(have, T.StringType)

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``id`` (if there) and the declared fields, typed; missing ones are null, others are left as they are.

        A column of the wrong type is an error that names it.
        """
        have = {f.name: f.dataType for f in df.schema.fields}
        if "id" in have and not isinstance(have["id"], (T.StringType, T.NullType)):
            raise DocumentValidationError("id must be a string", "id")

        def build(fields: dict, types: dict, column, at: str) -> list[Column]:
            out = []
            for name, kind in fields.items():
                path = f"{at}{name}"
                if name not in types:
                    out.append(F.lit(None).cast(self.struct(kind) if isinstance(kind, dict) else kind.spark).alias(name))
                elif isinstance(kind, dict):
                    if isinstance(types[name], T.NullType):
                        out.append(F.lit(None).cast(self.struct(kind)).alias(name))
                        continue
                    if not isinstance(types[name], T.StructType):
                        raise DocumentValidationError(f"{path}: nested fields expected", path)
                    inner = {f.name: f.dataType for f in types[name].fields}
                    own = column(name)
                    struct = F.struct(*build(kind, inner, lambda n, own=own: own[n], f"{path}."))
                    out.append(F.when(own.isNotNull(), struct).alias(name))
                else:
                    if not self._fits(kind, types[name]):
                        raise DocumentValidationError(f"{path}: {kind.value} expected, found {types[name].simpleString()}", path)
                    if kind is SchemaType.GEOPOINT and isinstance(types[name], T.StructType):
                        c = column(name)
                        out.append(F.when(c.isNotNull(), F.struct(c["lat"].cast("double").alias("lat"), c["lon"].cast("double").alias("lon"))).alias(name))
                    else:
                        out.append(column(name).cast(kind.spark).alias(name))
            return out

        fields = build(self.fields, have, lambda n: df[n], "")
        extra = [df[n] for n in have if n not in self.fields and n != "id"]
        ids = [df["id"].cast("string").alias("id")] if "id" in have and "id" not in self.fields else []
        return df.select(*ids, *fields, *extra)
