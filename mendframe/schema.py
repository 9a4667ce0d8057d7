"""Target schemas: what a value must become, and how leniently."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import re
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class Default(Enum):
    """Says that a field has no default; equal to itself in every process."""

    MISSING = 0


MISSING = Default.MISSING


class Invalid(ValueError):
    """A value doesn't fit; ``path`` is a JSON Pointer."""

    def __init__(self, message: str, path: str = ""):
        super().__init__(f"{path or '/'}: {message}")
        self.path = path


@dataclass(frozen=True)
class Kind:
    """A type: int, float, str, bool, any, enum, list, dict, struct, union, tuple,
    datetime, date, decimal or bytes."""

    name: str
    item: Kind | None = None
    fields: tuple[Field, ...] = ()
    domain: tuple[str, ...] = ()
    variants: tuple[Kind, ...] = ()
    key: Kind | None = None
    strict: bool = False
    optional: bool = False
    extra: bool = False

    def spark(self) -> T.DataType:
        if self.name in SPARK:
            return SPARK[self.name]
        if self.name == "list":
            return T.ArrayType(self.item.spark())
        if self.name == "dict":
            return T.MapType(self.key.spark() if self.key else T.StringType(), self.item.spark())
        if self.name == "tuple":
            return T.StructType([T.StructField(f"_{k + 1}", v.spark()) for k, v in enumerate(self.variants)])
        return T.StructType([T.StructField(f.name, f.kind.spark()) for f in self.fields])

    def json_schema(self) -> dict:
        if self.name == "struct":
            return {"type": "object", "properties": {f.name: f.kind.json_schema() for f in self.fields}, "required": [f.name for f in self.fields if f.default is MISSING]}
        if self.name == "enum":
            return {"type": "string", "enum": list(self.domain)}
        if self.name == "list":
            return {"type": "array", "items": self.item.json_schema()}
        if self.name == "dict":
            return {"type": "object", "additionalProperties": self.item.json_schema()}
        if self.name == "union":
            return {"anyOf": [v.json_schema() for v in self.variants]}
        if self.name == "tuple":
            return {"type": "array", "prefixItems": [v.json_schema() for v in self.variants], "minItems": len(self.variants), "maxItems": len(self.variants)}
        if self.name in ("datetime", "date", "bytes"):
            return {"type": "string", "format": {"datetime": "date-time", "date": "date", "bytes": "binary"}[self.name]}
        return {} if self.name == "any" else {"type": {"int": "integer", "float": "number", "str": "string", "bool": "boolean", "decimal": "number"}[self.name]}

    def partial(self) -> Kind:
        """The type of a value that is still being written: nothing is required."""
        fields = tuple(Field(f.name, Kind(**{**f.kind.__dict__, "optional": True}), None, f.aliases) for f in self.fields)
        return Kind(**{**self.__dict__, "fields": fields})


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind
    default: Any = MISSING
    aliases: tuple[str, ...] = ()


#: Values of several types are JSON text; numbers of exact decimals have 18 behind the point.
SPARK = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "any": T.StringType(), "enum": T.StringType(), "union": T.StringType(), "datetime": T.TimestampType(), "date": T.DateType(), "decimal": T.DecimalType(38, 18), "bytes": T.BinaryType()}
INT, FLOAT, STR, BOOL, ANY = (Kind(k) for k in ("int", "float", "str", "bool", "any"))
DATETIME, DATE, DECIMAL, BYTES = (Kind(k) for k in ("datetime", "date", "decimal", "bytes"))
STRICT_INT, STRICT_FLOAT, STRICT_BOOL = (Kind(k, strict=True) for k in ("int", "float", "bool"))


def enum(*domain: str) -> Kind:
    return Kind("enum", domain=domain)


def list_of(item: Kind) -> Kind:
    return Kind("list", item)


def dict_of(item: Kind, key: Kind | None = None) -> Kind:
    """``key`` is for keys other than strings."""
    return Kind("dict", item, key=None if key == STR else key)


def union(*variants: Kind) -> Kind:
    """The variant that fits as it is, else the first that fits leniently."""
    return Kind("union", variants=variants)


def tuple_of(*items: Kind) -> Kind:
    """A list of a fixed length, each place with its own type."""
    return Kind("tuple", variants=items)


def dumps(value: Any) -> str:
    """JSON text of a validated value: times as ISO-8601, exact numbers and bytes as text."""

    def plain(x: Any) -> str:
        if isinstance(x, (dt.datetime, dt.date)):
            return x.isoformat().replace("+00:00", "Z")
        return x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)

    return json.dumps(value, ensure_ascii=False, default=plain)


def optional(kind: Kind) -> Kind:
    return Kind(**{**kind.__dict__, "optional": True})


def struct(*fields: Field, extra: bool = False) -> Kind:
    return Kind("struct", fields=fields, extra=extra)


def from_spark(kind: T.DataType) -> Kind:
    """A schema from a Spark type; nullable fields with no default are required
    unless their metadata says otherwise (keys aliases, domain, strict, default)."""
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            m = f.metadata or {}
            inner = enum(*m["domain"]) if "domain" in m else from_spark(f.dataType)
            if m.get("strict"):
                inner = Kind(**{**inner.__dict__, "strict": True})
            fields.append(Field(f.name, inner, m["default"] if "default" in m else MISSING, tuple(m.get("aliases", ()))))
        return struct(*fields)
    if isinstance(kind, T.ArrayType):
        return list_of(from_spark(kind.elementType))
    if isinstance(kind, T.MapType):
        return dict_of(from_spark(kind.valueType), from_spark(kind.keyType))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    others = ((T.BooleanType, BOOL), ((T.TimestampType, T.TimestampNTZType), DATETIME), (T.DateType, DATE), (T.DecimalType, DECIMAL), (T.BinaryType, BYTES), (T.VariantType, ANY))
    return next((k for t, k in others if isinstance(kind, t)), STR)


#: The words that a lax bool takes.
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def validate(value: Any, kind: Kind, path: str = "", by_name: bool = True) -> Any:
    """``value`` as ``kind`` under lax (or strict) rules, or Invalid."""
    if kind.optional and value is None:
        return None
    name = kind.name
    if name == "any":
        return value
    if name == "struct":
        return _struct(value, kind, path, by_name)
    if name == "list":
        if not isinstance(value, (list, tuple)):
            raise Invalid("not a list", path)
        return [validate(v, kind.item, f"{path}/{i}", by_name) for i, v in enumerate(value)]
    if name == "dict":
        if not isinstance(value, dict):
            raise Invalid("not an object", path)
        return {validate(k, kind.key, path) if kind.key else str(k): validate(v, kind.item, f"{path}/{k}", by_name) for k, v in value.items()}
    if name == "tuple":
        if not isinstance(value, (list, tuple)) or len(value) != len(kind.variants):
            raise Invalid(f"not a list of {len(kind.variants)}", path)
        return tuple(validate(v, k, f"{path}/{i}", by_name) for i, (v, k) in enumerate(zip(value, kind.variants, strict=True)))
    if name == "union":
        return _union(value, kind, path, by_name)
    if name in MORE:
        if isinstance(value, MADE[name]):  # converted already
            return value
        try:
            return MORE[name](value)
        except (ValueError, TypeError, OverflowError, ArithmeticError, OSError):
            raise Invalid(f"not a {name}", path) from None
    if name == "enum":
        if isinstance(value, str) and value in kind.domain:
            return value
        raise Invalid("not in the domain", path)
    if name == "str":
        if isinstance(value, str):
            return value
        raise Invalid("not a string", path)
    return _scalar(value, kind, path)


def _union(value: Any, kind: Kind, path: str, by_name: bool) -> Any:
    """The variant whose own type the value has, else the first that takes it."""
    own = {"int": int, "float": float, "str": str, "bool": bool, "list": list, "tuple": list, "dict": dict, "struct": dict, "enum": str}
    exact = [v for v in kind.variants if v.name in own and type(value) is own[v.name]]
    for variant in (*exact, *(v for v in kind.variants if v not in exact)):
        try:
            return validate(value, variant, path, by_name)
        except Invalid:
            continue
    raise Invalid("fits no variant", path)


def _datetime(value: Any) -> dt.datetime:
    """ISO-8601 text or Unix seconds (milliseconds beyond 2e10); without a zone, UTC."""
    if isinstance(value, str):
        text = value.strip()
        try:
            value = float(text)
        except ValueError:
            found = dt.datetime.fromisoformat(text)
            return found if found.tzinfo else found.replace(tzinfo=dt.UTC)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(value)
    return dt.datetime.fromtimestamp(value / 1000 if abs(value) > 2e10 else value, dt.UTC)


def _date(value: Any) -> dt.date:
    found = _datetime(value)
    if found.timetz().replace(tzinfo=None) != dt.time():
        raise ValueError(value)
    return found.date()


def _decimal(value: Any) -> decimal.Decimal:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeError(value)
    found = decimal.Decimal(str(value).strip())
    if not found.is_finite() or found.adjusted() > 19 or found.as_tuple().exponent < -18:
        raise ValueError(value)
    return found


def _bytes(value: Any) -> bytes:
    if not isinstance(value, str):
        raise TypeError(value)
    return value.encode()


MORE = {"datetime": _datetime, "date": _date, "decimal": _decimal, "bytes": _bytes}
MADE = {"datetime": dt.datetime, "date": dt.date, "decimal": decimal.Decimal, "bytes": bytes}


def _scalar(value: Any, kind: Kind, path: str) -> Any:
    name = kind.name
    is_bool, is_number = isinstance(value, bool), isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind.strict:
        if (name == "bool" and is_bool) or (is_number and (name == "float" or (name == "int" and isinstance(value, int)))):
            return float(value) if name == "float" else value
        raise Invalid(f"not a strict {name}", path)
    if name == "bool":
        word = value.lower() if isinstance(value, str) else None
        if is_bool or (is_number and value in (0, 1)) or word in TRUE + FALSE:
            return value if is_bool else word in TRUE if word is not None else bool(value)
        raise Invalid("not a bool", path)
    try:
        if name == "float" and isinstance(value, (int, float, str)):
            return float(value)
        if name == "int" and isinstance(value, (int, float)) and value == int(value):
            return _long(int(value), path)
        if name == "int" and isinstance(value, str):
            number = int(value) if "." not in value else float(value)
            if number == int(number):
                return _long(int(number), path)
    except (ValueError, OverflowError):
        pass
    raise Invalid(f"not a {name}", path)


def _long(value: int, path: str) -> int:
    if -(1 << 63) <= value < 1 << 63:
        return value
    raise Invalid("out of range", path)


def _struct(value: Any, kind: Kind, path: str, by_name: bool) -> dict:
    if not isinstance(value, dict):
        raise Invalid("not an object", path)
    out, used = {}, set()
    for f in kind.fields:
        key = next((k for k in (*f.aliases, *((f.name,) if by_name or not f.aliases else ())) if k in value), None)
        if key is not None:
            used.add(key)
            out[f.name] = validate(value[key], f.kind, f"{path}/{f.name}", by_name)
        elif f.default is MISSING:
            raise Invalid("missing", f"{path}/{f.name}")
        else:
            out[f.name] = f.default
    if kind.extra:
        out |= {k: v for k, v in value.items() if k not in used}
    return out


def error_paths(value: Any, kind: Kind, path: str = "") -> list[str]:
    """Pointers to every place where ``value`` doesn't fit, in order."""
    if kind.optional and value is None:
        return []
    if kind.name == "struct" and isinstance(value, dict):
        out = []
        for f in kind.fields:
            key = next((k for k in (f.name, *f.aliases) if k in value), None)
            if key is not None:
                out += error_paths(value[key], f.kind, f"{path}/{f.name}")
            elif f.default is MISSING:
                out.append(f"{path}/{f.name}")
        return out
    if kind.name in ("list", "dict") and isinstance(value, list if kind.name == "list" else dict):
        pairs = enumerate(value) if kind.name == "list" else value.items()
        return [p for k, v in pairs for p in error_paths(v, kind.item, f"{path}/{k}")]
    try:
        validate(value, kind)
    except Invalid:
        return [path or ""]
    return []


def from_pydantic(annotation: Any) -> Kind:
    """A schema from a model class or a type annotation, if pydantic is there."""
    import types
    import typing

    import pydantic
    from pydantic_core import PydanticUndefined

    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin is typing.Annotated:
        kind = from_pydantic(args[0])
        return Kind(**{**kind.__dict__, "strict": True}) if any(getattr(m, "strict", False) for m in args[1:]) else kind
    if origin in (typing.Union, types.UnionType):
        some = [a for a in args if a is not type(None)]
        kind = from_pydantic(some[0]) if len(some) == 1 else union(*map(from_pydantic, some))
        return optional(kind) if len(some) < len(args) else kind
    if origin is typing.Literal:
        return enum(*map(str, args))
    if origin in (list, set, frozenset) or (origin is tuple and len(args) == 2 and args[1] is Ellipsis):
        return list_of(from_pydantic(args[0]))
    if origin is tuple:
        return tuple_of(*map(from_pydantic, args))
    if origin is dict:
        return dict_of(from_pydantic(args[1]), from_pydantic(args[0]))
    simple = {int: INT, float: FLOAT, str: STR, bool: BOOL, list: list_of(ANY), dict: dict_of(ANY), dt.datetime: DATETIME, dt.date: DATE, decimal.Decimal: DECIMAL, bytes: BYTES}
    if annotation in simple:
        return simple[annotation]
    if isinstance(annotation, type) and issubclass(annotation, Enum):
        return enum(*(str(m.value) for m in annotation))
    if isinstance(annotation, type) and issubclass(annotation, pydantic.BaseModel):
        fields = []
        for name, f in annotation.model_fields.items():
            kind = from_pydantic(f.annotation)
            if any(getattr(m, "strict", False) for m in f.metadata):
                kind = Kind(**{**kind.__dict__, "strict": True})
            default = MISSING if f.is_required() else (f.default_factory() if f.default_factory else None if f.default is PydanticUndefined else f.default)
            aliases = tuple(dict.fromkeys(a for a in (f.alias, f.validation_alias) if isinstance(a, str)))
            fields.append(Field(name, kind, default.value if isinstance(default, Enum) and default is not MISSING else default, aliases))
        return struct(*fields, extra=annotation.model_config.get("extra") == "allow")
    return ANY


#: DDL names of scalar types.
DDL = {"tinyint": INT, "smallint": INT, "int": INT, "integer": INT, "bigint": INT, "long": INT, "float": FLOAT, "double": FLOAT, "boolean": BOOL, "string": STR, "variant": ANY, "timestamp": DATETIME, "timestamp_ntz": DATETIME, "timestamp_ltz": DATETIME, "date": DATE, "decimal": DECIMAL, "numeric": DECIMAL, "binary": BYTES}


def from_ddl(ddl: str) -> Kind:
    """A schema from 'a INT, b ARRAY<STRUCT<c: STRING>>', without a session."""
    depth, parts, start = 0, [], 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(ddl[start:i])
            start = i + 1
    fields = []
    for part in [*parts, ddl[start:]]:
        name, kind = re.match(r"\s*`?(\w+)`?\s*:?\s*(.*)", part, re.S).groups()
        fields.append(Field(name, _ddl_type(kind)))
    return struct(*fields)


def _ddl_type(text: str) -> Kind:
    text = text.strip()
    head, _, inside = text.partition("<")
    inside = inside.rstrip()[:-1]
    head = head.strip().lower()
    if head == "array":
        return list_of(_ddl_type(inside))
    if head == "map":
        key, _, value = inside.partition(",")
        return dict_of(_ddl_type(value), _ddl_type(key))
    if head == "struct":
        return from_ddl(inside)
    name = text.lower().partition("(")[0].split()[0]
    if name not in DDL:
        raise ValueError(f"no such type: {name!r}")
    return DDL[name]
