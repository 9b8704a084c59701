"""Strict JSON documents and their schemas, and key-value text; small inputs, read on the driver."""

from __future__ import annotations

import json
import math
import operator
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice


class Invalid(ValueError):
    pass


def _once(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise Invalid(f"{k} stands twice")
        out[k] = v
    return out


def _not_finite(text: str):
    raise Invalid(f"{text} is no number of JSON")


def loads(text: str):
    """JSON without repeated keys, NaN or infinities."""
    try:
        return json.loads(text, object_pairs_hook=_once, parse_constant=_not_finite)
    except json.JSONDecodeError as e:
        raise Invalid(str(e)) from e


def canonical(value) -> str:
    """JSON with sorted keys and without spaces: equal documents have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def sanitised(value):
    """value with NaN, at any depth, as the text "NaN"."""
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, dict):
        return {k: sanitised(v) for k, v in value.items()}
    return [sanitised(v) for v in value] if isinstance(value, list | tuple) else value


KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v),
}


class _Check:
    """One value against one schema: a method for each keyword, named by it; a keyword that has none, and is no annotation, is an error of the schema's."""

    ANNOTATIONS = frozenset(("$schema", "$id", "$defs", "title", "description", "default"))

    def __init__(self, root: dict):
        self.root = root

    def __call__(self, value, schema: dict, at: str):
        for keyword, wanted in schema.items():
            if keyword not in self.ANNOTATIONS:
                check = getattr(self, "on_" + keyword.lstrip("$"), None)
                if check is None:
                    raise Invalid(f"schema keyword {keyword}")
                yield from check(value, wanted, at, schema)

    def on_ref(self, value, pointer, at, _):
        target = self.root
        for part in pointer.removeprefix("#").split("/")[1:]:
            target = target[part.replace("~1", "/").replace("~0", "~")]
        yield from self(value, target, at)

    def on_oneOf(self, value, choices, at, _):
        fitting = sum(next(iter(self(value, c, at)), None) is None for c in choices)
        if fitting != 1:
            yield f"{at}: fits {fitting} of the choices"

    def on_type(self, value, kinds, at, _):
        if not any(KINDS[k](value) for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield f"{at}: not of type {kinds}"

    def on_const(self, value, only, at, _):
        yield from self.on_enum(value, [only], at, _)

    def on_enum(self, value, choices, at, _):
        if canonical(value) not in {canonical(c) for c in choices}:
            yield f"{at}: not one of {choices}"

    def on_required(self, value, names, at, _):
        if isinstance(value, dict):
            yield from (f"{at}: {n} is missing" for n in names if n not in value)

    def on_properties(self, value, schemas, at, _):
        for name in schemas.keys() & value.keys() if isinstance(value, dict) else ():
            yield from self(value[name], schemas[name], f"{at}.{name}")

    def on_additionalProperties(self, value, rule, at, schema):
        for name in sorted(value.keys() - schema.get("properties", {}).keys()) if isinstance(value, dict) else ():
            if rule is False:
                yield f"{at}: {name} isn't known"
            elif rule is not True:
                yield from self(value[name], rule, f"{at}.{name}")

    def on_items(self, value, schema, at, _):
        for i, item in enumerate(value if isinstance(value, list) else ()):
            yield from self(item, schema, f"{at}[{i}]")

    def on_uniqueItems(self, value, wanted, at, _):
        if wanted and isinstance(value, list) and len({canonical(v) for v in value}) < len(value):
            yield f"{at}: an item stands twice"

    def on_pattern(self, value, pattern, at, _):
        if isinstance(value, str) and re.fullmatch(pattern, value) is None:
            yield f"{at}: not as {pattern}"

    @staticmethod
    def _bound(kind, measure, beyond):
        def check(self, value, bound, at, _):
            if KINDS[kind](value) and beyond(measure(value), bound):
                yield f"{at}: {measure(value)} is out of range"

        return check

    on_minItems, on_maxItems = _bound("array", len, operator.lt), _bound("array", len, operator.gt)
    on_minLength, on_maxLength = _bound("string", len, operator.lt), _bound("string", len, operator.gt)
    on_minimum, on_maximum = _bound("number", lambda v: v, operator.lt), _bound("number", lambda v: v, operator.gt)


def problems(value, schema: dict) -> list[str]:
    """What in value goes against a JSON Schema of _Check's keywords; a pattern must match the whole text, and a reference's other keywords hold too."""
    return list(_Check(schema)(value, schema, "$"))


def with_defaults(value: dict, schema: dict) -> dict:
    fields = schema.get("properties", {})
    return {**{k: s["default"] for k, s in fields.items() if "default" in s}, **{k: with_defaults(v, fields[k]) if isinstance(v, dict) and k in fields else v for k, v in value.items()}}


def fields(spark: SparkSession, path: str) -> DataFrame:
    """(label, value, degrees) of lines `- label: value` of text files."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^- ([^:\n]+?)[^:\n]*?:\s*(.+?)\s*$", 1).alias("label"), F.regexp_extract("value", r"^- [^:\n]+:\s*(.+?)\s*$", 1).alias("value"))
    return lines.where("label <> ''").withColumn("degrees", lattice.degrees_of(F.col("value")))
