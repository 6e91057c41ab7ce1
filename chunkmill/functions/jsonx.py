"""JSON checks that match Python's ``json.loads`` strictness with native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, let

# Spark's JSON parsers ignore text after the first value. Wrapping the text as the first element
# of a two-element array whose second element is a sentinel makes any trailing text visible:
# the parse fails, or the sentinel is not found in second place, or a third element appears.
_SENTINEL = "\u0001~chunkmill-json-sentinel~\u0002"
_SENTINEL_JSON = '"\\u0001~chunkmill-json-sentinel~\\u0002"'


def strict_json(c) -> Column:
    """VARIANT of ``c`` when the whole text is exactly one JSON value (as ``json.loads`` would
    accept it), else null. A repeated key keeps its last value where the session sets
    ``spark.sql.variant.allowDuplicateKeys`` (``build_session`` does). Difference: bare ``NaN`` and
    ``Infinity`` count as invalid here."""
    def check(w):
        ok = (F.try_variant_get(w, "$[1]", "string") == F.lit(_SENTINEL)) & F.try_variant_get(w, "$[2]", "variant").isNull()
        return F.when(ok, F.try_variant_get(w, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), col_(c), F.lit(","), F.lit(_SENTINEL_JSON), F.lit("]"))), check)


def json_kind(v: Column) -> Column:
    """Type name of a VARIANT value: OBJECT, ARRAY, STRING, BIGINT, DOUBLE, BOOLEAN, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def is_object(v: Column) -> Column:
    return F.coalesce(json_kind(v) == "OBJECT", F.lit(False))


def object_keys(v: Column) -> Column:
    """Keys of a VARIANT object (null for other values)."""
    return F.map_keys(F.from_json(F.to_json(v), "map<string,string>"))


def has_key(v: Column, key: str, keys: Column | None = None) -> Column:
    """Object ``v`` holds ``key`` (a JSON null value counts as present)."""
    k = keys if keys is not None else object_keys(v)
    return F.coalesce(F.array_contains(k, F.lit(key)), F.lit(False))


def text_of(v: Column, key: str) -> Column:
    """Value of ``key`` as a Python program would keep it in a string field: strings as they
    are, other JSON values as their JSON text, JSON null as null."""
    return let(F.try_variant_get(v, f"$.{key}", "variant"), lambda inner: (
        F.when(inner.isNull() | F.is_variant_null(inner), F.lit(None).cast("string"))
        .when(json_kind(inner) == "STRING", F.try_variant_get(inner, "$", "string"))
        .otherwise(F.to_json(inner))))
