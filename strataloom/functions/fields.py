"""Fields of text, as forms and metadata hold them, as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def optional(text: Column, kind: str) -> Column:
    """The value of a field as int, double or string; null where it is blank. A value of another kind is an error
    that quotes it."""
    t = blank_to_null(text)
    if kind == "string":
        return t
    v = t.try_cast(kind)
    return F.when(t.isNotNull() & v.isNull(), F.raise_error(F.concat(F.lit(f"not {kind}: "), t)).cast(kind)).otherwise(v)


def required(text: Column, kind: str, name: str) -> Column:
    """``optional``, but a blank field is an error that names it."""
    v = optional(text, kind)
    return F.when(blank_to_null(text).isNull(), F.raise_error(F.lit(f"{name} is required")).cast(kind)).otherwise(v)


def key_of(label: Column, choices: dict[str, str]) -> Column:
    """Key of a choice from its label, or from the key itself; null for others."""
    table = {k: k for k in choices} | {v: k for k, v in choices.items()}
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.trim(label))


def first_size(*candidates: Column, name: str = "pixel size") -> Column:
    """The first of several sizes (native, physical, fallback) that is there, as a number. None at all, or one that is
    no number, is an error that names the field."""
    first = F.coalesce(*[blank_to_null(c.cast("string")) for c in candidates])
    v = first.try_cast("double")
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"{name} is not a number: "), F.coalesce(first, F.lit("missing")))).cast("double")).otherwise(v)
