"""Values at dotted paths of semi-structured payloads ("bibjson.author.0.name"), through VARIANT columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """JSON text as a VARIANT; null where it is no JSON."""
    return F.try_parse_json(payload)


def variant_path(path: str) -> str:
    """A dotted path as a VARIANT path; parts that are numbers are places of a list."""
    out = "$"
    for part in path.split("."):
        if part.isdigit():
            out += f"[{int(part)}]"
        elif re.fullmatch(r"[A-Za-z_]\w*", part):
            out += f".{part}"
        else:
            out += "['{}']".format(part.replace("'", "\\'"))
    return out


def get_string(data: Column, path: str, default: str | None = "") -> Column:
    """The value as text without white space around it."""
    return F.coalesce(F.trim(F.try_variant_get(data, variant_path(path), "string")), F.lit(default))


def get_int(data: Column, path: str, default: int | None = None) -> Column:
    """A number, or a text that is one, without its fraction; the default for anything else."""
    return F.coalesce(F.try_variant_get(data, variant_path(path), "double").cast("long"), F.lit(default).cast("long"))


def get_list(data: Column, path: str) -> Column:
    """The list at the path as VARIANTs; an empty list if there is none."""
    return F.coalesce(F.try_variant_get(data, variant_path(path), "array<variant>"), F.array().cast("array<variant>"))


def get_first(data: Column, *paths: str) -> Column:
    """The first value among several paths that is not null, as text."""
    return F.coalesce(*[F.try_variant_get(data, variant_path(p), "string") for p in paths])


def get_map(payload: Column) -> Column:
    """A JSON object's members as map<string,string>: for metadata and thresholds of any names."""
    return F.from_json(payload, "map<string,string>")
