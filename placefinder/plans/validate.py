"""Request checks: a column of messages for tables of requests, and exceptions for single values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refdata import COARSE_LAYERS, LAYERS, LIMITS, SOURCE_ALIASES, SOURCES
from .filters import expand_layers


#: The shapes of request values, and how many categories one may name.
BOOLEAN, COUNTRY, LANG = r"(?i)^(true|false|1|0|yes|no)$", r"^[A-Za-z]{2,3}$", r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"
GID, CATEGORY, MOST_CATEGORIES = r"^[a-z_]+:[a-z]+:[A-Za-z0-9_/.:-]+$", r"^[a-z0-9_=:.-]{1,60}$", 20


class RequestError(ValueError):
    """A request value that can't be answered."""


def limits(settings: dict[str, float] | None = None) -> dict[str, float]:
    """Limits with the caller's settings; one out of its range is an error."""
    out = {name: value for name, (value, _, _) in LIMITS.items()}
    for name, value in (settings or {}).items():
        if name not in LIMITS:
            raise RequestError(f"unknown limit {name}")
        least, most = LIMITS[name][1:]
        if not least <= value <= most:
            raise RequestError(f"{name} must be between {least} and {most}, not {value}")
        out[name] = value
    return out


def split_list(value: Column, aliases: dict[str, str]) -> Column:
    """A comma-separated list as an array: trimmed, lower case, aliases resolved, blanks dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    if not aliases:
        return parts
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.transform(parts, lambda x: F.coalesce(table[x], x))


def checked(requests: DataFrame, settings: dict[str, float] | None = None) -> DataFrame:
    """``requests`` (any of text, layers, sources, size, lat, lon, rect, circle) with layers and sources as arrays and
    ``errors``: an array of messages, empty for a request that can be answered. Also looked at: focus_lat and focus_lon,
    coarse (as text), country, gid, categories (a comma-separated list, returned as an array), lang."""
    lim, have = limits(settings), set(requests.columns)
    out, errors = requests, []
    add = lambda condition, message: errors.append(F.when(condition, F.lit(message)))
    if "text" in have:
        add(F.trim(F.coalesce("text", F.lit(""))) == "", "text is required")
        add(F.length("text") > int(lim["max_text"]), f"text is longer than {int(lim['max_text'])} characters")
    for name, allowed, aliases in (("layers", LAYERS, {}), ("sources", SOURCES, SOURCE_ALIASES)):
        if name in have:
            listed = split_list(F.col(name), aliases)
            out = out.withColumn(name, expand_layers(listed, COARSE_LAYERS) if name == "layers" else listed)
            add(F.size(F.array_except(name, F.array(*map(F.lit, allowed)))) > 0, f"{name} holds an unknown value")
    if "size" in have:
        add((F.col("size") < 1) | (F.col("size") > int(lim["max_size"])), f"size must be between 1 and {int(lim['max_size'])}")
    if {"lat", "lon"} <= have:
        add(F.col("lat").isNull() != F.col("lon").isNull(), "lat and lon go together")
        add(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180), "lat or lon is out of range")
    if "rect" in have:
        add(F.col("rect").isNotNull() & ((F.size("rect") != 4) | (F.get("rect", F.lit(0)) >= F.get("rect", F.lit(2))) | (F.get("rect", F.lit(1)) >= F.get("rect", F.lit(3)))), "the rectangle's corners are missing or out of order")
    if "circle" in have:
        add(F.col("circle").isNotNull() & ((F.size("circle") != 3) | (F.get("circle", F.lit(2)) > lim["max_circle_km"] * 1000)), "the circle is incomplete or too large")
    if {"focus_lat", "focus_lon"} <= have:
        add(F.col("focus_lat").isNull() != F.col("focus_lon").isNull(), "the focus needs both lat and lon")
        add(~F.col("focus_lat").between(-90, 90) | ~F.col("focus_lon").between(-180, 180), "the focus is out of range")
    for name, pattern, message in (("coarse", BOOLEAN, "coarse must be true or false"), ("country", COUNTRY, "country must be a code of two or three letters"), ("gid", GID, "gid must look like source:layer:id"), ("lang", LANG, "invalid lang")):
        if name in have:
            add(F.col(name).isNotNull() & ~F.trim(F.col(name).cast("string")).rlike(pattern), message)
    if "gid" in have:
        add(F.length("gid") > 200, "gid is too long")
    if "categories" in have:
        out = out.withColumn("categories", split_list(F.col("categories"), {}))
        add((F.size("categories") > MOST_CATEGORIES) | F.exists("categories", lambda c: ~c.rlike(CATEGORY)), "invalid categories")
    return out.withColumn("errors", F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"))
