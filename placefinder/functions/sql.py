"""The engine's scalar functions as temporary functions for SQL text."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import geo as G
from . import text as T
from .refdata import EXPANSIONS, NOT_SAINT

_TEXT, _PLACE = {"x": "STRING"}, {"lon1": "DOUBLE", "lat1": "DOUBLE", "lon2": "DOUBLE", "lat2": "DOUBLE"}


def _plain(spark: SparkSession, build, **arguments: str) -> str:
    """The SQL of a column expression over ``arguments``; one without lambdas, whose SQL can be read back."""
    row = spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in arguments.items()))
    made: Column = build(*(F.col(name) for name in arguments))
    return row.select(made.alias("_"))._jdf.queryExecution().analyzed().projectList().head().child().sql()


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _norm(folded: str) -> str:
    """The canonical form of the words of ``folded``, as :func:`text.norm`: a lambda's SQL can't be read back, so it is written."""
    words = f"filter(split(trim(regexp_replace(regexp_replace(lower({folded}), '[\\'’]', ''), '[^a-z0-9]+', ' ')), ' '), w -> w <> '')"
    table = "map(" + ", ".join(_quoted(x) for pair in EXPANSIONS.items() for x in pair) + ")"
    saint = f"coalesce(w = 'st' AND n RLIKE '^[a-z]' AND n NOT IN ({', '.join(map(_quoted, sorted(NOT_SAINT)))}), false)"
    return f"array_join(zip_with({words}, slice({words}, 2, greatest(size({words}), 0)), (w, n) -> CASE WHEN {saint} THEN 'saint' ELSE coalesce(element_at({table}, w), w) END), ' ')"


def _trigrams(x: str) -> str:
    words = f"filter(split(regexp_replace(lower({x}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), w -> w <> '')"
    return f"array_distinct(flatten(transform({words}, w -> transform(sequence(1, length(w) + 1), i -> substring('  ' || w || ' ', i, 3)))))"


def register(spark: SparkSession, prefix: str = "pf_") -> list[str]:
    """Temporary functions norm, unaccent, hn_int, hn_norm, similarity, distance_m, focus_boost and distance_confidence,
    each after ``prefix``; their bodies are SQL, so they are optimised with the query that calls them. Returns the names."""
    bodies = {
        "unaccent": (_TEXT, "STRING", _plain(spark, T.unaccent, **_TEXT)),
        "hn_int": (_TEXT, "INT", _plain(spark, T.hn_int, **_TEXT)),
        "hn_norm": (_TEXT, "STRING", _plain(spark, T.hn_norm, **_TEXT)),
        "distance_m": (_PLACE, "DOUBLE", _plain(spark, G.haversine_m, **_PLACE)),
        "focus_boost": ({"metres": "DOUBLE"}, "DOUBLE", _plain(spark, G.focus_boost, metres="DOUBLE")),
        "distance_confidence": ({"metres": "DOUBLE"}, "DOUBLE", _plain(spark, G.distance_confidence, metres="DOUBLE")),
        "norm": (_TEXT, "STRING", _norm(f"{prefix}unaccent(x)")),
        "_trigrams": (_TEXT, "ARRAY<STRING>", _trigrams("x")),
        "_jaccard": ({"a": "ARRAY<STRING>", "b": "ARRAY<STRING>"}, "DOUBLE", "coalesce(try_divide(CAST(size(array_intersect(a, b)) AS DOUBLE), size(array_union(a, b))), 0D)"),
        "similarity": ({"a": "STRING", "b": "STRING"}, "DOUBLE", f"{prefix}_jaccard({prefix}_trigrams(a), {prefix}_trigrams(b))"),
    }
    for name, (arguments, kind, body) in bodies.items():
        listed = ", ".join(f"{a} {t}" for a, t in arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({listed}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in bodies if not name.startswith("_")]
