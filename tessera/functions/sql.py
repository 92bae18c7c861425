"""The distance functions for SQL text: temporary SQL functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, p) -> s + p)"
_SQUARED = "aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0D, (s, p) -> s + p)"
_NORM = "sqrt(aggregate({v}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"

FUNCTIONS = {
    "vector_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": _DOT,
    "vector_l2_squared(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": _SQUARED,
    "vector_l2(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": f"sqrt({_SQUARED})",
    "vector_norm(a ARRAY<FLOAT>)": _NORM.format(v="a"),
    "vector_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": f"coalesce(try_divide({_DOT}, {_NORM.format(v='a')} * {_NORM.format(v='b')}), CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0D END)",
}


#: Functions with another result than a number.
ARRAYS = {
    "vector_normalize(a ARRAY<FLOAT>) RETURNS ARRAY<DOUBLE>": "CASE WHEN {n} > 0 THEN transform(a, x -> CAST(x AS DOUBLE) / {n}) END".format(n=_NORM.format(v="a")),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session; gives their names."""
    heads = {f"{head} RETURNS DOUBLE": body for head, body in FUNCTIONS.items()} | ARRAYS
    for head, body in heads.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in heads]
