"""The state of keyed rows as a snapshot and an append-only log of changes.

Log rows are ``seq`` (strictly rising), ``op`` and the key with its payload. Operations: ``i`` insert
(ignored while the key is live), ``d`` delete, ``o`` overwrite or put, ``t`` set the tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many changed keys are broadcast, so that unchanged rows stay where they are read.
BROADCAST_KEYS = 200_000
#: Operations of one key that are looked at together.
RUN = 1 << 16


def _latest(ops: tuple[str, ...]) -> Column:
    return F.coalesce(F.max(F.when(F.col("op").isin(*ops), F.col("seq"))), F.lit(0))


def fold(log: DataFrame, key: str, payload: list[str], tag: str | None = None) -> DataFrame:
    """The live rows: per key the overwrite after which nothing was deleted or overwritten, or the
    first insert after the last deletion; and the last tag set since then.

    Two aggregations over the key, combined before the shuffle, so that a hot key's operations meet
    as partial results and not as a group.
    """
    row = F.struct("seq", *payload)
    bars = log.groupBy(key).agg(_latest(("d", "o")).alias("bar"))
    after = log.where(F.col("op").isin("i", "o", "t")).join(bars, key).where((F.col("seq") > F.col("bar")) | ((F.col("seq") == F.col("bar")) & (F.col("op") == "o")))
    kept = F.min_by(row, F.struct(F.when(F.col("op") == "o", 0).otherwise(1), F.col("seq")))
    live = after.where(F.col("op") != "t").groupBy(key).agg(kept.alias("row"))
    if tag is None:
        return live.select(key, *[F.col(f"row.{c}").alias(c) for c in payload])
    tags = after.where(F.col("op") == "t").select(F.col(key), F.col("seq").alias("tag_seq"), F.col(tag).alias("new_tag"))
    late = live.join(tags, key, "left").where(F.col("tag_seq").isNull() | (F.col("tag_seq") > F.col("row.seq")))
    latest = late.groupBy(key).agg(F.max_by("new_tag", "tag_seq").alias("new_tag"))
    joined = live.join(latest, key, "left")
    return joined.select(key, *[F.coalesce("new_tag", f"row.{c}").alias(c) if c == tag else F.col(f"row.{c}").alias(c) for c in payload])


def keys_of(log: DataFrame, key: str, changes: int) -> DataFrame:
    """The keys of a log of ``changes`` rows, marked for a broadcast where they are few enough."""
    keys = log.select(key).distinct()
    return F.broadcast(keys) if changes <= BROADCAST_KEYS else keys


def as_log(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Rows of a snapshot as the first entries of a log."""
    return rows.select(F.lit(0).cast("long").alias("seq"), F.lit("o").alias("op"), key, *payload)


def state(snapshot: DataFrame, log: DataFrame, changes: int, key: str, payload: list[str], tag: str | None = None, part: DataFrame | None = None) -> DataFrame:
    """The snapshot after the log. Rows whose key has no entry in the log are only filtered; the
    others, and the log, are folded. With ``part``, of the unchanged rows only those in it."""
    keys = keys_of(log, key, changes)
    columns = [key, *payload]
    same = (snapshot if part is None else part).join(keys, key, "left_anti").select(*columns)
    touched = as_log(snapshot.join(keys, key, "left_semi"), key, payload)
    return same.union(fold(touched.union(log.select("seq", "op", *columns)), key, payload, tag).select(*columns))


def outcomes(log: DataFrame, key: str) -> DataFrame:
    """``log`` with ``outcome``: SUCCESS, DUPLICATED_ENTRY or NOT_FOUND_ID of each operation.

    What was last said of a key is carried from run to run of ``RUN`` numbers, so that the operations
    of a hot key are several groups.
    """
    columns = log.columns
    marked = log.withColumn("run", F.floor(F.col("seq") / RUN))
    last = lambda ops: F.max(F.when(F.col("op").isin(*ops), F.col("seq")))
    per_run = marked.groupBy(key, "run").agg(last(("i", "o")).alias("put"), last(("d",)).alias("gone"))
    earlier = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_run.select(key, "run", F.max("put").over(earlier).alias("put_before"), F.max("gone").over(earlier).alias("gone_before"))
    before = Window.partitionBy(key, "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = marked.join(carried, [key, "run"])
    at = lambda ops, carry: F.coalesce(F.greatest(last(ops).over(before), F.col(carry)), F.lit(-1))
    live = at(("i", "o"), "put_before") > at(("d",), "gone_before")
    outcome = F.when((F.col("op") == "i") & live, "DUPLICATED_ENTRY").when(F.col("op").isin("d", "t") & ~live, "NOT_FOUND_ID").otherwise("SUCCESS")
    return rows.withColumn("outcome", outcome).select(*columns, "outcome")
