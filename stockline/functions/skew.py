"""Ordered work per key that survives hot keys.

A plain window sends every row of a key to one task. Here a key's rows are cut
into buckets that follow the order (a day of its history, a price step): the
window runs inside (key, bucket), one summary row per (key, bucket) carries
state across the cuts, and a join puts both together. A third of all rows under
one key is then spread over as many tasks as the key has buckets. Results are
the same as those of the plain window.

``order`` must be a total order within the key and ``bucket`` a non-decreasing
function of it. Key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_BUCKET = "__bucket"


def _rank(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _windows(keys: Sequence[str], order: Sequence[str]):
    inner = Window.partitionBy(*keys, _BUCKET)
    outer = Window.partitionBy(*(keys or [F.lit(0)]))
    return (
        inner.orderBy(*[F.col(c).asc() for c in order]),
        inner.orderBy(*[F.col(c).desc() for c in order]),
        outer.orderBy(F.col(_BUCKET).asc()),
        outer.orderBy(F.col(_BUCKET).desc()),
        outer,
    )


def _attach(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(edges, [*keys, _BUCKET], "left")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds lag (``prev``) and lead (``next``) columns: {new column: source column}."""
    prev, next = dict(prev or {}), dict(next or {})
    df = df.withColumn(_BUCKET, bucket)
    up, _, over_buckets, _, _ = _windows(keys, order)
    rank = _rank(order)
    rows = df.select(
        "*",
        *[F.lag(F.struct(F.col(s).alias("v"))).over(up).alias(f"__p_{o}") for o, s in prev.items()],
        *[F.lead(F.struct(F.col(s).alias("v"))).over(up).alias(f"__n_{o}") for o, s in next.items()],
    )
    edges = df.groupBy(*keys, _BUCKET).agg(
        *[F.max_by(F.col(s), rank).alias(f"__e_{o}") for o, s in prev.items()],
        *[F.min_by(F.col(s), rank).alias(f"__f_{o}") for o, s in next.items()],
    )
    edges = edges.select(
        *keys,
        _BUCKET,
        *[F.lag(f"__e_{o}").over(over_buckets).alias(f"__e_{o}") for o in prev],
        *[F.lead(f"__f_{o}").over(over_buckets).alias(f"__f_{o}") for o in next],
    )

    def pick(inside: str, across: str, out: str) -> Column:
        here = F.col(inside)
        return F.when(here.isNotNull(), here["v"]).otherwise(F.col(across)).alias(out)

    return _attach(rows, edges, keys).select(
        *[c for c in df.columns if c != _BUCKET],
        *[pick(f"__p_{o}", f"__e_{o}", o) for o in prev],
        *[pick(f"__n_{o}", f"__f_{o}", o) for o in next],
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    back: Mapping[str, str] | None = None,
    ahead: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds the last non-null value at or before each row (``back``) and the
    first at or after it (``ahead``): an as-of join over a union of both sides."""
    back, ahead = dict(back or {}), dict(ahead or {})
    df = df.withColumn(_BUCKET, bucket)
    up, down, over_up, over_down, _ = _windows(keys, order)
    to_here = (Window.unboundedPreceding, Window.currentRow)
    before = (Window.unboundedPreceding, -1)
    rank = _rank(order)
    rows = df.select(
        "*",
        *[F.last(s, ignorenulls=True).over(up.rowsBetween(*to_here)).alias(f"__p_{o}") for o, s in back.items()],
        *[F.last(s, ignorenulls=True).over(down.rowsBetween(*to_here)).alias(f"__n_{o}") for o, s in ahead.items()],
    )
    edges = df.groupBy(*keys, _BUCKET).agg(
        *[F.max_by(F.col(s), F.when(F.col(s).isNotNull(), rank)).alias(f"__e_{o}") for o, s in back.items()],
        *[F.min_by(F.col(s), F.when(F.col(s).isNotNull(), rank)).alias(f"__f_{o}") for o, s in ahead.items()],
    )
    edges = edges.select(
        *keys,
        _BUCKET,
        *[F.last(f"__e_{o}", ignorenulls=True).over(over_up.rowsBetween(*before)).alias(f"__e_{o}") for o in back],
        *[F.last(f"__f_{o}", ignorenulls=True).over(over_down.rowsBetween(*before)).alias(f"__f_{o}") for o in ahead],
    )
    return _attach(rows, edges, keys).select(
        *[c for c in df.columns if c != _BUCKET],
        *[F.coalesce(f"__p_{o}", f"__e_{o}").alias(o) for o in back],
        *[F.coalesce(f"__n_{o}", f"__f_{o}").alias(o) for o in ahead],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, str | Column],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds running sums up to and including each row, and key totals
    (``totals``: {new column: name of a running sum})."""
    df = df.withColumn(_BUCKET, bucket)
    up, _, over_up, _, whole = _windows(keys, order)
    measures = {o: (F.col(c) if isinstance(c, str) else c) for o, c in sums.items()}
    rows = df.select(
        "*",
        *[F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__p_{o}") for o, c in measures.items()],
    )
    edges = df.groupBy(*keys, _BUCKET).agg(*[F.sum(c).alias(f"__e_{o}") for o, c in measures.items()])
    edges = edges.select(
        *keys,
        _BUCKET,
        *[
            F.sum(f"__e_{o}").over(over_up.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__f_{o}")
            for o in measures
        ],
        *[F.sum(f"__e_{s}").over(whole).alias(f"__t_{o}") for o, s in (totals or {}).items()],
    )
    return _attach(rows, edges, keys).select(
        *[c for c in df.columns if c != _BUCKET],
        *[(F.coalesce(f"__p_{o}", F.lit(0)) + F.coalesce(f"__f_{o}", F.lit(0))).alias(o) for o in measures],
        *[F.col(f"__t_{o}").alias(o) for o in (totals or {})],
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Mapping[str, float],
    width: float,
) -> DataFrame:
    """Exact interpolated percentiles per key without gathering a key's values.

    Equal values are counted first; ranks come from running counts over steps
    of ``width``; only the rows holding a wanted rank are kept.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    ranked = running(
        counts, keys, ["__v"], F.floor(F.col("__v") / F.lit(width)), {"__cum": "__c"}, {"__n": "__cum"}
    )
    pos = {o: F.lit(q) * (F.col("__n") - 1) for o, q in qs.items()}

    def holds(rank: Column) -> Column:
        return (F.col("__cum") - F.col("__c") <= rank) & (rank < F.col("__cum"))

    wanted = None
    for p in pos.values():
        cond = holds(F.floor(p)) | holds(F.ceil(p))
        wanted = cond if wanted is None else wanted | cond
    picked = (
        ranked.where(wanted)
        .groupBy(*keys)
        .agg(
            F.max("__n").alias("__n"),
            *[F.max(F.when(holds(F.floor(p)), F.col("__v"))).alias(f"__lo_{o}") for o, p in pos.items()],
            *[F.max(F.when(holds(F.ceil(p)), F.col("__v"))).alias(f"__hi_{o}") for o, p in pos.items()],
        )
    )
    return picked.select(
        *keys,
        *[
            (F.col(f"__lo_{o}") + (F.col(f"__hi_{o}") - F.col(f"__lo_{o}")) * (p - F.floor(p))).alias(o)
            for o, p in pos.items()
        ],
    )


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, width: float) -> DataFrame:
    """Adds the share of other rows of the key with a lower value; null values
    stay out. Ranks are found among counted distinct values, then joined back."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running(
        counts, keys, [value], F.floor(F.col(value) / F.lit(width)), {"__cum": "__c"}, {"__n": "__cum"}
    ).select(
        *keys,
        value,
        F.when(F.col("__n") > 1, (F.col("__cum") - F.col("__c")) / (F.col("__n") - 1)).otherwise(F.lit(0.0)).alias(out),
    )
    return df.join(ranked, [*keys, value], "left")


def ntile(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, tiles: int, out: str) -> DataFrame:
    """Adds the tile (1..``tiles``) of each row within its key, larger tiles first."""
    rows = running(df, keys, order, bucket, {"__rn": F.lit(1)}, {"__n": "__rn"})
    size, extra = F.floor(F.col("__n") / tiles), F.col("__n") % tiles
    wide = extra * (size + 1)
    tile = F.when(F.col("__rn") <= wide, F.floor((F.col("__rn") - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((F.col("__rn") - 1 - wide) / F.greatest(size, F.lit(1))) + 1
    )
    return rows.withColumn(out, tile.cast("int")).drop("__rn", "__n")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(*keys, "__r.*")


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(*keys, "__r.*")
