"""Equi-joins, theta joins and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOW = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "outer": "full",
    "full": "full",
    "semi": "left_semi",
    "anti": "left_anti",
    "left_semi": "left_semi",
    "left_anti": "left_anti",
}


#: Bytes of a side that may be broadcast on the caller's word.
BROADCAST_LIMIT = 512 << 20


def _may_travel(df: DataFrame) -> bool:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_LIMIT or size >= 1 << 60  # what Spark says where it knows nothing


def join(left: DataFrame, right: DataFrame, on=None, how: str = "inner", *, left_on=None, right_on=None, broadcast: bool = False, right_suffix: str = "_right", strategy: str | None = None) -> DataFrame:
    """Key columns once (filled from either side in outer joins), then the left's other columns, then the right's.

    A right column whose name is taken gets ``right_suffix``. Null keys match nothing. ``broadcast`` asks for the right side to
    be sent to all tasks; that is done unless its estimated size is known to be above BROADCAST_LIMIT, where Spark decides by
    measured size, as without it. ``strategy``: ``shuffle_hash``, ``merge`` or ``broadcast``.
    """
    if how not in HOW:
        raise ValueError(f"unknown join type {how!r}; one of {', '.join(HOW)}")
    kind = HOW[how]
    left_keys = _names(left_on if left_on is not None else on)
    right_keys = _names(right_on if right_on is not None else on)
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("a join needs as many keys on the left as on the right, at least one")
    for side, keys, df in (("left", left_keys, left), ("right", right_keys, right)):
        if missing := [k for k in keys if k not in df.columns]:
            raise ValueError(f"no column {', '.join(missing)} on the {side}")

    same = left_keys == right_keys
    # names that cannot clash, also when a frame is joined to itself
    inner_key = [f"__k{i}" for i in range(len(left_keys))]
    rest = [c for c in right.columns if c not in right_keys] if same else list(right.columns)
    r = right.select(*[right[_q(k)].alias(a) for k, a in zip(right_keys, inner_key, strict=True)], *[right[_q(c)].alias(f"__r_{c}") for c in rest])
    if broadcast or strategy == "broadcast":
        r = F.broadcast(r) if _may_travel(r) else r
    elif strategy:
        r = r.hint(strategy)
    l_ = left.select("*", *[left[_q(k)].alias(f"__l{i}") for i, k in enumerate(left_keys)])
    condition = [F.col(f"__l{i}") == F.col(a) for i, a in enumerate(inner_key)]
    out = l_.join(r, condition, kind)
    if kind in ("left_semi", "left_anti"):
        return out.select(*[F.col(_q(c)) for c in left.columns])
    columns = []
    for c in left.columns:
        if same and c in left_keys and kind in ("right", "full"):
            columns.append(F.coalesce(F.col(f"__l{left_keys.index(c)}"), F.col(inner_key[left_keys.index(c)])).alias(c))
        else:
            columns.append(F.col(_q(c)))
    taken = set(left.columns)
    for c in rest:
        name = c + right_suffix if c in taken else c
        taken.add(name)
        columns.append(F.col(_q(f"__r_{c}")).alias(name))
    return out.select(*columns)


def join_within(left: DataFrame, right: DataFrame, on, times: tuple[str, str], within: str, how: str = "inner", *, right_suffix: str = "_right") -> DataFrame:
    """As join, of rows whose ``times`` are no further apart than the interval ``within``, like ``1 hour``."""
    if how not in HOW:
        raise ValueError(f"unknown join type {how!r}; one of {', '.join(HOW)}")
    keys = _names(on)
    names = {c: f"__r_{c}" for c in right.columns}
    r = right.withColumnsRenamed(names)
    span = F.expr(f"INTERVAL {within}") if not within.strip().upper().startswith("INTERVAL") else F.expr(within)
    condition = [left[_q(k)] == r[_q(names[k])] for k in keys]
    condition += [r[_q(names[times[1]])] >= left[_q(times[0])] - span, r[_q(names[times[1]])] <= left[_q(times[0])] + span]
    out = left.join(r, condition, HOW[how])
    if HOW[how] in ("left_semi", "left_anti"):
        return out
    taken = set(left.columns)
    kept = [F.coalesce(F.col(_q(c)), F.col(_q(names[c]))).alias(c) if c in keys else F.col(_q(c)) for c in left.columns]
    return out.select(*kept, *[F.col(_q(n)).alias(c + right_suffix if c in taken else c) for c, n in names.items() if c not in keys])


def join_asof(left: DataFrame, right: DataFrame, on: str, by=None, *, right_suffix: str = "_right", slices: int | None = None) -> DataFrame:
    """Each left row with the latest right row of the same ``by`` whose ``on`` is not later (null if none).

    Both sides are stacked, and the last right row seen is carried along in order of ``on``. Of right rows with one ``on``,
    the largest by its other columns counts. ``slices``: into how many ranges of ``on`` (a number or a time) each ``by`` is
    split, so that no ``by`` has to fit one task; each range then starts with the last right row of those before, which
    are one row a range. By default that is the number of shuffle partitions without ``by``, and one with it.
    """
    keys = _names(by)
    ks = [f"__k{i}" for i in range(len(keys))]
    rest = [c for c in right.columns if c not in keys]
    taken = set(left.columns)
    name = {c: c + right_suffix if c in taken else c for c in rest}
    kind = lambda df, columns: df.select(F.struct(*[F.col(_q(c)) for c in columns]).alias("x")).schema["x"].dataType
    none = lambda df, columns: F.lit(None).cast(kind(df, columns))
    columns = lambda df: [df[_q(k)].alias(a) for k, a in zip(keys, ks, strict=True)]
    l_ = left.select(F.struct(*[F.col(_q(c)) for c in left.columns]).alias("l"), none(right, rest).alias("r"), *columns(left), left[_q(on)].alias("__on"), F.lit(1).alias("__side"))
    r = right.where(right[_q(on)].isNotNull()).select(none(left, left.columns).alias("l"), F.struct(*[F.col(_q(c)) for c in rest]).alias("r"), *columns(right), right[_q(on)].alias("__on"), F.lit(0).alias("__side"))
    rows = l_.unionByName(r)
    if slices is None:
        slices = 1 if keys else int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if slices > 1 and not isinstance(rows.schema["__on"].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        slices = 1
    if slices > 1:
        cuts = rows.agg(F.percentile_approx("__on", [(i + 1) / slices for i in range(slices - 1)]).alias("__cuts"))
        rows = rows.join(F.broadcast(cuts)).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < F.col("__on")))).drop("__cuts")
    else:
        rows = rows.withColumn("__slice", F.lit(0))
    w = Window.partitionBy(*ks, "__slice").orderBy("__on", "__side", "r")
    out = rows.withColumn("__hit", F.last("r", ignorenulls=True).over(w))
    if slices > 1:
        last = rows.where("__side = 0").groupBy(*ks, "__slice").agg(F.max(F.struct("__on", "r")).alias("__m"))
        # every range that a key may have, with the last row of those before
        ranges = last.select(*ks).distinct().withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        same = [ranges[k].eqNullSafe(last[k]) for k in ks] + [ranges["__slice"] == last["__slice"]]
        carried = ranges.join(last, same, "left").select(*[ranges[k].alias(f"{k}c") for k in ks], ranges["__slice"].alias("__slicec"), F.last("__m", ignorenulls=True).over(_before(ranges, ks)).alias("__carry"))
        met = [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in ks] + [F.col("__slice") == F.col("__slicec")]
        out = out.where("__side = 1").join(carried if ks else F.broadcast(carried), met, "left").withColumn("__hit", F.coalesce("__hit", "__carry.r"))
    usable = F.col("__on").isNotNull()
    for k in ks:
        usable = usable & F.col(k).isNotNull()
    return out.where("__side = 1").select(*[F.col(f"l.{_q(c)}").alias(c) for c in left.columns], *[F.when(usable, F.col(f"__hit.{_q(c)}")).alias(name[c]) for c in rest])


def _before(ranges: DataFrame, keys: list[str]):
    """The ranges before, over the columns of ``ranges`` where a join has others of the same names."""
    return Window.partitionBy(*[ranges[k] for k in keys]).orderBy(ranges["__slice"]).rowsBetween(Window.unboundedPreceding, -1)


#: How much wider each level of a range join's buckets is than the one before.
WIDER = 16


def join_range(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Left rows with ``start <= point < end`` of right rows: an equi-join on buckets, then the exact test.

    Buckets of ``width`` (near the usual interval length) are for intervals up to a few widths; longer ones go to buckets that
    are 16, 256, … times as wide, so no interval is copied to more than 17 buckets. Points look in the levels that are in use.
    What a left join adds are the points whose value no interval holds; nothing is sorted by row, however many rows there are.
    """
    if how not in ("inner", "left"):
        raise ValueError("a range join is inner or left")
    at, a, b = (df[_q(c)] for df, c in ((left, point), (right, start), (right, end)))
    wide = lambda level: F.lit(float(width)) * F.pow(F.lit(float(WIDER)), level)
    bucket = lambda c, level: F.floor(c.cast("double") / wide(level))
    length = (b.cast("double") - a.cast("double")) / F.lit(float(width))
    level = F.greatest(F.lit(0), F.ceil(F.log(float(WIDER), F.greatest(length, F.lit(1.0)))) - 1).cast("int")
    r = right.where(a < b).withColumn("__level", level)
    levels = r.agg(F.sort_array(F.collect_set("__level")).alias("x")).select(F.when(F.size("x") > 0, F.col("x")).otherwise(F.array(F.lit(0))).alias("__levels"))
    r = r.withColumn("__b", F.explode(F.sequence(bucket(a, F.col("__level")), bucket(b, F.col("__level")))))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = lambda df, c: df.join(F.broadcast(levels)).withColumn("__ll", F.explode("__levels")).drop("__levels").withColumn("__lb", bucket(df[_q(c)], F.col("__ll")))
    on = lambda p, c: (p["__ll"] == r["__level"]) & (p["__lb"] == r["__b"]) & (p[_q(c)] >= r[_q(start)]) & (p[_q(c)] < r[_q(end)])
    # a file of few row groups would be read, and so joined, by few tasks
    points = probes(left.repartition(n), point)
    hits = points.join(r, on(points, point)).drop("__ll", "__lb", "__level", "__b")
    if how == "inner":
        return hits
    # points without any interval: whether a value has one is found out once, and ends at the first
    values = probes(left.select(at.alias("__v")).distinct(), "__v")
    found = values.join(r, on(values, "__v"), "left_semi").select("__v").distinct()
    missed = left.join(found, at == F.col("__v"), "left_anti")
    return hits.union(missed.select(*[missed[_q(c)] for c in left.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]))


def _names(on) -> list[str]:
    return [] if on is None else [on] if isinstance(on, str) else list(on)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
