"""Star schemas: dimensions with an Unknown member, lookups, interval joins, facts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import surrogate_key
from tidemark.operators.windows import dedup_latest, forward_fill_segmented, up

OPEN_END = "9999-12-31"
UNKNOWN = "-1"


def with_unknown(dim: DataFrame, values: dict) -> DataFrame:
    """Add the Unknown member: given values, NULL elsewhere, in the dimension's own types."""
    cols = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in dim.schema.fields]
    return dim.unionByName(dim.sparkSession.range(1).select(*cols))


def dimension(df: DataFrame, key: str, natural: list[str], columns: list[str], unknown: dict) -> DataFrame:
    """Surrogate key over the natural one, the attributes, and the Unknown member."""
    return with_unknown(df.select(surrogate_key(*natural).alias(key), *columns), {key: UNKNOWN} | unknown)


@dataclass(frozen=True)
class Lookup:
    """Resolve a fact's foreign key in a dimension: by equal keys and, for versions, the event's day."""

    dim: DataFrame
    key: str  # the dimension's surrogate key
    on: dict[str, str]  # fact column: dimension column
    alias: str  # name of the foreign key in the fact
    day: str | None = None
    start: str = "valid_from_date"
    end: str = "valid_to_date"
    missing: object = UNKNOWN
    extra: dict[str, str] = field(default_factory=dict)  # attribute of the dimension: name in the fact


def miss_reason(fact: DataFrame, look: Lookup, name: str) -> DataFrame:
    """Why a lookup by versions met none: ``no key`` (NULL in the fact), ``unknown key``, ``before first version``, or
    ``between versions`` (a gap, or after the last one's end); NULL where it met one.

    The dimension is cut to one row for each key: the first day of its versions. ``look.alias`` must be resolved.
    """
    keys = {d: f"_m{n}" for n, d in enumerate(look.on.values())}
    first = look.dim.groupBy(*look.on.values()).agg(F.min(look.start).alias("_first") if look.day else F.lit(None).cast("date").alias("_first"))
    first = first.select(*[F.col(d).alias(m) for d, m in keys.items()], "_first", F.lit(True).alias("_held"))
    cond, null = F.lit(True), F.lit(False)
    for f, d in look.on.items():
        cond, null = cond & (F.col(f) == F.col(keys[d])), null | F.col(f).isNull()
    reason = F.when(F.col(look.alias) != F.lit(look.missing), F.lit(None).cast("string")).when(null, "no key").when(F.col("_held").isNull(), "unknown key")
    if look.day:
        reason = reason.when(F.col(look.day).isNull(), "no key").when(F.col(look.day) < F.col("_first"), "before first version")
    return fact.join(first, cond, "left").withColumn(name, reason.otherwise("between versions")).drop(*keys.values(), "_first", "_held")


def resolve(fact: DataFrame, *lookups: Lookup, reasons: bool = False) -> DataFrame:
    """Left joins, each on a dimension cut to its keys; a miss becomes the Unknown member, never NULL.

    With ``reasons`` each foreign key gets a column ``<name>_miss_reason`` (see ``miss_reason``), so that a bad key and
    an event before the first version are told apart. No join is forced to broadcast: Spark broadcasts a dimension by its
    size, and splits skewed keys otherwise.
    """
    for k, look in enumerate(lookups):
        cut = {look.key: f"_k{k}"} | {d: f"_d{k}_{n}" for n, d in enumerate(look.on.values())} | {a: f"_x{k}_{n}" for n, a in enumerate(look.extra)}
        if look.day:
            cut |= {look.start: f"_s{k}", look.end: f"_e{k}"}
        dim = look.dim.select(*[F.col(a).alias(b) for a, b in cut.items()])
        met = [F.col(f) == F.col(f"_d{k}_{n}") for n, f in enumerate(look.on)]
        if look.day:
            met.append((F.col(look.day) >= F.col(f"_s{k}")) & (F.col(look.day) <= F.coalesce(F.col(f"_e{k}"), F.lit(OPEN_END).cast("date"))))
        cond = met[0]
        for m in met[1:]:
            cond = cond & m
        fact = fact.join(dim, cond, "left").withColumn(look.alias, F.coalesce(F.col(f"_k{k}"), F.lit(look.missing)))
        fact = fact.withColumns({name: F.col(f"_x{k}_{n}") for n, name in enumerate(look.extra.values())} or {look.alias: F.col(look.alias)}).drop(*cut.values())
        if reasons:
            fact = miss_reason(fact, look, f"{look.alias}_miss_reason")
    return fact


def interval_join(events: DataFrame, versions: DataFrame, on: str, day: Column, how: str = "left", start: str = "valid_from_date", end: str = "valid_to_date") -> DataFrame:
    """Join events to the version that holds on their day: an equi-join by key with a range condition on the match."""
    v = versions.withColumnRenamed(on, "_on")
    hit = (F.col(on) == F.col("_on")) & (day >= F.col(start)) & (day <= F.coalesce(F.col(end), F.lit(OPEN_END).cast("date")))
    return events.join(v, hit, how).drop("_on")


def asof_merge(
    events: DataFrame,
    versions: DataFrame,
    on: str,
    day: str,
    columns: list[str],
    segment: Column | None = None,
    start: str = "valid_from_date",
    end: str = "valid_to_date",
) -> DataFrame:
    """``interval_join`` (left) as a merge: events and versions in one sorted pass, work linear in both.

    Each event takes the last version that starts on or before its day, if that one has not ended by then. Versions of a
    key must not overlap; of several that start on one day the one that ends last counts. Events without key or day, and
    those before the first version, get NULL. Unlike a join, no event meets all versions of its key. ``segment`` numbers
    segments of time (by the ``day`` column, on both sides): keys with very many events are then merged in parallel.
    """
    taken = {"_version": F.struct(F.col(start).alias("_start"), F.col(end).alias("_end"), *[F.col(c).alias(f"_v{k}") for k, c in enumerate(columns)])}
    kind = versions.select(
        F.col(on),
        F.col(start).alias(day),
        F.lit(0).alias("_side"),
        F.col(end).alias("_until"),
        *[c.alias(n) for n, c in taken.items()],
    ).where(F.col(on).isNotNull() & F.col(day).isNotNull())
    sided = events.withColumns({"_side": F.lit(1), "_until": F.lit(None).cast(versions.schema[end].dataType)})
    both = sided.unionByName(kind, allowMissingColumns=True)
    order = [day, "_side", "_until"]  # an open end is NULL, and the latest
    if segment is None:
        w = Window.partitionBy(on).orderBy(*[up(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_version", F.last("_version", ignorenulls=True).over(w))
    else:
        both = forward_fill_segmented(both, [on], order, ["_version"], segment)
    open_ = F.coalesce(F.col("_version._end"), F.lit(OPEN_END).cast("date"))
    met = F.col(on).isNotNull() & (F.col(day) <= open_)
    return both.where("_side = 1").select(*events.columns, *[F.when(met, F.col(f"_version._v{k}")).alias(c) for k, c in enumerate(columns)])


def reference_join(df: DataFrame, dim: DataFrame, id_column: str, name_column: str, key: str, dim_id: str, dim_name: str, order: list[Column], missing=UNKNOWN) -> DataFrame:
    """Join by id where there is one and by name elsewhere: two equi-joins in place of an OR.

    Names that several rows share are resolved to one of them, by ``order``, so no row fans out.
    """
    by_id = dim.select(F.col(dim_id).alias("_id"), F.col(key).alias("_by_id"))
    by_name = dedup_latest(dim.where(F.col(dim_name).isNotNull()), [dim_name], order).select(F.col(dim_name).alias("_name"), F.col(key).alias("_by_name"))
    out = df.join(by_id, F.col(id_column) == F.col("_id"), "left").join(by_name, F.col(id_column).isNull() & (F.col(name_column) == F.col("_name")), "left")
    return out.withColumn(key, F.coalesce("_by_id", "_by_name", F.lit(missing))).drop("_id", "_name", "_by_id", "_by_name")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key is not NULL and not in the parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def star(fact: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner joins of a fact with its dimensions: (dimension, fact key, dimension key)."""
    for dim, fk, pk in dims:
        fact = fact.join(dim, fact[fk] == dim[pk])
    return fact
