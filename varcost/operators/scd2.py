"""Type-2 history of a dimension, from full snapshots.

Versions cover half-open intervals ``[fecha_inicio, fecha_fin)``. A change in any tracked column
starts a new version; a key that a snapshot lacks closes its version on that snapshot's date.
Carried columns (audit data) are kept from the snapshot that began a version, not compared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varcost.functions.keys import surrogate_key

PROVIDER_TRACKED = ("nombre", "especialidad", "region", "cuit", "cuit_valido", "habilitado")

# Names a row's version by the day it begins: with the row's own key that gives the surrogate key, in a fraction of its bytes.
VERSION_SINCE = "_version_since"


def version_key(key: str = "prestador_id", since: str = "fecha_inicio") -> Column:
    """Surrogate key of the version of ``key`` that began on ``since``; NULL without a version."""
    return F.when(F.col(since).isNotNull(), surrogate_key(F.col(key), F.col(since)))


def _finish(
    versions: DataFrame, key: str, tracked: Sequence[str], carried: Sequence[str], sk: str
) -> DataFrame:
    return versions.withColumns({
        sk: surrogate_key(F.col(key), F.col("fecha_inicio")),
        "es_vigente": F.col("fecha_fin").isNull(),
    }).select(sk, key, *tracked, "fecha_inicio", "fecha_fin", "es_vigente", *carried)


def history(
    snapshots: Mapping[date, DataFrame],
    key: str = "prestador_id",
    tracked: Sequence[str] = PROVIDER_TRACKED,
    carried: Sequence[str] = (),
    sk: str = "prestador_sk",
) -> DataFrame:
    """All versions from all snapshots, with one shuffle on the key.

    The dates are known where the snapshots are listed, so each row carries the date of the next
    snapshot; a series breaks where a key skips it. A window partition is one key's snapshots.
    """
    dates = sorted(snapshots)
    following = dict(zip(dates, [*dates[1:], None]))
    rows = reduce(
        DataFrame.unionByName,
        (
            snapshots[d].select(
                key,
                *tracked,
                *carried,
                F.lit(d).alias("_date"),
                F.lit(following[d]).cast("date").alias("_next"),
            )
            for d in dates
        ),
    )
    in_time = Window.partitionBy(key).orderBy("_date")
    state = F.struct(*tracked)
    starts = (
        F.lag("_date").over(in_time).isNull()
        | ~F.lag("_next").over(in_time).eqNullSafe(F.col("_date"))
        | ~F.lag(state).over(in_time).eqNullSafe(state)
    )
    runs = rows.withColumn("_starts", starts).withColumn(
        "_run", F.sum(F.col("_starts").cast("int")).over(in_time)
    )
    versions = runs.groupBy(key, "_run", *tracked).agg(
        F.min("_date").alias("fecha_inicio"),
        F.max_by("_next", "_date").alias("fecha_fin"),
        *(F.min_by(c, "_date").alias(c) for c in carried),
    )
    return _finish(versions, key, tracked, carried, sk)


def merge_snapshot(
    dimension: DataFrame,
    snapshot: DataFrame,
    on: date,
    key: str = "prestador_id",
    tracked: Sequence[str] = PROVIDER_TRACKED,
    carried: Sequence[str] = (),
    sk: str = "prestador_sk",
    new_since: date | None = None,
) -> DataFrame:
    """The dimension after one more full snapshot.

    The first version of a key that had none begins at ``new_since`` (by default on the snapshot's date); a key
    that appears again begins on the snapshot's date.

    Only current versions are joined with the snapshot; closed ones pass through. Merging the
    same snapshot again changes nothing, and a correction of the same date replaces the version
    it began. A snapshot older than a current version of one of its keys is an error.
    """
    columns = [key, *tracked, *carried, "fecha_inicio", "fecha_fin"]
    closed = dimension.filter(~F.col("es_vigente")).select(*columns)
    old = dimension.filter("es_vigente").select(
        F.col(key).alias("_key"),
        F.struct(*tracked).alias("_old"),
        F.struct(*tracked, *carried).alias("_old_row"),
        F.col("fecha_inicio").alias("_since"),
    )
    new = snapshot.select(
        F.col(key).alias("_new_key"),
        F.struct(*tracked).alias("_new"),
        F.struct(*tracked, *carried).alias("_new_row"),
    )
    # Null-safe: a NULL key has versions like any other, as in history().
    both = old.withColumn("_has_old", F.lit(True)).join(
        new.withColumn("_has_new", F.lit(True)), F.col("_key").eqNullSafe(F.col("_new_key")), "full"
    )
    if new_since is not None:
        ended_keys = closed.select(F.col(key).alias("_ended_key"), F.lit(True).alias("_known")).distinct()
        both = both.join(ended_keys, F.col("_new_key").eqNullSafe(F.col("_ended_key")), "left")

    day = F.lit(on)
    is_old, is_new = F.col("_has_old").isNotNull(), F.col("_has_new").isNotNull()
    first_day = day if new_since is None else F.when(is_old | F.col("_known"), day).otherwise(F.lit(new_since))
    same = is_old & is_new & F.col("_old").eqNullSafe(F.col("_new"))
    in_order = F.when(
        F.col("_since") > day,
        F.raise_error(
            F.concat(F.lit(f"snapshot {on} is older than the version of "), F.coalesce(F.col("_key"), F.lit("NULL")))
        ),
    ).otherwise(F.col("_since"))

    def version(state: Column, since: Column, until: Column) -> Column:
        fields = [state[c].alias(c) for c in (*tracked, *carried)]
        return F.struct(
            F.coalesce("_key", "_new_key").alias(key),
            *fields,
            since.alias("fecha_inicio"),
            until.cast("date").alias("fecha_fin"),
        )

    open_end = F.lit(None)
    kept = F.when(same, version(F.col("_old_row"), in_order, open_end))
    ended = F.when(is_old & ~same & (in_order < day), version(F.col("_old_row"), in_order, day))
    begun = F.when(is_new & ~same, version(F.col("_new_row"), first_day, open_end))
    merged = both.select(F.explode(F.array_compact(F.array(kept, ended, begun))).alias("v")).select("v.*")
    return _finish(closed.unionByName(merged), key, tracked, carried, sk)


def current(dimension: DataFrame) -> DataFrame:
    """The open version of every key."""
    return dimension.filter("es_vigente")


def versions_by_key(dimension: DataFrame, key: str = "prestador_id") -> DataFrame:
    """One row per key with ``_versions``, the months its versions cover and the days they began; a NULL key has none to be found."""
    version = F.struct(
        F.date_format("fecha_inicio", "yyyyMM").alias("begun"), F.date_format("fecha_fin", "yyyyMM").alias("ended"),
        F.col("fecha_inicio").alias("since"),
    )
    return dimension.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(version).alias("_versions"))


def since_in_force(versions: Column, month: Column) -> Column:
    """When the version in force on the last day of ``month`` began, of ``versions`` by :func:`versions_by_key`."""
    found = F.filter(versions, lambda v: (v["begun"] <= month) & (v["ended"].isNull() | (v["ended"] > month)))
    return F.get(found, F.lit(0))["since"]


def as_of_month(
    fact: DataFrame,
    dimension: DataFrame,
    key: str = "prestador_id",
    month: str = "periodo",
    columns: Sequence[str] = ("prestador_sk",),
) -> DataFrame:
    """Left-join the version in force on the last day of each row's month.

    The key is an equi-join condition and the interval a residual on the few versions of that
    key; intervals of a key do not overlap, so no row is multiplied. A date is not after the last
    day of a month exactly if its own month is not after that month, so months are compared as
    ``yyyyMM`` text: dates are formatted once per version and never parsed per fact row.

    Give the dimension as scanned from a table. Its size is then known, so a small one is
    broadcast without shuffling the fact, and with a large one a provider with very many fact
    rows is split over tasks; a frame still partitioned by the key from a window or aggregate of
    its own would be joined in place, which rules that out.
    """
    versions = dimension.select(
        F.col(key).alias("_key"),
        F.date_format("fecha_inicio", "yyyyMM").alias("_from"),
        F.date_format("fecha_fin", "yyyyMM").alias("_to"),
        *columns,
    )
    begun = versions["_from"] <= fact[month]
    not_ended = versions["_to"].isNull() | (versions["_to"] > fact[month])
    return fact.join(versions, (fact[key] == versions["_key"]) & begun & not_ended, "left").drop(
        "_key", "_from", "_to"
    )
