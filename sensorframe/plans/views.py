"""Views assembled from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.time import epoch_ms, epoch_us, utc_session
from ..operators.bundle_kernel import bundle_batches
from ..operators.resample import resample
from ..operators.rolling import rolling
from ..operators.series import source_series
from ..operators.table import exclude_identifiers, sort_table
from ..schema import ROUND_DECIMALS, has_point, require_aggregates, require_columns, require_positive, series_keys
from ..scratch import pin


@dataclass(frozen=True)
class SeriesSpec:
    """What a series view shows besides the source."""

    resampling: tuple[str, ...] = ("mean",)
    every_s: int = 60
    period_s: int = 120
    rolling: tuple[str, ...] = ()
    window_size: int = 30
    min_periods: int = 1


def table_view(
    df: DataFrame,
    exclude=(),
    by: str = "ts",
    order: str = "asc",
    *,
    id_col: str = "identifier",
    seq_col: str | None = "seq",
) -> DataFrame:
    """The table as shown and exported: excluded identifiers out, then sorted."""
    return sort_table(exclude_identifiers(df, exclude, id_col), by, order, seq_col=seq_col)


# Rows of one series that a task holds while it makes all series of it.
BUNDLE_ROWS = 1_000_000


def series_bundle(
    df: DataFrame,
    spec: SeriesSpec = SeriesSpec(),
    *,
    id_col: str | Sequence[str] | None = None,
    ts_col: str = "ts",
    value_col: str = "value",
    seq_col: str | None = "seq",
    hot_rows: int = BUNDLE_ROWS,
) -> DataFrame:
    """All requested series as long rows ``(series, metric?, identifier, x, y)``.

    ``series`` is ``source``, ``resampling_mean``, ``resampling_median``,
    ``rolling_mean`` or ``rolling_median``. All come out of one scan, one shuffle
    by series and one walk over the sorted rows. Series with more than
    ``hot_rows`` rows, found by a count beforehand, are cut up by ``rolling``
    and ``resample`` instead.
    """
    ids = series_keys(df, id_col)
    require_columns(df, ts_col, value_col, *([seq_col] if seq_col else []))
    require_positive(window_size=spec.window_size, min_periods=spec.min_periods, every_s=spec.every_s, period_s=spec.period_s, hot_rows=hot_rows)
    if spec.min_periods > spec.window_size:
        raise ValueError(f"min_periods {spec.min_periods} exceeds window_size {spec.window_size}")
    for aggs in filter(None, (spec.rolling, spec.resampling)):
        require_aggregates(aggs)
    rows = df.where(has_point(ids, ts_col))
    sizes = rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("__sf_n"))
    hot = sizes.where(F.col("__sf_n") > hot_rows).select(*ids)
    if hot.isEmpty():
        return _fused(rows, spec, ids, ts_col, value_col, seq_col)
    hot = pin(hot, "long-series")
    same = reduce(lambda a, b: a & b, [rows[key].eqNullSafe(hot[key]) for key in ids])
    short = _fused(rows.join(hot, same, "left_anti"), spec, ids, ts_col, value_col, seq_col)
    return short.unionByName(_apart(rows.join(hot, same, "left_semi"), spec, ids, ts_col, value_col, seq_col))


def _fused(rows: DataFrame, spec: SeriesSpec, ids: list[str], ts_col: str, value_col: str, seq_col: str | None) -> DataFrame:
    keys = [f"key{i}" for i in range(len(ids))]  # other names could clash with the working columns
    names = ["source", *[f"rolling_{agg}" for agg in spec.rolling], *[f"resampling_{agg}" for agg in spec.resampling]]
    points = rows.select(
        *[F.col(name).alias(key) for name, key in zip(ids, keys)], epoch_us(ts_col, utc_session(rows.sparkSession)).alias("us"),
        *([F.col(seq_col).alias("seq")] if seq_col else []), F.col(value_col).cast("double").alias("v"),
    )
    order = ["us", "seq"] if seq_col else ["us"]
    fields = ", ".join(f"{key} {points.schema[key].dataType.simpleString()}" for key in keys)
    sorted_rows = points.repartition(*keys).sortWithinPartitions(*keys, *order)
    made = sorted_rows.mapInArrow(lambda batches: bundle_batches(batches, keys, names, spec), f"series int, {fields}, us bigint, y double")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("series") + 1)
    y = F.when(name.startswith("rolling_"), F.round("y", ROUND_DECIMALS)).otherwise(F.col("y"))
    return made.select(name.alias("series"), *[F.col(k).alias(n) for k, n in zip(keys, ids)], (F.col("us") / F.lit(1000.0)).alias("x"), y.alias("y"))


def _apart(df: DataFrame, spec: SeriesSpec, ids: list[str], ts_col: str, value_col: str, seq_col: str | None) -> DataFrame:
    cols = {"id_col": ids, "ts_col": ts_col, "value_col": value_col}
    x = epoch_ms(ts_col, utc_session(df.sparkSession))

    def long(frame: DataFrame, named: dict) -> DataFrame:
        pairs = [F.struct(F.lit(name).alias("series"), y.alias("y")) for name, y in named.items()]
        return frame.select(*ids, x.alias("x"), F.explode(F.array(*pairs)).alias("s")).select(
            "s.series", *ids, "x", "s.y"
        )

    if spec.rolling:
        rolled = rolling(df, spec.window_size, spec.min_periods, spec.rolling, seq_col=seq_col, **cols)
        named = {"source": F.col(value_col)} | {
            f"rolling_{agg}": F.col(f"rolling_{agg}") for agg in spec.rolling
        }
        bundle = long(rolled, named)
    else:
        source = source_series(df, seq_col=seq_col, **cols)
        bundle = source.select(F.lit("source").alias("series"), *ids, "x", "y")
    if spec.resampling:
        windows = resample(df, spec.every_s, spec.period_s, spec.resampling, **cols)
        named = {f"resampling_{agg}": F.col(agg) for agg in spec.resampling}
        bundle = bundle.unionByName(long(windows, named))
    return bundle
