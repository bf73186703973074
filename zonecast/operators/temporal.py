"""Strictly past features of a dense panel.

History windows run per (zone, stretch of time). Each stretch also receives the last rows of the
stretch before it as context, so results equal a window over the whole zone while a zone with a
long history spreads over many tasks. Rolling sums are differences of running sums, which are
exact for counts and cost the same for 3 and for 168 hours.
"""

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions.clock import hour_index, hours, to_local
from zonecast.settings import (
    DELAYS,
    LAGS,
    MEAN_WIDTHS,
    MORNING_EVENING_RUSH,
    STD_WIDTH,
    TIMEZONE,
)

STRETCH_HOURS = 13 * 168
LAG_NAMES = [f"lag_{lag}" for lag in LAGS]
MEAN_NAMES = [f"rolling_mean_{width}" for width in MEAN_WIDTHS]
STD_NAME = f"rolling_std_{STD_WIDTH}"
HISTORY = [*LAG_NAMES, *MEAN_NAMES, STD_NAME, "trend_1"]


def check_delay(delay: int) -> None:
    if type(delay) is not int or delay not in DELAYS:
        raise ValueError(f"Supported observation delays are {DELAYS} hours")


def effective_lags(delay: int = 0) -> dict[str, int]:
    """Recent lags move with the delay; day and week lags stay anchored to the target."""
    check_delay(delay)
    return {f"lag_{lag}": lag + (delay if lag <= 3 else 0) for lag in LAGS}


def reach(delays, lags=()) -> int:
    """Rows of context a stretch needs."""
    return max([max(delays) + max(*MEAN_WIDTHS, *LAGS), *lags])


def in_stretches(frame: DataFrame, context: int, stretch: int = STRETCH_HOURS) -> DataFrame:
    """Adds ``_stretch`` and ``_own``; rows near the end of a stretch also go to the next one."""
    if context >= stretch:
        raise ValueError("A stretch must be longer than its context")
    at = hour_index(F.col("hour"))
    home = F.floor(at / stretch)
    copies = F.when(at % stretch >= stretch - context, F.array(home, home + 1)).otherwise(
        F.array(home)
    )
    return frame.withColumn("_stretch", F.explode(copies)).withColumn("_own", F.col("_stretch") == home)


def past_window():
    return Window.partitionBy("zone_id", "_stretch").orderBy("hour")


def running_sums(frame: DataFrame) -> DataFrame:
    """Row number and running sums of counts and squared counts, needed by ``past_columns``."""
    upto = past_window().rowsBetween(Window.unboundedPreceding, 0)
    count = F.coalesce(F.col("demand").cast("bigint"), F.lit(0).cast("bigint"))
    return frame.withColumns(
        {
            "_row": F.row_number().over(past_window()),
            "_sum": F.sum(count).over(upto),
            "_squares": F.sum(count * count).over(upto),
        }
    )


def trailing(column: str, width: int, skip: int) -> Column:
    """Sum over ``width`` rows ending ``skip`` rows before this one; NULL unless complete."""
    w = past_window()
    before = F.coalesce(F.lag(column, skip + width).over(w), F.lit(0))
    return F.when(F.col("_row") >= skip + width, F.lag(column, skip).over(w) - before)


def past_columns(delay: int = 0) -> dict[str, Column]:
    """All history features under an observation delay."""
    w = past_window()
    columns = {name: F.lag("demand", k).over(w) for name, k in effective_lags(delay).items()}
    skip = 1 + delay
    for width in MEAN_WIDTHS:
        columns[f"rolling_mean_{width}"] = trailing("_sum", width, skip) / F.lit(float(width))
    total, squares = trailing("_sum", STD_WIDTH, skip), trailing("_squares", STD_WIDTH, skip)
    columns[STD_NAME] = F.sqrt((STD_WIDTH * squares - total * total).cast("double")) / STD_WIDTH
    lags = effective_lags(delay)
    columns["trend_1"] = F.lag("demand", lags["lag_1"]).over(w) - F.lag("demand", lags["lag_2"]).over(w)
    return columns


def history(
    panel: DataFrame, names=HISTORY, delay: int = 0, extra: dict | None = None, stretch: int = STRETCH_HOURS
) -> DataFrame:
    """Panel columns plus the named history features, in one shuffle and one sort.

    ``extra`` adds ``{new_name: (column, rows_back)}`` lags of further panel columns.
    """
    extra = extra or {}
    known = past_columns(delay)
    context = reach([delay], [back for _, back in extra.values()])
    ready = running_sums(in_stretches(panel, context, stretch))
    made = {name: known[name] for name in names}
    made |= {new: F.lag(column, back).over(past_window()) for new, (column, back) in extra.items()}
    return ready.withColumns(made).where("_own").select(*panel.columns, *made)


def lags(panel: DataFrame, delay: int = 0) -> DataFrame:
    return history(panel, LAG_NAMES, delay)


def rolling_means(panel: DataFrame, delay: int = 0) -> DataFrame:
    return history(panel, MEAN_NAMES, delay)


def rolling_std(panel: DataFrame, delay: int = 0) -> DataFrame:
    return history(panel, [STD_NAME], delay)


def trend(panel: DataFrame, delay: int = 0) -> DataFrame:
    return history(panel, ["trend_1"], delay)


def delayed_features(panel: DataFrame, delays=DELAYS, stretch: int = STRETCH_HOURS) -> DataFrame:
    """History features of all delays as rows with ``delay_hours``; one shuffle for all of them."""
    for delay in delays:
        check_delay(delay)
    ready = running_sums(in_stretches(panel, reach(delays), stretch))
    made = {}
    for delay in delays:
        made |= {f"_{delay}_{name}": column for name, column in past_columns(delay).items()}
    computed = ready.withColumns(made).where("_own")
    scenario = [
        F.struct(
            F.lit(delay).alias("delay_hours"),
            *[F.col(f"_{delay}_{name}").alias(name) for name in HISTORY],
        )
        for delay in delays
    ]
    return computed.select(*panel.columns, F.inline(F.array(*scenario)))


def local_calendar(frame: DataFrame, zone: str = TIMEZONE) -> DataFrame:
    """Local hour, weekday (Monday 0), weekend, month, weekday rush hour."""
    local = to_local(F.col("hour"), zone)
    day = F.weekday(local)
    return frame.withColumns(
        {
            "local_hour": F.hour(local),
            "weekday": day,
            "weekend": (day >= 5).cast("int"),
            "month": F.month(local),
            "rush_hour": ((day < 5) & F.hour(local).isin(*MORNING_EVENING_RUSH)).cast("int"),
        }
    )


def cyclic(frame: DataFrame) -> DataFrame:
    """Sine and cosine of the local hour and weekday; needs ``local_calendar``."""
    hour, day = F.col("local_hour") * (2 * pi) / 24, F.col("weekday") * (2 * pi) / 7
    return frame.withColumns(
        {
            "hour_sin": F.sin(hour),
            "hour_cos": F.cos(hour),
            "weekday_sin": F.sin(day),
            "weekday_cos": F.cos(day),
        }
    )


def make_features(panel: DataFrame, delay: int = 0, extra: dict | None = None) -> DataFrame:
    """Panel plus all model inputs and calendar columns."""
    return cyclic(local_calendar(history(panel, HISTORY, delay, extra)))


def future_target_rows(panel: DataFrame) -> DataFrame:
    """One row per zone for the hour after its history, demand NULL, plus the history itself."""
    carried = [c for c in panel.columns if c not in ("zone_id", "hour", "demand")]
    nxt = panel.groupBy("zone_id").agg(
        (F.max("hour") + hours(1)).alias("hour"),
        *[F.max_by(c, "hour").alias(c) for c in carried],
    )
    missing = nxt.withColumn("demand", F.lit(None).cast(panel.schema["demand"].dataType))
    return panel.unionByName(missing.select(*panel.columns))


def drop_warmup(features: DataFrame, needed=HISTORY) -> DataFrame:
    """Rows with a full history. Calendar features are never missing and are not looked at."""
    return features.dropna(subset=list(needed))
