"""Small table helpers shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Far below the kept digits and far above summation noise.
TIE_SHIFT = 2e-10


def rows_from_columns(frame: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    """Turn the columns of a one-row aggregate into ``(key, value)`` rows."""
    pairs = [F.struct(F.lit(n).alias(key), F.col(n).cast("bigint").alias(value)) for n in names]
    return frame.select(F.inline(F.array(*pairs)))


def count_true(condition: Column) -> Column:
    """Rows where the condition holds; NULL does not count, and no rows give 0."""
    return F.count_if(condition)


def add_up(column: Column | str) -> Column:
    """A sum that is 0 on no rows."""
    return F.coalesce(F.sum(column), F.lit(0))


def finite(column: Column) -> Column:
    value = column.cast("double")
    return ~F.isnan(value) & ~value.isin(float("inf"), float("-inf"))


def long_models(frame: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """One row per model and forecast: ``keep`` + ``model, prediction``."""
    return frame.select(*keep, *[F.col(m).cast("double").alias(m) for m in models]).unpivot(
        keep, models, "model", "prediction"
    )


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so two engines can be compared by value.

    The small shift moves exact ties such as 3/128, which summation order would otherwise send
    either way.
    """
    return frame.select(
        *[
            F.round(F.col(f"`{f.name}`") + TIE_SHIFT, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in frame.schema.fields
        ]
    )
