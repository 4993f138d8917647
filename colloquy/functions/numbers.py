"""Column functions for rounding, exact sums, units and JSON numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int = 0) -> Column:
    """Rounds half toward plus infinity, which Spark's own ``round`` does not for negatives."""
    k = float(10**places)
    return F.floor(x * k + 0.5).cast("double") / k


def exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of rows; an empty one is 0."""
    return F.coalesce(F.sum(x.cast("decimal(18,6)")).cast("double"), F.lit(0.0))


def exact_sum_if(condition: Column, x: Column) -> Column:
    return exact_sum(F.when(condition, x))


def hours(ms: Column) -> Column:
    return ms / 3_600_000.0


def json_number(json: Column, name: str) -> Column:
    """The field if it is a JSON number other than 0; null for strings, other types and bad JSON."""
    v = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")
    number = F.schema_of_variant(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    x = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "double")
    return F.when(number & (x != 0), x)
