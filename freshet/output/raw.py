"""Every field of a record, one line each, under its own heading: for looking at few records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.output.json import fields


def raw(df: DataFrame) -> DataFrame:
    """One text column `record`: a heading and a line `name = value` for each field that the record has."""
    lines = [F.when(v.isNotNull(), F.concat(F.rpad(F.lit(f"  {k}"), 26, " "), F.lit("= "), v.cast("string"))) for k, v in fields(df).items()]
    return df.select(F.concat(F.lit("Flow Record:\n"), F.concat_ws("\n", *lines), F.lit("\n")).alias("record"))
