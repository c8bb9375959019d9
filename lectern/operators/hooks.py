"""Functions of the user (a model that embeds, scores or judges) that stand in for built-in results, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hooked(rows: DataFrame, name: str, kind: str, default: Column, hook: Callable | None, inputs: list[str | Column]) -> DataFrame:
    """Adds name, of the type kind, and name_by: which spoke for the row, 'hook' or 'default'.

    hook takes pandas Series of the inputs, an Arrow batch at a time, and returns as many values. Where it raises or
    returns another number of them, the whole batch has the default, and where it gives null, the row; so a
    provider that fails never fails the job. Without a hook all rows have the default.
    """
    if hook is None:
        return rows.withColumn(name, default).withColumn(f"{name}_by", F.lit("default"))

    @F.pandas_udf(f"struct<value:{kind}, spoke:boolean>")
    def run(*columns: pd.Series) -> pd.DataFrame:
        nothing = pd.DataFrame({"value": pd.Series([None] * len(columns[0]), dtype="object"), "spoke": False})
        try:
            values = list(hook(*columns))
        except Exception:  # whatever a provider raises
            return nothing
        if len(values) != len(columns[0]):
            return nothing
        return pd.DataFrame({"value": pd.Series(values, dtype="object"), "spoke": [v is not None for v in values]})

    said = rows.withColumn("hook_said", run(*[F.col(c) if isinstance(c, str) else c for c in inputs]))
    spoke = F.col("hook_said.spoke")
    return said.withColumn(name, F.when(spoke, F.col("hook_said.value")).otherwise(default)).withColumn(f"{name}_by", F.when(spoke, "hook").otherwise("default")).drop("hook_said")
