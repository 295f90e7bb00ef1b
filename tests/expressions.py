"""Helpers of the known-case tests."""


def one(spark, expr, **values):
    """Evaluate one expression over literal string columns."""
    schema = ", ".join(f"{k} STRING" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("r")).first()["r"]
