"""A customer table of any size for trying the operators: nulls and repeated rows included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Shape of the sample.
CITIES = ("New York", "London", "Tokyo", "Sydney")
FIRST_DAY = "2020-01-01"
ROWS, REPEATED_ROWS = 1000, 20
MISSING_INCOME, MISSING_SCORE, PREMIUM = 0.05, 0.02, 0.3


def sample_customers(spark: SparkSession, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """`rows` customers, of which 2% appear twice; every value is a function of the customer and seed."""
    ids = spark.range(1, rows + 1).select(F.col("id").alias("customer_id"))

    def uniform(salt: int):
        return (F.pmod(F.xxhash64("customer_id", F.lit(seed * 1000 + salt)), F.lit(2**31)) + 0.5) / 2.0**31

    def normal(salt: int):
        return F.sqrt(-2.0 * F.log(uniform(salt))) * F.cos(2.0 * F.pi() * uniform(salt + 1))

    city = F.get(F.array(*[F.lit(c) for c in CITIES]), F.floor(uniform(5) * len(CITIES)).cast("int"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("customer_id") - 1).cast("int"))
    customers = ids.select(
        "customer_id",
        F.concat(F.lit("Customer "), F.col("customer_id")).alias("name"),
        (35 + 12 * normal(1)).cast("bigint").alias("age"),
        F.when(uniform(7) >= MISSING_INCOME, 50000 + 15000 * normal(3)).alias("income"),
        city.alias("city"),
        day.cast("timestamp_ntz").alias("signup_date"),
        (uniform(6) < PREMIUM).alias("is_premium"),
        F.when(uniform(9) >= MISSING_SCORE, 1 + 4 * uniform(8)).alias("satisfaction_score"),
    )
    repeats = rows * REPEATED_ROWS // ROWS
    stride = max(1, rows // repeats) if repeats else 0
    if not repeats:
        return customers
    again = customers.filter((F.col("customer_id") % stride == 0) & (F.col("customer_id") <= stride * repeats))
    return customers.unionByName(again)
