"""Every query of the catalog engine, with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.plans import domain

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = domain.oracle(sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "D10",
    """
SELECT c_name AS bill_to, count(*) AS n_invoices, cast(sum(cast(o_totalprice AS decimal(12,2))) AS decimal(18,2)) AS total
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= timestamp '1994-01-01' AND o_orderdate < timestamp '1998-01-01'
GROUP BY c_name""",
)
def customer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(
        F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("bill_to"))
    money = F.col("o_totalprice").cast("decimal(12,2)")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("bill_to")
        .agg(F.count(F.lit(1)).alias("n_invoices"), F.sum(money).cast("decimal(18,2)").alias("total"))
    )


def _load() -> None:
    from partloom.plans import q_commands, q_dml, q_guides, q_nested, q_relations, q_search, q_text  # noqa: F401  they register themselves


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
