"""Session view over an order/line-item warehouse.

One line item plays one network session: the customer is the user, the part is
the handset, price, quantity, tax and discount give volumes and quality
figures.  Nulls and outliers are planted by key arithmetic so that cleaning has
something to do.  The view is a pure projection over two equi-joins, so column
pruning reaches the three Parquet scans.  Whoever reads all of it several times (fitting the
cleaning does) stores the joined rows, which are a fifth of the view, and joins once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.schema import APPLICATIONS


#: Tables behind the session view.
VIEW_TABLES = ("lineitem", "orders", "part")


def table_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(directory, name))


def _unless(broken: Column, value: Column) -> Column:
    return F.when(~broken, value)


def session_user() -> Column:
    """The user of a joined row."""
    return _unless(F.col("l_orderkey") % 61 == 0, F.col("o_custkey"))


def joined_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Line items with their order's customer and their part's brand and name."""
    line = read_table(spark, directory, "lineitem").drop("l_returnflag", "l_linestatus")
    orders = read_table(spark, directory, "orders").select("o_orderkey", "o_custkey")
    part = read_table(spark, directory, "part").select("p_partkey", "p_brand", "p_name")
    return (line.join(orders, line.l_orderkey == orders.o_orderkey)
                .join(part, line.l_partkey == part.p_partkey).drop("o_orderkey", "p_partkey"))


def session_view(spark: SparkSession, directory: str, joined: DataFrame | None = None) -> DataFrame:
    """Sessions derived from ``lineitem``, ``orders`` and ``part``, or from their stored
    :func:`joined_rows`."""
    joined = joined_rows(spark, directory) if joined is None else joined
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    rate = price / quantity
    retransmitted = price * F.col("l_tax")

    def volume(step: int, modulus: int) -> Column:
        return price * ((F.col("l_partkey") * step + F.col("l_suppkey")) % modulus)

    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bearer_id"),
        session_user().alias("user_id"),
        F.col("l_shipdate").alias("start_ts"),
        _unless(F.col("l_orderkey") % 37 == 0, F.col("p_brand")).alias("handset_manufacturer"),
        _unless(F.col("l_orderkey") % 41 == 0, F.col("p_name")).alias("handset_type"),
        _unless(F.col("l_orderkey") % 53 == 0,
                F.when(F.col("l_orderkey") % 59 == 0, quantity * 1_500_000)
                 .otherwise(quantity * 60000)).alias("dur_ms"),
        _unless(F.col("l_suppkey") % 10 == 0,
                (F.col("l_partkey") % 196 + 5).cast("double")).alias("rtt_dl_ms"),
        (F.col("l_suppkey") % 97 + 5).cast("double").alias("rtt_ul_ms"),
        rate.alias("tp_dl_kbps"),
        (rate / 10).alias("tp_ul_kbps"),
        _unless(F.col("l_partkey") % 10 == 3,
                F.when(F.col("l_orderkey") % 50 == 0, price * 20)
                 .otherwise(retransmitted)).alias("tcp_dl_bytes"),
        (retransmitted / 2).alias("tcp_ul_bytes"),
        *[volume(i, 97).alias(a.downlink) for i, a in enumerate(APPLICATIONS, 1)],
        *[volume(i, 11).alias(a.uplink) for i, a in enumerate(APPLICATIONS, 1)],
        F.when(F.col("l_orderkey") % 67 == 0, price * 30_000)
         .otherwise(price * 1000).alias("total_dl"),
        (price * 100 * (F.col("l_discount") + 1)).alias("total_ul"),
    )
