"""How the tables at hand play the roles of the domain: state sequences, posteriors, feature vectors, covariates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from statewalk.operators import posterior, sequences

EVENT_STATES = ["click", "error", "purchase", "signup", "view"]
ORDER_STATES = ["F", "O", "P"]
ROLE_STATES = ["assistant", "system", "user"]
#: Fixed parameters of the two-state model whose forward pass is checked against SQL.
START, STAY, HIT = (0.6, 0.4), (0.7, 0.8), (0.9, 0.3)
#: Levels at which the fit that is checked against SQL starts.
LEVELS = (-0.5, 0.8)
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares for checkpoints; where none is set, all of Spark has to run here."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top or tempfile.mkdtemp(prefix='spark-shared-')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.positions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", EVENT_STATES)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.positions(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", ORDER_STATES)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.positions(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", ROLE_STATES)


def gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-posterior of three states for each supplier, from positive weights of its line items."""
    rows = table(spark, sf_dir, "lineitem")
    w = F.array(F.col("l_quantity"), F.col("l_discount") * 100.0 + 1.0, F.col("l_tax") * 100.0 + 1.0)
    t = (F.row_number().over(W.partitionBy("l_suppkey").orderBy(*LINE_KEY)) - 1).cast("int")
    return rows.select(F.col("l_suppkey").alias("sid"), t.alias("t"), posterior.normalized(w, 3).alias("g"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, s, p, x: labelled vectors in long form."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("sid"), F.col("label").alias("s"), F.posexplode("embedding").alias("p", "x")).withColumn("x", F.col("x").cast("double"))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, sex (by parity of the nation), age (market segment), fd (nation's number as nuisance), y (balance)."""
    rows = table(spark, sf_dir, "customer")
    sex = F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F")
    return rows.select(F.col("c_custkey").alias("sid"), sex.alias("sex"), F.col("c_mktsegment").alias("age"), F.col("c_nationkey").cast("double").alias("fd"), F.col("c_acctbal").alias("y"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, s, p, value, sex: mean price by supplier, return flag and brand, as a stack of state maps."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    s = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    by = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("sid"), s.cast("int").alias("s"), F.col("p_brand").alias("p")).agg(F.avg("l_extendedprice").alias("value"))
    return by.withColumn("sex", F.when(F.col("sid") % 2 == 0, "M").otherwise("F"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, s, y: mean price of a customer's orders by status, of the customers with all three."""
    rows = table(spark, sf_dir, "orders")
    s = (F.array_position(F.array(*[F.lit(x) for x in ORDER_STATES]), F.col("o_orderstatus")) - 1).cast("int")
    from statewalk.operators.statistics import complete_blocks

    return complete_blocks(rows.groupBy(F.col("o_custkey").alias("sid"), s.alias("s")).agg(F.avg("o_totalprice").alias("y")), 3)


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, sid, s, y: mean and greatest price of a customer's orders by status."""
    rows = table(spark, sf_dir, "orders")
    s = (F.array_position(F.array(*[F.lit(x) for x in ORDER_STATES]), F.col("o_orderstatus")) - 1).cast("int")
    wide = rows.groupBy(F.col("o_custkey").alias("sid"), s.alias("s")).agg(F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("most_price"))
    return wide.select("sid", "s", F.explode(F.array(F.struct(F.lit("mean_price").alias("metric"), F.col("mean_price").alias("y")), F.struct(F.lit("most_price").alias("metric"), F.col("most_price").alias("y")))).alias("x")).select("x.metric", "sid", "s", "x.y")
