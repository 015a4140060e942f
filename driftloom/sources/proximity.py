"""The proximity log as a sequence of daily contact graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.order import dense_index
from driftloom.session import written
from driftloom.sources.tables import DAY0, PEER, USER

#: Days of the events marked in the study's calendar.
LABELLED_DAYS = (23, 68, 97, 173, 234)
N_DAYS = 289

SCHEMA = T.StructType(
    [
        T.StructField("user.id", T.IntegerType()),
        T.StructField("remote.user.id.if.known", T.IntegerType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("prob2", T.FloatType()),
    ]
)


@dataclass(frozen=True)
class ContactGraphs:
    """Daily graphs: ``snapshots`` (series_id, t, n), ``edges`` (series_id, t, u, v) and ``nodes`` (node, user_id)."""

    snapshots: DataFrame
    edges: DataFrame
    nodes: DataFrame


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The log from CSV with a header and ``NA`` for missing values."""
    reader = spark.read.schema(SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.[SSSSSS][SSSSS][SSSS][SSS][SS][S]]")
    return reader.csv(path, header=True, nullValue="NA")


def contacts(log: DataFrame, threshold: float = 0.0, day0: str = DAY0, n_days: int = N_DAYS) -> DataFrame:
    """``t, a, b``: rows with a known peer, a probability at or above the threshold (missing counts as 0) and a day in range."""
    start = F.lit(day0).cast("timestamp_ntz")
    end = start + F.make_dt_interval(days=F.lit(n_days))
    kept = log.filter(
        F.col(USER).isNotNull()
        & F.col(PEER).isNotNull()
        & (F.coalesce(F.col("prob2"), F.lit(0.0).cast("float")) >= F.lit(threshold).cast("float"))
        & (F.col("time") >= start)
        & (F.col("time") < end)
    )
    return kept.select(F.datediff(F.col("time"), F.lit(day0).cast("date")).alias("t"), F.col(USER).alias("a"), F.col(PEER).alias("b"))


def contact_graphs(log: DataFrame, threshold: float = 0.0, day0: str = DAY0, n_days: int = N_DAYS, series_id: str = "proximity") -> ContactGraphs:
    """One graph per day of the study, all over the same nodes, days without contact included.

    Nodes are the users and peers of the kept contacts in order of their ids;
    loops then drop out, and each pair counts once a day.
    """
    # Pairs are combined per day on the map side and written once: users and edges both come from these.
    rows = written(contacts(log, threshold, day0, n_days).select("t", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    users = rows.select(F.explode(F.array("a", "b")).alias("user_id")).distinct()
    nodes = dense_index(users, "user_id", "node").select("node", "user_id")
    u = nodes.select(F.col("node").alias("u"), F.col("user_id").alias("a"))
    v = nodes.select(F.col("node").alias("v"), F.col("user_id").alias("b"))
    edges = rows.filter("a <> b").join(u, "a").join(v, "b").select(F.lit(series_id).alias("series_id"), "t", "u", "v")
    n = nodes.agg(F.count(F.lit(1)).cast("int").alias("n"))
    days = F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("t")
    snapshots = n.select(F.lit(series_id).alias("series_id"), days, "n")
    return ContactGraphs(snapshots, edges, nodes)


def labelled_days(spark: SparkSession, series_id: str = "proximity") -> DataFrame:
    """``series_id, cp``: the labelled days as change points."""
    return spark.createDataFrame([(series_id, d) for d in LABELLED_DAYS], "series_id string, cp int")
