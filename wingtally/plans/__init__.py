"""Tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Boxes found in frames. The pair (l_orderkey, l_linenumber) has repeats, so row_id ranks whole rows.
DETECTIONS = """select l_suppkey % 7 as flight_id, l_orderkey as frame,
  l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as row_id,
  (l_partkey % 100) * 1.0e0 as x1, (l_suppkey % 50) * 1.0e0 as y1,
  (l_partkey % 100) * 1.0e0 + 1 + l_quantity / 5 as x2, (l_suppkey % 50) * 1.0e0 + 1 + l_quantity / 10 as y2,
  1 - l_tax * 5 as confidence, cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as bigint) as class_id, l_suppkey as track_id
from lineitem"""

#: Positions of flights in time.
TELEMETRY = """select user_id as flight_id, event_id as id, ts, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
  48 + (event_id % 1000) / 10000.0e0 as lat, 14 + (event_id % 777) / 10000.0e0 as lon, value as alt,
  (event_id * 7) % 360 * 1.0e0 as heading, event_id * 13 % 90 - 90.0e0 as pitch, event_id * 3 % 21 - 10.0e0 as roll,
  case when event_type = 'purchase' then 1 else 0 end as is_video
from events"""

#: Flights of telemetry as routes in metres.
ROUTES = """select flight_id, frame, (lat - 48) * 111320.0e0 as x, (lon - 14) * 74500.0e0 as y, alt as z from tele"""

VIEWS = {"det": (DETECTIONS, ["lineitem"]), "tele": (TELEMETRY, ["events"])}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTIONS.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TELEMETRY.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROUTES.replace("from tele", "from {tele}"), tele=telemetry(spark, sf_dir))


def oracle(sql: str) -> str:
    """The statement with the derived tables that it names before it."""
    return f"with recursive det as ({DETECTIONS}), tele as ({TELEMETRY}), route as ({ROUTES}) {', ' + sql[5:] if sql.startswith('with ') else sql}"


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the folder that spark.checkpoint.dir names; a session of one machine without one gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wingtally-"))
    return df.checkpoint()
