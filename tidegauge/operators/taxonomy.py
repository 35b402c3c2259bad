"""Dimensions: display names of sensors, subsystems, known couplings, faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators.reach import reachable

# Display names of the 41 measured and 11 manipulated variables, in order.
DISPLAY = """A_Feed_Stream1 D_Feed_Stream2 E_Feed_Stream3 A_C_Feed_Stream4 Recycle_Flow_Stream8 Reactor_Feed_Rate
Reactor_Pressure Reactor_Level Reactor_Temperature Purge_Rate Separator_Temperature Separator_Level Separator_Pressure
Separator_Underflow_Stream10 Stripper_Level Stripper_Pressure Stripper_Underflow_Stream11 Stripper_Temperature
Stripper_Steam_Flow Compressor_Work Reactor_Cooling_Water_Outlet_Temperature
Condenser_Cooling_Water_Outlet_Temperature Component_A_Stream6 Component_B_Stream6 Component_C_Stream6
Component_D_Stream6 Component_E_Stream6 Component_F_Stream6 Component_A_Stream9 Component_B_Stream9
Component_C_Stream9 Component_D_Stream9 Component_E_Stream9 Component_F_Stream9 Component_G_Stream9
Component_H_Stream9 Component_D_Stream11 Component_E_Stream11 Component_F_Stream11 Component_G_Stream11
Component_H_Stream11 D_Feed_Flow E_Feed_Flow A_Feed_Flow A_C_Feed_Flow Compressor_Recycle_Valve Purge_Valve
Separator_Pot_Liquid_Flow Stripper_Liquid_Product_Flow Stripper_Steam_Valve Reactor_Cooling_Water_Flow
Condenser_Cooling_Water_Flow""".split()

# Members of each subsystem, in order; a sensor belongs to the first that has it.
GROUPS = {
    "feed_system": "A_Feed_Stream1 D_Feed_Stream2 E_Feed_Stream3 A_C_Feed_Stream4 D_Feed_Flow E_Feed_Flow A_Feed_Flow A_C_Feed_Flow Component_A_Stream6 Component_B_Stream6 Component_C_Stream6 Component_D_Stream6 Component_E_Stream6 Component_F_Stream6",
    "reactor_system": "Reactor_Feed_Rate Reactor_Pressure Reactor_Level Reactor_Temperature Reactor_Cooling_Water_Outlet_Temperature Reactor_Cooling_Water_Flow",
    "reactor_cooling_system": "Reactor_Cooling_Water_Flow Reactor_Cooling_Water_Outlet_Temperature Reactor_Temperature Reactor_Pressure",
    "separation_system": "Separator_Temperature Separator_Level Separator_Pressure Separator_Underflow_Stream10 Separator_Pot_Liquid_Flow Recycle_Flow_Stream8 Compressor_Work",
    "condenser_cooling_system": "Condenser_Cooling_Water_Flow Condenser_Cooling_Water_Outlet_Temperature Separator_Temperature Separator_Pressure",
    "stripper_system": "Stripper_Level Stripper_Pressure Stripper_Underflow_Stream11 Stripper_Temperature Stripper_Steam_Flow Stripper_Steam_Valve Stripper_Liquid_Product_Flow",
    "purge_compressor_system": "Purge_Rate Purge_Valve Compressor_Work Compressor_Recycle_Valve",
    "product_composition_system": "Component_A_Stream9 Component_B_Stream9 Component_C_Stream9 Component_D_Stream9 Component_E_Stream9 Component_F_Stream9 Component_G_Stream9 Component_H_Stream9 Component_D_Stream11 Component_E_Stream11 Component_F_Stream11 Component_G_Stream11 Component_H_Stream11",
}

# Known couplings, upstream then downstream.
COUPLINGS = """Reactor_Cooling_Water_Flow Reactor_Temperature
Reactor_Cooling_Water_Outlet_Temperature Reactor_Temperature
Reactor_Temperature Reactor_Pressure
Reactor_Temperature Component_A_Stream6
Reactor_Feed_Rate Reactor_Temperature
A_C_Feed_Flow Reactor_Feed_Rate
A_Feed_Flow Reactor_Feed_Rate
D_Feed_Flow Reactor_Feed_Rate
E_Feed_Flow Reactor_Feed_Rate
Reactor_Level Reactor_Feed_Rate
Reactor_Pressure Purge_Rate
Separator_Underflow_Stream10 Recycle_Flow_Stream8
Recycle_Flow_Stream8 Reactor_Feed_Rate
Condenser_Cooling_Water_Flow Separator_Temperature
Condenser_Cooling_Water_Outlet_Temperature Separator_Temperature
Separator_Temperature Separator_Pressure
Separator_Pressure Compressor_Work
Separator_Underflow_Stream10 Stripper_Level
Stripper_Steam_Flow Stripper_Temperature
Stripper_Temperature Stripper_Underflow_Stream11
Stripper_Steam_Valve Stripper_Steam_Flow"""

# Fault number, subsystem, severity.
FAULTS = """1 feed_system medium
2 feed_system medium
3 reactor_system medium
4 reactor_cooling_system high
5 condenser_cooling_system high
6 feed_system high
7 feed_system high
8 feed_system medium
9 reactor_system medium
10 feed_system medium
11 reactor_cooling_system high
12 condenser_cooling_system high
13 reactor_system low
14 reactor_cooling_system critical
15 condenser_cooling_system critical
16 unknown medium
17 unknown medium
18 unknown medium
19 unknown medium
20 unknown medium
21 feed_system high
22 feed_system high"""


def sensors(spark: SparkSession) -> DataFrame:
    """sensor (position), name, display_name."""
    from tidegauge.sources.files import default_names

    return spark.createDataFrame([(k, n, d) for k, (n, d) in enumerate(zip(default_names(), DISPLAY, strict=True))], "sensor int, name string, display_name string")


def subsystems(spark: SparkSession) -> DataFrame:
    """display_name, subsystem, place: all memberships."""
    return spark.createDataFrame([(s, g, k) for k, (g, own) in enumerate(GROUPS.items()) for s in own.split()], "display_name string, subsystem string, place int")


def first_subsystem(spark: SparkSession) -> DataFrame:
    """display_name, subsystem: the first that has the sensor."""
    return subsystems(spark).groupBy("display_name").agg(F.min_by("subsystem", "place").alias("subsystem"))


def couplings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x.split()) for x in COUPLINGS.splitlines()], "src string, dst string")


def faults(spark: SparkSession, path: str | None = None) -> DataFrame:
    """fault_id, subsystem, severity of the known faults, or a knowledge base in JSON lines that the caller has."""
    if path:
        return spark.read.json(path)
    return spark.createDataFrame([(int(a), b, c) for a, b, c in (x.split() for x in FAULTS.splitlines())], "fault_id int, subsystem string, severity string")


def named(rows: DataFrame) -> DataFrame:
    """``rows`` (sensor) with name, display_name and subsystem; a sensor past the known ones keeps a plain name."""
    spark = rows.sparkSession
    plain = F.concat(F.lit("S"), (F.col("sensor") + 1).cast("string"))
    told = rows.join(sensors(spark), "sensor", "left").withColumn("name", F.coalesce("name", plain)).withColumn("display_name", F.coalesce("display_name", "name"))
    return told.join(first_subsystem(spark), "display_name", "left").withColumn("subsystem", F.coalesce("subsystem", F.lit("unknown")))


def candidates(rows: DataFrame, k: int = 3) -> DataFrame:
    """event_id, rank, subsystem, matched: subsystems by how many of an event's ``rows`` they have."""
    votes = rows.groupBy("event_id", "subsystem").agg(F.count(F.lit(1)).alias("matched"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("matched"), "subsystem"))
    return votes.withColumn("rank", rank).where(F.col("rank") <= k)


def downstream(rows: DataFrame, hops: int | None = 1) -> DataFrame:
    """``rows`` (display_name) with effect and hop: sensors known to follow, within a number of hops or (None) at any distance."""
    if hops is None:
        found = reachable(couplings(rows.sparkSession), rows.select(F.col("display_name").alias("src")))
        return rows.join(found, rows["display_name"] == found["src"]).select(*rows.columns, F.col("node").alias("effect"), "hop")
    edges = couplings(rows.sparkSession)
    step = rows.join(edges, rows["display_name"] == edges["src"]).select(*rows.columns, F.col("dst").alias("effect"), F.lit(1).alias("hop"))
    out = step
    for hop in range(2, hops + 1):
        step = step.join(edges, step["effect"] == edges["src"]).select(*rows.columns, F.col("dst").alias("effect"), F.lit(hop).alias("hop")).distinct()
        out = out.unionByName(step)
    return out.groupBy(*rows.columns, "effect").agg(F.min("hop").alias("hop"))
