"""Small literal dimensions (host inventory, racks, metric definitions).

Their size is fixed by the inventory (hundreds of rows), never by the data,
so joins to them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K

INVENTORY_DDL = "hostname string, node_type string, rack int, database string, max_gap_seconds double"


def inventory(spark: SparkSession) -> DataFrame:
    """Every listed host with type, rack, database and gap limit (4 x cadence)."""
    rows = []
    for h in K.IRC_NODES:
        rows.append((h, "irc", int(h.split("-")[1]), "infra", float(K.GAP_FACTOR * K.IRC_SENSING_SECONDS)))
    for h in K.pdu_nodes():
        rows.append((h, "pdu", int(h.split("-")[1]), "infra", float(K.GAP_FACTOR * K.PDU_SENSING_SECONDS)))
    for h in K.compute_nodes():
        db = "h100" if h.startswith("rpg-") else "zen4"
        rows.append((h, "compute", int(h.split("-")[1]), db, float(K.GAP_FACTOR * K.COMPUTE_SENSING_SECONDS)))
    return spark.createDataFrame(rows, INVENTORY_DDL)


def rack_info(spark: SparkSession) -> DataFrame:
    """Rack -> IRC host (null for 97), analysis type, estimated kW."""
    rows = [(r, K.RACK_TO_IRC.get(r), t, kw) for r, (t, kw) in K.RACK_ESTIMATES.items()]
    return spark.createDataFrame(rows, "rack int, irc_node string, analysis_type string, estimated_kw double")


def metric_groups(spark: SparkSession) -> DataFrame:
    """Metric lists by group."""
    groups = {
        "irc_power": K.IRC_POWER_METRICS,
        "irc_all": K.IRC_ALL_METRICS,
        "pdu": K.PDU_POWER_METRICS,
        "h100": K.H100_METRICS,
        "zen4": K.ZEN4_METRICS,
        "excluded": K.EXCLUDED_METRICS,
        "derived": K.DERIVED_METRICS,
    }
    rows = [(g, m, i) for g, ms in groups.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, "group string, metric string, position int")


# --- fixed values: metric definitions of the test adapter (FIXTURES 3.4) ---
# (metric_id, metric_name, metric_data_type, units, accuracy, sensing_interval)
METRIC_DEFS = [
    ("CompressorPower", "Compressor Power", "float", "kW", 0.99, 120),
    ("CondenserFanPower", "Condenser Fan Power", "float", "W", 0.99, 120),
    ("CoolDemand", "Cool Demand", "float", "kW", 0.95, 120),
    ("CoolOutput", "Cool Output", "float", "kW", 0.95, 120),
    ("TotalSensibleCoolingPower", "Total Sensible Cooling Power", "float", "kW", 0.95, 120),
    ("pdu", "PDU Power", "float", "W", 0.99, 60),
    ("TotalCPUPower", "Total CPU Power", "int", "W", 0.98, 5),
    ("CPUPower", "CPU Power", "int", "W", 0.98, 5),
    ("TotalFanPower", "Total Fan Power", "int", "W", 0.97, 5),
    ("TotalStoragePower", "Total Storage Power", "int", "W", 0.97, 5),
    ("SystemInputPower", "System Input Power", "int", "W", 0.99, 5),
    ("SystemOutputPower", "System Output Power", "int", "W", 0.99, 5),
    ("PowerConsumption", "GPU Power Consumption", "int", "mW", 0.96, 5),
    ("DRAMPwr", "DRAM Power", "int", "W", 0.95, 5),
    ("TotalMemoryPower", "Total Memory Power", "int", "W", 0.97, 5),
    ("SystemPowerConsumption", "System Power Consumption", "float", "kW", 0.99, 5),
    ("BoardTemperature", "Board Temperature", "float", "C", 0.9, 5),
    ("SupplyAirTemperature", "Supply Air Temperature", "float", "C", 0.9, 120),
    ("RoomHumidity", "Room Humidity", "float", "%", 0.9, 120),
    ("SuctionPressure", "Suction Pressure", "float", "kPa", 0.9, 120),
    ("CompressorRunHours", "Compressor Run Hours", "int", "h", 1.0, 120),
    ("AirFilterHours", "Air Filter Hours", "int", "h", 1.0, 120),
    ("FanSpeed", "Fan Speed", "int", "rpm", 0.9, 5),
    ("SystemHeadRoomInstantaneous", "System Headroom Instantaneous", "int", "W", 0.9, 5),
]
METRIC_DEFS_DDL = (
    "metric_id string, metric_name string, metric_data_type string, units string, "
    "accuracy double, sensing_interval int"
)


def metric_defs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRIC_DEFS, METRIC_DEFS_DDL)


def display_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.DISPLAY_LABELS.items()), "metric string, label string")
