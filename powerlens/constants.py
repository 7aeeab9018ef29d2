"""Fixed values of the telemetry domain.

Everything in this module is a fixed value that results depend on: host
inventory, metric lists, sensing cadences, rack maps, thresholds.  They are
kept together, in their natural order, so they can be checked at a glance.
Larger tables (the 118 compute hosts) are built from a rule, not listed.
"""

from __future__ import annotations

# --- fixed values: hosts -------------------------------------------------

IRC_NODES = ["irc-91-5", "irc-92-5", "irc-93-3", "irc-94-5", "irc-95-3", "irc-96-5"]

# rack -> number of PDUs (pdu-<rack>-1 .. pdu-<rack>-n)
PDUS_PER_RACK = {91: 4, 92: 4, 93: 2, 94: 4, 95: 2, 96: 4, 97: 4}

# rack -> (compute host prefix, number of hosts); hosts are <prefix>-<rack>-1..n
COMPUTE_PER_RACK = {
    91: ("rpc", 20),
    92: ("rpc", 20),
    93: ("rpg", 8),
    94: ("rpc", 20),
    95: ("rpc", 10),
    96: ("rpc", 20),
    97: ("rpc", 20),
}

# rack -> IRC host cooling it (rack 97 has none)
RACK_TO_IRC = {
    91: "irc-91-5",
    92: "irc-92-5",
    93: "irc-93-3",
    94: "irc-94-5",
    95: "irc-95-3",
    96: "irc-96-5",
}

# rack -> (analysis type, estimated unmeasured power in kW)
RACK_ESTIMATES = {
    91: ("estimated_switches", 2.0),
    92: ("estimated_amd_nodes", 1.0),
    93: ("estimated_mixed", 3.0),
    94: ("estimated_switches", 2.0),
    95: ("estimated_switches", 4.0),
    96: ("estimated_switches", 2.0),
    97: ("accurate", 0.0),
}

# --- fixed values: metrics -----------------------------------------------

IRC_POWER_METRICS = ["CompressorPower", "CondenserFanPower"]
IRC_ALL_METRICS = [
    "CompressorPower",
    "CondenserFanPower",
    "CoolDemand",
    "CoolOutput",
    "TotalAirSideCoolingDemand",
    "TotalSensibleCoolingPower",
]
PDU_POWER_METRICS = ["pdu"]
H100_METRICS = [
    "TotalCPUPower",
    "TotalMemoryPower",
    "TotalStoragePower",
    "TotalFanPower",
    "SystemInputPower",
    "SystemOutputPower",
    "PowerConsumption",
]
ZEN4_METRICS = [
    "TotalCPUPower",
    "TotalMemoryPower",
    "TotalStoragePower",
    "TotalFanPower",
    "SystemInputPower",
    "SystemOutputPower",
]
EXCLUDED_METRICS = ["systemheadroominstantaneous"]
DERIVED_METRICS = ["computepower", "systemheadroominstantaneous"]
COP_METRICS = ["CompressorPower", "CondenserFanPower", "CoolDemand"]

# metrics of one host reported by the node energy table
NODE_ENERGY_TABLE_METRICS = [
    "SystemPowerConsumption",
    "SystemOutputPower",
    "TotalCPUPower",
    "TotalStoragePower",
    "TotalMemoryPower",
    "TotalFanPower",
]

# metric -> category for component breakdowns (list form, B13)
METRIC_CATEGORIES = {
    "CPU": ["CPUPower", "PkgPwr", "TotalCPUPower"],
    "MEMORY": ["DRAMPwr", "TotalMemoryPower"],
    "GPU": ["PowerConsumption"],
    "FAN": ["TotalFanPower"],
    "STORAGE": ["TotalStoragePower"],
    "SYSTEM": ["SystemInputPower", "SystemOutputPower", "SystemPowerConsumption", "WattsReading"],
}
# metric of a category that already is the category total (preferred over sums)
CATEGORY_TOTAL_METRIC = {
    "CPU": "TotalCPUPower",
    "MEMORY": "TotalMemoryPower",
    "FAN": "TotalFanPower",
    "STORAGE": "TotalStoragePower",
}

# substring grouping of the chart data (B14): a metric whose upper-cased name
# contains an upper-cased member of a category list falls in that category,
# categories tried in this order; names containing SYSTEMOUTPUT are the output
# reference; the rest is Other.  System metrics are tested first.
CONTAINS_ORDER = ["CPU", "MEMORY", "GPU", "FAN", "STORAGE"]

# expected unit of IRC power metrics (Q3)
EXPECTED_UNITS = {"CompressorPower": "kW", "CondenserFanPower": "W"}

# display labels of metrics
DISPLAY_LABELS = {
    "TotalCPUPower": "CPU",
    "TotalMemoryPower": "Memory",
    "TotalStoragePower": "Storage",
    "TotalFanPower": "Fan",
    "PowerConsumption": "GPU",
    "SystemInputPower": "SystemInput",
    "SystemOutputPower": "SystemOutput",
}

# --- fixed values: cadences and thresholds -------------------------------

IRC_SENSING_SECONDS = 120
PDU_SENSING_SECONDS = 60
COMPUTE_SENSING_SECONDS = 5
GAP_FACTOR = 4  # an interval longer than 4 x cadence is not bridged

JOULES_PER_KWH = 3_600_000.0
MAX_NODE_WATTS = 10_000.0
IDLE_PERCENTILE = 0.03
PEAK_PERCENTILE = 0.97
PUE_BANDS = [(1.2, "excellent"), (1.5, "good"), (2.0, "average")]
RACK_VERDICTS = [(10.0, "GOOD"), (20.0, "ACCEPTABLE")]
RELATION_IDENTICAL_PCT = 5.0
SYSTEM_MATCH_PCT = 10.0
GUARD_EDGE_GAP_SECONDS = 7200
GUARD_INNER_GAP_SECONDS = 3600

# window-table time formats, tried in this order
WINDOW_TIME_FORMATS = [
    "M/d/yy H:mm:ss",
    "M/d/yy H:mm",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
]


# --- rules building the larger tables -------------------------------------


def pdu_nodes() -> list[str]:
    return [f"pdu-{r}-{i}" for r, n in PDUS_PER_RACK.items() for i in range(1, n + 1)]


def compute_nodes() -> list[str]:
    return [f"{p}-{r}-{i}" for r, (p, n) in COMPUTE_PER_RACK.items() for i in range(1, n + 1)]

# Units and words of the definition filters (units in the list, or a word in the name).
COMPUTE_DEF_RULES = {
    "all": ([], []),
    "power": (["mW", "W", "kW"], ["Power"]),
    "power_units": (["mW", "W", "kW"], []),
    "temperature": (["C", "F", "K"], ["Temperature", "Temp"]),
}

INFRA_DEF_RULES = {
    "all": ([], []),
    "power": (["kW", "W", "mW"], ["Power"]),
    "temperature": (["C", "F", "K"], ["Temperature"]),
    "compressor": ([], ["Compressor"]),
    "air": ([], ["Air", "Filter", "Flow"]),
    "run_hours": ([], ["Run", "Hours"]),
    "humidity": ([], ["Humidity", "RH"]),
    "pressure": (["Pa", "kPa", "bar", "psi"], ["Pressure"]),
}
