import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from powerlens.session import local_session

    s = local_session(cores=4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def readings(spark):
    """Build a readings frame from (ts, value[, hostname, metric, fqdd, units, event_id]) tuples."""
    from pyspark.sql import functions as F

    def make(rows, hostname="h", metric="m", units="W", fqdd=None, node_type="compute"):
        data = []
        for i, r in enumerate(rows):
            ts, v = r[0], r[1]
            data.append((i, ts, hostname, metric, fqdd, float(v), units, node_type))
        df = spark.createDataFrame(
            data, "event_id bigint, ts string, hostname string, metric string, fqdd string, value double, units string, node_type string"
        )
        return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return make
