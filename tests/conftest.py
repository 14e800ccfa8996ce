import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


def scratch(name):
    """A new folder of this test run."""
    return os.path.join(tempfile.mkdtemp(prefix="run-"), name)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def packets(spark):
    """Skewed packets: key 1 holds a third of them. Small, for checks by brute force."""
    import random

    random.seed(11)
    rows = []
    for no in range(600):
        hot = no % 3 == 0
        rows.append(
            (
                no,
                no // 250,
                1 if hot else random.randrange(2, 14),
                random.randrange(6),
                random.randrange(1, 9),
                random.choice([2, 16, 17, 18, 18, 24]),
                random.randrange(5),
                random.randrange(5),
            )
        )
    columns = "pkt_no long, epoch long, dst_addr long, src_addr long, size long, tcp_flags int, tcp_seq long, tcp_ack long"
    return spark.createDataFrame(rows, columns).withColumn("proto", F.lit(6))
