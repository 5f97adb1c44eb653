from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from gridsla.sources.tables import conform_alarms, conform_imports, conform_jobs  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[*]").appName("gridsla-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


JOB_SCHEMA = ("job_id bigint, task string, guid string, status string, meterid string, "
              "createddate timestamp_ntz, completiondatetime timestamp_ntz")
ALARM_SCHEMA = "meterid string, alarm_date timestamp_ntz, alarm_names string"
IMPORT_SCHEMA = "meter_id string, das_rtc timestamp_ntz"


@pytest.fixture
def make_jobs(spark):
    def make(rows):
        return conform_jobs(spark.createDataFrame(rows, JOB_SCHEMA))
    return make


@pytest.fixture
def make_alarms(spark):
    def make(rows):
        return conform_alarms(spark.createDataFrame(rows, ALARM_SCHEMA))
    return make


@pytest.fixture
def make_imports(spark):
    def make(rows):
        return conform_imports(spark.createDataFrame(rows, IMPORT_SCHEMA))
    return make
