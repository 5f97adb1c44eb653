"""The folder for written tables: shared on a cluster, or an error that names the setting."""

import datetime as dt
import os
from types import SimpleNamespace

import pytest

from gridsla import SlaAnalysis
from gridsla.plans.materialize import shared_dir


def session(master, **settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
                           sparkContext=SimpleNamespace(master=master))


WAREHOUSE, CHECKPOINT = "spark.sql.warehouse.dir", "spark.checkpoint.dir"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
@pytest.mark.parametrize("folder", ["file:/home/me/spark-warehouse", "/home/me/spark-warehouse", "spark-warehouse"])
def test_local_warehouse_is_refused_on_a_cluster(master, folder):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(master, **{WAREHOUSE: folder}))


def test_given_folder_and_shared_warehouse():
    local = "file:/home/me/spark-warehouse"
    assert shared_dir(session("local[8]", **{WAREHOUSE: local})) == local
    assert shared_dir(session("yarn", **{WAREHOUSE: "hdfs://host/warehouse/"})) == "hdfs://host/warehouse"
    assert shared_dir(session("yarn", **{WAREHOUSE: local, CHECKPOINT: "/mnt/shared/"})) == "/mnt/shared"


def test_close_deletes_the_table_of_the_oldest_guid(spark, make_jobs):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    a = SlaAnalysis(make_jobs([(1, "serviceSetLoadLimit", "G1", "1", "M1", dt.datetime(2024, 2, 2, 10), None)]))
    assert [r.guid for r in a.oldest_open_guid().collect()] == ["G1"]
    assert set(os.listdir(folder)) > before
    a.close()
    assert set(os.listdir(folder)) == before
