import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from quillon.llm.blobs import bounded
from quillon.llm.identity import identified
from quillon.llm.spool import Spool, discard, shared_dir


def session(master, given=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: given), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://x"])
def test_clusters_need_a_folder_that_all_share(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(session(master))
    assert shared_dir(session(master, "hdfs:///shared/")) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_local_sessions_take_a_temporary_one(master):
    assert shared_dir(session(master)) == shared_dir(session(master)) and shared_dir(session(master)).startswith("file://")


def test_bounded_batches_hold_the_same_rows():
    texts = ["x" * n for n in (0, 10, 5000, 3, 3, 90_000, 1, 0, 700)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(bounded(iter([batch, batch.slice(0, 0), batch.slice(7, 50)]), 10_000))
    rows = [r for p in parts for r in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)]
    every = list(enumerate(texts))
    assert rows == every + every[7:57]
    assert all(p.num_rows == 1 or p.nbytes <= 10_000 for p in parts)


def test_written_tables_can_be_deleted(spark):
    spool = Spool(spark, "test")
    df = spool.table("a", spark.range(3).toDF("doc_id"))
    path = spool.path("a").removeprefix("file:").replace("//", "/")
    assert df.count() == 3 and os.path.isdir(path)
    discard(spark)
    assert not os.path.isdir(path)


def test_ids_are_numbered_only_where_texts_differ(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, _given string, part int")
    plain = identified(make([(1, "a", "g", 1), (2, "b", "g", 1), (None, "c", "g", 1)]), Spool(spark, "test"))
    assert plain.names is None and not plain.repeated
    same = identified(make([(1, "a", "g", 1), (1, "a", "h", 2), (3, None, "g", 1), (3, "", "g", 1)]), Spool(spark, "test"))
    assert same.names is None and same.repeated
    empty = identified(make([]), Spool(spark, "test"))
    assert empty.names is None and empty.docs.count() == 0
