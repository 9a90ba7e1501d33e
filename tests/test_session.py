import os

from strandline import session


def test_settled_tables_live_in_the_shared_folder(spark):
    df = session.settle(spark.range(10))
    folder = session.own_dir(spark).removeprefix("file:")
    assert df.count() == 10 and os.path.isdir(folder)
    assert "Scan parquet" in df._jdf.queryExecution().toString() or "FileScan" in df._jdf.queryExecution().toString()
    session.discard(spark)
    assert not os.path.isdir(folder)
    assert session.settle(spark.range(3)).count() == 3


def test_the_folder_the_cluster_names_is_used():
    class Named:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return "file:///shared" if key == session.CHECKPOINT_KEY else default

    assert session.shared_dir(Named) == "file:///shared"
