"""What long runs leave at the driver."""

from mosaiq.llm import common


def test_a_written_table_gives_back_what_ended_jobs_held(spark, monkeypatch):
    assert not common.relieve(spark, 1.0)  # a small heap is left alone
    monkeypatch.setattr(common.relieve, "__defaults__", (0.0,))
    left = spark._jvm.java.lang.ref.WeakReference(spark._jvm.java.util.ArrayList())
    assert [r[0] for r in common.materialise(spark.range(3)).orderBy("id").collect()] == [0, 1, 2]
    assert left.get() is None
