"""Written tables: what stays, what goes, and the session's settings."""

import os

from plumbline.llm import common


def test_settled_keeps_the_result_alone(spark):
    inner, before = [], spark.conf.get(common.CLEANUP)

    def step():
        inner.append(common.materialize(spark.range(100).repartition(4, "id")))
        inner.append(common.settled(spark, lambda: inner[0].where("id < 50")))
        return inner[1].groupBy((inner[1]["id"] % 5).alias("k")).count()

    found = common.settled(spark, step)
    assert sorted(map(tuple, found.collect())) == [(k, 10) for k in range(5)]
    assert spark.conf.get(common.CLEANUP) == before
    for table in inner:
        assert not any(os.path.exists(f.removeprefix("file://")) for f in table.inputFiles())


def test_settled_deletes_after_failure(spark):
    inner = []

    def step():
        inner.append(common.materialize(spark.range(3)))
        raise ZeroDivisionError

    try:
        common.settled(spark, step)
    except ZeroDivisionError:
        pass
    assert not any(os.path.exists(f.removeprefix("file://")) for f in inner[0].inputFiles())
    assert common.materialize(spark.range(0)).count() == 0
