"""Tables that are written hand few rows to Python at once."""

import pyarrow as pa

from linkloom.llm import common

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_are_small_and_the_setting_stays(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(SETTING)
    rows = common.written(common.in_arrow(spark.range(0, 3_500, 1, 1), count, "n long"), "batches")
    found = [r["n"] for r in rows.collect()]
    assert sum(found) == 3_500 and max(found) <= 1_000
    assert spark.conf.get(SETTING) == before
