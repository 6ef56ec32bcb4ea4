import datetime as dt

from pyspark.sql import functions as F

from pulse.streaming.daily import arriving, daily_rates, keep_table


def test_finished_days_equal_the_batch_job_and_are_written_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def add(day, texts):
        rows = [(dt.datetime(2021, 1, day, 12, i), x) for i, x in enumerate(texts)]
        spark.createDataFrame(rows, "t timestamp_ntz, body string").coalesce(1).write.mode(
            "append").parquet(source)

    def run():
        stream = arriving(spark, source, spark.read.parquet(source).schema)
        flags = {"dollar": F.col("body").contains("$")}
        keep_table(daily_rates(stream, F.col("t"), flags), out, checkpoint).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    add(1, ["$1", "x"])
    add(2, ["y"])
    add(5, ["z"])
    first = [(dt.date(2021, 1, 1), 2, 0.5), (dt.date(2021, 1, 2), 1, 0.0)]
    assert run() == first
    add(9, ["$"])
    assert run() == [*first, (dt.date(2021, 1, 5), 1, 0.0)]
