import datetime as dt

from quizlens.plans.queries import corpus
from quizlens.streaming import incremental as inc


def run(spark, frame, name, mode):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}")


SCHEMA = "pos long, item_id string, question string, choices array<string>, answer_index int, subject string, at timestamp"


def test_running_positions_equal_the_batch(spark, data, tmp_path):
    items = corpus(spark, data).repartition(3)
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in run(spark, inc.running_positions(stream), "positions", "complete").collect()}
    assert got == {tuple(r) for r in inc.running_positions(items).collect()}


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    t0 = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
    rows = [(0, "a", "q", ["x", "y"], 0, "", t0), (1, "b", "q ", ["x", "y"], 0, "", t0), (2, "c", "q", ["x", "y"], 1, "", t0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = run(spark, inc.arriving_unique(stream, "at", "1 hour"), "uniques", "append").collect()
    assert len(got) == 2 and {r.answer_index for r in got} == {0, 1}


def test_windows(spark):
    t0 = dt.datetime(2024, 5, 1, 10, 5, tzinfo=dt.UTC)
    rows = [(k, str(k), "q", ["x", "y"], k % 2, "", t0 + dt.timedelta(minutes=20 * k)) for k in range(6)]
    got = inc.windowed_positions(spark.createDataFrame(rows, SCHEMA), "at", "1 hour", "10 minutes").collect()
    assert sum(r.n for r in got) == 6 and len({r.start for r in got}) == 2
