"""The streaming fold ends where the batch fold does."""

from pyspark.sql import functions as F

from lorespark.plans import progress as plans
from lorespark.operators import progress
from lorespark.streaming.levels import stream_levels


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    answers = plans.answers(spark, sf_dir).where("target_id < 8").withColumn("ts", F.col("ts").cast("timestamp"))
    order = answers.orderBy("ts", "event_id").collect()
    for k in range(3):
        part = order[k * len(order) // 3 : (k + 1) * len(order) // 3]
        # An answer that comes twice counts once.
        spark.createDataFrame([*part, part[0]], answers.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_levels(stream).writeStream.outputMode("update").format("memory").queryName("levels").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.target_id: (r.level, r.correct, r.wrong, r.streak) for r in spark.table("levels").orderBy(F.col("correct") + F.col("wrong")).collect()}
    batch = progress.fold_results(answers, ["target_id"], ["ts", "event_id"]).collect()
    assert got == {r.target_id: (r.level, r.correct, r.wrong, r.streak) for r in batch}
