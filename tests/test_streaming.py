from pyspark.sql import functions as F

from loomline.operators import grouping, parsing
from loomline.streaming.windows import stream_windows


def test_stream_gives_the_windows_of_a_batch(spark, tmp_path):
    times = [1000, 1003, 1009, 1011, 1015, 995, 990, 2000, 2100]
    rows = [(i, f"{'-' if t != 1003 else 'X'} {t} 2005.06.03 x") for i, t in enumerate(times)]
    batch = parsing.parse_labelled(spark.createDataFrame(rows, "line_no bigint, text string"))
    want = {r.source_window_id: (len(r.lines), r.label, r.start_timestamp) for r in grouping.window_paragraphs(batch, 10, "bgl").collect()}
    spark.createDataFrame(rows, "line_no bigint, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = parsing.parse_labelled(spark.readStream.schema("line_no bigint, text string").parquet(str(tmp_path / "in")))
    out = stream_windows(stream.withColumn("event_time", F.timestamp_seconds("ts")), 10, anchor=1000, lateness="1 second")
    query = out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.source_window_id: (r.n_lines, r.label, r.start_timestamp) for r in spark.table("windows").collect()}
    assert got == want
