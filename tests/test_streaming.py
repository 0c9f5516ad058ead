from quoin.streaming.edits import live_boxes


def test_live_boxes(spark, tmp_path):
    schema = "result_id long, at long, op string, box string, old string"
    source = f"file://{tmp_path}/in"
    batches = [[(1, 1, "add", "a", None), (1, 2, "add", "b", None), (2, 1, "add", "x", None)], [(1, 3, "modify", "c", "a"), (1, 4, "delete", None, "b"), (1, 5, "add", "d", None)]]
    seen = {}

    def keep(df, _):
        seen.update({r.result_id: (r.n, r.boxes) for r in df.collect()})

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = live_boxes(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert seen == {1: (2, "c,d"), 2: (1, "x")}
