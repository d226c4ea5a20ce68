from corpuslens.streaming import scores


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"Profound learning number {i}. It plays an important role in all of this work. " * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = scores.scored(scores.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string", 1)).select("doc_id", "score")
    query = stream.writeStream.format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in scores.scored(df).select("doc_id", "score").collect()}
    assert {tuple(r) for r in spark.table("scores").collect()} == want and len(want) == 20
