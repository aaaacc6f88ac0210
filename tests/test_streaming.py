from __future__ import annotations

from quillon.sources.store import Database
from quillon.streaming.ingest import into_table, windowed_counts


def test_stream_into_table(spark, tmp_path):
    db = Database.create(spark, f"{tmp_path}/db")
    db.session().create_table("t", "id bigint, x string")
    source = f"{tmp_path}/in"
    for n in (3, 5):
        spark.range(n).selectExpr("id", "cast(id as string) as x").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, x string").parquet(source)
        into_table(stream, db, "t", f"{tmp_path}/c").awaitTermination()
    assert db.session().table("t").count() == 8
    assert db.session().table("t_batches").count() == 2


def test_windowed_counts_agree_on_batch_and_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 09:00:00", "b")]
    df = spark.createDataFrame(rows, "ts string, k string").selectExpr("cast(ts as timestamp) as ts", "k")
    want = sorted(map(tuple, windowed_counts(df, "ts", ["k"]).collect()))
    assert [w[3] for w in want] == [2, 1, 1]
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", ["k"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == want
