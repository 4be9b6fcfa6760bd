import tempfile

from setsift.streaming import membership_stream


def test_membership_stream(spark, demo_scores):
    d = tempfile.mkdtemp(prefix="setsift-stream-")
    demo_scores.write.mode("overwrite").parquet(f"{d}/in")
    stream = spark.readStream.schema(demo_scores.schema).parquet(f"{d}/in")
    q = (membership_stream(stream, "crisp", threshold=0.3).writeStream.format("memory").queryName("members")
         .option("checkpointLocation", f"{d}/ckpt").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    rows = {r.case_id: r for r in spark.sql("SELECT * FROM members").collect()}
    assert len(rows) == 10
    assert (rows[7].dissatisfaction, rows[7].policy_demand, rows[7].coproduction_request) == (1, 1, 1)
    assert rows[6].confidence == "high"
