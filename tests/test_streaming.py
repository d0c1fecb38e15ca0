from __future__ import annotations

from tessitura.operators.corpus import speaker_amount
from tessitura.streaming.amounts import speaker_amounts, windowed_amounts


def test_stream_equals_batch(spark, tmp_path):
    utts = spark.createDataFrame([(f"s{i % 3}", float(i), f"2024-01-01 {i % 5:02}:30:00") for i in range(30)], "spk string, duration double, ts string")
    for k in range(3):
        utts.where(f"cast(duration as int) % 3 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(utts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("amounts", speaker_amounts(stream)), ("windows", windowed_amounts(stream, lateness="1 day"))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    want = {r.spk: r.amount for r in speaker_amount(utts).collect()}
    assert {r.spk: r.amount for r in spark.table("amounts").collect()} == want
    assert spark.table("windows").count() == 15 and sum(r.amount for r in spark.table("windows").collect()) == sum(want.values())
