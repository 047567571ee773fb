import random

from chronotext.operators import sequences
from chronotext.streaming import cues


def run_stream(spark, tmp_path, rows, schema, op, name, batches=4):
    """Feed the rows in order, some a file, one file a micro-batch."""
    src = tmp_path / "in"
    size = -(-len(rows) // batches)
    for n in range(batches):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{src}/b{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    query = op(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    r = random.Random(2)
    seg = [(f"v{i % 3}", i, float(i), r.choice("ab")) for i in range(60)]
    schema = "video_id string, seq int, t double, text string"
    got = run_stream(spark, tmp_path / "a", seg, schema, cues.drop_repeats_stream, "kept_cues")
    want = sequences.drop_repeats(spark.createDataFrame(seg, schema))
    assert sorted((x["video_id"], x["seq"]) for x in got.collect()) == sorted((x["video_id"], x["seq"]) for x in want.collect())

    far = [0, (1 << 17) - 1, ((1 << 17) - 1) << 20, -1]
    frames = [(f"v{i % 2}", i, r.choice(far)) for i in range(80)]
    schema = "video_id string, idx int, phash long"
    got = run_stream(spark, tmp_path / "b", frames, schema, cues.keyframes_stream, "kept_frames")
    want = sequences.select_keyframes(spark.createDataFrame(frames, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
