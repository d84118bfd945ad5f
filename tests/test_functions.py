from pyspark.sql import functions as F

from galley.functions import text
from galley.streaming import ingest


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string" if not isinstance(values[0], bytearray) else "x binary")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, text.tidy, "a  b \n c\n\n\n\nd", None) == ["a b\nc\n\nd", None]
    assert one(spark, text.clean_metadata, " ;A. Cook|& ", "") == ["A. Cook", ""]
    assert one(spark, text.heading_like, "Roast Chicken", "mix it well.", "METHOD", "add the salt", "") == [True, False, True, False, False]
    assert one(spark, text.content_type, bytearray(b"\xff\xd8\xff\xe0"), bytearray(b"RIFF1234WEBP"), bytearray(b"")) == ["image/jpeg", "image/webp", "application/octet-stream"]


def test_stream_hands_each_file_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.EPUB").write_bytes(b"one")
    (folder / "b.txt").write_bytes(b"no")
    each = lambda df, _: seen.extend(r[0] for r in df.select("format").collect())
    for _ in range(2):
        ingest.watch(spark, str(folder), str(tmp_path / "state"), each).awaitTermination(60)
    assert seen == ["epub"]
