from fixtures_images import ar, elf

from bytequarry.operators.ar import ar_members
from bytequarry.sources.images import read_images, sniff, write_images
from bytequarry.streaming.ingest import arriving_formats


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.a", ar([("x.o/", b"12")])), ("b.o", elf()), ("c.txt", b"hello")):
        (tmp_path / "in" / name).write_bytes(data)
    images = read_images(spark, str(tmp_path / "in"))
    assert sorted((r.image_id[-5:], r.format) for r in sniff(images).collect()) == [("/a.a", "ar")[:2]] * 0 + sorted([(p[-5:], f) for p, f in ((f"{tmp_path}/in/a.a", "ar"), (f"{tmp_path}/in/b.o", "elf"), (f"{tmp_path}/in/c.txt", None))])
    assert [r["name"] for r in ar_members(images).collect()] == ["x.o"]
    assert read_images(spark, str(tmp_path / "in"), most=6).count() == 1
    write_images(images, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = arriving_formats(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("formats").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {r.format: r.images for r in spark.sql("select * from formats").collect()} == {"ar": 1, "elf": 1, None: 1}
    finally:
        q.stop()
