import hashlib
import tarfile
import zlib

from pyspark.sql import functions as F

from bytequarry.llm.media import ROW, from_png, media_metadata, png_header, read_media, store_texts, to_png


def padded(text):
    b = (text or "").encode()
    return b + b" " * (-len(b) % ROW if b else ROW)


def test_round_trip(spark):
    texts = ["", None, "a" * ROW, "b" * (ROW + 1), "été\x00", "x" * 100_000, "same", "same", " "]
    rows = [(i, t, "d") for i, t in enumerate(texts)] + [(None, "same", "d"), (6, "same", "d")]
    catalog, folder = store_texts(spark.createDataFrame(rows, "doc_id long, text string, digest string"))
    assert catalog.count() == len(rows)
    back = catalog.join(read_media(catalog, folder), "digest").join(media_metadata(catalog, folder), "digest").collect()
    assert len(back) == len(rows)
    for r in back:
        p = padded("same" if r.doc_id is None else texts[r.doc_id])
        assert r.payload_bytes == len(p) and r.payload_sha256 == hashlib.sha256(p).hexdigest() == bytes(r.digest).hex()
        assert r.tail_crc32 == zlib.crc32(p[-16:]) and (r.width, r.height, r.depth) == (ROW, len(p) // ROW, 8)
        with tarfile.open(f"{folder.removeprefix('file://')}/{r.shard}") as t:
            member = t.getmember(f"{bytes(r.digest).hex()}.png")
            assert (member.offset_data, member.size) == (r.offset, r.length) and from_png(t.extractfile(member).read()) == p
    assert catalog.groupBy("digest").agg(F.countDistinct("shard", "offset").alias("n")).where("n > 1").isEmpty()


def test_png_and_empty(spark):
    assert png_header(to_png(b"q" * ROW)[:33]) == (ROW, 1, 8)
    catalog, folder = store_texts(spark.createDataFrame([], "doc_id long, text string"))
    assert read_media(catalog, folder).collect() == []
