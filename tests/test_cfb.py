import re
import struct

from bytequarry.operators import cfb
from bytequarry.operators.cfb_edit import _rewritten
from bytequarry.operators.walks import _sector_table

FREE, END = -1, -2


def entry(name, kind, left=-1, right=-1, child=-1, start=END, size=0):
    text = name.encode("utf-16le")
    return text.ljust(64, b"\0") + struct.pack("<HBBiii16sIQQiII", len(text) + 2 if name else 0, kind, 1, left, right, child, bytes(16), 0, 5, 7, start, size, 0)


def document(big, small, first_mini=3, difat=()):
    """Sectors: 0 table, 1 and 2 directory, 3 small sectors' table, 4 small sectors, 15 down to 5 the large stream."""
    fat = [-3, 2, END, END, END, END, *range(5, 15)]
    fat += [FREE] * (128 - len(fat))
    mini = [2, END, 1] + [FREE] * 125
    head = struct.pack("<8s16sHHHHH6sIIIIIIIII", bytes.fromhex("D0CF11E0A1B11AE1"), bytes(16), 62, 3, 0xFFFE, 9, 6, bytes(6), 0, 1, 1, 0, 4096, first_mini, 1, 0xFFFFFFFE, 0)
    table = (struct.pack("<i", 0) + struct.pack("<i", FREE) * 108)[:436]
    entries = entry("Root Entry", 5, child=1, start=4, size=192) + entry("Dir", 1, left=2, child=3) + entry("small", 2, start=0, size=len(small)) + entry("Große", 2, right=4, start=15, size=len(big))
    entries += entry("none", 2) + entry("", 0) * 3
    padded = big.ljust(11 * 512, b"\xee")
    blocks = [padded[i : i + 512] for i in range(0, len(padded), 512)]
    small = small.ljust(192, b"\xdd")
    mini_data = small[:64] + small[128:192] + small[64:128]
    return head + table + struct.pack("<128i", *fat) + entries[:1024] + struct.pack("<128i", *mini) + mini_data.ljust(512, b"\0") + b"".join(reversed(blocks))


def test_documents(spark):
    big, small = bytes(i * 7 % 251 for i in range(5555)), bytes(range(170))
    image = document(big, small)
    rows = [("d", image), ("cut", image[:700]), ("head", image[:60]), ("none", document(big, small, 0xFFFFFFFE)), ("x", b"zz"), ("e", b""), ("n", None)]
    df = spark.createDataFrame([(a, None if b is None else bytearray(b)) for a, b in rows], "image_id string, content binary")
    h = {r.image_id: r for r in cfb.cfb_header(df).collect()}
    assert set(h) == {"d", "cut", "head", "none"} and (h["d"].sector_size, h["d"].mini_size, h["d"].mini_cutoff) == (512, 64, 4096)
    e = sorted(cfb.cfb_entries(df.where("image_id = 'd'")).collect(), key=lambda r: r.idx)
    assert [(r.name, r.type, r.visit) for r in e[:5]] == [("Root Entry", "RootStorage", 0), ("Dir", "UserStorage", 1), ("small", "UserStream", 2), ("Große", "UserStream", 3), ("none", "UserStream", 4)]
    assert e[3].path == ["Root Entry", "Dir", "Große"] and e[2].path == ["Root Entry", "small"] and e[5].path is None and len(e) == 8
    s = {(r.image_id, r.name): bytes(r.data) for r in cfb.cfb_streams(df).collect()}
    assert s["d", "Große"] == big and s["d", "small"] == small and s["d", "none"] == b""
    assert s["none", "Große"] == big and s["none", "small"] == b"" and not [k for k in s if k[0] in ("cut", "head", "x", "e", "n")]
    assert cfb.cfb_find(df, "none").select("image_id", "idx").orderBy("image_id").collect() == [("d", 4), ("none", 4)]
    links = {(r.mini, r.id): r.next for r in cfb.cfb_fat(df.where("image_id = 'd'")).collect()}
    assert links[False, 15] == 14 and links[False, 5] == END and links[True, 0] == 2 and len(links) == 256


def test_cycle_ends(spark):
    image = bytearray(document(b"a" * 5000, b"b"))
    struct.pack_into("<i", image, 512 + 4 * 14, 15)
    df = spark.createDataFrame([("c", image)], "image_id string, content binary")
    data = {r.name: bytes(r.data) for r in cfb.cfb_streams(df).collect()}
    assert data["Große"] == b"a" * 1024


def test_empty_table(spark):
    df = spark.createDataFrame([], "image_id string, content binary")
    assert cfb.cfb_entries(df).count() == cfb.cfb_streams(df).count() == 0


def test_write(spark):
    """Streams grow, shrink and move between both kinds of sectors; everything else stays as it was."""
    big, small = bytes(i * 7 % 251 for i in range(5555)), bytes(range(170))
    image = document(big, small)
    df = spark.createDataFrame([("d", bytearray(image)), ("same", bytearray(image)), ("x", bytearray(b"zz")), ("n", None)], "image_id string, content binary")
    schema = "image_id string, name string, data binary"
    for new_small, new_big, new_none in ((b"", b"q" * 100, bytes(range(256)) * 40), (b"y" * 9000, big + big, b"z"), (small[:65], b"", b"k" * 300_000), (bytes(4095), bytes(4096), b"w" * 64)):
        updates = spark.createDataFrame([("d", "small", bytearray(new_small)), ("d", "Große", bytearray(new_big)), ("d", "none", bytearray(new_none)), ("d", "absent", bytearray(b"1")), ("x", "small", bytearray(b"1")), ("d", None, None)], schema)
        out = cfb.cfb_write(df, updates).persist()
        content = {r.image_id: None if r.content is None else bytes(r.content) for r in out.collect()}
        assert content["same"] == image and content["x"] == b"zz" and content["n"] is None and len(content["d"]) % 512 == 0
        got = {(r.image_id, r.name): bytes(r.data) for r in cfb.cfb_streams(out).collect()}
        assert (got["d", "small"], got["d", "Große"], got["d", "none"]) == (new_small, new_big, new_none) and got["same", "small"] == small
        fat = {r.id: r.next for r in cfb.cfb_fat(out.where("image_id = 'd'")).where("not mini").collect()}
        used = [x for x in fat.values() if x >= 0]
        assert len(used) == len(set(used))  # no sector has two leaders
        again = cfb.cfb_write(out, spark.createDataFrame([("d", "small", bytearray(small)), ("d", "Große", bytearray(big)), ("d", "none", None)], schema))
        assert {r.name: bytes(r.data) for r in cfb.cfb_streams(again).where("image_id = 'd'").collect()} == {"small": small, "Große": big, "none": b""}
        changed = {r.sector for r in cfb.cfb_changed_sectors(df, out).collect()}
        a, b = image, content["d"]
        assert changed == {i - 1 for i in range(len(b) // 512) if a[512 * i : 512 * i + 512] != b[512 * i : 512 * i + 512]}
        out.unpersist()


def test_workers_get_tables_not_contents(spark):
    """A batch holds thousands of images: what Python gets of each must be far smaller than the image."""
    df = spark.createDataFrame([("d", bytearray(document(b"a" * 5000, b"b")))], "image_id string, content binary")
    for out, most in ((cfb.cfb_streams(df), 2), (cfb.cfb_entries(df), 2)):
        calls = re.findall(r"ArrowEvalPython \[(.*?)\)#", out._jdf.queryExecution().optimizedPlan().toString())
        assert 0 < len(calls) <= most and not any("content#" in x for x in calls)


def test_directory_walk_gets_links_not_names(spark):
    """Paths come back as ids of entries, so that a batch of thousands of directories has no name in the workers."""
    df = spark.createDataFrame([("d", bytearray(document(b"a" * 5000, b"b")))], "image_id string, content binary")
    out = cfb.cfb_entries(df)
    calls = re.findall(r"ArrowEvalPython \[(_directory_order.*?)\)#", out._jdf.queryExecution().optimizedPlan().toString())
    assert len(calls) == 1 and ".child" in calls[0] and ".name" not in calls[0]
    assert [r.path for r in out.orderBy("idx").collect()][:4] == [["Root Entry"], ["Root Entry", "Dir"], ["Root Entry", "small"], ["Root Entry", "Dir", "Große"]]


def test_table_beyond_the_header(spark):
    """The 109 ids in the header list 7 MB; the others are in a chain of sectors, which may be cut or run in a circle."""
    data = bytes(i * 11 % 253 for i in range(253)) * 40_000
    image = _rewritten(document(b"x" * 5000, b"y"), [{"name": "none", "data": data}])
    first, count = struct.unpack_from("<II", image, 68)
    circle, cut = bytearray(image), image[: (first + 1) * 512]
    struct.pack_into("<I", circle, (first + 2) * 512 - 4, first)
    struct.pack_into("<I", circle, 72, 5)
    df = spark.createDataFrame([("d", bytearray(image)), ("circle", circle), ("cut", bytearray(cut))], "image_id string, content binary")
    assert count == 1
    got = {r.image_id: r.difat for r in cfb._tables(df).select("image_id", "difat").collect()}
    assert got == {k: _sector_table(bytes(v), 512, first, n) for k, v, n in (("d", image, 1), ("circle", circle, 5), ("cut", cut, 1))} and len(got["d"]) > 109
    streams = {(r.image_id, r.name): bytes(r.data) for r in cfb.cfb_streams(df).collect()}
    assert streams["d", "none"] == streams["circle", "none"] == data and streams["d", "small"] == b"y"


def test_writing_holds_one_document(spark):
    """Documents reach the workers by groups of one id, not thousands in a batch; equal ids and null ids stay rows of their own."""
    image = document(b"a" * 5000, b"b")
    df = spark.createDataFrame([("d", bytearray(image)), ("d", bytearray(image)), (None, bytearray(image)), (None, None)], "image_id string, content binary")
    out = cfb.cfb_write(df, spark.createDataFrame([("d", "small", bytearray(b"new"))], "image_id string, name string, data binary"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "ArrowEvalPython" not in plan
    new = _rewritten(image, [{"name": "small", "data": b"new"}])
    assert sorted((r.image_id or "", bytes(r.content or b"")) for r in out.collect()) == sorted([("d", new), ("d", new), ("", image), ("", b"")])
