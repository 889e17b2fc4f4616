"""Damaged and hostile files: the plan reads what it can and never fails."""

import random

import bytes_built as b
from filetrail.operators import pdf, segments
from filetrail.plans.analyze import analyze
from filetrail.sources.files import scan_files, split_rejects
from pyspark.sql import functions as F

MUTATIONS = 600


def test_mutated_files_go_through_the_plan(spark):
    app1 = b.segment(0xE1, b"Exif\x00\x00" + b.camera_tiff("<"))
    app2 = b.segment(0xE2, b"ICC_PROFILE\x00\x01\x01" + b.icc("(c) someone"))
    big = b.segment(0xE1, b"Exif\x00\x00" + b.camera_tiff(">"))
    sources = [
        ("a.jpg", b.jpeg(app1, app2, tail=b"more")), ("b.jpg", b.jpeg(big, width=9)),
        ("c.png", b.png([[(1, 2, 3)] * 4] * 4, b.chunk(b"eXIf", b.camera_tiff("<")), b.chunk(b"caBX", b.claim_store()))),
        ("d.pdf", b.pdf("Maker", "tool", True)),
    ]
    rng = random.Random(11)
    rows = []
    for n in range(MUTATIONS):
        name, data = rng.choice(sources)
        data = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            change = rng.choice([b"\x00\x00\x00\x00", b"\x80\x00\x00\x00", b"\xff\xff\xff\xff", bytes([rng.randrange(256)])])
            data[at:at + len(change)] = change
        if rng.random() < 0.2:
            del data[rng.randrange(len(data)):]
        rows.append(("s", n, name, data))
    files = spark.createDataFrame(rows, "session_id string, arrival long, filename string, content binary").repartition(8)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    results, rejects = analyze(files)
    seen = {r.arrival for r in results.select("arrival").collect()} | {r.arrival for r in rejects.select("arrival").collect()}
    assert seen == set(range(MUTATIONS))


def test_pdf_strings():
    body = lambda s: f"<< /Producer {s} /Creator (c) >>"
    read = lambda s: pdf.pdf_string(body(s), "Producer")
    assert read("(a (b (c)) d)") == "a (b (c)) d"
    assert read(r"(a\) \( \\ \101\n)") == "a) ( \\ A\n"
    assert read("<FEFF00530065>") == "Se" and read("<48 65 6>") == "He`"
    assert read("(\xfe\xff\x00S\x00k)") == "Sk" and read("(\xef\xbb\xbf\xc3\xa9)") == "é"
    assert read("()") is None and read("<< /Length 3 >>") is None and read("8 0 R") is None
    assert pdf.pdf_string("<< /Producer (never ends", "Producer") is None
    for long in ("x" * 2**20, "\\(" * 2**19, "()" * 2**19):
        assert len(read(f"({long})")) >= 2**19


def test_inflating_is_bounded(spark):
    import zlib

    bomb = zlib.compress(bytes(segments.MAX_INFLATED + 1))
    rows = [(bytearray(zlib.compress(b"profile")),), (bytearray(bomb),), (bytearray(b"no"),), (bytearray(zlib.compress(b"cut")[:-2]),), (None,)]
    got = spark.createDataFrame(rows, "packed binary").coalesce(1).select(segments.inflate(F.col("packed")).alias("p")).collect()
    assert [None if r.p is None else bytes(r.p) for r in got] == [b"profile", None, None, None, None]


def test_boxes_nest_to_any_depth():
    deep = b.box(b"json", b"{}")
    for _ in range(3000):
        deep = b.box(b"jumb", deep)
    rows, _, _ = segments.box_records(deep)
    assert rows[-1][0] == "json" and rows[-1][4] == 3000


def test_large_files_are_rejected_not_lost(spark, tmp_path):
    (tmp_path / "small.jpg").write_bytes(b.jpeg())
    (tmp_path / "large.jpg").write_bytes(b.jpeg() + bytes(5000))
    files = scan_files(spark, str(tmp_path), max_bytes=4000).withColumns({
        "session_id": F.lit("s"), "arrival": F.when(F.col("filename") == "small.jpg", 0).otherwise(1).cast("long")})
    good, bad = split_rejects(files, F.col("length"), 4000)
    assert [r.filename for r in good.collect()] == ["small.jpg"]
    assert [(r.filename, r.reason, r.content) for r in bad.collect()] == [("large.jpg", "413", None)]
