"""Files on disk to verdicts: container walks, metadata, rules, parents, and the invariants of the result."""

import hashlib
import random

import pytest
from filetrail.operators import claims, segments
from filetrail.operators.exif import exposure_text
from filetrail.operators.images import image_evidence
from filetrail.operators.rules import Rule, standard_rules
from filetrail.plans.analyze import analyze
from filetrail.plans.bindings import table
from filetrail.sources.files import scan_files, scan_images
from filetrail.sources.results import lookup_result
from filetrail.streaming.streams import run_available, stream_files
from pyspark.sql import functions as F

import bytes_built as b


def test_jpeg_walk_edges():
    whole = b.jpeg(tail=b"HIDDEN-PAYLOAD-AFTER-EOI")
    rows, trailing, truncated = segments.jpeg_records(whole)
    assert [r[0] for r in rows] == ["FFDB", "FFDB", "FFC0", "FFDA"] and (trailing, truncated) == (24, False)
    assert segments.jpeg_records(whole[:60])[1:] == (0, True)
    assert segments.jpeg_records(b"\xff\xd8\xff")[1:] == (0, True)
    padded = b"\xff\xd8" + b"\xff\xff\xff" + whole[2:]  # fill bytes before a marker
    assert [r[0] for r in segments.jpeg_records(padded)[0]] == ["FFDB", "FFDB", "FFC0", "FFDA"]
    restart = b"\xff\xd8\xff\x01" + whole[2:]  # a marker without a length
    assert segments.jpeg_records(restart)[1] == 24
    assert segments.jpeg_records(b"\xff\xd8" + b.segment(0xFE, b"x") + b"junk\xff\xd9")[1:] == (0, True)


def test_png_walk_edges():
    image = b.png([[(1, 2, 3)] * 4] * 3, b.chunk(b"teSt", b"hello-world"), tail=b"TRAILING")
    rows, trailing, truncated = segments.png_records(image)
    assert [r[0] for r in rows] == ["IHDR", "teSt", "IDAT", "IEND"] and (trailing, truncated) == (8, False)
    assert rows[1][3] == b"hello-world"
    assert segments.png_records(image[:40])[1:] == (0, True)
    assert segments.png_records(b"not a png at all")[1:] == (0, True)


def test_box_walk_edges():
    rows, _, _ = segments.box_records(b.claim_store())
    assert [(r[0], r[4], r[5]) for r in rows] == [
        ("jumb", 0, "c2pa"), ("jumd", 1, "c2pa"), ("jumb", 1, "c2pa.claim"), ("jumd", 2, "c2pa.claim"),
        ("cbor", 2, "c2pa.claim"), ("jumb", 1, "c2pa.more"), ("jumd", 2, "c2pa.more"), ("json", 2, "c2pa.more")]
    to_end = b"\x00\x00\x00\x00json" + b"{}"
    assert segments.box_records(to_end)[0][0][3] == b"{}"
    long_form = b"\x00\x00\x00\x01json" + (18).to_bytes(8, "big") + b"{}" + b.box(b"bfdb", b"z")
    assert [r[3] for r in segments.box_records(long_form)[0]] == [b"{}", b"z"]
    deep = b.box(b"json", b"{}")
    for n in range(20):
        deep = b.superbox(str(n), deep)
    assert max(r[4] for r in segments.box_records(deep)[0]) == 20 and segments.box_records(deep)[0][-1][3] == b"{}"


def test_cbor_items():
    item = claims._cbor_item
    assert item(b.cbor(b.CLAIM), 0)[0] == b.CLAIM
    assert item(b"\x9f\x01\x20\xff", 0)[0] == [1, -1]
    assert item(b"\x7f\x61a\x61b\xff", 0)[0] == "ab"
    assert item(b"\xf5", 0)[0] is True and item(b"\xf6", 0)[0] is None
    assert item(b"\xfb\x3f\xf0\x00\x00\x00\x00\x00\x00", 0)[0] == 1.0
    with pytest.raises((ValueError, IndexError)):
        item(b"\x64ab", 0)


def picture(width, height, seed, left=0.0, top=0.0, wide=1.0, high=1.0):
    """A noisy scene of rectangles sampled at any size; a part of it is a crop."""
    rng = random.Random(seed)
    shapes = [(rng.random(), rng.random(), rng.uniform(.1, .5), rng.uniform(.1, .5), [rng.randrange(200) for _ in range(3)])
              for _ in range(14)]
    noise = random.Random(seed + width)
    rows = []
    for j in range(height):
        y = top + high * (j + .5) / height
        row = []
        for i in range(width):
            x = left + wide * (i + .5) / width
            color = [int(60 * x), int(60 * y), 30]
            for sx, sy, w, h, c in shapes:
                if sx <= x < sx + w and sy <= y < sy + h:
                    color = c
            row.append(tuple(min(255, v + noise.randrange(12)) for v in color))
        rows.append(row)
    return rows


FLAT = [[(255, 255, 255)] * 40] * 30
FILES = [
    ("camera.jpg", b.jpeg(b.segment(0xE1, b"Exif\x00\x00" + b.camera_tiff("<")), width=640, height=480)),
    ("camera_big_endian.jpg", b.jpeg(b.segment(0xE1, b"Exif\x00\x00" + b.camera_tiff(">")))),
    ("long_exposure.jpg", b.jpeg(b.segment(0xE1, b"Exif\x00\x00" + b.camera_tiff(exposure=(2, 1))))),
    ("whole_exposure.jpg", b.jpeg(b.segment(0xE1, b"Exif\x00\x00" + b.camera_tiff(exif=[(0x829A, 3, 1, b"\x01\x00")])))),
    ("sent.jpg", b.jpeg(progressive=True, chroma=range(1, 65))),
    ("reshared.jpg", b.jpeg(
        b.segment(0xE2, b"ICC_PROFILE\x00\x02\x02" + b.icc("Google Inc. 2016")[100:]),
        b.segment(0xE2, b"ICC_PROFILE\x00\x01\x02" + b.icc("Google Inc. 2016")[:100]))),
    ("best_quality.png", b.jpeg(luma=[1] * 64, chroma=[1] * 64)),
    ("signed.jpg", b.jpeg(
        b.segment(0xEB, b"JP\x00\x01\x00\x00\x00\x02" + b.claim_store()[150:]),
        b.segment(0xEB, b"JP\x00\x01\x00\x00\x00\x01" + b.claim_store()[:150]))),
    ("signed.png", b.png(picture(40, 30, 1), b.chunk(b"caBX", b.claim_store()))),
    ("screenshot.png", b.png(FLAT, b.chunk(b"eXIf", b.camera_tiff(software="Android 13", exif=[(0xA420, 2, 9, b.text("image-id"))])))),
    ("report.pdf", b.pdf("ReportLab PDF Library", "tool", False)),
    ("printed.pdf", b.pdf("Skia/PDF m130", "Chromium", True)),
    ("smaller.pdf", b.pdf("iLovePDF", "tool", False)),
    ("scene.png", b.png(picture(80, 60, 5))),
    ("scene_half.png", b.png(picture(40, 30, 5))),
    ("scene_again.png", b.png(picture(80, 60, 5))),
    ("other.png", b.png(picture(80, 60, 77))),
    ("notes.txt", b"plain text"),
]


@pytest.fixture(scope="module")
def analyzed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, data in FILES:
        (folder / name).write_bytes(data)
    order = spark.createDataFrame([(n, name) for n, (name, _) in enumerate(FILES)], "arrival long, filename string")
    files = scan_files(spark, str(folder)).join(order, "filename").withColumn("session_id", F.lit("s"))
    empty = files.limit(1).select("session_id", F.lit(99).cast("long").alias("arrival"), F.lit("empty.jpg").alias("filename"),
                                  F.lit(b"").alias("content"))
    hashes = files.select("path", F.sha2("content", 256).alias("sha256"))
    pixels = image_evidence(scan_images(spark, str(folder)), "path").join(hashes, "path").drop("path").dropDuplicates(["sha256"])
    results, rejects = analyze(
        files.select("session_id", "arrival", "filename", "content").unionByName(empty), pixels)
    return {r.filename: r for r in results.collect()}, {r.filename: r.reason for r in rejects.collect()}


def rules_of(row):
    return [m.name for m in row.pipeline_matches]


def test_rejects(analyzed):
    assert analyzed[1] == {"empty.jpg": "400", "whole_exposure.jpg": "422"}


@pytest.mark.parametrize("name", ["camera.jpg", "camera_big_endian.jpg"])
def test_camera_metadata_in_both_byte_orders(analyzed, name):
    row = analyzed[0][name]
    exif = row.record.exif
    assert row.verdict == "VERIFIED_ORIGIN" and rules_of(row) == ["direct_phone_camera"]
    assert (exif.make, exif.model, exif.exposure_time, exif.fnumber, exif.iso) == ("TECNO", "KL4", "1/25", 1.85, 2042)
    assert (exif.datetime_original, exif.subsec_time, exif.has_thumbnail_ifd) == ("2026:08:12 09:41:03", "123", True)
    assert (exif.gps.latitude, round(exif.gps.longitude, 6)) == (-6.5, 3.41)
    assert exif.raw["ISOSpeedRatings"] == "2042.0" and exif.raw["ImageUniqueID"] == "image-id"
    assert row.pipeline_matches[0].confidence == "high"
    assert row.verdict_statement == (
        "Captured on TECNO KL4. ISO 2042, 1/25, f/1.85 — consistent with a coherent exposure triangle. Thumbnail IFD present.")


def test_long_exposures_print_as_one_over_zero(analyzed):
    assert analyzed[0]["long_exposure.jpg"].record.exif.exposure_time == "1/0"


@pytest.mark.parametrize("name, rule", [
    ("sent.jpg", "whatsapp_transmission"), ("reshared.jpg", "android_camera_reshared"),
    ("best_quality.png", "near_lossless_export"), ("signed.jpg", "openai_generation"), ("signed.png", "openai_generation"),
    ("screenshot.png", "android_screenshot"), ("report.pdf", "reportlab_programmatic_pdf"),
    ("printed.pdf", "browser_print_to_pdf"), ("smaller.pdf", "ilovepdf_compression"),
])
def test_each_signature_is_found(analyzed, name, rule):
    assert rule in rules_of(analyzed[0][name])


def test_signed_files(analyzed):
    for name in ("signed.jpg", "signed.png"):
        row = analyzed[0][name]
        claim = row.record.c2pa
        assert row.verdict == "VERIFIED_ORIGIN" and row.derivation is None
        assert (claim.software_agent, claim.generator) == ("gpt-image", "Image Service")
        assert claim.assertions == ["c2pa", "c2pa.claim", "c2pa.more"] and claim.signature_checked is False
        assert row.verdict_statement == (
            "Cryptographically signed by Image Service. Declared as AI-generated "
            "(http://example.org/trainedAlgorithmicMedia). Signed 2026-08-12.")
        assert row.score.breakdown["valid_c2pa_manifest_present"] == 40 and row.score.value <= row.score.max_value


def test_profiles_and_encoder(analyzed):
    reshared = analyzed[0]["reshared.jpg"].record
    assert (reshared.icc.copyright, reshared.icc.description) == ("Google Inc. 2016", "a profile")
    assert (reshared.width, reshared.height, reshared.encoder.chroma_subsampling) == (64, 48, "4:2:0")
    assert reshared.encoder.quant_table_luma == list(range(1, 65))
    assert analyzed[0]["sent.jpg"].record.encoder.is_progressive


def test_flat_screens_and_declared_formats(analyzed):
    shot = analyzed[0]["screenshot.png"]
    assert "screen_capture" in rules_of(shot) and shot.record.min_flat_region_std == 0.0
    wrong = analyzed[0]["best_quality.png"]
    assert wrong.record.format_mismatch and "no_format_extension_mismatch" not in wrong.score.breakdown
    assert wrong.pipeline_matches[0].basis[-1] == "format/extension mismatch (declared png, actual jpeg)"


def test_printed_pdf_lists_embedded_fonts(analyzed):
    basis = {m.name: m.basis for m in analyzed[0]["printed.pdf"].pipeline_matches}
    assert basis["browser_print_to_pdf"][-1] == "embedded subsetted fonts: ArialMT"
    basis = {m.name: m.basis for m in analyzed[0]["report.pdf"].pipeline_matches}
    assert basis["reportlab_programmatic_pdf"][-1] == "non-embedded base-14 fonts: Helvetica"


def test_derived_files_name_their_parent(analyzed):
    half, again, other = (analyzed[0][n] for n in ("scene_half.png", "scene_again.png", "other.png"))
    assert half.verdict == "DERIVED" and half.derivation.parent_filename == "scene.png"
    assert half.transformations == ["resized 25%"]
    assert again.transformations == ["identical (bit-for-bit)"] and again.derivation.hash_distance == 0
    assert other.verdict == "NO_RECORD" and other.parent_file_id is None
    assert other.verdict_statement == (
        "No chain of custody found for this file. Content credentials are commonly removed by screenshots, "
        "messaging apps, and re-encoding.")


def test_statistics_stay_out_of_scores_and_statements(analyzed):
    for row in analyzed[0].values():
        shown = (row.verdict_statement + " ".join(row.score.breakdown)).lower()
        assert "noise" not in shown and "chromatic" not in shown


def test_unknown_files_pass_through(analyzed):
    row = analyzed[0]["notes.txt"]
    assert row.record.actual_format == "unknown" and row.record.trailing_byte_count == 0 and row.score.value == 15


def test_files_arriving_in_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b.jpeg())
    (tmp_path / "in" / "big.jpg").write_bytes(b.jpeg() + bytes(5000))
    seen = []
    run_available(stream_files(spark, str(tmp_path / "in"), max_bytes=4000),
                  lambda batch, _: seen.extend(r.filename for r in batch.collect()), str(tmp_path / "cp"))
    assert sorted(seen) == ["a.jpg", "big.jpg"]


def test_exposure_rounding_is_half_to_even(spark):
    values = [0.04, 0.4, 2.0, 1.0, 0.0, 1 / 3.5, 1 / 2.5, None]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(
        exposure_text(F.col("v")).alias("t")).collect()]
    assert got == [None if not v else f"1/{round(1 / v)}" for v in values]


def test_results_read_back_by_key(spark):
    rows = table(spark, "/root/testdata/sf0.001", "labels").select(
        F.lit("s").alias("session_id"), F.col("doc_id").cast("string").alias("file_id"))
    assert lookup_result(rows, "s", "none").count() == 0


def rows_of(spark, *named):
    return spark.createDataFrame(
        [("s", n, name, bytearray(data)) for n, (name, data) in enumerate(named)],
        "session_id string, arrival long, filename string, content binary")


def test_without_matching_nothing_is_derived_and_rules_can_be_added(spark):
    files = rows_of(spark, ("a.jpg", b.jpeg()), ("b.jpg", b.jpeg()))
    wide = Rule("wide_frame", F.col("width") > 60, F.lit("low"), [F.concat(F.lit("width "), F.col("width").cast("string"))])
    results, rejects = analyze(files, match=False, rules=[*standard_rules(), wide])
    rows = results.collect()
    assert [r.verdict for r in rows] == ["NO_RECORD"] * 2 and rejects.count() == 0
    assert [(m.name, m.basis) for m in rows[0].pipeline_matches] == [("wide_frame", ["width 64"])]


def test_local_features_and_exact_copies(spark):
    rng = random.Random(8)
    points = [rng.getrandbits(256).to_bytes(32, "big") for _ in range(60)]
    first, second = b.jpeg(width=640, height=480), b.jpeg(width=300, height=400)
    document = b.pdf("tool", "tool", False)
    files = rows_of(spark, ("first.jpg", first), ("paper.pdf", document), ("second.jpg", second), ("again.pdf", document))
    features = spark.createDataFrame([
        (hashlib.sha256(first).hexdigest(), bytearray(b"".join(points))),
        (hashlib.sha256(second).hexdigest(), bytearray(b"".join(points[:30])))], "sha256 string, blob binary")
    plain, _ = analyze(files, features=features)
    found = {r.filename: r for r in plain.collect()}
    row = found["second.jpg"]
    assert (row.derivation.parent_filename, row.derivation.hash_type, row.derivation.hash_distance) == ("first.jpg", "orb_features", 30)
    assert row.transformations == ["cropped"] and row.record.orb_descriptor_count == 30
    assert row.verdict_statement == (
        "Matches 'first.jpg' uploaded earlier this session (cropped; 30 matching local features (ORB)).")
    assert found["again.pdf"].verdict == "NO_RECORD"  # no fingerprint, so no match by default
    exact, _ = analyze(files, match_exact=True)
    again = {r.filename: r for r in exact.collect()}["again.pdf"]
    assert again.verdict == "DERIVED" and again.transformations == ["identical (bit-for-bit)"]
