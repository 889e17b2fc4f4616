"""The whole plan: files in, evidence, rules, parents, verdicts, scores and the graph out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.functions.fingerprints import content_sha256, file_id, hash_bits
from filetrail.functions.formats import declared_format, format_mismatch, sniff_format
from filetrail.functions.truth import holds
from filetrail.operators.evidence import evidence_of
from filetrail.operators.matching import attach_parent, best_match
from filetrail.operators.ordered import exclusive_prefix
from filetrail.operators.pdf import pdf_parts, pdf_strings
from filetrail.operators.rules import Rule, classify, coherent_camera, near_lossless
from filetrail.operators.segments import FRAMES, nest_chained
from filetrail.operators.verdicts import STATISTICS_NOTE, detect_transformations, trace_score, verdict, verdict_statement
from filetrail.session import stage
from filetrail.sources.files import reject_reason

# Record types whose payload carries evidence; pixels stay out of the evidence rows.
EVIDENCE_RECORDS = [*FRAMES, "FFDB", "FFE1", "FFE2", "FFEB", "IHDR", "eXIf", "iCCP", "sRGB", "caBX"]
# Values of files a walker does not apply to.
DEFAULTS = {
    "exif_present": False, "exif_gps": False, "exif_thumbnail": False, "exif_invalid": False, "icc_present": False,
    "c2pa_present": False, "quant_identical": False, "progressive": False, "trailing_bytes": 0,
}


def identify(files: DataFrame) -> DataFrame:
    """Content hash, file id, formats and size; the bytes stay beside them."""
    actual, declared = sniff_format(F.col("content")), declared_format(F.col("filename"))
    return files.select(
        *[c for c in files.columns if c != "length"],
        F.coalesce(F.octet_length("content").cast("bigint"), *([F.col("length")] if "length" in files.columns else [])).alias("file_size"),
        content_sha256(F.col("content")).alias("sha256"),
        file_id(content_sha256(F.col("content"))).alias("file_id"),
        actual.alias("actual_format"), declared.alias("declared_format"),
        format_mismatch(actual, declared).alias("format_mismatch"),
    )


def dispatch_evidence(files: DataFrame, keys: list[str], once: list[str] = ()) -> DataFrame:
    """Container evidence per file (keys, actual_format, content), with the `once` columns passed through.

    The bytes are read in one pass and nothing is shuffled: PDF information is extracted inside the JVM, only JPEG and PNG bytes go to
    the walker, which picks the container by magic bytes, and a file's records stay in its row, where array functions read them.
    """
    walked = files.select(
        *keys, *once, "actual_format",
        F.when(F.col("actual_format") == "pdf", pdf_parts(F.col("content"))).alias("pdf"),
        F.when(F.col("actual_format").isin("jpeg", "png"), F.col("content")).alias("bytes"),
    )
    nested = nest_chained(walked, keys, "bytes", "any", EVIDENCE_RECORDS, once=[*once, "actual_format", "pdf"])
    evidence = evidence_of(nested.withColumn("strings", pdf_strings(F.col("pdf.info"))).select(
        *keys, *once, "actual_format", F.col("trailing").alias("trailing_bytes"), "truncated",
        F.col("strings.producer").alias("pdf_producer"), F.col("strings.creator").alias("pdf_creator"),
        F.col("pdf.fonts").alias("pdf_fonts"), "records"))
    return evidence.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}).withColumn(
        "quant_all_le1", near_lossless(F.col("quant_luma"), F.col("quant_chroma"))
    )


def assemble_record(df: DataFrame) -> Column:
    """The nested file record out of the flat evidence columns."""
    def group(prefix: str, names: dict[str, str]) -> Column:
        return F.struct(*[F.col(c).alias(n) for n, c in names.items()]).alias(prefix)

    return F.struct(
        "sha256", "declared_format", "actual_format", "format_mismatch", "file_size", "width", "height",
        group("c2pa", {
            "present": "c2pa_present", "software_agent": "c2pa_agent", "digital_source_type": "c2pa_source",
            "generator": "c2pa_generator", "timestamp": "c2pa_when", "claim_generator": "c2pa_claim_generator",
            "assertions": "assertions", "signature_checked": "signature_checked",
        }),
        group("exif", {
            "present": "exif_present", "make": "exif_make", "model": "exif_model", "software": "exif_software",
            "datetime_original": "exif_datetime", "exposure_time": "exposure_text", "fnumber": "exif_fnumber",
            "iso": "exif_iso", "has_gps_ifd": "exif_gps", "has_thumbnail_ifd": "exif_thumbnail",
            "subsec_time": "exif_subsec", "gps": "exif_position", "raw": "exif_raw",
        }),
        group("icc", {"present": "icc_present", "description": "icc_description", "copyright": "icc_copyright"}),
        group("encoder", {
            "quant_table_luma": "quant_luma", "quant_table_chroma": "quant_chroma",
            "quant_tables_identical": "quant_identical", "is_progressive": "progressive",
            "chroma_subsampling": "chroma_subsampling",
        }),
        F.col("trailing_bytes").alias("trailing_byte_count"),
        F.col("min_flat_std").alias("min_flat_region_std"),
        "pipeline_matches", "phash", "dhash", "ahash", "whash", "orb_descriptor_count",
        F.struct(
            "mean_residual_noise", "chromatic_aberration_px", F.lit(STATISTICS_NOTE).alias("note")
        ).alias("stats"),
    )


def observations() -> Column:
    return F.struct(
        F.col("pipeline_matches").alias("pipeline_inference"),
        F.coalesce("transformations", F.array().cast("array<string>")).alias("transformations_detected"),
        "format_mismatch",
        F.struct("c2pa_present", "exif_present", "icc_present").alias("embedded_credentials"),
    )


def derivation() -> Column:
    return F.when(
        F.col("parent_sha256").isNotNull() & (F.col("verdict") == "DERIVED"),
        F.struct(
            "parent_sha256", F.col("parent_filename").alias("parent_filename"),
            F.col("transformations").alias("transformations_detected"),
            F.col("metric").alias("hash_distance"), F.col("match_type").alias("hash_type"),
        ),
    )


_RECORD_STRINGS = [
    "phash", "dhash", "ahash", "whash",
]


def same_bytes(uploads: DataFrame) -> DataFrame:
    """For asking uploads the latest earlier upload of the session with the same sha256, as matches at distance 0."""
    lean = uploads.select("session_id", "arrival", "file_id", "sha256", "asks")
    seen = exclusive_prefix(
        lean, ["session_id", "sha256"], [F.col("arrival")], F.col("arrival"), "parent_order")
    return seen.filter(F.col("asks") & F.col("parent_order").isNotNull()).select(
        "session_id", "arrival", F.col("file_id").alias("parent_file_id"), "parent_order", F.lit(0).alias("metric"),
        F.lit("sha256").alias("match_type"))


def analyze(
    files: DataFrame, pixels: DataFrame | None = None, features: DataFrame | None = None, match: bool = True,
    rules: list[Rule] | None = None, match_exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) for files (session_id, arrival, filename, content).

    `pixels` holds pixel evidence per sha256 (from `image_evidence`), `features` descriptor blobs per sha256; both have
    one row per content. The bytes of a file are read once and never shuffled. `match_exact` also derives byte-identical files that have no fingerprint (PDFs).
    """
    keys = ["session_id", "arrival"]
    identified = identify(files).withColumn("reason", reject_reason(F.col("file_size")))
    bad = F.col("reason").isNotNull()
    # Rejected files pass through without their bytes being looked at.
    readable = identified.withColumn("actual_format", F.when(bad, "unknown").otherwise(F.col("actual_format")))
    once = [c for c in readable.columns if c not in (*keys, "content", "actual_format")]
    evidence = stage(dispatch_evidence(readable, keys, once), "evidence")
    if pixels is None:
        none = [F.lit(None).cast("string").alias(c) for c in _RECORD_STRINGS]
        pixels = evidence.select(
            "sha256", *none, F.lit(None).cast("int").alias("decoded_width"), F.lit(None).cast("int").alias("decoded_height"),
            *[F.lit(None).cast("double").alias(c) for c in ("min_flat_std", "mean_residual_noise", "chromatic_aberration_px")],
        ).limit(0)
    else:
        pixels = pixels.withColumnsRenamed({"width": "decoded_width", "height": "decoded_height"})
    counts = None
    if features is not None:
        counts = features.select("sha256", F.floor(F.octet_length("blob") / 32).cast("int").alias("orb_descriptor_count"))
    facts = evidence.join(pixels, "sha256", "left")
    facts = facts.join(counts, "sha256", "left") if counts is not None else facts.withColumn(
        "orb_descriptor_count", F.lit(None).cast("int"))
    facts = facts.withColumns({
        "width": F.coalesce("width", "decoded_width"), "height": F.coalesce("height", "decoded_height"),
        "reason": F.coalesce("reason", F.when(F.col("exif_invalid"), "422")),
    }).drop("decoded_width", "decoded_height")
    classified = stage(facts.withColumn("pipeline_matches", classify(rules)), "classified")
    rejects = classified.filter("reason is not null").select("session_id", "arrival", "filename", "file_id", "reason")
    good = classified.filter("reason is null")
    if match:
        # Verified files never search, but every good file is a candidate.
        searching = good.withColumns({
            "p": hash_bits(F.col("phash")), "d": hash_bits(F.col("dhash")),
            "asks": ~(holds(F.col("c2pa_present")) | coherent_camera()),
        }).select("session_id", "arrival", "file_id", "sha256", F.col("p").alias("phash"), F.col("d").alias("dhash"), "asks")
        hashes = ["phash", "dhash"]
        blobs = None
        if features is not None:
            blobs = good.select("session_id", "file_id", "sha256").distinct().join(features, "sha256").select(
                "session_id", "file_id", "blob")
        matches = best_match(searching, hashes, searching="asks", features=blobs)
        if match_exact:
            exact = same_bytes(searching.filter("phash is null and dhash is null"))
            matches = matches.unionByName(exact.join(matches, ["session_id", "arrival"], "left_anti"))
    else:
        matches = good.select(
            "session_id", "arrival", F.lit(None).cast("string").alias("parent_file_id"),
            F.lit(None).cast("bigint").alias("parent_order"), F.lit(None).cast("int").alias("metric"),
            F.lit(None).cast("string").alias("match_type"),
        ).limit(0)
    rows = attach_parent(good, matches, ["filename", "sha256", "width", "height"])
    hits = F.transform("pipeline_matches", lambda m: m["name"])
    transformations = F.when(F.col("parent_file_id").isNotNull(), detect_transformations(
        F.col("sha256"), F.col("parent_sha256"), F.col("width"), F.col("height"), F.col("parent_width"),
        F.col("parent_height"), F.array_contains(hits, "whatsapp_transmission"),
        F.array_contains(hits, "android_screenshot") | F.array_contains(hits, "screen_capture"),
    ))
    matched = F.col("parent_file_id").isNotNull()
    judged = rows.withColumn("transformations", transformations).withColumns({
        "verdict": verdict(matched),
        "verdict_statement": verdict_statement(
            matched, F.col("parent_filename"), F.col("transformations"), F.col("metric"), F.col("match_type")),
        "score": trace_score(),
    })
    results = judged.select(
        "session_id", "file_id", "arrival", "filename", "sha256", "phash", "dhash", "ahash", "whash", "width", "height",
        "verdict", "verdict_statement", F.col("score.value").alias("trace_score"), F.col("score").alias("score"),
        "pipeline_matches", "parent_file_id", "transformations", assemble_record(judged).alias("record"),
        derivation().alias("derivation"), observations().alias("observations"),
    )
    return results, rejects
