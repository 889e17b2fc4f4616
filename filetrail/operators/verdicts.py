"""Transformations, verdicts, scores and the assembled record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filetrail.functions.truth import filled, first_filled, holds
from filetrail.operators.rules import coherent_camera

# Statement texts, score parts and label bounds.
NO_RECORD_TEXT = (
    "No chain of custody found for this file. Content credentials are commonly removed by screenshots, "
    "messaging apps, and re-encoding."
)
SCORE_PARTS = [
    ("valid_c2pa_manifest_present", 40),
    ("full_camera_exif_coherent_exposure_triangle", 25),
    ("thumbnail_ifd_present", 10),
    ("icc_profile_known_vendor_pipeline", 10),
    ("no_format_extension_mismatch", 10),
    ("no_trailing_bytes_after_eoi", 5),
]
MAX_SCORE = 100
SCORE_LABELS = [
    (1, "no verifiable provenance data survives in this file."),
    (30, "most provenance data has been stripped from this file."),
    (70, "partial provenance history survives."),
    (None, "strong verifiable history survives."),
]
STATISTICS_NOTE = (
    "Pixel statistics are logged for transparency only. They do not drive any verdict or score."
)


def texts(*parts: Column) -> Column:
    """array<string> of the parts that are not NULL."""
    return F.array_compact(F.array(*parts))


def detect_transformations(
    sha: Column, parent_sha: Column, width: Column, height: Column, parent_width: Column, parent_height: Column,
    over_messenger: Column, screenshot: Column,
) -> Column:
    """array<string>: what happened between a matched parent and this file. All sizes in pixels."""
    known = holds((width != 0) & (height != 0) & (parent_width != 0) & (parent_height != 0))
    ratio = F.when(known, (width.cast("double") * height) / (parent_width.cast("double") * parent_height))
    reshaped = F.abs(width / height - parent_width / parent_height) > 0.03
    percent = F.bround(ratio * 100, 0).cast("bigint").cast("string")
    sizing = (
        F.when((ratio < 0.98) & reshaped, "cropped")
        .when(ratio < 0.98, F.concat(F.lit("resized "), percent, F.lit("%")))
        .when(ratio > 1.02, F.concat(F.lit("upscaled "), percent, F.lit("%")))
    )
    seen = texts(
        F.when(known, sizing),
        F.when(holds(over_messenger), "WhatsApp (1 hop)"),
        F.when(holds(screenshot), "screenshot"),
    )
    return F.when(sha == parent_sha, F.array(F.lit("identical (bit-for-bit)"))).when(
        F.size(seen) == 0, F.array(F.lit("re-encoded"))
    ).otherwise(seen)


def verdict(matched: Column) -> Column:
    """VERIFIED_ORIGIN, DERIVED or NO_RECORD from the evidence columns and a matched flag."""
    return (
        F.when(holds(F.col("c2pa_present")), "VERIFIED_ORIGIN")
        .when(coherent_camera(), "VERIFIED_ORIGIN")
        .when(holds(matched), "DERIVED")
        .otherwise("NO_RECORD")
    )


def verdict_statement(
    matched: Column, parent_name: Column, transformations: Column, metric: Column, match_type: Column
) -> Column:
    """The sentence published with the verdict. The generator is named before the software agent."""
    agent = first_filled(F.col("c2pa_generator"), F.col("c2pa_agent"))
    day = F.when(
        F.try_to_timestamp(F.col("c2pa_when")).isNotNull(),
        F.nullif(F.regexp_extract("c2pa_when", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")),
    )
    signed = F.concat(
        F.lit("Cryptographically signed"),
        F.when(filled(agent), F.concat(F.lit(" by "), agent)).otherwise(""),
        F.lit("."),
        F.when(filled(F.col("c2pa_source")),
               F.concat(F.lit(" Declared as AI-generated ("), F.col("c2pa_source"), F.lit(")."))).otherwise(""),
        F.when(day.isNotNull(), F.concat(F.lit(" Signed "), day, F.lit("."))).otherwise(""),
    )
    triangle = texts(
        F.when(F.col("exif_iso") != 0, F.concat(F.lit("ISO "), F.col("exif_iso").cast("string"))),
        F.when(filled(F.col("exposure_text")), F.col("exposure_text")),
        F.when(F.col("exif_fnumber") != 0, F.concat(F.lit("f/"), F.col("exif_fnumber").cast("string"))),
    )
    captured = F.array_join(
        texts(
            F.concat(F.lit("Captured on "), F.col("exif_make"), F.lit(" "), F.col("exif_model"), F.lit(".")),
            F.when(F.size(triangle) > 0, F.concat(
                F.array_join(triangle, ", "), F.lit(" — consistent with a coherent exposure triangle."))),
            F.when(holds(F.col("exif_thumbnail")), "Thumbnail IFD present."),
        ),
        " ",
    )
    note = F.when(
        match_type == "orb_features", F.concat(metric.cast("string"), F.lit(" matching local features (ORB)"))
    ).otherwise(F.concat(match_type, F.lit(" distance "), metric.cast("string")))
    derived = F.concat(
        F.lit("Matches '"), parent_name, F.lit("' uploaded earlier this session ("),
        F.array_join(transformations, ", "), F.lit("; "), note, F.lit(")."),
    )
    return (
        F.when(holds(F.col("c2pa_present")), signed)
        .when(coherent_camera(), captured)
        .when(holds(matched), derived)
        .otherwise(NO_RECORD_TEXT)
    )


def _earned() -> dict[str, Column]:
    return {
        "valid_c2pa_manifest_present": holds(F.col("c2pa_present")),
        "full_camera_exif_coherent_exposure_triangle": coherent_camera(),
        "thumbnail_ifd_present": holds(F.col("exif_thumbnail")),
        "icc_profile_known_vendor_pipeline": holds(F.col("icc_present")) & filled(F.col("icc_copyright")),
        "no_format_extension_mismatch": ~holds(F.col("format_mismatch")),
        "no_trailing_bytes_after_eoi": holds(F.col("trailing_bytes") == 0),
    }


def score_breakdown() -> Column:
    """map<string,int> of the parts that were earned."""
    earned = _earned()
    return F.map_from_entries(
        F.array_compact(
            F.array(*[
                F.when(earned[name], F.struct(F.lit(name).alias("key"), F.lit(points).alias("value")))
                for name, points in SCORE_PARTS
            ])
        )
    )


def score_value() -> Column:
    earned = _earned()
    total = F.lit(0)
    for name, points in SCORE_PARTS:
        total = total + F.when(earned[name], points).otherwise(0)
    return F.least(F.lit(MAX_SCORE), total)


def score_label(value: Column) -> Column:
    text = F.lit(SCORE_LABELS[-1][1])
    for bound, words in reversed(SCORE_LABELS[:-1]):
        text = F.when(value < bound, words).otherwise(text)
    return F.concat(F.lit("Trace Score: "), value.cast("string"), F.lit("/100 — "), text)


def trace_score() -> Column:
    """struct<value, max_value, label, breakdown>: a plain sum of independent facts."""
    value = score_value()
    return F.struct(
        value.alias("value"), F.lit(MAX_SCORE).alias("max_value"), score_label(value).alias("label"),
        score_breakdown().alias("breakdown"),
    )
