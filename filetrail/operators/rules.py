"""Ordered, auditable rules over evidence columns. Every rule that holds is reported.

A rule is data: a name and three Column expressions. Users add rules by passing their own list to `classify`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from filetrail.functions.fingerprints import sorted_distinct
from filetrail.functions.truth import filled, first_filled, holds, mentions

# The fourteen standard PDF fonts and the badge shown for each rule.
STANDARD_FONTS = [
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique",
    "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic",
    "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique",
    "Symbol", "ZapfDingbats",
]
BADGES = {
    "whatsapp_transmission": "whatsapp",
    "android_screenshot": "android",
    "android_camera_reshared": "android",
    "direct_phone_camera": "camera",
    "openai_generation": "ai-generator",
    "screen_capture": "screen-capture",
    "near_lossless_export": "export-tool",
    "reportlab_programmatic_pdf": "pdf",
    "browser_print_to_pdf": "pdf",
    "ilovepdf_compression": "pdf",
}


@dataclass(frozen=True)
class Rule:
    """`basis` entries that are NULL for a row are left out of its report."""

    name: str
    when: Column
    confidence: Column
    basis: list[Column]

    def finding(self) -> Column:
        return F.when(
            holds(self.when),
            F.struct(
                F.lit(self.name).alias("name"),
                self.confidence.alias("confidence"),
                F.array_compact(F.array(*self.basis)).alias("basis"),
            ),
        )


def _says(text: str, value: Column) -> Column:
    return F.concat(F.lit(text), value)


def _if(condition: Column, value: Column | str) -> Column:
    return F.when(condition, value)


def coherent_camera() -> Column:
    """Make and model named, and the whole exposure triangle known."""
    return (
        holds(F.col("exif_present"))
        & filled(F.col("exif_make")) & filled(F.col("exif_model"))
        & F.col("exposure_text").isNotNull() & F.col("exif_fnumber").isNotNull() & F.col("exif_iso").isNotNull()
    )


def near_lossless(luma: Column, chroma: Column) -> Column:
    """At least one quantization table, and no step above one."""
    steps = F.flatten(F.array_compact(F.array(luma, chroma)))
    return holds((F.size(steps) > 0) & F.forall(steps, lambda v: v <= 1))


def _font_names(keep) -> Column:
    return sorted_distinct(F.transform(F.filter("pdf_fonts", keep), lambda f: f["name"]))


def standard_rules() -> list[Rule]:
    """The ten standard rules in report order, over the flat evidence columns."""
    high, medium = F.lit("high"), F.lit("medium")
    fmt = F.col("actual_format")
    exif, icc = holds(F.col("exif_present")), holds(F.col("icc_present"))
    progressive = holds(F.col("progressive"))
    agent = first_filled(F.col("c2pa_agent"), F.col("c2pa_generator"))
    producer, creator = F.col("pdf_producer"), F.col("pdf_creator")
    standard = _font_names(lambda f: ~f["embedded"] & f["name"].isin(STANDARD_FONTS))
    embedded = _font_names(lambda f: f["embedded"])
    camera_parts = F.concat(
        F.lit("exposure triangle present: "), F.col("exposure_text"), F.lit(", f/"),
        F.col("exif_fnumber").cast("string"), F.lit(", ISO "), F.col("exif_iso").cast("string"),
    )
    return [
        Rule(
            "openai_generation",
            holds(F.col("c2pa_present")) & (
                mentions(agent, "gpt") | mentions(agent, "openai")
                | mentions(F.col("c2pa_source"), "trainedalgorithmicmedia")
            ),
            high,
            [
                F.when(fmt == "png", "C2PA manifest embedded (PNG caBX)")
                .otherwise("C2PA manifest embedded (JPEG APP11 JUMBF)"),
                _if(filled(F.col("c2pa_agent")), _says("softwareAgent: ", F.col("c2pa_agent"))),
                _if(filled(F.col("c2pa_source")), _says("digitalSourceType: ", F.col("c2pa_source"))),
            ],
        ),
        Rule(
            "whatsapp_transmission",
            (fmt == "jpeg") & progressive & holds(F.col("quant_identical")) & ~exif & ~icc,
            high,
            [
                F.lit("progressive JPEG (SOF2)"),
                F.lit("luma and chroma quantization tables byte-identical"),
                F.lit("no EXIF present"),
                F.lit("no ICC profile present"),
            ],
        ),
        Rule(
            "android_screenshot",
            (fmt == "png") & exif & mentions(F.col("exif_software"), "android"),
            high,
            [
                _says("PNG eXIf chunk with Software: ", F.col("exif_software")),
                _if(filled(F.col("exif_datetime")), "DateTimeOriginal present"),
                _if(filled(F.col("exif_image_id")), "ImageUniqueID present"),
            ],
        ),
        Rule(
            "android_camera_reshared",
            (fmt == "jpeg") & mentions(F.col("icc_copyright"), "google inc") & ~exif & ~progressive,
            high,
            [
                F.concat(F.lit("ICC profile copyright = '"), F.col("icc_copyright"), F.lit("'")),
                F.lit("EXIF stripped"),
                F.lit("baseline JPEG"),
            ],
        ),
        Rule(
            "direct_phone_camera",
            coherent_camera(),
            F.when(holds(F.col("exif_thumbnail")), high).otherwise(medium),
            [
                F.concat(F.lit("Make/Model: "), F.col("exif_make"), F.lit(" / "), F.col("exif_model")),
                camera_parts,
                _if(filled(F.col("exif_subsec")), _says("SubSecTime: ", F.col("exif_subsec"))),
                _if(holds(F.col("exif_gps")), "GPS IFD present"),
                _if(holds(F.col("exif_thumbnail")), "thumbnail IFD present"),
            ],
        ),
        Rule(
            "near_lossless_export",
            (fmt == "jpeg") & holds(F.col("quant_all_le1")) & ~exif & ~icc,
            medium,
            [
                F.lit("all-1 quantization tables (quality ~100)"),
                F.lit("no EXIF present"),
                F.lit("no ICC profile present"),
                _if(holds(F.col("format_mismatch")), F.concat(
                    F.lit("format/extension mismatch (declared "), F.col("declared_format"),
                    F.lit(", actual "), fmt, F.lit(")"))),
            ],
        ),
        Rule(
            "screen_capture",
            F.col("min_flat_std") == 0.0,
            high,
            [F.lit("flat region with standard deviation exactly 0.000 (min == max) — framebuffer capture")],
        ),
        Rule(
            "reportlab_programmatic_pdf",
            (fmt == "pdf") & mentions(producer, "reportlab"),
            high,
            [
                _says("Producer: ", producer),
                _if(F.size(standard) > 0, _says("non-embedded base-14 fonts: ", F.array_join(standard, ", "))),
            ],
        ),
        Rule(
            "browser_print_to_pdf",
            (fmt == "pdf") & mentions(producer, "skia/pdf") & mentions(creator, "chromium"),
            high,
            [
                _says("Producer: ", producer),
                _says("Creator: ", creator),
                _if(F.size(embedded) > 0, _says("embedded subsetted fonts: ", F.array_join(embedded, ", "))),
            ],
        ),
        Rule(
            "ilovepdf_compression",
            (fmt == "pdf") & mentions(producer, "ilovepdf"),
            high,
            [F.concat(F.lit("Producer: "), producer, F.lit(" (overwrites the original producer string)"))],
        ),
    ]


def classify(rules: list[Rule] | None = None) -> Column:
    """array<struct<name, confidence, basis>> of every rule that holds, in rule order."""
    return F.array_compact(F.array(*[r.finding() for r in (standard_rules() if rules is None else rules)]))


def badges(matches: Column) -> Column:
    """Sorted distinct badges; rules without a badge show under their own name."""
    known = F.create_map(*[F.lit(x) for pair in BADGES.items() for x in pair])
    return sorted_distinct(
        F.transform(matches, lambda m: F.coalesce(F.try_element_at(known, m["name"]), m["name"]))
    )


def names(matches: Column) -> Column:
    return F.transform(matches, lambda m: m["name"])
