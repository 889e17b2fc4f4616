"""Evidence of a file from the nested records of its row: functions over arrays, so that no file's records are ever shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.functions.binary import number
from filetrail.functions.fingerprints import sorted_distinct
from filetrail.operators.claims import CLAIM_KEYS, claim_facts, claim_fields
from filetrail.operators.exif import exif_of
from filetrail.operators.icc import PREFIX, packed_profile, png_profile
from filetrail.operators.segments import FRAMES, chroma_subsampling, frame_header, inflate, tables_in

RECORDS = "records"


def _of(*types: str, least: int = 0) -> Column:
    """The row's records of these types with at least so many payload bytes, in file order."""
    return F.filter(RECORDS, lambda r: r["type"].isin(*types) & (F.octet_length(r["payload"]) >= least))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _rest(data: Column, at: int) -> Column:
    return F.substring(data, F.lit(at + 1), F.octet_length(data))


def _joined(sorted_parts: Column, field: str) -> Column:
    return F.aggregate(sorted_parts, F.lit(b""), lambda out, p: F.concat(out, p[field]))


def image_size(width: str = "width", height: str = "height") -> list[Column]:
    """Size of a JPEG (its last whole frame header) or a PNG (IHDR)."""
    frame, head = _last(_of(*FRAMES, least=6))["payload"], _last(_of("IHDR", least=8))["payload"]
    return [F.coalesce(number(head, 0, 4), number(frame, 3, 2)).alias(width), F.coalesce(number(head, 4, 4), number(frame, 1, 2)).alias(height)]


def tiff_block() -> Column:
    """The first APP1 segment with the EXIF prefix, without it, or the first eXIf chunk."""
    prefix = F.lit(b"Exif\x00\x00")
    hits = F.filter(RECORDS, lambda r: ((r["type"] == "FFE1") & F.startswith(r["payload"], prefix)) | (r["type"] == "eXIf"))
    body = F.get(hits, 0)["payload"]
    return F.when(F.startswith(body, prefix), _rest(body, 6)).otherwise(body)


def profile_block() -> Column:
    """The profile of a JPEG: its parts in sequence order; short ones count, but hold nothing. NULL without any."""
    hits = F.filter(RECORDS, lambda r: (r["type"] == "FFE2") & F.startswith(r["payload"], F.lit(PREFIX)))
    parts = F.transform(hits, lambda r: F.struct(
        number(r["payload"], 12, 1).alias("seq"), r["seg_no"].alias("seg_no"),
        F.when(F.octet_length(r["payload"]) > 14, _rest(r["payload"], 14)).otherwise(F.lit(b"")).alias("part")))
    return F.when(F.size(hits) > 0, _joined(F.sort_array(parts), "part"))


def claim_block() -> Column:
    """The claim store: APP11 parts by instance in packet order, the first instance that is a superbox or else the first; or a caBX chunk."""
    hits = F.filter(RECORDS, lambda r: (r["type"] == "FFEB") & (F.octet_length(r["payload"]) >= 8)
                    & (F.substring(r["payload"], 1, 2) == F.lit(b"JP")))
    parts = F.transform(hits, lambda r: F.struct(
        number(r["payload"], 4, 4).alias("packet"), r["seg_no"].alias("seg_no"), _rest(r["payload"], 8).alias("part"),
        number(r["payload"], 2, 2).alias("instance")))
    streams = F.transform(
        F.array_distinct(F.transform(parts, lambda p: p["instance"])),
        lambda i: _joined(F.sort_array(F.filter(parts, lambda p: p["instance"] == i)), "part"))
    boxed = F.filter(streams, lambda s: (F.octet_length(s) >= 8) & (F.substring(s, 5, 4) == F.lit(b"jumb")))
    return F.coalesce(F.get(boxed, 0), F.get(streams, 0), F.get(_of("caBX"), 0)["payload"])


def encoder_columns() -> list[Column]:
    """Both quantization tables, whether they are identical, progressive flag, subsampling; NULLs but for the flags without them."""
    tables = F.col("quant_read")
    table = lambda n: _last(F.filter(tables, lambda t: t["table_id"] == n))["values"]
    luma, chroma = table(0), table(1)
    return [
        luma.alias("quant_luma"), chroma.alias("quant_chroma"), F.coalesce(luma == chroma, F.lit(False)).alias("quant_identical"),
        F.coalesce(_last(_of(*FRAMES))["type"] == "FFC2", F.lit(False)).alias("progressive"),
        chroma_subsampling(F.col("sampling_read")).alias("chroma_subsampling"),
    ]


def evidence_of(nested: DataFrame) -> DataFrame:
    """`nested` (a row per file with `records`) with the flat evidence of JPEG and PNG files in place of the records."""
    kept = [c for c in nested.columns if c != RECORDS]
    samplings = F.transform(_of(*FRAMES), lambda f: frame_header(f["payload"])["sampling"])
    blocks = nested.select(
        *kept, RECORDS, *image_size(), tiff_block().alias("tiff"), profile_block().alias("profile"), claim_block().alias("claims"),
        F.get(_of("iCCP", "sRGB"), 0).alias("png_chunk"),
        F.flatten(F.transform(_of("FFDB"), lambda r: tables_in(r["payload"]))).alias("quant_read"),
        F.flatten(F.filter(samplings, lambda s: s.isNotNull())).alias("sampling_read"))
    made = ["width", "height"]
    # Shorter stores hold no box. That the column is used twice also keeps its array functions out of the Python call's argument.
    store = F.when(F.octet_length("claims") >= 8, F.col("claims"))
    opened = blocks.withColumn("png_inflated", inflate(packed_profile(F.col("png_chunk"))))
    read = opened.select(
        *kept, *made, "tiff", "png_chunk", *encoder_columns(), claim_facts(CLAIM_KEYS)(store).alias("claim"),
        F.coalesce("profile", "png_inflated").alias("profile")).withColumn("icc", png_profile(F.col("png_chunk"), F.col("profile")))
    made += ["quant_luma", "quant_chroma", "quant_identical", "progressive", "chroma_subsampling"]
    there = F.col("claim.present")
    found = [F.try_element_at(F.col("claim.found"), F.lit(k)) for k in CLAIM_KEYS]
    flat = read.select(
        *kept, *made, "tiff", F.col("icc.present").alias("icc_present"), F.col("icc.description").alias("icc_description"),
        F.col("icc.copyright").alias("icc_copyright"), there.alias("c2pa_present"),
        F.when(there, sorted_distinct(F.col("claim.labels"))).alias("assertions"),
        F.when(there, F.lit(False)).alias("signature_checked"), *claim_fields(found))
    return exif_of(flat)
