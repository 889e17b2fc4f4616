"""Colour profiles: reassembled from segments, read with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.functions.binary import fixed_records, let, number, piece
from filetrail.operators.segments import inflate, reassemble_parts

# Segment prefix, header size, description of a bare sRGB chunk.
PREFIX = b"ICC_PROFILE\x00"
HEADER = 132
SRGB_TEXT = "sRGB (embedded sRGB chunk)"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _until_nul(data: Column) -> Column:
    """ASCII text up to the first NUL, other bytes as replacement characters, white space stripped."""
    text = F.substring_index(F.decode(data, "ISO-8859-1"), "\x00", 1)
    return _stripped(F.regexp_replace(text, r"[\x80-\xff]", "\ufffd"))


def icc_tag_text(block: Column) -> Column:
    """Text of one tag: `text`, `desc` or `mluc` encoded; NULL for anything else."""
    kind = F.decode(F.substring(block, 1, 4), "ISO-8859-1")
    size = F.octet_length(block)
    localized = F.decode(piece(block, number(block, 24, 4), number(block, 20, 4)), "UTF-16BE")
    return F.when(
        size >= 8,
        F.when(kind == "text", _until_nul(piece(block, 8, size)))
        .when((kind == "desc") & (size >= 12), _until_nul(piece(block, 12, F.least(number(block, 8, 4), size))))
        .when((kind == "mluc") & (size >= 28), _stripped(F.btrim(localized, F.lit("\x00")))),
    )


def icc_text(profile: Column) -> Column:
    """struct<present, description, copyright> of a profile."""
    size = F.octet_length(profile)
    entries = fixed_records(profile, HEADER, number(profile, 128, 4), 12)

    def read(sig: str) -> Column:
        named = F.filter(entries, lambda e: F.substring(e, 1, 4) == F.lit(sig.encode()))
        return let(
            F.try_element_at(named, F.lit(-1)),
            lambda e: F.when(
                number(e, 4, 4) + number(e, 8, 4) <= size,
                icc_tag_text(piece(profile, number(e, 4, 4), number(e, 8, 4))),
            ),
        )

    big = size >= HEADER
    return F.struct(
        (size > 0).alias("present"),
        F.when(big, read("desc")).alias("description"),
        F.when(big, read("cprt")).alias("copyright"),
    )


def icc_of_jpeg(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, icc) for every JPEG with profile segments; parts in sequence order, short ones dropped."""
    p = F.col("payload")
    tagged = records.filter((F.col("type") == "FFE2") & F.startswith(p, F.lit(PREFIX)))
    # A segment of 14 bytes or less carries no profile data but still says a profile was meant.
    parts = tagged.select(
        *keys, number(p, 12, 1).alias("seq"), "seg_no",
        F.when(F.octet_length(p) > 14, F.substring(p, F.lit(15), F.octet_length(p))).otherwise(
            F.lit(b"")).alias("part"),
    )
    whole = reassemble_parts(parts, keys, "part", "seq", "seg_no", out="profile")
    return whole.select(*keys, icc_text(F.col("profile")).alias("icc"))


def icc_of_png(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, icc) for every PNG with an iCCP or sRGB chunk, whichever comes first."""
    p = F.col("payload")
    first = records.filter(F.col("type").isin("iCCP", "sRGB")).groupBy(*keys).agg(
        F.min_by(F.struct("type", "payload"), F.col("seg_no")).alias("chunk"))
    opened = first.select(*keys, "chunk", inflate(packed_profile(F.col("chunk"))).alias("profile"))
    return opened.select(*keys, png_profile(F.col("chunk"), F.col("profile")).alias("icc"))


def packed_profile(chunk: Column) -> Column:
    """The compressed profile of an iCCP chunk (type, payload); NULL for others."""
    p = chunk["payload"]
    name_end = F.locate("00", F.regexp_replace(F.hex(p), "(..)", "$1 "))
    return F.when(
        (chunk["type"] == "iCCP") & (name_end > 0), F.substring(p, (F.floor(name_end / 3) + 3).cast("int"), F.octet_length(p)))


def png_profile(chunk: Column, profile: Column) -> Column:
    """icc_text of a profile that lies in segments, or of the inflated one of an iCCP chunk, or what an sRGB chunk says; else NULL."""
    def said(description: Column) -> Column:
        return F.struct(F.lit(True).alias("present"), description.alias("description"), F.lit(None).cast("string").alias("copyright"))

    return F.when(chunk["type"] == "sRGB", said(F.lit(SRGB_TEXT))).when(profile.isNotNull(), icc_text(profile)).when(
        chunk["type"].isNotNull(), said(F.lit(None).cast("string")))
