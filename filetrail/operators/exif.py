"""EXIF directories as rows and columns, decoded with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.functions.binary import fixed_records, indexes, let, number_in_order, piece, signed32
from filetrail.functions.truth import first_filled

# TIFF value types by size (all others take one byte), and the tags that are read.
DOUBLE_BYTE, FOUR_BYTE, EIGHT_BYTE = [3, 8], [4, 9, 11], [5, 10, 12]
WHOLE, RATIONAL = (1, 3, 4, 9), (5, 10)
TAG_MAKE, TAG_MODEL, TAG_SOFTWARE, TAG_DATETIME = 0x010F, 0x0110, 0x0131, 0x0132
TAG_EXIF_POINTER, TAG_GPS_POINTER = 0x8769, 0x8825
TAG_EXPOSURE, TAG_FNUMBER, TAG_ISO, TAG_ISO_SPEED = 0x829A, 0x829D, 0x8827, 0x8833
TAG_ORIGINAL, TAG_DIGITIZED = 0x9003, 0x9004
TAG_SUBSEC, TAG_SUBSEC_ORIGINAL, TAG_SUBSEC_DIGITIZED, TAG_IMAGE_ID = 0x9290, 0x9291, 0x9292, 0xA420
RAW_NAMES = [
    ("ifd0", TAG_MAKE, "Make"), ("ifd0", TAG_MODEL, "Model"), ("ifd0", TAG_SOFTWARE, "Software"),
    ("ifd0", TAG_DATETIME, "DateTime"), ("ifd0", TAG_EXIF_POINTER, "ExifIFDPointer"),
    ("ifd0", TAG_GPS_POINTER, "GPSInfoIFDPointer"), ("exif", TAG_EXPOSURE, "ExposureTime"),
    ("exif", TAG_FNUMBER, "FNumber"), ("exif", TAG_ISO, "ISOSpeedRatings"),
    ("exif", TAG_ORIGINAL, "DateTimeOriginal"), ("exif", TAG_DIGITIZED, "DateTimeDigitized"),
    ("exif", TAG_SUBSEC, "SubSecTime"), ("exif", TAG_SUBSEC_ORIGINAL, "SubSecTimeOriginal"),
    ("exif", TAG_SUBSEC_DIGITIZED, "SubSecTimeDigitized"), ("exif", TAG_IMAGE_ID, "ImageUniqueID"),
]


def tiff_of(records: DataFrame, keys: list[str]) -> DataFrame:
    """The TIFF block of each file: first APP1 segment with the EXIF prefix, or first eXIf chunk."""
    prefix = F.lit(b"Exif\x00\x00")
    p = F.col("payload")
    prefixed = F.startswith(p, prefix)
    body = F.when(prefixed, F.substring(p, F.lit(7), F.octet_length(p))).otherwise(p)
    rows = records.filter(((F.col("type") == "FFE1") & prefixed) | (F.col("type") == "eXIf"))
    return rows.groupBy(*keys).agg(F.min_by(body, F.col("seg_no")).alias("tiff"))


def directory(tiff: Column, start: Column, little: Column) -> Column:
    """array<struct<pos, tag, type, count, data>> of the directory at `start`; empty if there is none.

    `data` holds the value bytes, taken from the entry itself if they fit there.
    """
    def entry(raw: Column, pos: Column) -> Column:
        def field(at: int, size: int) -> Column:
            return number_in_order(raw, at, size, little)

        def valued(head: Column) -> Column:
            each = F.when(head["type"].isin(DOUBLE_BYTE), 2).when(head["type"].isin(FOUR_BYTE), 4).when(
                head["type"].isin(EIGHT_BYTE), 8).otherwise(1)
            total = each * head["count"]
            data = F.when(total <= 4, F.substring(raw, F.lit(9), F.least(total, F.lit(4)).cast("int"))).otherwise(
                piece(tiff, field(8, 4), F.least(total, F.octet_length(tiff)))
            )
            return F.struct(
                pos.cast("int").alias("pos"), head["tag"].alias("tag"), head["type"].alias("type"),
                head["count"].alias("count"), data.alias("data"),
            )

        return let(
            F.struct(field(0, 2).alias("tag"), field(2, 2).alias("type"), field(4, 4).alias("count")), valued
        )

    count = number_in_order(tiff, start, 2, little)
    return F.transform(fixed_records(tiff, start + 2, count, 12), entry)


def is_tiff(block: Column) -> Column:
    return (F.octet_length(block) >= 8) & F.substring(block, 1, 2).isin(b"II", b"MM")


def exif_directories(tiffs: DataFrame, keys: list[str]) -> DataFrame:
    """Per file the entries of its four directories as arrays. Blocks that are not TIFF are dropped."""
    return with_directories(tiffs.filter(is_tiff(F.col("tiff"))), keys)


def with_directories(valid: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` with the directories of the column `tiff` as arrays; without entries where it is NULL."""
    t = F.col("tiff")
    le = F.col("little")
    first = valid.select(*keys, "tiff", (F.substring(t, 1, 2) == F.lit(b"II")).alias("little"))
    first = first.withColumn("start", number_in_order(t, 4, 4, le)).withColumn("size", F.octet_length(t).cast("bigint"))
    main = first.withColumn("ifd0", directory(t, F.col("start"), le))
    next_at = F.col("start") + 2 + F.size("ifd0") * 12
    readable = (F.col("start") + 2 <= F.col("size")) & (next_at + 4 <= F.col("size"))

    def pointer(tag: int) -> Column:
        entry = F.try_element_at(F.filter("ifd0", lambda e: e["tag"] == tag), F.lit(-1))
        wide = number_in_order(entry["data"], 0, 4, le)
        return F.coalesce(F.when(entry["type"] == 3, number_in_order(entry["data"], 0, 2, le)).otherwise(wide), F.col("size"))

    linked = main.withColumns({
        "next_start": F.when(readable, number_in_order(t, next_at, 4, le)).otherwise(0),
        "exif_start": pointer(TAG_EXIF_POINTER), "gps_start": pointer(TAG_GPS_POINTER),
    })
    ifd1_start = F.when(F.col("next_start") > 0, F.col("next_start")).otherwise(F.col("size"))
    # One expression for the three other directories: plans of this size are costly to build.
    others = F.transform(F.array("exif_start", "gps_start", ifd1_start), lambda start: directory(t, start, le))
    return linked.withColumn("others", others).select(
        *keys, "little", "next_start", "ifd0", *(F.get("others", i).alias(name) for i, name in enumerate(("exif", "gps", "ifd1"))))


def _big_endian(digits: Column, little: Column) -> Column:
    """Hex digits of one number, most significant byte first."""
    return F.when(little, F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")).otherwise(digits)


def exif_entries(directories: DataFrame, keys: list[str]) -> DataFrame:
    """One row per directory entry: (keys, ifd, pos, tag, type, count, numbers, text).

    `numbers` holds numeric values as doubles, NULL if bytes are missing. `text` holds strings, cut at the first
    NUL, and hex digits for types that are not decoded. Every file also has one row without an `ifd`, whose count
    is the start of the second directory.
    """
    def tagged_as(name: str) -> Column:
        return F.transform(F.col(name), lambda e: F.struct(
            F.lit(name).alias("ifd"), e["pos"].alias("pos"), e["tag"].alias("tag"), e["type"].alias("type"),
            e["count"].alias("count"), e["data"].alias("data")))

    none = F.array(F.struct(
        F.lit(None).cast("string").alias("ifd"), F.lit(0).alias("pos"), F.lit(None).cast("bigint").alias("tag"),
        F.lit(None).cast("bigint").alias("type"), F.col("next_start").cast("bigint").alias("count"),
        F.lit(None).cast("binary").alias("data")))
    rows = directories.select(
        *keys, "little", F.explode(F.concat(none, *[tagged_as(d) for d in ("ifd0", "exif", "gps", "ifd1")])).alias("e")
    ).select(*keys, "little", "e.*")
    read = let(F.struct("type", "data", "count"), lambda e: entry_value(e, F.col("little")))
    return rows.withColumn("read", read).select(
        *keys, "ifd", "pos", "tag", "type", "count", "read.numbers", "read.text")


def entry_value(entry: Column, little: Column) -> Column:
    """struct<numbers, text> of an entry with type, data and count."""
    kind, data, count = entry["type"], entry["data"], entry["count"]
    width = F.when(kind == 1, 1).when(kind == 3, 2).when(kind.isin(4, 5, 9, 10), 4)
    per_value = F.when(kind.isin(*RATIONAL), 2).otherwise(1)
    present = F.when(kind == 1, F.octet_length(data).cast("bigint")).otherwise(count * per_value)
    complete = (kind == 1) | (F.octet_length(data) >= count * per_value * width)

    def word(digits: Column, k: Column) -> Column:
        one = F.substring(digits, (k * width * 2 + 1).cast("int"), (width * 2).cast("int"))
        value = F.conv(_big_endian(one, little), 16, 10).cast("bigint")
        return F.when(kind.isin(9, 10), signed32(value)).otherwise(value)

    words = F.when(
        complete, let(F.hex(data), lambda digits: F.transform(indexes(present), lambda k: word(digits, k)))
    )

    def ratio(ws: Column, k: Column) -> Column:
        bottom = F.get(ws, k * 2 + 1)
        return F.when(bottom == 0, F.lit(0.0)).otherwise(F.get(ws, k * 2) / bottom)

    def numbers(ws: Column) -> Column:
        ratios = F.transform(indexes(F.floor(F.size(ws) / 2)), lambda k: ratio(ws, k))
        return F.when(kind.isin(*RATIONAL), F.when(ws.isNotNull(), ratios)).otherwise(ws.cast("array<double>"))

    # Invalid UTF-8 becomes replacement characters.
    ascii_text = F.substring_index(F.decode(data, "ISO-8859-1"), "\x00", 1)
    text = F.when(kind == 2, F.make_valid_utf8(F.encode(ascii_text, "ISO-8859-1").cast("string"))).when(
        ~kind.isin(1, 3, 4, 5, 9, 10), F.lower(F.hex(data)))
    return F.struct(let(words, numbers).alias("numbers"), text.alias("text"))


def tag_pivot(entries: DataFrame, keys: list[str], tag: str, value: str, order: str, tags: list) -> DataFrame:
    """One column per listed tag holding its last value by order; a conditional aggregate, no extra shuffle."""
    return entries.groupBy(*keys).agg(*[
        F.max_by(F.col(value), F.when(F.col(tag) == t, F.col(order))).alias(str(t)) for t in tags
    ])


def exposure_text(value: Column) -> Column:
    """`1/n` with n rounded half to even; NULL for zero. Long exposures really come out as `1/0`."""
    return F.when(value != 0, F.concat(F.lit("1/"), F.bround(1 / value, 0).cast("bigint").cast("string")))


def gps_decimal(dms: Column, ref: Column) -> Column:
    """Degrees from array<double> of degrees, minutes, seconds; NULL unless there are exactly three."""
    value = F.get(dms, 0) + F.get(dms, 1) / 60 + F.get(dms, 2) / 3600
    return F.when(F.size(dms) == 3, F.when(ref.isin("S", "W"), -value).otherwise(value))


def gps_position(latitude: Column, longitude: Column) -> Column:
    """struct<latitude, longitude>, NULL if both are."""
    return F.when(
        latitude.isNotNull() | longitude.isNotNull(),
        F.struct(latitude.alias("latitude"), longitude.alias("longitude")),
    )


def normalised(
    original: Column, changed: Column, subsec_original: Column, subsec: Column
) -> tuple[Column, Column]:
    """Date-time and sub-second texts: the original's if filled, else the general one."""
    return first_filled(original, changed), first_filled(subsec_original, subsec)


def _scalar(entry: Column, kinds: tuple[int, ...]) -> Column:
    return F.when(entry["type"].isin(*kinds) & (F.size(entry["numbers"]) == 1), F.get(entry["numbers"], 0))


def _slots() -> dict[tuple[str, int], str]:
    """Column names of the entries that evidence is made of, by directory and tag."""
    slots = {(ifd, tag): f"{ifd}_{tag:04x}" for ifd, tag, _ in RAW_NAMES}
    slots.update({("gps", tag): f"gps_{tag}" for tag in (1, 2, 3, 4)})
    slots[("exif", TAG_ISO_SPEED)] = "exif_iso_speed"
    return slots


def exif_columns(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The flat EXIF evidence of each file, and `exif_invalid` for values a record cannot hold.

    A pivot with a fixed tag list: of a tag that occurs twice in a directory the last entry counts.
    """
    value = F.struct("type", "numbers", "text")
    return _evidence(entries.groupBy(*keys).agg(
        F.max(F.when(F.col("ifd").isNull(), F.col("count"))).alias("next_start"),
        F.count_if(F.col("ifd") == "ifd1").alias("ifd1_entries"),
        *[F.max_by(value, F.when((F.col("ifd") == ifd) & (F.col("tag") == tag), F.col("pos"))).alias(name)
          for (ifd, tag), name in _slots().items()],
    ), keys, F.lit(True))


def exif_of(files: DataFrame) -> DataFrame:
    """All columns of `files` but `tiff`, and the EXIF evidence of that block; NULLs where it is no TIFF block.

    The same as `exif_columns` of the block's entries, by functions over the arrays of a row.
    """
    kept = [c for c in files.columns if c != "tiff"]
    present = F.col("tiff_present")
    known = with_directories(files.withColumn("tiff", F.when(is_tiff(F.col("tiff")), F.col("tiff"))).withColumn(
        "tiff_present", F.col("tiff").isNotNull()), [*kept, "tiff_present"])
    little = F.col("little")

    asked = {ifd: [tag for own, tag in _slots() if own == ifd] for ifd in ("ifd0", "exif", "gps")}

    def wanted(ifd: str, tags: list[int]) -> Column:
        return F.transform(F.filter(ifd, lambda e: e["tag"].isin(*tags)), lambda e: F.struct(F.lit(ifd).alias("ifd"), e.alias("e")))

    def valued(item: Column) -> Column:
        entry = item["e"]
        return let(entry_value(entry, little), lambda v: F.struct(
            item["ifd"].alias("ifd"), entry["tag"].alias("tag"), entry["type"].alias("type"), v["numbers"].alias("numbers"),
            v["text"].alias("text")))

    read = known.select(
        *kept, "tiff_present", F.col("next_start").cast("bigint").alias("next_start"),
        F.coalesce(F.size("ifd1"), F.lit(0)).alias("ifd1_entries"),
        F.transform(F.concat(*(wanted(ifd, tags) for ifd, tags in asked.items())), valued).alias("entries"))

    def last(ifd: str, tag: int) -> Column:
        return F.try_element_at(F.filter("entries", lambda e: (e["ifd"] == ifd) & (e["tag"] == tag)), F.lit(-1))

    return _evidence(read.select(*kept, "tiff_present", "next_start", "ifd1_entries", *(
        last(ifd, tag).alias(name) for (ifd, tag), name in _slots().items())), kept, present)


def _evidence(wide: DataFrame, kept: list[str], present: Column) -> DataFrame:
    slots = _slots()
    at = lambda ifd, tag: F.col(slots[(ifd, tag)])
    text = lambda ifd, tag: at(ifd, tag)["text"]
    exposure = at("exif", TAG_EXPOSURE)
    ratio = _scalar(exposure, RATIONAL)
    when, subsec = normalised(
        text("exif", TAG_ORIGINAL), text("ifd0", TAG_DATETIME),
        text("exif", TAG_SUBSEC_ORIGINAL), text("exif", TAG_SUBSEC),
    )
    lat = gps_decimal(at("gps", 2)["numbers"], text("gps", 1))
    lon = gps_decimal(at("gps", 4)["numbers"], text("gps", 3))
    shown = lambda e: F.coalesce(e["text"], F.array_join(e["numbers"].cast("array<string>"), ","))
    iso_speed = F.coalesce(shown(at("exif", TAG_ISO_SPEED)), shown(at("exif", TAG_ISO)))
    raw = F.map_from_entries(F.array_compact(F.array(*[
        F.when((iso_speed if tag == TAG_ISO else at(ifd, tag)).isNotNull(), F.struct(
            F.lit(name).alias("name"), (iso_speed if tag == TAG_ISO else shown(at(ifd, tag))).alias("value")))
        for ifd, tag, name in RAW_NAMES
    ])))
    named = F.lit(False)
    for tag in (TAG_MAKE, TAG_MODEL, TAG_SOFTWARE):
        named = named | at("ifd0", tag)["numbers"].isNotNull()
    # An exposure that is neither a scalar ratio nor text has no place in the record.
    odd_exposure = exposure["numbers"].isNotNull() & ratio.isNull()
    return wide.select(
        *kept,
        present.alias("exif_present"),
        text("ifd0", TAG_MAKE).alias("exif_make"),
        text("ifd0", TAG_MODEL).alias("exif_model"),
        text("ifd0", TAG_SOFTWARE).alias("exif_software"),
        when.alias("exif_datetime"),
        F.coalesce(exposure_text(ratio), exposure["text"]).alias("exposure_text"),
        _scalar(at("exif", TAG_FNUMBER), WHOLE + RATIONAL).alias("exif_fnumber"),
        _scalar(at("exif", TAG_ISO), WHOLE).cast("bigint").alias("exif_iso"),
        at("ifd0", TAG_GPS_POINTER).isNotNull().alias("exif_gps"),
        gps_position(lat, lon).alias("exif_position"),
        ((F.col("next_start") != 0) & (F.col("ifd1_entries") > 0)).alias("exif_thumbnail"),
        subsec.alias("exif_subsec"),
        text("exif", TAG_IMAGE_ID).alias("exif_image_id"),
        F.when(present, raw).alias("exif_raw"),
        (named | odd_exposure).alias("exif_invalid"),
    )
