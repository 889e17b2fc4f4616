"""File formats from magic bytes and from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic prefixes and file-name extensions of the recognised formats.
MAGIC = [
    ("jpeg", b"\xff\xd8\xff"),
    ("png", b"\x89PNG\r\n\x1a\n"),
    ("pdf", b"%PDF-"),
    ("bmp", b"BM"),
    ("gif", b"GIF87a"),
    ("gif", b"GIF89a"),
]
EXTENSIONS = {
    "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "pdf": "pdf", "webp": "webp", "bmp": "bmp", "gif": "gif",
}
RASTER_FORMATS = ("jpeg", "png", "webp", "bmp", "gif")


def sniff_format(content: Column) -> Column:
    """Format by magic bytes, never by name; `unknown` if none fits."""
    webp = F.startswith(content, F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP"))
    branches = F.when(webp, "webp")
    for name, magic in MAGIC:
        branches = branches.when(F.startswith(content, F.lit(magic)), name)
    return branches.otherwise("unknown")


def declared_format(name: Column) -> Column:
    """Format the file name claims: known extensions are normalised, others are returned as they are."""
    extension = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.nullif(extension, F.lit("")), F.lit("unknown"))


def format_mismatch(actual: Column, declared: Column) -> Column:
    """True when both formats are known and differ."""
    return (actual != "unknown") & (declared != "unknown") & (actual != declared)
