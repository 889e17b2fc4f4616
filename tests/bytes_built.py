"""Small files built byte by byte for the tests."""

from __future__ import annotations

import struct
import zlib


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pixels: list[list[tuple[int, int, int]]], *extra: bytes, tail: bytes = b"") -> bytes:
    """A decodable RGB image."""
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\x00" + bytes(v for p in row for v in p) for row in pixels)
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + b"".join(extra) + chunk(b"IDAT", zlib.compress(raw))
            + chunk(b"IEND", b"") + tail)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments: bytes, width=64, height=48, progressive=False, luma=range(1, 65), chroma=range(2, 66), tail=b"") -> bytes:
    """Container structure of a JPEG; the scan is filler, so it does not decode."""
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    return (b"\xff\xd8" + b"".join(segments)
            + segment(0xDB, b"\x00" + bytes(luma)) + segment(0xDB, b"\x01" + bytes(chroma))
            + segment(0xC2 if progressive else 0xC0, frame)
            + segment(0xDA, bytes(10)) + b"\x12\xff\x00\x34\xff\xd1\x56" + b"\xff\xd9" + tail)


def tiff(order: str, ifd0: list, exif: list = (), gps: list = (), ifd1: list = ()) -> bytes:
    """Directories of (tag, type, count, value bytes); pointers are added where a sub-directory is given."""
    head = b"II*\x00" if order == "<" else b"MM\x00*"

    def directory(entries, start, following):
        table, data = struct.pack(order + "H", len(entries)), b""
        data_at = start + 2 + 12 * len(entries) + 4
        for tag, kind, count, value in entries:
            inline = value.ljust(4, b"\x00") if len(value) <= 4 else struct.pack(order + "I", data_at + len(data))
            if len(value) > 4:
                data += value
            table += struct.pack(order + "HHI", tag, kind, count) + inline
        return table + struct.pack(order + "I", following) + data

    def size(entries):
        return 2 + 12 * len(entries) + 4 + sum(len(e[3]) for e in entries if len(e[3]) > 4)

    main = list(ifd0) + [(0x8769, 4, 1, bytes(4))] * bool(exif) + [(0x8825, 4, 1, bytes(4))] * bool(gps)
    exif_at = 8 + size(main)
    gps_at = exif_at + (size(exif) if exif else 0)
    ifd1_at = gps_at + (size(gps) if gps else 0)
    main = list(ifd0)
    if exif:
        main.append((0x8769, 4, 1, struct.pack(order + "I", exif_at)))
    if gps:
        main.append((0x8825, 4, 1, struct.pack(order + "I", gps_at)))
    out = head + struct.pack(order + "I", 8) + directory(main, 8, ifd1_at if ifd1 else 0)
    out += directory(exif, exif_at, 0) if exif else b""
    out += directory(gps, gps_at, 0) if gps else b""
    return out + (directory(ifd1, ifd1_at, 0) if ifd1 else b"")


def text(value: str) -> bytes:
    return value.encode() + b"\x00"


def camera_tiff(order: str = "<", **changed) -> bytes:
    ratio = lambda *pairs: b"".join(struct.pack(order + "II", *p) for p in pairs)
    short = lambda v: struct.pack(order + "H", v)
    exif = [
        (0x829A, 5, 1, ratio(changed.get("exposure", (1, 25)))), (0x829D, 5, 1, ratio((185, 100))),
        (0x8827, 3, 1, short(2042)), (0x9003, 2, 20, text("2026:08:12 09:41:03")), (0x9291, 2, 4, text("123")),
        (0xA420, 2, 9, text("image-id")),
    ]
    gps = [(1, 2, 2, text("S")), (2, 5, 3, ratio((6, 1), (30, 1), (0, 1))), (3, 2, 2, text("E")),
           (4, 5, 3, ratio((3, 1), (24, 1), (36, 1)))]
    ifd0 = [(0x010F, 2, 6, text("TECNO")), (0x0110, 2, 4, text("KL4")), (0x0131, 2, 11, text(changed.get("software", "Camera")))]
    return tiff(order, ifd0, changed.get("exif", exif), gps, [(0x0103, 3, 1, short(6))])


def icc(copyright: str, description: str = "a profile") -> bytes:
    tag = lambda s: b"text\x00\x00\x00\x00" + s.encode() + b"\x00"
    wide = description.encode("utf-16-be")
    desc = b"mluc\x00\x00\x00\x00" + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", len(wide), 28) + wide
    at = 128 + 4 + 24
    table = struct.pack(">I", 2) + b"desc" + struct.pack(">II", at, len(desc))
    table += b"cprt" + struct.pack(">II", at + len(desc), len(tag(copyright)))
    return bytes(128) + table + desc + tag(copyright)


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def superbox(label: str, *children: bytes) -> bytes:
    return box(b"jumb", box(b"jumd", bytes(16) + b"\x01" + label.encode() + b"\x00") + b"".join(children))


def cbor(value) -> bytes:
    """Enough of CBOR for claims: text, small integers, lists, maps."""
    def head(major: int, n: int) -> bytes:
        return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 24, n]) if n < 256 else bytes(
            [major << 5 | 25]) + struct.pack(">H", n)

    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, int):
        return head(0, value)
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(cbor, value))
    return head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())


CLAIM = {
    "alg": "sha256", "claim_generator_info": [{"name": "Image Service", "version": 7}],
    "actions": [{"action": "created", "softwareAgent": {"name": "gpt-image"}, "when": "2026-08-12T10:00:00Z",
                 "digitalSourceType": "http://example.org/trainedAlgorithmicMedia"}],
}


def claim_store(claim=CLAIM) -> bytes:
    return superbox("c2pa", superbox("c2pa.claim", box(b"cbor", cbor(claim))), superbox("c2pa.more", box(b"json", b'{"when": "late"}')))


def pdf(producer: str, creator: str, embedded: bool) -> bytes:
    font = "/BaseFont /ABCDEF+ArialMT /FontDescriptor 6 0 R" if embedded else "/BaseFont /Helvetica"
    return (f"%PDF-1.4\n3 0 obj\n<< /Type /Page >>\nendobj\n5 0 obj\n<< /Type /Font /Subtype /Type1 {font} >>\nendobj\n"
            f"6 0 obj\n<< /Type /FontDescriptor /FontFile2 7 0 R >>\nendobj\n"
            f"8 0 obj\n<< /Producer ({producer}) /Creator ({creator}) >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 8 0 R >>\n%%EOF").encode()
