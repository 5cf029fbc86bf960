"""What a picture file says of itself: format, size in pixels and the time it was taken, from its header.

Nothing is decoded: a few hundred bytes tell all of it. Files that break off or lie give None where they do."""

from __future__ import annotations

import struct

# Numbers of EXIF fields (time taken, time changed, where the EXIF directory is), and of sizes in TIFF files.
TAKEN, CHANGED, EXIF_DIRECTORY = 0x9003, 0x0132, 0x8769
TIFF_WIDTH, TIFF_HEIGHT = 0x0100, 0x0101
#: JPEG segments that hold a picture's size.
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
MOST_FIELDS = 512


def tiff_fields(data: bytes) -> dict[int, int | str]:
    """Whole numbers and texts of the first directory of a TIFF block and of its EXIF directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        return {}
    out: dict[int, int | str] = {}

    def directory(at: int) -> None:
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(min(n, MOST_FIELDS)):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            place = at + 10 + 12 * k
            if kind == 2:
                start = struct.unpack_from(order + "I", data, place)[0] if count > 4 else place
                out.setdefault(tag, bytes(data[start : start + count]).split(b"\0")[0].decode("latin-1"))
            elif kind in (3, 4) and count == 1:
                out.setdefault(tag, struct.unpack_from(order + {3: "H", 4: "I"}[kind], data, place)[0])

    try:
        directory(struct.unpack_from(order + "I", data, 4)[0])
        if isinstance(out.get(EXIF_DIRECTORY), int):
            directory(out[EXIF_DIRECTORY])
    except struct.error:
        pass  # a directory that points outside: what was read before it stays
    return out


def _jpeg(data: bytes) -> tuple[int | None, int | None, dict]:
    at, size, fields = 2, (None, None), {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # fill byte or a marker without length
            at += 1 if kind == 0xFF else 2
            continue
        if kind in (0xD9, 0xDA):
            break
        (length,) = struct.unpack_from(">H", data, at + 2)
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and not fields:
            fields = tiff_fields(data[at + 10 : at + 2 + length])
        elif kind in FRAMES and at + 9 <= len(data):
            height, width = struct.unpack_from(">HH", data, at + 5)
            size = (width, height)
        at += 2 + max(2, length)
    return *size, fields


def _png(data: bytes) -> tuple[int | None, int | None, dict]:
    at, size, fields = 8, (None, None), {}
    while at + 8 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR" and at + 16 <= len(data):
            size = struct.unpack_from(">II", data, at + 8)
        elif kind == b"eXIf":
            fields = tiff_fields(data[at + 8 : at + 8 + length])
        elif kind == b"IEND":
            break
        at += 12 + length
    return *size, fields


def _webp(data: bytes) -> tuple[int | None, int | None, dict]:
    at, size, fields = 12, (None, None), {}
    while at + 8 <= len(data):
        kind, length = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + length]
        if kind == b"VP8X" and len(body) >= 10:
            size = (1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"))
        elif kind == b"VP8 " and size == (None, None) and len(body) >= 10:
            w, h = struct.unpack_from("<HH", body, 6)
            size = (w & 0x3FFF, h & 0x3FFF)
        elif kind == b"VP8L" and size == (None, None) and len(body) >= 5:
            bits = int.from_bytes(body[1:5], "little")
            size = (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        elif kind == b"EXIF":
            fields = tiff_fields(body.removeprefix(b"Exif\0\0"))
        at += 8 + length + length % 2
    return *size, fields


def described(data: bytes) -> dict:
    """width, height, format and exif_text (the time taken, else changed, as the camera wrote it) of a picture file;
    ValueError if it is none that is known."""
    data = bytes(data)
    if data[:3] == b"\xff\xd8\xff":
        kind, (width, height, fields) = "JPEG", _jpeg(data)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        kind, (width, height, fields) = "PNG", _png(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind, (width, height, fields) = "WEBP", _webp(data)
    elif data[:4] in (b"II*\0", b"MM\0*"):
        fields = tiff_fields(data)
        kind, width, height = "TIFF", fields.get(TIFF_WIDTH), fields.get(TIFF_HEIGHT)
    elif data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        kind, height, fields = "BMP", abs(height), {}
    elif data[4:8] == b"ftyp" and data[8:12] in (b"heic", b"heix", b"mif1", b"msf1", b"hevc"):
        at = data.find(b"ispe")
        width, height = struct.unpack_from(">II", data, at + 8) if 0 <= at <= len(data) - 16 else (None, None)
        kind, fields = "HEIF", {}
    else:
        raise ValueError("not a picture of a known format")
    times = [x for x in (fields.get(TAKEN), fields.get(CHANGED)) if isinstance(x, str) and x.strip()]
    return {"width": width, "height": height, "format": kind, "exif_text": times[0].strip() if times else None}
