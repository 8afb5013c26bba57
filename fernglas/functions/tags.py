"""Camera tags and size of a picture from the bytes of its file, without an image library.

Tags are read from JPEG, TIFF, PNG and WebP; of GIF, BMP and HEIF files only the kind is told, and the size of the former two.
"""

from __future__ import annotations

import struct

#: Tag numbers, bytes of a value by its type, markers that carry a picture's size.
WIDTH, HEIGHT, MAKE, MODEL, TURN, SUB, EXPOSURE, APERTURE, ISO, TAKEN, FOCAL = 0x0100, 0x0101, 0x010F, 0x0110, 0x0112, 0x8769, 0x829A, 0x829D, 0x8827, 0x9003, 0x920A
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
#: Orientations that lay a picture on its side.
_ON_SIDE = (5, 6, 7, 8)
#: The most pixels that a picture may have.
CEILING = 300_000_000
SCHEMA = "format string, aperture double, focal_length double, exposure_s double, iso int, camera_make string, camera_model string, taken string, width int, height int"


def _directory(data: bytes, at: int, order: str) -> dict[int, list]:
    """Tag -> values of one directory; entries that don't fit the data are left out."""
    found = {}
    if at + 2 > len(data):
        return found
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
        size = _SIZE.get(kind, 0) * n
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if not size or start + size > len(data):
            continue
        raw = data[start : start + size]
        if kind in (5, 10):
            numbers = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
            found[tag] = [a / b if b else None for a, b in zip(numbers[::2], numbers[1::2])]
        elif kind in (2, 7):
            found[tag] = [raw.split(b"\0")[0].decode("utf-8", "replace")]
        else:
            found[tag] = list(struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind] }", raw))
    return found


def _segments(data: bytes) -> tuple[bytes, int | None, int | None]:
    """The tag block of a JPEG, its width and its height."""
    at, block, width, height = 2, b"", None, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and not block:
            block = data[at + 10 : at + 2 + size]
        if marker in _FRAMES and at + 9 <= len(data):
            height, width = struct.unpack_from(">HH", data, at + 5)
        if marker == 0xDA or size < 2:
            break
        at += 2 + size
    return block, width, height


def _png(data: bytes) -> tuple[bytes, int | None, int | None]:
    """The same of a PNG."""
    at, block, width, height = 8, b"", None, None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == b"IHDR" and at + 16 <= len(data):
            width, height = struct.unpack_from(">II", data, at + 8)
        if name == b"eXIf" and not block:
            block = data[at + 8 : at + 8 + size]
        at += 12 + size
    return block, width, height


def _webp(data: bytes) -> tuple[bytes, int | None, int | None]:
    """The same of a WebP."""
    at, block, width, height = 12, b"", None, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"VP8X" and len(body) >= 10:
            width, height = int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        elif name == b"VP8 " and len(body) >= 10 and width is None:
            width, height = (n & 0x3FFF for n in struct.unpack_from("<HH", body, 6))
        elif name == b"VP8L" and len(body) >= 5 and width is None:
            bits = int.from_bytes(body[1:5], "little")
            width, height = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif name == b"EXIF" and not block:
            block = body.removeprefix(b"Exif\0\0")
        at += 8 + size + size % 2
    return block, width, height


def _opened(data: bytes) -> tuple[str, bytes, int | None, int | None]:
    """Kind, tag block, width and height."""
    if data[:2] == b"\xff\xd8":
        return "jpeg", *_segments(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff", data, None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", *_png(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp", *_webp(data)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", b"", *struct.unpack_from("<HH", data, 6)
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack_from("<ii", data, 18)
        return "bmp", b"", width, abs(height)
    if data[4:8] == b"ftyp" and data[8:12] in (b"heic", b"heix", b"hevc", b"heim", b"mif1", b"msf1"):
        return "heif", b"", None, None
    raise ValueError("no picture")


def read_tags(data: bytes) -> dict:
    """Camera fields and upright size of a picture; ValueError for what is no picture or has more than CEILING pixels.
    Maker and model are those of the main directory, the others those of the sub-directory before those of the main one."""
    kind, block, width, height = _opened(data)
    main, sub = {}, {}
    if len(block) >= 8 and block[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if block[:2] == b"II" else ">"
        main = _directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
        if SUB in main:
            sub = _directory(block, main[SUB][0], order)

    def first(tag: int, *directories: dict):
        return next((d[tag][0] for d in directories or (sub, main) if d.get(tag) and d[tag][0] not in (None, "")), None)

    if kind == "tiff":
        width, height = first(WIDTH, main), first(HEIGHT, main)
    if width and height and width * height > CEILING:
        raise ValueError("too many pixels")
    if first(TURN, main) in _ON_SIDE:
        width, height = height, width
    positive = lambda x: float(x) if isinstance(x, (int, float)) and x > 0 else None
    text = lambda x: x.strip() or None if isinstance(x, str) else None
    iso = positive(first(ISO))
    return {"format": kind, "aperture": positive(first(APERTURE)), "focal_length": positive(first(FOCAL)), "exposure_s": positive(first(EXPOSURE)), "iso": int(iso) if iso else None, "camera_make": text(first(MAKE, main)), "camera_model": text(first(MODEL, main)), "taken": text(first(TAKEN)), "width": width, "height": height}
