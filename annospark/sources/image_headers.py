"""Width and height from the header of an image file. The formats are public; nothing is decoded."""

from __future__ import annotations

import struct


def _exactly(file, n: int) -> bytes:
    found = file.read(n)
    if len(found) < n:
        raise ValueError("the file ends inside its header")
    return found


def _png(file):
    return struct.unpack(">II", _exactly(file, 24)[16:])


def _gif(file):
    return struct.unpack("<HH", _exactly(file, 10)[6:])


def _bmp(file):
    head = _exactly(file, 26)
    if struct.unpack_from("<I", head, 14)[0] == 12:
        return struct.unpack_from("<HH", head, 18)
    width, height = struct.unpack_from("<ii", head, 18)
    return width, abs(height)  # negative: stored from the top


# Markers that stand alone, and the frame headers that hold the size.
ALONE = (0x01, *range(0xD0, 0xD8))
FRAMES = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))


def _jpeg(file):
    file.seek(2)
    while True:
        byte = _exactly(file, 1)[0]
        if byte != 0xFF:
            raise ValueError("no marker")
        while byte == 0xFF:
            byte = _exactly(file, 1)[0]
        if byte in ALONE:
            continue
        if byte in (0xD9, 0xDA):
            raise ValueError("no frame before the image")
        length = struct.unpack(">H", _exactly(file, 2))[0]
        if byte in FRAMES:
            return struct.unpack(">HH", _exactly(file, 5)[1:])[::-1]
        file.seek(length - 2, 1)


def _tiff(file):
    head = _exactly(file, 16)
    order = "<" if head[:2] == b"II" else ">"
    large = struct.unpack_from(order + "H", head, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if large else "I"), head, 8 if large else 4)[0]
    file.seek(at)
    entries = struct.unpack(order + ("Q" if large else "H"), _exactly(file, 8 if large else 2))[0]
    found = {}
    for _ in range(min(entries, 1 << 16)):
        entry = _exactly(file, 20 if large else 12)
        tag, kind = struct.unpack_from(order + "HH", entry)
        if tag in (256, 257) and kind in (3, 4, 16):
            found[tag] = struct.unpack_from(order + {3: "H", 4: "I", 16: "Q"}[kind], entry, 12 if large else 8)[0]
        if len(found) == 2:
            return found[256], found[257]
    raise ValueError("no size")


def _webp(file):
    head = _exactly(file, 30)
    if head[12:16] == b"VP8 ":
        width, height = struct.unpack_from("<HH", head, 26)
        return width & 0x3FFF, height & 0x3FFF
    if head[12:16] == b"VP8L":
        bits = struct.unpack_from("<I", head, 21)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if head[12:16] == b"VP8X":
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    raise ValueError("unknown chunk")


def size_of(file) -> list[int]:
    """``[width, height]`` of an open PNG, JPEG, BMP, GIF, TIFF or WebP file; ``ValueError`` for anything else."""
    head = file.read(16)
    file.seek(0)
    if head.startswith(b"\x89PNG\r\n\x1a\n") and head[12:16] == b"IHDR":
        found = _png(file)
    elif head[:6] in (b"GIF87a", b"GIF89a"):
        found = _gif(file)
    elif head[:2] == b"BM":
        found = _bmp(file)
    elif head[:2] == b"\xff\xd8":
        found = _jpeg(file)
    elif head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        found = _tiff(file)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        found = _webp(file)
    else:
        raise ValueError("no image")
    if not all(0 < v < 1 << 31 for v in found):
        raise ValueError("no size")
    return list(found)
