"""The orientation tag of JPEG and PNG files; whatever is malformed counts as upright."""

import struct

from . import png


def _from_tiff(block: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return 1
    magic, first = struct.unpack_from(order + "HI", block, 2)
    if magic != 42 or first + 2 > len(block):
        return 1
    (entries,) = struct.unpack_from(order + "H", block, first)
    for i in range(entries):
        at = first + 2 + 12 * i
        if at + 12 > len(block):
            return 1
        tag, kind, count = struct.unpack_from(order + "HHI", block, at)
        if tag == 0x0112 and count >= 1:
            value = {3: "H", 4: "I"}.get(kind)
            found = struct.unpack_from(order + value, block, at + 8)[0] if value else 1
            return found if 1 <= found <= 8 else 1
    return 1


def orientation(data: bytes | None) -> int:
    """1 to 8."""
    if not data:
        return 1
    if data.startswith(png.SIGNATURE):
        for kind, body in png.chunks(data):
            if kind == b"eXIf":
                return _from_tiff(body)
            if kind == b"IDAT":
                break
        return 1
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker in (0xD9, 0xDA) or size < 2 or at + 2 + size > len(data):
            break
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            return _from_tiff(body[6:])
        at += 2 + size
    return 1
