"""A small PNG reader and writer: all colour types, 8 and 16 bits, palettes, transparency; no interlacing."""

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    """(kind, content) of each chunk; stops at a length that leaves the data."""
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if n > len(data) - at - 12:
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += n + 12


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            out[y + 1] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        else:
            now = bytearray(stride)
            for x in range(stride):
                left = now[x - step] if x >= step else 0
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[x - step]) if x >= step else 0
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                now[x] = (int(line[x]) + guess) & 255
            out[y + 1] = np.frombuffer(bytes(now), np.uint8)
    return out[1:]


def decode(data: bytes) -> np.ndarray:
    """height x width x samples of 8 bits: grey, grey and alpha, RGB or RGBA. 16-bit samples keep their contrast."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    packed, palette, clear, head = [], None, None, None
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or not packed:
        raise ValueError("a PNG file without image data")
    width, height, depth, colour, _, _, interlace = head
    if interlace or colour not in _SAMPLES or width == 0 or height == 0:
        raise ValueError("an unsupported kind of PNG file")
    samples = _SAMPLES[colour]
    stride = -(-width * samples * depth // 8)
    flat = _unfilter(zlib.decompress(b"".join(packed)), height, stride, max(1, samples * depth // 8))
    if depth == 16:
        wide = flat.reshape(height, width, samples, 2)
        image = wide[..., 0].astype(np.uint16) * 256 + wide[..., 1]
        value = image
        image = ((image.astype(np.uint32) * 255 + 32767) // 65535).astype(np.uint8)
    elif depth == 8:
        image = value = flat.reshape(height, width, samples)
    else:
        bits = np.unpackbits(flat, axis=1)[:, : width * depth].reshape(height, width, depth)
        value = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[..., None]
        image = value if colour == 3 else (value.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour == 3:
        index = image[..., 0]
        rgb = palette[index]
        if clear is None:
            return rgb
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.dstack([rgb, alpha[index]])
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")
        hidden = (value == key[: value.shape[2]]).all(axis=2)
        return np.dstack([image, np.where(hidden, 0, 255).astype(np.uint8)])
    return image


def encode(image: np.ndarray, depth: int = 8, extra: bytes = b"") -> bytes:
    """A PNG file of height x width (x samples); extra chunks go before the image data."""
    image = image[..., None] if image.ndim == 2 else image
    height, width, samples = image.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    body = image.astype(">u2" if depth == 16 else np.uint8).reshape(height, -1)
    raw = b"".join(b"\0" + row.tobytes() for row in body)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
