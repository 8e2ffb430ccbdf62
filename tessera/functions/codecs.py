"""Byte-stream codecs: LZW of both families, PackBits, bounded inflate, bitmap run lengths, predictors.

Each is a function of bytes, without Spark; decoders stop when the asked-for
output is full and never produce more.
"""

from __future__ import annotations

import zlib

import numpy as np

from tessera.errors import RasterError

REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def reverse_bits(data: bytes) -> bytes:
    """Bytes of fill order 2 in fill order 1."""
    return data.translate(REVERSED)


# --- LZW of animated images: least significant bit first ---------------------------------------------


def gif_lzw_decode(min_size: int, data: bytes, limit: int) -> tuple[bytes, bool]:
    """(at most limit indices, whether the stream gave all of them)."""
    if not 1 <= min_size <= 11:
        raise RasterError("Invalid", f"minimum code size {min_size}")
    clear, end = 1 << min_size, (1 << min_size) + 1
    roots = [bytes([i]) if i < 256 else None for i in range(clear)] + [b"", b""]
    entries: list = list(roots)
    width, bits, held, at = min_size + 1, 0, 0, 0
    out: list[bytes] = []
    size, previous, n = 0, None, len(data)
    while size < limit:
        while bits < width:
            if at >= n:
                return b"".join(out)[:limit], False
            held |= data[at] << bits
            bits += 8
            at += 1
        code = held & (1 << width) - 1
        held >>= width
        bits -= width
        if code == clear:
            entries = list(roots)
            width, previous = min_size + 1, None
            continue
        if code == end:
            break
        if code < len(entries):
            entry = entries[code]
            if entry is None:
                raise RasterError("Invalid", f"index {code} over 255")
            if previous is not None and len(entries) < 4096:
                entries.append(previous + entry[:1])
        elif code == len(entries) and previous is not None:
            entry = previous + previous[:1]
            if len(entries) < 4096:
                entries.append(entry)
        else:
            raise RasterError("Invalid", f"code {code} before its entry")
        if len(entries) == 1 << width and width < 12:
            width += 1
        out.append(entry)
        size += len(entry)
        previous = entry
    return b"".join(out)[:limit], size >= limit


def gif_lzw_encode(min_size: int, data: bytes) -> bytes:
    if not 2 <= min_size <= 8:
        raise RasterError("BadInput", f"minimum code size {min_size}")
    clear, end = 1 << min_size, (1 << min_size) + 1
    if data and max(data) >= clear:
        raise RasterError("BadInput", "an index does not fit the code size")
    out, held, bits = bytearray(), clear, min_size + 1
    width, free = min_size + 1, end + 1
    known: dict[int, int] = {}

    def flush() -> None:
        nonlocal held, bits
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = known.get(key)
        if code is not None:
            prefix = code
            continue
        held |= prefix << bits
        bits += width
        flush()
        if free < 4096:
            known[key] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        else:
            held |= clear << bits
            bits += width
            flush()
            known = {}
            width, free = min_size + 1, end + 1
        prefix = b
    if prefix >= 0:
        held |= prefix << bits
        bits += width
        flush()
        if free == 1 << width and width < 12:
            width += 1
    held |= end << bits
    bits += width + 7
    flush()
    return bytes(out)


# --- LZW of tagged images ---------------------------------------------------------------------------

CLEAR, END = 256, 257


def tiff_lzw_decode(data: bytes, limit: int) -> bytes:
    """New streams are most significant bit first and widen one code early; old ones begin with 0, 1 and do neither."""
    old = len(data) >= 2 and data[0] == 0 and data[1] & 1 == 1
    roots = [bytes([i]) for i in range(256)] + [b"", b""]
    entries = list(roots)
    early = 0 if old else 1
    width, bits, held, at, size, n = 9, 0, 0, 0, 0, len(data)
    out: list[bytes] = []
    previous = None
    while size < limit:
        while bits < width and at < n:
            if old:
                held |= data[at] << bits
            else:
                held = held << 8 | data[at]
            bits += 8
            at += 1
        if bits < width:
            break
        bits -= width
        if old:
            code = held & (1 << width) - 1
            held >>= width
        else:
            code = held >> bits
            held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            entries = list(roots)
            width, previous = 9, None
            continue
        if code < len(entries):
            entry = entries[code]
        elif code == len(entries) and previous is not None:
            entry = previous + previous[:1]
        else:
            raise RasterError("Invalid", f"code {code} before its entry")
        if previous is not None and len(entries) < 4096:
            entries.append(previous + entry[:1])
        if len(entries) + early >= 1 << width and width < 12:
            width += 1
        out.append(entry)
        size += len(entry)
        previous = entry
    return b"".join(out)[:limit]


def tiff_lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    held, bits, width, free = CLEAR, 9, 9, 258
    known: dict[int, int] = {}
    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = known.get(key)
        if code is not None:
            prefix = code
            continue
        held = held << width | prefix
        bits += width
        known[key] = free
        free += 1
        if free == 4094:  # the table's last usable entry
            held = held << 12 | CLEAR
            bits += 12
            known = {}
            width, free = 9, 258
        elif free + 1 > 1 << width:
            width += 1
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1
        prefix = b
    if prefix >= 0:
        held = held << width | prefix
        bits += width
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    held = held << width | END
    bits += width
    pad = -bits % 8
    held <<= pad
    bits += pad
    return bytes(out) + held.to_bytes(bits // 8, "big")


# --- PackBits ---------------------------------------------------------------------------------------


def packbits_decode(data: bytes, limit: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < limit:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128 and at < n:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out[:limit])


def packbits_encode(row: bytes) -> bytes:
    """Runs of three equal bytes and more are repeated; everything else is literal."""
    out = bytearray()
    n = len(row)
    if not n:
        return b""
    a = np.frombuffer(row, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    lengths = np.diff(np.append(starts, n))
    literal = 0

    def literals(end: int) -> None:
        for i in range(literal, end, 128):
            part = row[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, k in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literals(s)
        literal = s + k
        while k:
            part = min(k, 128)
            if part == 1:
                out += bytes([0, row[s]])
            else:
                out += bytes([257 - part, row[s]])
            k -= part
    literals(n)
    return bytes(out)


# --- deflate ----------------------------------------------------------------------------------------


def inflate(data: bytes, limit: int) -> bytes:
    """At most limit bytes of a zlib stream; its checksum is not asked for."""
    if len(data) < 2 or data[0] & 15 != 8 or (data[0] << 8 | data[1]) % 31:
        raise RasterError("Invalid", "not a zlib stream")
    try:
        return zlib.decompressobj(-15).decompress(data[2:], limit) if limit else b""
    except zlib.error as e:
        raise RasterError("Invalid", str(e)) from e


def deflate(data: bytes, level: int = 6) -> bytes:
    if not 0 <= level <= 9:
        raise RasterError("BadInput", f"level {level}")
    return zlib.compress(data, level)


# --- bitmap run lengths -----------------------------------------------------------------------------


def bmp_rle_decode(data: bytes, bits: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, written) in file row order; values are indices, or blue, green, red for 24 bits."""
    deep = 3 if bits == 24 else 1
    values = np.zeros((height, width, deep), np.uint8)
    written = np.zeros((height, width), bool)
    x = y = at = 0
    n = len(data)
    while at + 1 < n and y < height:
        count, value = data[at], data[at + 1]
        at += 2
        if count or value > 2:
            if count:
                if bits == 24:
                    pixels = np.frombuffer(data[at - 1 : at + 2].ljust(3, b"\0") * count, np.uint8).reshape(-1, 3)
                    at += 2
                elif bits == 8:
                    pixels = np.full((count, 1), value, np.uint8)
                else:
                    pixels = np.resize(np.array([value >> 4, value & 15], np.uint8), (count, 1))
            else:
                count = value
                size = {24: 3 * count, 8: count, 4: (count + 1) // 2}[bits]
                raw = np.frombuffer(data[at : at + size], np.uint8)
                at += size + size % 2
                if bits == 24:
                    pixels = raw[: len(raw) // 3 * 3].reshape(-1, 3)
                elif bits == 8:
                    pixels = raw.reshape(-1, 1)
                else:
                    pixels = np.stack([raw >> 4, raw & 15], 1).reshape(-1, 1)[:count]
            fits = max(0, min(len(pixels), width - x))
            values[y, x : x + fits] = pixels[:fits]
            written[y, x : x + fits] = True
            x += count
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            break
        else:
            if at + 1 >= n:
                break
            x, y = x + data[at], y + data[at + 1]
            at += 2
    return values, written


# --- predictors -------------------------------------------------------------------------------------


def predict(rows: np.ndarray) -> np.ndarray:
    """Differences along rows (rows, width, channels), modulo the word size."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def unpredict(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=1, dtype=rows.dtype)


def float_predict(rows: np.ndarray) -> bytes:
    """Big-endian byte planes of each row of floats, then byte differences over the channels."""
    h, w, c = rows.shape
    size = rows.dtype.itemsize
    planes = rows.astype(rows.dtype.newbyteorder(">")).reshape(h, w * c).view(np.uint8).reshape(h, w * c, size).transpose(0, 2, 1).reshape(h, -1)
    out = planes.copy()
    out[:, c:] -= planes[:, :-c]
    return out.tobytes()


def float_unpredict(data: bytes, h: int, w: int, c: int, size: int) -> np.ndarray:
    """Big-endian words of rows of floats."""
    a = np.frombuffer(data, np.uint8).reshape(h, size * w, c)
    planes = np.cumsum(a, axis=1, dtype=np.uint8).reshape(h, size, w * c)
    words = np.ascontiguousarray(planes.transpose(0, 2, 1))
    return words.view(f">f{size}").reshape(h, w, c)
