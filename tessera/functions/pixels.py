"""Numpy forms of the sample arithmetic; the same rules exist as column expressions in operators.relational."""

from __future__ import annotations

import numpy as np


def scale(v: np.ndarray, top: int, to: int) -> np.ndarray:
    """(v * to + top / 2) div top, so that the largest value maps to the largest."""
    return (v.astype(np.int64) * to + top // 2) // top


def to_u8(v: np.ndarray) -> np.ndarray:
    """8-bit form of 8- or 16-bit integers or of floats; halves are rounded up, NaN is 0."""
    if v.dtype == np.uint8:
        return v
    if v.dtype == np.uint16:
        return ((v.astype(np.uint32) * 255 + 32767) // 65535).astype(np.uint8)
    x = np.clip(np.nan_to_num(v.astype(np.float64), nan=0.0, posinf=1.0, neginf=0.0), 0, 1)
    return np.floor(x * 255 + 0.5).astype(np.uint8)


def cmyk_to_rgb(v: np.ndarray) -> np.ndarray:
    ink = v.astype(np.int32)
    return ((255 - ink[..., :3]) * (255 - ink[..., 3:4]) // 255).astype(np.uint8)


def unpremultiply(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha.astype(np.int32)[..., None]
    return np.where(a > 0, np.minimum(255, (rgb.astype(np.int32) * 255 + a // 2) // np.maximum(a, 1)), 0).astype(np.uint8)


def ycbcr_to_rgb(v: np.ndarray, luma: tuple[float, float, float], reference: tuple[float, ...]) -> np.ndarray:
    """luma: weights of red, green and blue; reference: black and white code of each component."""
    x = v.astype(np.float64)
    y0, y1, b0, b1, r0, r1 = reference
    y = (x[..., 0] - y0) * 255 / (y1 - y0 or 1)
    cb = (x[..., 1] - b0) * 127 / (b1 - b0 or 1)
    cr = (x[..., 2] - r0) * 127 / (r1 - r0 or 1)
    lr, lg, lb = luma
    red, blue = cr * (2 - 2 * lr) + y, cb * (2 - 2 * lb) + y
    green = (y - lb * blue - lr * red) / (lg or 1)
    return np.clip(np.floor(np.stack([red, green, blue], -1) + 0.5), 0, 255).astype(np.uint8)


def orient(image: np.ndarray, orientation: int) -> np.ndarray:
    """Upright form of an image (rows, columns, channels) stored with an orientation of 1 to 8."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    return np.ascontiguousarray(image)


def unpack_bits(data: bytes, rows: int, per_row: int, bits: int) -> np.ndarray:
    """Values of 1 to 64 bits, most significant bit first, rows padded to bytes; short data reads as zeros."""
    row_bytes = (per_row * bits + 7) // 8
    raw = np.frombuffer(data[: rows * row_bytes].ljust(rows * row_bytes, b"\0"), np.uint8).reshape(rows, row_bytes)
    if bits == 8:
        return raw.copy()
    flat = np.unpackbits(raw, axis=1)[:, : per_row * bits].reshape(rows, per_row, bits)
    out = np.zeros((rows, per_row), np.uint64 if bits > 32 else np.uint32)
    for k in range(bits):
        out = out << out.dtype.type(1) | flat[:, :, k]
    return out
