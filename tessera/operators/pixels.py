"""Sample arithmetic as column expressions: everything stays in generated code, no Python on the path.

Integers are BIGINT throughout, so that modular arithmetic cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("long")


def idiv(a: Column, b) -> Column:
    """Integer quotient of non-negative numbers."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("long"), b.cast("long"))


def scale(v: Column, top: int, to: int) -> Column:
    return idiv(long(v) * to + top // 2, top)


def mask_channel(word: Column, mask: int) -> Column:
    """8-bit value of the bits under a mask, from its lowest to its highest set bit."""
    if not mask:
        return F.lit(0).cast("long")
    low = (mask & -mask).bit_length() - 1
    top = (1 << mask.bit_length() - low) - 1
    return scale(F.shiftrightunsigned(long(word).bitwiseAND(F.lit(mask).cast("long")), low), top, 255)


def palette_index(byte: Column, k: int, bits: int) -> Column:
    """The k-th index in a byte of packed indices, most significant first."""
    return F.shiftrightunsigned(long(byte), 8 - bits * (k + 1)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def signed_to_unsigned(v: Column, bits: int) -> Column:
    return long(v).bitwiseXOR(F.lit(1 << bits - 1).cast("long"))


def invert(v: Column, bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("long") - long(v)


def float_to_u8(v: Column) -> Column:
    x = v.cast("double")
    x = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.floor(x * 255 + 0.5).cast("long")


def u16_to_u8(v: Column) -> Column:
    return scale(v, 65535, 255)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, luma=(0.299, 0.587, 0.114), reference=(0.0, 255.0, 128.0, 255.0, 128.0, 255.0)) -> list[Column]:
    y0, y1, b0, b1, r0, r1 = reference
    lr, lg, lb = luma
    a = (y.cast("double") - y0) * 255 / (y1 - y0)
    b = (cb.cast("double") - b0) * 127 / (b1 - b0)
    c = (cr.cast("double") - r0) * 127 / (r1 - r0)
    red, blue = c * (2 - 2 * lr) + a, b * (2 - 2 * lb) + a
    green = (a - lb * blue - lr * red) / lg
    return [F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("long") for v in (red, green, blue)]


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [idiv((255 - long(v)) * (255 - long(k)), 255) for v in (c, m, y)]


def unpremultiply(v: Column, a: Column) -> Column:
    a = long(a)
    return F.when(a > 0, F.least(F.lit(255).cast("long"), idiv(long(v) * 255 + idiv(a, 2), F.greatest(a, F.lit(1).cast("long"))))).otherwise(F.lit(0).cast("long"))


def alpha_threshold(channels: list[Column], alpha: Column, threshold: int = 128) -> list[Column]:
    """Channels and alpha of a pixel made wholly opaque or wholly transparent."""
    zero = F.lit(0).cast("long")
    return [*(F.when(alpha < threshold, zero).otherwise(long(c)) for c in channels), F.when(alpha < threshold, zero).otherwise(F.lit(255).cast("long"))]


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(long(r), 16).bitwiseOR(F.shiftleft(long(g), 8)).bitwiseOR(long(b))


def unpack_rgb(packed: Column) -> list[Column]:
    byte = F.lit(255).cast("long")
    return [F.shiftrightunsigned(long(packed), s).bitwiseAND(byte) for s in (16, 8, 0)]


def table_bits(n: Column) -> Column:
    """Bits that index a table of n entries, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))).cast("long")


def bottom_up(y: Column, height) -> Column:
    return long(height) - 1 - long(y)


def interlaced_row(stored: Column, height: Column) -> Column:
    """Row of the image for a stored row of four interlace passes."""
    h, s = long(height), long(stored)
    n1, n2, n3 = idiv(h + 7, 8), idiv(h + 3, 8), idiv(h + 1, 4)
    return F.when(s < n1, s * 8).when(s < n1 + n2, (s - n1) * 8 + 4).when(s < n1 + n2 + n3, (s - n1 - n2) * 4 + 2).otherwise((s - n1 - n2 - n3) * 2 + 1)


def oriented(y: Column, x: Column, height: Column, width: Column, orientation: Column) -> tuple[Column, Column]:
    """(row, column) of a stored pixel in the upright image; width and height are those of the stored image."""
    o, y, x = orientation, long(y), long(x)
    back_y, back_x = long(height) - 1 - y, long(width) - 1 - x
    row = F.when(o.isin(1, 2), y).when(o.isin(3, 4), back_y).when(o.isin(5, 6), x).otherwise(back_x)
    column = F.when(o.isin(1, 4), x).when(o.isin(2, 3), back_x).when(o.isin(5, 8), y).otherwise(back_y)
    return row, column


def inferred_photometric(photometric: Column, compression: Column, samples: Column) -> Column:
    return F.coalesce(photometric, F.when(compression.isin(2, 3, 4), 0).when(samples >= 3, 2).otherwise(1))


def channels_of(color: Column) -> Column:
    return F.when(color == "Gray", 1).when(color == "GrayAlpha", 2).when(color == "Rgb", 3).when(color.isin("Rgba", "Cmyk"), 4).when(color == "CmykAlpha", 5).cast("long")


def magic(content: Column) -> Column:
    """Container of a file by its first bytes, or null."""
    first = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(first(6).isin("474946383761", "474946383961"), "gif")
        .when(first(2) == "424D", "bmp")
        .when(first(4).isin("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff")
    )


def limit_error(width: Column, height: Column, max_pixels: int) -> Column:
    """Kind of the error that a reader gives before it takes memory, or null."""
    return F.when((width < 1) | (height < 1), "Invalid").when(long(width) * long(height) > max_pixels, "LimitExceeded")


def bytes_of(values: Column) -> Column:
    """Binary of an array of numbers from 0 to 255."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
