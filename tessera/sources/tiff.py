"""Tagged image files: directories, strips and tiles, samples, display forms, and a writer."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from tessera.errors import Limits, RasterError
from tessera.functions.codecs import (
    deflate,
    float_unpredict,
    inflate,
    packbits_decode,
    packbits_encode,
    predict,
    reverse_bits,
    tiff_lzw_decode,
    tiff_lzw_encode,
    unpredict,
)
from tessera.functions.fax import fax_decode
from tessera.functions.pixels import cmyk_to_rgb, orient, scale, to_u8, unpack_bits, unpremultiply, ycbcr_to_rgb

# Field types with their struct letters.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
COMPRESSION = {1: "None", 2: "CcittMh", 3: "CcittG3", 4: "CcittG4", 5: "Lzw", 6: "OldJpeg", 7: "Jpeg", 8: "Deflate", 32946: "Deflate", 32773: "PackBits"}
PHOTOMETRIC = {0: "WhiteIsZero", 1: "BlackIsZero", 2: "Rgb", 3: "Palette", 4: "Mask", 5: "Cmyk", 6: "YCbCr", 8: "CieLab"}
FORMAT = {1: "Uint", 2: "Int", 3: "Float", 4: "Undefined"}
CHANNELS = {"Gray": 1, "GrayAlpha": 2, "Rgb": 3, "Rgba": 4, "Cmyk": 4, "CmykAlpha": 5}


def named(table: dict, code: int) -> str:
    return table.get(code, f"Other({code})")


@dataclass
class Entry:
    type: int
    count: int
    at: int


@dataclass
class PageInfo:
    big_tiff: bool
    big_endian: bool
    width: int
    height: int
    bits_per_sample: list[int]
    samples_per_pixel: int
    sample_format: str
    photometric: str
    compression: str
    planar: str
    tile_w: int | None
    tile_h: int | None
    rows_per_strip: int
    predictor: int
    orientation: int
    extra_samples: list[int]
    icc_profile: bytes | None
    x_res: float | None
    y_res: float | None
    res_unit: int
    subfile_type: int
    page_no: int | None
    page_total: int | None


@dataclass
class Chunk:
    idx: int
    plane: int
    x0: int
    y0: int
    width: int
    rows: int
    offset: int | None
    byte_count: int | None


@dataclass
class TiffImage:
    info: PageInfo
    color: str
    samples: np.ndarray
    premultiplied: bool
    incomplete: bool = False

    def to_rgba8(self) -> np.ndarray:
        v = to_u8(self.samples)
        if self.color.startswith("Gray"):
            rgb, alpha = np.repeat(v[..., :1], 3, -1), v[..., 1:2]
        elif self.color.startswith("Cmyk"):
            rgb, alpha = cmyk_to_rgb(v), v[..., 4:5]
        else:
            rgb, alpha = v[..., :3], v[..., 3:4]
        if not alpha.shape[-1]:
            alpha = np.full((*v.shape[:2], 1), 255, np.uint8)
        elif self.premultiplied:
            rgb = unpremultiply(rgb, alpha[..., 0])
        return np.concatenate([rgb, alpha], -1)

    def to_rgba8_upright(self) -> np.ndarray:
        return orient(self.to_rgba8(), self.info.orientation)

    @property
    def sample_type(self) -> str:
        return {"u1": "U8", "u2": "U16", "f4": "F32"}[self.samples.dtype.str[1:]]


class Tiff:
    """All directories of a file; pages are decoded one at a time."""

    def __init__(self, data: bytes, limits: Limits = Limits()):
        self.data, self.limits = data, limits
        if data[:2] not in (b"II", b"MM"):
            raise RasterError("Invalid", "not a tagged image file")
        self.e = "<" if data[:2] == b"II" else ">"
        if len(data) < 8:
            raise RasterError("Truncated", "header")
        magic = struct.unpack_from(self.e + "H", data, 2)[0]
        if magic not in (42, 43):
            raise RasterError("Invalid", "not a tagged image file")
        self.big = magic == 43
        if self.big:
            if len(data) < 16:
                raise RasterError("Truncated", "header")
            if struct.unpack_from(self.e + "HH", data, 4) != (8, 0):
                raise RasterError("Invalid", "offset size")
        at = struct.unpack_from(self.e + ("Q" if self.big else "I"), data, 8 if self.big else 4)[0]
        self.directories: list[dict[int, Entry]] = []
        seen = set()
        while at and at not in seen and at < len(data):
            if limits.max_pages is not None and len(self.directories) >= limits.max_pages:
                break  # the first pages stay readable
            seen.add(at)
            try:
                tags, at = self.directory(at)
            except struct.error:
                break
            self.directories.append(tags)
        if not self.directories:
            raise RasterError("Truncated", "no directory")

    def directory(self, at: int) -> tuple[dict[int, Entry], int]:
        e, big = self.e, self.big
        n = struct.unpack_from(e + ("Q" if big else "H"), self.data, at)[0]
        at += 8 if big else 2
        step = 20 if big else 12
        n = min(n, max(0, len(self.data) - at) // step)
        tags: dict[int, Entry] = {}
        for k in range(n):
            here = at + step * k
            tag, kind = struct.unpack_from(e + "HH", self.data, here)
            count = struct.unpack_from(e + ("Q" if big else "I"), self.data, here + 4)[0]
            if kind not in SIZE:
                continue
            value = here + (12 if big else 8)
            if SIZE[kind] * count > (8 if big else 4):
                value = struct.unpack_from(e + ("Q" if big else "I"), self.data, value)[0]
            tags.setdefault(tag, Entry(kind, count, value))
        at += step * n
        following = struct.unpack_from(e + ("Q" if big else "I"), self.data, at)[0] if at + (8 if big else 4) <= len(self.data) else 0
        return tags, following

    # -- fields ------------------------------------------------------------------------------------

    def raw(self, tags: dict[int, Entry], tag: int) -> tuple[Entry, bytes] | None:
        entry = tags.get(tag)
        if entry is None:
            return None
        size = SIZE[entry.type] * entry.count
        if entry.at + size > len(self.data):
            return None
        return entry, self.data[entry.at : entry.at + size]

    def ints(self, tags: dict[int, Entry], tag: int) -> list[int] | None:
        found = self.raw(tags, tag)
        if found is None or found[0].type not in (1, 3, 4, 6, 8, 9, 13, 16, 17, 18) or not found[0].count:
            return None
        return list(struct.unpack(f"{self.e}{found[0].count}{FIELD[found[0].type]}", found[1]))

    def int(self, tags: dict[int, Entry], tag: int, default=None):
        found = self.ints(tags, tag)
        return found[0] if found else default

    def floats(self, tags: dict[int, Entry], tag: int) -> list[float] | None:
        found = self.raw(tags, tag)
        if found is None or not found[0].count:
            return None
        entry, data = found
        if entry.type in (5, 10):
            v = struct.unpack(f"{self.e}{2 * entry.count}{FIELD[entry.type][0]}", data)
            return [a / max(b, 1) for a, b in zip(v[::2], v[1::2], strict=True)]
        if entry.type in (11, 12):
            return list(struct.unpack(f"{self.e}{entry.count}{FIELD[entry.type]}", data))
        return [float(x) for x in self.ints(tags, tag) or []] or None

    def tags(self, page: int) -> Iterator[tuple[int, int, int, list[int] | None, list[float] | None, bytes | None]]:
        """(tag, type, count, ints, floats, raw) of a directory."""
        d = self.directories[page]
        for tag, entry in sorted(d.items()):
            found = self.raw(d, tag)
            ints = self.ints(d, tag)
            if ints and max(ints) >= 1 << 63:
                ints = None
            yield tag, entry.type, entry.count, ints, self.floats(d, tag) if entry.type in (5, 10, 11, 12) else None, found[1] if found and entry.type in (1, 2, 6, 7) else None

    def info(self, page: int) -> PageInfo:
        d = self.directories[page]
        w, h = self.int(d, 256), self.int(d, 257)
        if w is None or h is None:
            raise RasterError("Invalid", "no dimensions")
        if w < 1 or h < 1:
            raise RasterError("Invalid", "a dimension is zero")
        spp = self.int(d, 277, 1)
        code = self.int(d, 259, 1)
        photometric = self.int(d, 262)
        if photometric is None:
            photometric = 0 if code in (2, 3, 4) else 2 if spp >= 3 else 1
        planar = self.int(d, 284, 1) == 2 and spp > 1
        tile_w, tile_h = self.tile(d, w, h, spp if planar else 1)
        rows = self.int(d, 278, h)
        icc = self.raw(d, 34675)
        number = self.ints(d, 297) or []
        res = [(self.floats(d, t) or [None])[0] for t in (282, 283)]
        return PageInfo(
            self.big, self.e == ">", w, h, self.ints(d, 258) or [1], spp, named(FORMAT, self.int(d, 339, 1)), named(PHOTOMETRIC, photometric), named(COMPRESSION, code),
            "Planar" if planar else "Chunky", tile_w, tile_h, max(1, min(rows, h)), self.int(d, 317, 1), o if 1 <= (o := self.int(d, 274, 1)) <= 8 else 1,
            self.ints(d, 338) or [], icc[1] if icc else None, *res, self.int(d, 296, 2), self.int(d, 254, 0), number[0] if number else None, number[1] if len(number) > 1 else None,
        )

    # -- strips and tiles --------------------------------------------------------------------------

    def tile(self, d: dict[int, Entry], w: int, h: int, planes: int) -> tuple[int, int] | tuple[None, None]:
        """Tile dimensions, where tiles have places of their own or there is a strip's place for each of them."""
        tw, th = self.int(d, 322), self.int(d, 323)
        if not tw or not th:
            return None, None
        strips = d.get(273)
        own = 324 in d or strips is not None and strips.count == -(-w // tw) * -(-h // th) * planes
        return (tw, th) if own else (None, None)

    def places(self, page: int, info: PageInfo) -> tuple[list[int], list[int]]:
        """Offsets and sizes of strips or tiles; sizes may lack."""
        d = self.directories[page]
        at, size = (324, 325) if info.tile_w is not None and 324 in d else (273, 279)
        offsets = self.ints(d, at)
        if not offsets:
            raise RasterError("Invalid", "no strip or tile offsets")
        return offsets, self.ints(d, size) or []

    def chunks(self, page: int, info: PageInfo | None = None, wanted: Iterable[int] | None = None) -> Iterator[Chunk]:
        """Geometry and place of every strip or tile, or of the wanted ones.

        The place is None where the file lists fewer; a size that the file lacks is the
        stored size of uncompressed data and else what is left of the file.
        """
        info = info or self.info(page)
        cw, ch = (info.tile_w, info.tile_h) if info.tile_w is not None else (info.width, info.rows_per_strip)
        if self.limits.max_pixels is not None and info.tile_w is not None and cw * ch > max(self.limits.max_pixels, 0):
            raise RasterError("LimitExceeded", f"tiles of {cw} x {ch} pixels")
        offsets, counts = self.places(page, info)
        planes = info.samples_per_pixel if info.planar == "Planar" else 1
        across, down = -(-info.width // cw), -(-info.height // ch)
        for idx in range(across * down * planes) if wanted is None else wanted:
            plane, rest = divmod(idx, across * down)
            y, x = divmod(rest, across)
            rows = ch if info.tile_w is not None else min(ch, info.height - y * ch)
            chunk = Chunk(idx, plane, x * cw, y * ch, cw, rows, None, None)
            if idx < len(offsets):
                chunk.offset = offsets[idx]
                if idx < len(counts):
                    chunk.byte_count = counts[idx]
                elif info.compression == "None":
                    chunk.byte_count = self.stored_size(page, info, chunk)
                else:
                    chunk.byte_count = max(0, len(self.data) - chunk.offset)
            yield chunk

    def subsampling(self, page: int, info: PageInfo) -> tuple[int, int] | None:
        """Pixels of a unit of subsampled components across and down."""
        if info.photometric != "YCbCr":
            return None
        sx, sy = ((self.ints(self.directories[page], 530) or [2, 2]) + [2])[:2]
        if sx not in (1, 2, 4) or sy not in (1, 2, 4):
            raise RasterError("Invalid", "subsampling")
        if (sx, sy) == (1, 1):
            return None
        if info.planar == "Planar" or info.samples_per_pixel != 3 or info.bits_per_sample[0] != 8:
            raise RasterError("Unsupported", "subsampled components")
        return sx, sy

    def stored_size(self, page: int, info: PageInfo, chunk: Chunk) -> int:
        """Bytes of a strip or tile before compression."""
        units = self.subsampling(page, info)
        if units:
            return -(-chunk.width // units[0]) * -(-chunk.rows // units[1]) * (units[0] * units[1] + 2)
        channels = 1 if info.planar == "Planar" else info.samples_per_pixel
        return chunk.rows * ((chunk.width * channels * info.bits_per_sample[0] + 7) // 8)

    def chunk_rows(self, page: int, info: PageInfo, chunk: Chunk, bits: int) -> tuple[np.ndarray, bool]:
        """(values (rows, width, channels), whether data were missing) of a strip or tile; values in file codes."""
        d = self.directories[page]
        channels = 1 if info.planar == "Planar" else info.samples_per_pixel
        w, h = chunk.width, chunk.rows
        packed = self.subsampling(page, info)
        size = self.stored_size(page, info, chunk)
        if packed:
            if info.predictor != 1:
                raise RasterError("Unsupported", "a predictor with subsampled components")
            sx, sy = packed
            units = (-(-h // sy), -(-w // sx))
        if self.limits.max_alloc is not None and max(size, h * w * channels * 8) > self.limits.max_alloc:
            raise RasterError("LimitExceeded", "bytes of a strip or tile")
        if chunk.offset is None or chunk.byte_count is None:
            data, missing = b"", True
        else:
            data = self.data[chunk.offset : chunk.offset + chunk.byte_count]
            missing = False
            if self.int(d, 266, 1) == 2:
                data = reverse_bits(data)
            code = info.compression
            if code == "Lzw":
                data = tiff_lzw_decode(data, size)
            elif code == "PackBits":
                data = packbits_decode(data, size)
            elif code == "Deflate":
                data = inflate(data, size)
            elif code.startswith("Ccitt"):
                if bits != 1 or channels != 1:
                    raise RasterError("Invalid", "facsimile of more than one bit")
                options = 0 if code == "CcittMh" else self.int(d, 293 if code == "CcittG4" else 292, 0)
                if options & 2:
                    raise RasterError("Unsupported", "facsimile in uncompressed mode")
                scheme = {"CcittMh": "mh", "CcittG4": "g4"}.get(code) or ("g3-2d" if options & 1 else "g3-1d")
                data = fax_decode(data, w, h, scheme)
                if info.photometric == "BlackIsZero":
                    data = bytes(255 - b for b in data)
            elif code != "None":
                raise RasterError("Unsupported", code)
            missing = len(data) < size
        data = data[:size].ljust(size, b"\0")
        if packed:
            units_ = np.frombuffer(data, np.uint8).reshape(*units, sx * sy + 2)
            out = np.empty((units[0] * sy, units[1] * sx, 3), np.uint8)
            out[..., 0] = units_[..., : sx * sy].reshape(*units, sy, sx).transpose(0, 2, 1, 3).reshape(units[0] * sy, -1)
            for k in (1, 2):
                out[..., k] = units_[..., sx * sy + k - 1].repeat(sy, 0).repeat(sx, 1)
            return out[:h, :w], missing
        word = {8: "u1", 16: "u2", 32: "u4", 64: "u8"}.get(bits)
        if info.predictor not in (1, 2, 3):
            raise RasterError("Unsupported", f"predictor {info.predictor}")
        if info.predictor == 3:
            if info.sample_format != "Float":
                raise RasterError("Invalid", "a predictor for floats on integers")
            if bits not in (16, 32, 64):
                raise RasterError("Unsupported", f"predictor 3 with {bits} bits")
            return float_unpredict(data, h, w, channels, bits // 8).view(f">u{bits // 8}").astype(word), missing
        if info.predictor == 2 and not word:
            raise RasterError("Unsupported", f"predictor 2 with {bits} bits")
        if bits == 24:
            raw = np.frombuffer(data, np.uint8).reshape(h, w, channels, 3).astype(np.uint32)
            order = (0, 1, 2) if self.e == ">" else (2, 1, 0)
            return raw[..., order[0]] << 16 | raw[..., order[1]] << 8 | raw[..., order[2]], missing
        if word:
            values = np.frombuffer(data, self.e + word).reshape(h, w, channels).astype(word)
            return (unpredict(values) if info.predictor == 2 else values), missing
        return unpack_bits(data, h, w * channels, bits).reshape(h, w, channels), missing

    def decode(self, page: int) -> TiffImage:
        d, info = self.directories[page], self.info(page)
        self.limits.check_pixels(info.width, info.height)
        bits = info.bits_per_sample[0]
        spp = info.samples_per_pixel
        if spp < 1:
            raise RasterError("Invalid", "no samples")
        if spp > 65535 or any(b != bits for b in info.bits_per_sample):
            raise RasterError("Unsupported", "samples of different depths")
        kind = info.sample_format
        if not (kind == "Float" and bits in (16, 32, 64) or kind in ("Uint", "Int") and 1 <= bits <= 32):
            raise RasterError("Unsupported", f"{bits} bits of {kind}")
        if info.photometric not in ("WhiteIsZero", "BlackIsZero", "Rgb", "Palette", "Cmyk", "YCbCr"):
            raise RasterError("Unsupported", info.photometric)
        if info.photometric == "Cmyk" and (self.int(d, 332, 1) != 1 or spp < 4):
            raise RasterError("Unsupported", "inks other than four")
        if self.limits.max_alloc is not None and info.width * info.height * spp * 8 > self.limits.max_alloc:
            raise RasterError("LimitExceeded", "bytes of a page")
        if info.compression not in ("None", "Lzw", "PackBits", "Deflate", "CcittMh", "CcittG3", "CcittG4"):
            raise RasterError("Unsupported", info.compression)
        if info.tile_w is not None and info.tile_w * bits * (1 if info.planar == "Planar" else spp) % 8:
            raise RasterError("Unsupported", "tiles that do not start at a byte")
        canvas: np.ndarray | None = None
        incomplete = False
        for chunk in self.chunks(page, info):
            if canvas is not None and chunk.offset is None:
                incomplete = True  # what has no place stays zero
                break
            values, missing = self.chunk_rows(page, info, chunk, bits)
            incomplete |= missing
            if canvas is None:
                canvas = np.zeros((info.height, info.width, spp), values.dtype)
            h, w = min(chunk.rows, info.height - chunk.y0), min(chunk.width, info.width - chunk.x0)
            at = slice(chunk.plane, chunk.plane + 1) if info.planar == "Planar" else slice(None)
            canvas[chunk.y0 : chunk.y0 + h, chunk.x0 : chunk.x0 + w, at] = values[:h, :w]
        image = self.interpret(page, info, canvas, bits)
        image.incomplete = incomplete
        return image

    def interpret(self, page: int, info: PageInfo, values: np.ndarray, bits: int) -> TiffImage:
        d, kind, spp = self.directories[page], info.photometric, info.samples_per_pixel
        if kind == "Palette":
            table = self.ints(d, 320)
            if table is None or bits > 16 or info.sample_format != "Uint" or len(table) < 3 << bits:
                raise RasterError("Invalid", "no colour map of this depth")
            lut = np.array(table[: 3 << bits], np.uint16).reshape(3, -1).T
            return TiffImage(info, "Rgb", lut[values[..., 0]], False)
        base = {"Rgb": 3, "YCbCr": 3, "Cmyk": 4}.get(kind, 1)
        if spp < base:
            raise RasterError("Invalid", "too few samples")
        if kind == "YCbCr":
            if bits != 8:
                raise RasterError("Unsupported", "components of other than 8 bits")
            luma = self.floats(d, 529) or [0.299, 0.587, 0.114]
            reference = self.floats(d, 532) or [0, 255, 128, 255, 128, 255]
            rgb = ycbcr_to_rgb(values[..., :3], tuple(luma[:3]), tuple(reference[:6]))
            values = np.concatenate([rgb, values[..., 3:]], -1)
        elif info.sample_format == "Float":
            f = values.view({16: np.float16, 32: np.float32, 64: np.float64}[bits]).astype(np.float32)
            if kind == "WhiteIsZero":
                f = np.concatenate([1 - f[..., :1], f[..., 1:]], -1)
            values = f
        else:
            top = (1 << bits) - 1
            wide = values.astype(np.int64)
            if info.sample_format == "Int":
                wide ^= 1 << bits - 1
            if kind == "WhiteIsZero":
                wide[..., 0] = top - wide[..., 0]
            if bits <= 8:
                values = (wide if bits == 8 else scale(wide, top, 255)).astype(np.uint8)
            else:
                values = (wide if bits == 16 else scale(wide, top, 65535)).astype(np.uint16)
        extra = info.extra_samples
        alpha = spp > base and bool(extra) and extra[0] in (1, 2)
        name = {3: "Rgb", 4: "Cmyk", 1: "Gray"}[base]
        name += ("a" if name == "Rgb" else "Alpha") if alpha else ""
        return TiffImage(info, name, np.ascontiguousarray(values[..., : base + alpha]), alpha and extra[0] == 1)


def decode(data: bytes, limits: Limits = Limits()) -> TiffImage:
    return Tiff(data, limits).decode(0)


def decode_pages(data: bytes, limits: Limits = Limits()) -> list[TiffImage]:
    t = Tiff(data, limits)
    return [t.decode(i) for i in range(len(t.directories))]


# --- writing ----------------------------------------------------------------------------------------

#: Name: channels, sample type, photometric, has alpha.
PIXEL_FORMATS = {
    "Gray8": (1, "u1", 1, False), "Gray16": (1, "u2", 1, False), "GrayF32": (1, "f4", 1, False), "GrayAlpha8": (2, "u1", 1, True), "GrayAlpha16": (2, "u2", 1, True),
    "Rgb8": (3, "u1", 2, False), "Rgb16": (3, "u2", 2, False), "RgbF32": (3, "f4", 2, False), "Rgba8": (4, "u1", 2, True), "Rgba16": (4, "u2", 2, True), "Cmyk8": (4, "u1", 5, False),
}


@dataclass(frozen=True)
class EncodeOptions:
    compression: str = "None"
    predictor: bool = False
    level: int = 6
    strip_bytes: int = 65_536
    big_tiff: bool = False
    big_endian: bool = False


@dataclass
class Encoder:
    options: EncodeOptions = EncodeOptions()
    pages: list = field(default_factory=list)

    def add_page(self, samples: np.ndarray, pixel_format: str) -> None:
        """samples (rows, columns, channels) of the format's type."""
        if pixel_format not in PIXEL_FORMATS:
            raise RasterError("BadInput", f"format {pixel_format}")
        channels, kind, photometric, alpha = PIXEL_FORMATS[pixel_format]
        if samples.ndim != 3 or samples.shape[2] != channels or 0 in samples.shape or samples.dtype.str[1:] != kind:
            raise RasterError("BadInput", "samples do not fit the format")
        o = self.options
        if o.compression not in ("None", "PackBits", "Lzw", "Deflate") or o.strip_bytes < 1 or not 0 <= o.level <= 9:
            raise RasterError("BadInput", "options")
        h, w, _ = samples.shape
        order = ">" if o.big_endian else "<"
        predictor = 1
        rows = samples.astype(order + kind)
        if o.predictor and o.compression in ("Lzw", "Deflate"):
            predictor = 3 if kind == "f4" else 2
        per_row = w * channels * samples.dtype.itemsize
        step = max(1, o.strip_bytes // per_row)
        strips = []
        for y in range(0, h, step):
            part = samples[y : y + step]
            if predictor == 2:
                data = predict(part).astype(order + kind).tobytes()
            elif predictor == 3:
                planes = part.astype(">f4").reshape(len(part), -1).view(np.uint8).reshape(len(part), -1, 4).transpose(0, 2, 1).reshape(len(part), -1)
                diff = planes.copy()
                diff[:, channels:] -= planes[:, :-channels]
                data = diff.tobytes()
            else:
                data = rows[y : y + step].tobytes()
            if o.compression == "PackBits":
                data = b"".join(packbits_encode(data[i : i + per_row]) for i in range(0, len(data), per_row))
            elif o.compression == "Lzw":
                data = tiff_lzw_encode(data)
            elif o.compression == "Deflate":
                data = deflate(data, o.level)
            strips.append(data)
        bits = 8 * samples.dtype.itemsize
        tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * channels), 259: (3, [{"None": 1, "PackBits": 32773, "Lzw": 5, "Deflate": 8}[o.compression]]), 262: (3, [photometric]), 277: (3, [channels]), 278: (4, [min(step, h)]), 284: (3, [1])}
        tags |= {282: (5, [72, 1]), 283: (5, [72, 1]), 296: (3, [2])}
        if predictor != 1:
            tags[317] = (3, [predictor])
        if alpha:
            tags[338] = (3, [2])
        if kind == "f4":
            tags[339] = (3, [3] * channels)
        if photometric == 5:
            tags[332] = (3, [1])
        self.pages.append((tags, strips))

    def finish(self) -> bytes:
        if not self.pages:
            raise RasterError("BadInput", "no pages")
        o = self.options
        size = sum(len(s) + 1 for _, strips in self.pages for s in strips)
        big = o.big_tiff or size > (1 << 32) - (1 << 20)
        e, word = (">" if o.big_endian else "<"), ("Q" if big else "I")
        inline = 8 if big else 4
        out = bytearray((b"MM" if o.big_endian else b"II") + (struct.pack(e + "HHHQ", 43, 8, 0, 0) if big else struct.pack(e + "HI", 42, 0)))
        link = 8 if big else 4
        for n, (tags, strips) in enumerate(self.pages):
            places = []
            for s in strips:
                out += bytes(len(out) % 2)
                places.append(len(out))
                out += s
            full = dict(tags)
            full[273] = (16 if big else 4, places)
            full[279] = (16 if big else 4, [len(s) for s in strips])
            if len(self.pages) > 1:
                full[254] = (4, [2])
                full[297] = (3, [n, len(self.pages)])
            entries = b""
            for tag, (kind, values) in sorted(full.items()):
                count = len(values) // (2 if kind == 5 else 1)
                data = struct.pack(f"{e}{len(values)}{FIELD[kind][0]}", *values)
                if len(data) > inline:
                    out += bytes(len(out) % 2)
                    at = len(out)
                    out += data
                    data = struct.pack(e + word, at)
                entries += struct.pack(e + "HH" + word, tag, kind, count) + data.ljust(inline, b"\0")
            out += bytes(len(out) % 2)
            struct.pack_into(e + word, out, link, len(out))
            out += struct.pack(e + ("Q" if big else "H"), len(full)) + entries
            link = len(out)
            out += bytes(8 if big else 4)
        return bytes(out)


def encode(samples: np.ndarray, pixel_format: str, options: EncodeOptions = EncodeOptions()) -> bytes:
    e = Encoder(options)
    e.add_page(samples, pixel_format)
    return e.finish()
