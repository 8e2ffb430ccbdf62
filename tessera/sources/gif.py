"""Animated images: blocks, composited frames, and a writer with frame differencing."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from tessera.errors import Limits, RasterError
from tessera.functions.codecs import gif_lzw_decode, gif_lzw_encode
from tessera.functions.palette import build, dither, histogram, nearest, pack_rgb

DISPOSAL = {0: "Unspecified", 1: "Keep", 2: "Background", 3: "Previous"}
CODE = {v: k for k, v in DISPOSAL.items()}


@dataclass
class GifInfo:
    version: str
    width: int
    height: int
    global_palette: np.ndarray | None
    background_index: int
    aspect_ratio: int

    @property
    def background(self) -> tuple[int, int, int] | None:
        p = self.global_palette
        return tuple(p[self.background_index].tolist()) if p is not None and self.background_index < len(p) else None


@dataclass
class Frame:
    rgba: np.ndarray
    delay_cs: int
    disposal: str
    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    user_input: bool
    incomplete: bool


@dataclass
class Animation:
    info: GifInfo
    frames: list[Frame] = field(default_factory=list)
    loop_count: int | None = None
    comments: list[bytes] = field(default_factory=list)
    icc_profile: bytes | None = None


def interlaced_rows(height: int) -> np.ndarray:
    """Row of the image at which each stored row belongs."""
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


class Decoder:
    """Yields composited frames one by one; extensions met so far are attributes."""

    def __init__(self, data: bytes, limits: Limits = Limits()):
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise RasterError("Truncated" if len(data) < 6 and (b"GIF87a".startswith(data) or b"GIF89a".startswith(data)) else "Invalid", "not an animation")
        if len(data) < 13:
            raise RasterError("Truncated", "header")
        w, h, flags, background, aspect = struct.unpack_from("<HHBBB", data, 6)
        self.data, self.limits, self.at = data, limits, 13
        limits.check_pixels(w, h)
        palette = self.palette(flags) if flags & 128 else None
        self.info = GifInfo(data[3:6].decode(), w, h, palette, background, aspect)
        self.loop_count: int | None = None
        self.comments: list[bytes] = []
        self.icc_profile: bytes | None = None

    def palette(self, flags: int) -> np.ndarray:
        size = 3 << (flags & 7) + 1
        if self.at + size > len(self.data):
            raise RasterError("Truncated", "palette")
        out = np.frombuffer(self.data, np.uint8, size, self.at).reshape(-1, 3)
        self.at += size
        return out

    def sub_blocks(self) -> tuple[bytes, bool]:
        """Joined data of the blocks that follow, and whether their end was found."""
        parts, data, n = [], self.data, len(self.data)
        while self.at < n:
            size = data[self.at]
            self.at += 1
            if not size:
                return b"".join(parts), True
            parts.append(data[self.at : self.at + size])
            self.at += size
        return b"".join(parts), False

    def extension(self, control: list) -> None:
        label = self.data[self.at] if self.at < len(self.data) else 0
        self.at += 1
        if label == 0xFF:
            size = self.data[self.at] if self.at < len(self.data) else 0
            name = self.data[self.at + 1 : self.at + 1 + size]
            self.at += 1 + size
            body, _ = self.sub_blocks()
            if name in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 3 and body[0] == 1:
                self.loop_count = body[1] | body[2] << 8
            elif name == b"ICCRGBG1012":
                self.icc_profile = body
            return
        body, _ = self.sub_blocks()
        if label == 0xF9 and len(body) >= 4:
            control[:] = [body[0], body[1] | body[2] << 8, body[3]]
        elif label == 0xFE:
            self.comments.append(body)
        elif label == 0x01:
            control.clear()

    def __iter__(self) -> Iterator[Frame]:
        info, data, n = self.info, self.data, len(self.data)
        canvas = np.zeros((info.height, info.width, 4), np.uint8)
        undo = None  # (disposal, rows, columns, saved)
        count = total = 0
        control: list = []
        while True:
            if self.at >= n:
                if not count:
                    raise RasterError("Truncated", "no image")
                return
            kind = data[self.at]
            self.at += 1
            if kind == 0x3B:
                return
            if kind == 0x21:
                self.extension(control)
                continue
            if kind != 0x2C:
                if count:
                    return
                raise RasterError("Invalid", f"block {kind}")
            if self.at + 9 > n:
                if count:
                    return
                raise RasterError("Truncated", "image descriptor")
            count += 1
            total += canvas.nbytes
            if self.limits.max_frames is not None and count > self.limits.max_frames:
                raise RasterError("LimitExceeded", "frames")
            if self.limits.max_total_bytes is not None and total > self.limits.max_total_bytes:
                raise RasterError("LimitExceeded", "bytes of all frames")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, self.at)
            self.at += 9
            limit = self.limits.max_pixels
            if limit is not None and w * h > limit:
                raise RasterError("LimitExceeded", f"{w} x {h} pixels")
            try:
                palette = self.palette(flags) if flags & 128 else info.global_palette
            except RasterError:
                if count > 1:
                    return
                raise
            size = data[self.at] if self.at < n else None
            self.at += 1
            body, ended = self.sub_blocks()
            if undo is not None:
                disposal, ys, xs, saved = undo
                if disposal == 2:
                    canvas[ys, xs] = 0
                elif disposal == 3:
                    canvas[ys, xs] = saved
            packed, delay, transparent = control or [0, 0, 0]
            disposal = packed >> 2 & 7
            control = []
            ys = slice(min(top, info.height), min(top + h, info.height))
            xs = slice(min(left, info.width), min(left + w, info.width))
            undo = (disposal, ys, xs, canvas[ys, xs].copy() if disposal == 3 else None)
            if palette is None:
                raise RasterError("Invalid", "no palette")
            index, whole = gif_lzw_decode(size, body, w * h) if size is not None else (b"", False)
            self.draw(canvas, np.frombuffer(index, np.uint8), (left, top, w, h), bool(flags & 64), palette, transparent if packed & 1 else -1)
            incomplete = not whole
            yield Frame(canvas.copy(), delay, DISPOSAL.get(disposal, "Unspecified"), left, top, w, h, bool(flags & 64), bool(packed & 2), incomplete)

    def draw(self, canvas: np.ndarray, index: np.ndarray, rect: tuple, interlaced: bool, palette: np.ndarray, transparent: int) -> None:
        left, top, w, h = rect
        full = np.full(w * h, -1, np.int64)
        full[: len(index)] = index
        rows = full.reshape(h, w) if w and h else np.zeros((h, w), np.int64)
        if interlaced and h:
            image = np.empty_like(rows)
            image[interlaced_rows(h)] = rows
            rows = image
        part = rows[: max(0, canvas.shape[0] - top), : max(0, canvas.shape[1] - left)]
        shown = (part >= 0) & (part != transparent)
        if shown.any():
            if part[shown].max() >= len(palette):
                raise RasterError("Invalid", "index out of the palette")
            target = canvas[top : top + part.shape[0], left : left + part.shape[1]]
            target[shown, :3] = palette[part[shown]]
            target[shown, 3] = 255


def decode(data: bytes, limits: Limits = Limits()) -> tuple[Animation, RasterError | None]:
    """The animation; frames before an error are kept and the error is given beside them."""
    decoder = Decoder(data, limits)
    out = Animation(decoder.info)
    error = None
    try:
        for frame in decoder:
            out.frames.append(frame)
    except RasterError as e:
        if not out.frames:
            raise
        error = e
    out.loop_count, out.comments, out.icc_profile = decoder.loop_count, decoder.comments, decoder.icc_profile
    return out, error


def read_info(data: bytes) -> GifInfo:
    return Decoder(data).info


# --- writing ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class EncodeOptions:
    loop_count: int | None = None
    dither: bool = False
    max_colors: int = 256
    alpha_threshold: int = 128
    palette: np.ndarray | None = None  # one for all frames; else each frame has its own
    differencing: bool = True


def blocks(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        out.append(len(part))
        out += part
    out.append(0)
    return bytes(out)


def table_bits(n: int) -> int:
    return max(1, (n - 1).bit_length())


def table(palette: np.ndarray) -> bytes:
    return palette.astype(np.uint8).tobytes().ljust(3 << table_bits(len(palette)), b"\0")


class Encoder:
    """Writes a file frame by frame; a frame is held back until the next tells how to dispose of it."""

    def __init__(self, width: int, height: int, options: EncodeOptions = EncodeOptions()):
        o = options
        if not (1 <= width <= 65535 and 1 <= height <= 65535):
            raise RasterError("BadInput", "dimension")
        if not 2 <= o.max_colors <= 256 or o.palette is not None and not 1 <= len(o.palette) <= 255:
            raise RasterError("BadInput", "palette size")
        self.width, self.height, self.options = width, height, o
        flags = 0 if o.palette is None else 128 | table_bits(len(o.palette)) - 1
        self.out = bytearray(struct.pack("<6sHHBBB", b"GIF89a", width, height, 0x70 | flags, 0, 0))
        if o.palette is not None:
            self.out += table(o.palette)
        if o.loop_count is not None:
            self.out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", o.loop_count) + b"\0"
        self.canvas = np.zeros((height, width, 4), np.uint8)
        self.held: tuple[np.ndarray, int] | None = None
        self.first = True

    def add_frame(self, rgba: np.ndarray, delay_cs: int = 0) -> None:
        if rgba.shape != (self.height, self.width, 4) or rgba.dtype != np.uint8 or not 0 <= delay_cs <= 65535:
            raise RasterError("BadInput", "frame")
        opaque = rgba[..., 3:] >= self.options.alpha_threshold
        frame = np.where(opaque, np.concatenate([rgba[..., :3], np.full_like(rgba[..., 3:], 255)], -1), 0).astype(np.uint8)
        if self.held is not None:
            self.write(*self.held, frame)
        self.held = (frame, delay_cs)

    def finish(self) -> bytes:
        if self.held is None:
            raise RasterError("BadInput", "no frames")
        self.write(*self.held, None)
        self.held = None
        return bytes(self.out) + b"\x3b"

    def write(self, frame: np.ndarray, delay: int, following: np.ndarray | None) -> None:
        o = self.options
        changed = (frame != self.canvas).any(-1) if o.differencing else np.ones(frame.shape[:2], bool)
        # what the next frame needs transparent but this one shows must be cleared in between
        clear = following is not None and bool(((frame[..., 3] > 0) & (following[..., 3] == 0)).any())
        if clear:
            box = changed | ((frame[..., 3] > 0) & (following[..., 3] == 0))
        else:
            box = changed
        ys, xs = np.flatnonzero(box.any(1)), np.flatnonzero(box.any(0))
        top, bottom, left, right = (ys[0], ys[-1] + 1, xs[0], xs[-1] + 1) if len(ys) else (0, 1, 0, 1)
        disposal = "Background" if clear else "Unspecified" if self.first and following is None else "Keep"
        part, own = frame[top:bottom, left:right], changed[top:bottom, left:right]
        opaque = part[..., 3] > 0
        drawn = opaque & own if o.differencing else opaque
        need = not drawn.all()
        colours, counts = histogram(part[drawn][:, :3])
        palette = o.palette if o.palette is not None else build(colours, counts, o.max_colors - (1 if need else 0))
        if not len(palette):
            palette = np.zeros((1, 3), np.uint8)
        transparent = len(palette)
        if o.dither and (o.palette is not None or len(colours) > len(palette)):
            index = dither(part[..., :3], drawn, palette)
        else:
            index = np.zeros(part.shape[:2], np.int64)
            if len(colours):
                index[drawn] = nearest(colours, palette)[np.searchsorted(colours, pack_rgb(part[drawn][:, :3]))]
        index[~drawn] = transparent
        size = len(palette) + need
        bits = table_bits(size)
        if not (self.first and following is None and not need and delay == 0):
            self.out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, CODE[disposal] << 2 | need, delay, transparent if need else 0, 0)
        local = o.palette is None or table_bits(len(o.palette)) < bits
        self.out += struct.pack("<BHHHHB", 0x2C, left, top, right - left, bottom - top, 128 | bits - 1 if local else 0)
        if local:
            self.out += table(np.concatenate([palette, np.zeros((1, 3), np.uint8)])[:size])
        minimum = max(2, bits if local else max(bits, table_bits(len(o.palette))))
        self.out += bytes([minimum]) + blocks(gif_lzw_encode(minimum, index.astype(np.uint8).tobytes()))
        shown = self.canvas.copy()
        target = shown[top:bottom, left:right]
        rgb = np.concatenate([palette, np.zeros((1, 3), palette.dtype)])[index]
        target[drawn] = np.concatenate([rgb, np.full((*index.shape, 1), 255)], -1).astype(np.uint8)[drawn]
        if o.differencing:
            shown[top:bottom, left:right][opaque & ~drawn] = self.canvas[top:bottom, left:right][opaque & ~drawn]
        if clear:
            shown[top:bottom, left:right] = 0
        self.canvas = shown
        self.first = False


def encode(rgba: np.ndarray, options: EncodeOptions = EncodeOptions()) -> bytes:
    """A still image."""
    if rgba.ndim != 3:
        raise RasterError("BadInput", "frame")
    e = Encoder(rgba.shape[1], rgba.shape[0], options)
    e.add_frame(rgba)
    return e.finish()


def encode_frames(frames: list[tuple[np.ndarray, int]], options: EncodeOptions = EncodeOptions()) -> bytes:
    if not frames:
        raise RasterError("BadInput", "no frames")
    e = Encoder(frames[0][0].shape[1], frames[0][0].shape[0], options)
    for rgba, delay in frames:
        e.add_frame(rgba, delay)
    return e.finish()
