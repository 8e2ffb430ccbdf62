import itertools
import struct

import numpy as np
import pytest

from tessera.errors import KINDS, Limits, RasterError, guarded
from tessera.functions.codecs import deflate
from tessera.functions.fax import fax_encode
from tessera.sources import bmp, gif, tiff

rng = np.random.default_rng(11)


def gradient(h=120, w=160):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 255 // (w - 1), y * 255 // (h - 1), (x + y) * 255 // (h + w - 2), np.full_like(x, 255)], -1).astype(np.uint8)


def psnr(a, b):
    return 10 * np.log10(255**2 / ((a.astype(float) - b) ** 2).mean())


# --- bitmaps ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("w,h", [(1, 1), (2, 3), (3, 2), (5, 7), (31, 9), (64, 1), (1, 64), (127, 33)])
@pytest.mark.parametrize("top_down", [False, True])
def test_bitmap_round_trips(w, h, top_down):
    image = rng.integers(0, 256, (200, 4)).astype(np.uint8)[rng.integers(0, 200, (h, w))]
    assert (bmp.decode(bmp.encode(image, "Rgba32", top_down)).rgba == image).all()
    for fmt in ("Rgb24", "Indexed8"):
        got = bmp.decode(bmp.encode(image, fmt, top_down))
        assert (got.rgba[..., :3] == image[..., :3]).all() and not got.has_alpha and got.info.top_down == top_down


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_bitmap_palettes(bits):
    palette = rng.integers(0, 256, (min(1 << bits, 11), 3)).astype(np.uint8)
    for w, h in ((1, 1), (7, 3), (9, 9), (33, 2)):
        index = rng.integers(0, len(palette), (h, w)).astype(np.uint8)
        assert (bmp.decode(bmp.encode_indexed(index, palette, bits)).rgba[..., :3] == palette[index]).all()


def hand_made(size, bits, compression, masks, pixels, w=1, h=1):
    head = struct.pack("<IiiHHIIiiII", size, w, h, 1, bits, compression, len(pixels), 0, 0, 0, 0)
    head += struct.pack("<4I", *masks) if size > 40 else struct.pack("<3I", *masks[:3]) if compression == 3 else b""
    head = head.ljust(size, b"\0")
    return struct.pack("<2sIII", b"BM", 0, 0, 14 + len(head)) + head + pixels


def test_bitmap_masks_and_alpha():
    pixel = struct.pack("<H", 0b10000_100000_00001)
    got = bmp.decode(hand_made(40, 16, 3, (0xF800, 0x7E0, 0x1F, 0), pixel))
    assert got.rgba[0, 0].tolist() == [(16 * 255 + 15) // 31, (32 * 255 + 31) // 63, (255 + 15) // 31, 255]
    word = struct.pack("<I", 0x40102030)
    full = (0xFF0000, 0xFF00, 0xFF, 0xFF000000)
    assert not bmp.decode(hand_made(40, 32, 0, full, word)).has_alpha
    assert bmp.decode(hand_made(56, 32, 0, full, word)).rgba[0, 0].tolist() == [0x10, 0x20, 0x30, 0x40]
    assert not bmp.decode(hand_made(56, 32, 0, (*full[:3], 0), word)).has_alpha


def test_bitmap_run_lengths_leave_holes():
    index = bytes([2, 1, 0, 1])
    head = struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, 8, 1, len(index), 0, 0, 2, 0) + bytes([0, 0, 0, 0, 9, 8, 7, 0])
    got = bmp.decode(struct.pack("<2sIII", b"BM", 0, 0, 14 + len(head)) + head + index)
    assert got.has_alpha and got.rgba[1, 0].tolist() == [7, 8, 9, 255] and got.rgba[0, 3].tolist() == [0, 0, 0, 0]


def test_bitmap_refusals():
    assert guarded(bmp.decode, hand_made(40, 24, 4, (0, 0, 0, 0), bytes(4)))[1].kind == "Unsupported"
    assert guarded(bmp.decode, hand_made(40, 24, 0, (0, 0, 0, 0), bytes(4), 9, 9))[1].kind == "Truncated"
    assert guarded(bmp.decode, hand_made(40, 24, 0, (0, 0, 0, 0), bytes(4), 60_000, 60_000))[1].kind == "LimitExceeded"
    assert guarded(bmp.encode, np.zeros((2, 2, 3), np.uint8))[1].kind == "BadInput"
    with pytest.raises(RasterError):
        bmp.encode(rng.integers(0, 256, (40, 40, 4)).astype(np.uint8), "Indexed8")


# --- animations -------------------------------------------------------------------------------------


@pytest.mark.parametrize("differencing", [True, False])
def test_animations_are_exact(differencing):
    for k in range(12):
        h, w = rng.integers(1, 60, 2)
        palette = rng.integers(0, 256, (int(rng.integers(1, 41)), 4)).astype(np.uint8)
        palette[:, 3] = np.where(rng.random(len(palette)) < 0.2, 0, 255)
        palette[palette[:, 3] == 0] = 0
        frames = [palette[rng.integers(0, len(palette), (h, w))] for _ in range(7)]
        for i in range(1, 7):
            frames[i] = np.where(rng.random((h, w, 1)) < 0.6, frames[i - 1], frames[i])
        data = gif.encode_frames([(f, 3 * i) for i, f in enumerate(frames)], gif.EncodeOptions(loop_count=k, differencing=differencing))
        got, error = gif.decode(data)
        assert error is None and got.loop_count == k and [f.delay_cs for f in got.frames] == [3 * i for i in range(7)]
        assert all((a.rgba == b).all() for a, b in zip(got.frames, frames, strict=True))


def test_stills_of_many_sizes():
    for w, h, n in ((1, 1, 1), (2, 2, 2), (17, 5, 3), (64, 64, 16), (100, 37, 200), (40, 40, 256)):
        colours = rng.integers(0, 256, (n, 4)).astype(np.uint8) | np.array([0, 0, 0, 255], np.uint8)
        image = colours[rng.integers(0, n, (h, w))]
        got, _ = gif.decode(gif.encode(image))
        assert (got.frames[0].rgba == image).all() and got.loop_count is None


def test_differencing_makes_files_smaller():
    base = rng.integers(0, 64, (90, 120))
    palette = rng.integers(0, 256, (64, 4)).astype(np.uint8) | np.array([0, 0, 0, 255], np.uint8)
    frames = []
    for k in range(10):
        f = base.copy()
        f[10:20, 5 * k : 5 * k + 10] = k
        frames.append((palette[f], 5))
    small, big = (len(gif.encode_frames(frames, gif.EncodeOptions(differencing=d))) for d in (True, False))
    assert 3 * small < big


def test_quantised_quality():
    image = gradient()
    for options, floor in ((gif.EncodeOptions(), 30), (gif.EncodeOptions(dither=True), 30), (gif.EncodeOptions(max_colors=16), 22)):
        assert psnr(gif.decode(gif.encode(image, options))[0].frames[0].rgba[..., :3], image[..., :3]) > floor


def test_animation_damage():
    data = gif.encode_frames([(gradient(20, 30), 1), (gradient(20, 30)[::-1].copy(), 2)])
    for cut in range(0, len(data), 17):
        got, error = guarded(gif.decode, data[:cut])
        assert error is None or error.kind in KINDS
    partial, _ = gif.decode(data[: len(data) // 3])
    assert partial.frames[-1].incomplete
    for k in range(60):
        bad = bytearray(data)
        for _ in range(4):
            bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
        assert (guarded(gif.decode, bytes(bad))[1] or RasterError("Invalid", "")).kind in KINDS
    assert gif.decode(data[:13] + b"\x3b" if not data[10] & 128 else b"GIF89a\1\0\1\0\0\0\0\x3b")[0].frames == []
    assert guarded(gif.decode, b"GIF89a\xff\xff\xff\xff\0\0\0\x3b")[1].kind == "LimitExceeded"
    assert gif.decode(data, Limits(max_frames=1))[1].kind == "LimitExceeded"


def test_disposal_and_plain_text():
    def block(left, colour, disposal, w=1):
        control = bytes([0x21, 0xF9, 4, disposal << 2, 0, 0, 0, 0])
        return control + struct.pack("<BHHHHB", 0x2C, left, 0, w, 1, 0) + b"\x02" + gif.blocks(gif.gif_lzw_encode(2, bytes([colour]) * w))

    head = b"GIF89a\x03\0\x01\0\x81\0\0" + bytes(range(12))
    got, _ = gif.decode(head + block(0, 1, 1, 3) + block(0, 2, 3) + block(1, 3, 2) + block(2, 0, 0) + b"\x3b")
    shown = [[p[0] // 3 if p[3] else None for p in f.rgba[0].tolist()] for f in got.frames]
    assert shown == [[1, 1, 1], [2, 1, 1], [1, 3, 1], [1, None, 0]]


def test_animation_encoder_refuses_bad_input():
    for f in (lambda: gif.encode_frames([]), lambda: gif.Encoder(0, 1), lambda: gif.Encoder(1, 1, gif.EncodeOptions(max_colors=1)), lambda: gif.Encoder(2, 2).add_frame(np.zeros((1, 1, 4), np.uint8))):
        assert guarded(f)[1].kind == "BadInput"


# --- tagged images ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", tiff.PIXEL_FORMATS)
def test_tagged_round_trips(name):
    channels, kind, _, _ = tiff.PIXEL_FORMATS[name]
    for comp, pred, (order, big) in itertools.product(("None", "PackBits", "Lzw", "Deflate"), (False, True), itertools.product((False, True), repeat=2)):
        h, w = int(rng.integers(1, 40)), int(rng.integers(1, 70))
        s = rng.random((h, w, channels)).astype(kind) if kind == "f4" else np.cumsum(rng.integers(0, 9, (h, w, channels)), axis=1).astype(kind)
        got = tiff.decode(tiff.encode(s, name, tiff.EncodeOptions(comp, pred, 6, int(rng.integers(1, 3000)), big, order)))
        assert got.samples.dtype == s.dtype and (got.samples == s).all() and not got.incomplete
        assert got.info.big_tiff == big and got.info.big_endian == order


def test_several_pages():
    e = tiff.Encoder()
    for k in range(3):
        e.add_page(np.full((k + 1, 2, 1), k, np.uint8), "Gray8")
    t = tiff.Tiff(e.finish())
    assert [t.info(k).height for k in range(3)] == [1, 2, 3] and t.info(2).page_no == 2 and t.info(0).page_total == 3
    assert t.decode(1).samples.max() == 1


def directory(tags, tail=b""):
    """A little-endian file with the tags (type 4 unless given) and bytes after the directory, which start at TAIL."""
    n = len(tags)
    at = 8 + 2 + 12 * n + 4
    out = b"II*\0" + struct.pack("<IH", 8, n)
    for tag, (kind, count, value) in sorted(tags.items()):
        value = at + value[0] if isinstance(value, tuple) else value
        out += struct.pack("<HHII", tag, kind, count, value)
    return out + bytes(4) + tail


def short(v):
    return (3, 1, v)


def test_facsimile_pages():
    rows = (rng.random((9, 40)) < 0.3).astype(np.uint8)
    for scheme, code, options in (("mh", 2, 0), ("g3-1d", 3, 0), ("g3-2d", 3, 1), ("g4", 4, 0)):
        data = fax_encode(rows, scheme)
        base = {256: short(40), 257: short(9), 259: short(code), 273: (4, 1, (0,)), 279: (4, 1, len(data)), 278: short(9), 292: (4, 1, options)}
        got = tiff.decode(directory(base, data))
        assert (got.samples[..., 0] == np.where(rows, 0, 255)).all() and got.info.photometric == "WhiteIsZero"
        inverted = tiff.decode(directory(base | {262: short(1)}, data))
        assert (inverted.samples[..., 0] == np.where(rows, 0, 255)).all()


def test_tiles_planes_depths_and_palette():
    values = rng.integers(0, 16, (20, 32)).astype(np.uint8)
    tiles = [values[y : y + 16, x : x + 16] for y in (0, 16) for x in (0, 16)]
    packed = b"".join(np.pad(t, ((0, 16 - t.shape[0]), (0, 0))).reshape(16, 8, 2).dot([16, 1]).astype(np.uint8).tobytes() for t in tiles)
    offsets = struct.pack("<4I", *range(0, 512, 128))
    sizes = struct.pack("<4I", *[128] * 4)
    tags = {256: short(32), 257: short(20), 258: short(4), 262: short(1), 322: short(16), 323: short(16), 325: (4, 4, (512,)), 324: (4, 4, (528,))}
    where = 8 + 2 + 12 * len(tags) + 4
    offsets = struct.pack("<4I", *(where + k for k in range(0, 512, 128)))
    got = tiff.decode(directory(tags, packed + sizes + offsets))
    assert (got.samples[..., 0] == (values.astype(int) * 255 + 7) // 15).all()
    table = rng.integers(0, 65536, 48).astype(np.uint16)
    got = tiff.decode(directory(tags | {262: short(3), 320: (3, 48, (544,))}, b"\0" * 0 + packed + sizes + struct.pack("<4I", *(where + 12 + k for k in range(0, 512, 128))) + table.tobytes()))
    assert (got.samples == table.reshape(3, 16).T[values]).all() and got.color == "Rgb" and got.sample_type == "U16"


def test_display_forms():
    cmyk = tiff.decode(tiff.encode(np.array([[[255, 0, 0, 0], [0, 0, 0, 128]]], np.uint8), "Cmyk8"))
    assert cmyk.to_rgba8()[0].tolist() == [[0, 255, 255, 255], [127, 127, 127, 255]]
    image = tiff.decode(tiff.encode(np.arange(6, dtype=np.uint8).reshape(2, 3, 1), "Gray8"))
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for o, rows in want.items():
        image.info.orientation = o
        assert image.to_rgba8_upright()[..., 0].tolist() == rows


def test_bombs_and_damage():
    assert guarded(tiff.decode, directory({256: (4, 1, 100_000), 257: (4, 1, 100_000)}))[1].kind == "LimitExceeded"
    assert guarded(tiff.decode, directory({256: short(16), 257: short(16), 322: (4, 1, 1 << 30), 323: (4, 1, 1 << 30), 324: (4, 1, 8), 325: (4, 1, 1)}))[1].kind == "LimitExceeded"
    bomb = deflate(bytes(10 << 20))
    got = tiff.decode(directory({256: short(4), 257: short(4), 258: short(8), 259: short(8), 262: short(1), 273: (4, 1, (0,)), 279: (4, 1, len(bomb))}, bomb))
    assert got.samples.shape == (4, 4, 1)
    loop = bytearray(directory({256: short(1), 257: short(1)}))
    loop[-4:] = struct.pack("<I", 8)
    assert len(tiff.Tiff(bytes(loop)).directories) == 1
    assert guarded(tiff.decode, directory({256: short(3), 257: short(2), 258: short(8), 262: short(1)}))[1].kind == "Invalid"
    whole = tiff.encode(rng.integers(0, 256, (20, 30, 3)).astype(np.uint8), "Rgb8", tiff.EncodeOptions("Lzw", True))
    for cut in range(0, len(whole), 41):
        assert (guarded(tiff.decode_pages, whole[:cut])[1] or RasterError("Invalid", "")).kind in KINDS
    for _ in range(80):
        bad = bytearray(whole)
        for _ in range(6):
            bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
        assert (guarded(tiff.decode_pages, bytes(bad))[1] or RasterError("Invalid", "")).kind in KINDS


def test_predictor_makes_files_smaller():
    image = gradient(256, 256)[..., :3].copy()
    sizes = [len(tiff.encode(image, "Rgb8", tiff.EncodeOptions(*o))) for o in (("None",), ("Lzw", True), ("Deflate", True))]
    assert sizes[0] > 10 * sizes[1] > 10 * sizes[2]


def test_subsampled_components():
    sub = struct.pack("<HH", 2, 2)
    unit = bytes([100, 110, 120, 130, 128, 128])
    tags = {256: short(2), 257: short(2), 258: (3, 3, (6,)), 262: short(6), 277: short(3), 273: (4, 1, (0,)), 279: (4, 1, 6), 530: (3, 2, struct.unpack("<I", sub)[0])}
    got = tiff.decode(directory(tags, unit + struct.pack("<3H", 8, 8, 8)))
    assert got.samples[..., 0].tolist() == [[100, 110], [120, 130]] and got.color == "Rgb"


def grey(w, h, bits=8, tail=b"", **more):
    """Tags of a grey page with its samples at TAIL in strips of one row; more tags as t<number>."""
    base = {256: short(w), 257: short(h), 258: short(bits), 262: short(1), 273: (4, 1, (0,)), 278: short(h), 279: (4, 1, len(tail))}
    return directory(base | {int(k[1:]): v for k, v in more.items()}, tail)


def test_strips_without_sizes():
    where = 8 + 2 + 12 * 6 + 4
    tags = {256: short(4), 257: short(3), 258: short(8), 262: short(1), 278: short(1), 273: (4, 3, (12,))}
    got = tiff.decode(directory(tags, bytes(range(12)) + struct.pack("<3I", *(where + k for k in (0, 4, 8)))))
    assert got.samples[..., 0].tolist() == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]] and not got.incomplete
    packed = b"\x03abcd" + b"\x03efgh"
    tags |= {257: short(2), 259: short(32773), 273: (4, 2, (10,))}
    where += 12
    got = tiff.decode(directory(tags, packed + struct.pack("<2I", where, where + 5)))
    assert got.samples.tobytes() == b"abcdefgh"


def test_more_tiles_than_places():
    tags = {256: short(600), 257: short(600), 258: short(8), 262: short(1), 322: short(1), 323: short(1), 324: (4, 1, (0,)), 325: (4, 1, 1)}
    got = tiff.decode(directory(tags, b"\x09"))
    assert got.samples[0, 0, 0] == 9 and got.samples.sum() == 9 and got.incomplete
    t = tiff.Tiff(directory(tags, b"\x09"))
    assert sum(1 for _ in t.chunks(0)) == 360_000 and [c.x0 for c in t.chunks(0, wanted=[599])] == [599]


def test_predictors_that_do_not_fit():
    kind = lambda **tags: (guarded(tiff.decode, grey(2, 1, tail=bytes(8), **tags))[1] or RasterError("none", "")).kind
    assert kind(t317=short(2)) == "none"
    assert kind(t317=short(2), t258=short(24)) == kind(t317=short(2), t258=short(4)) == kind(t317=short(7)) == "Unsupported"
    assert kind(t317=short(3)) == "Invalid" and kind(t339=short(4)) == kind(t262=short(4)) == "Unsupported"


def test_colour_map_must_be_whole():
    table = np.arange(12, dtype=np.uint16).tobytes()
    tags = {"t262": short(3), "t320": (3, 12, (1,))}
    assert tiff.decode(grey(4, 1, 2, b"\x1b" + table, **tags)).samples[0].tolist() == [[k, 4 + k, 8 + k] for k in range(4)]
    assert guarded(tiff.decode, grey(4, 1, 2, b"\x1b" + table, **tags | {"t320": (3, 11, (1,))}))[1].kind == "Invalid"


@pytest.mark.parametrize("scheme,code,options", [("mh", 2, 0), ("g3-1d", 3, 0), ("g3-2d", 3, 1), ("g4", 4, 0)])
def test_damaged_facsimile_is_refused(scheme, code, options):
    rows = (rng.random((8, 60)) < 0.3).astype(np.uint8)
    data = fax_encode(rows, scheme)
    tags = {"t259": short(code), "t292": (4, 1, options)}
    assert (tiff.decode(grey(60, 8, 1, data, **tags)).samples[..., 0] == np.where(rows, 0, 255)).all()
    middle = len(data) // 2
    for bad in (data[:middle] + bytes(12) + data[middle + 12 :], data[:middle], b""):
        assert guarded(tiff.decode, grey(60, 8, 1, bad, **tags))[1].kind == "Invalid"
    if code > 2:
        assert guarded(tiff.decode, grey(60, 8, 1, data, **tags | {f"t{289 + code}": (4, 1, 2 | options)}))[1].kind == "Unsupported"
    if code == 4:
        assert guarded(tiff.decode, grey(60, 8, 1, b"\x03\xc0", **tags))[1].kind == "Unsupported"
    assert guarded(tiff.decode, grey(60, 8, 2, data, **tags))[1].kind == "Invalid"


def test_bitmap_pixel_offset_that_cannot_be_right():
    pixels = bytes([1, 2, 3, 0])
    whole = hand_made(40, 24, 0, (0, 0, 0, 0), pixels)
    for offset in (0, 20, len(whole), 1 << 30):
        assert bmp.decode(whole[:10] + struct.pack("<I", offset) + whole[14:]).rgba[0, 0].tolist() == [3, 2, 1, 255]
    assert guarded(bmp.decode, whole[:-3])[1].kind == "Truncated"
    assert guarded(bmp.decode, whole[:14] + struct.pack("<I", 110) + bytes(120))[1].kind == "Invalid"


def test_bitmap_alpha_takes_what_colours_leave():
    word = struct.pack("<I", 0x40102030)
    assert bmp.decode(hand_made(56, 32, 0, (0, 0, 0, 0xFFFFFFFF), word)).rgba[0, 0].tolist() == [0x10, 0x20, 0x30, 0x40]
    for bit, alpha in ((0x8000, 255), (0, 0)):
        got = bmp.decode(hand_made(56, 16, 0, (0, 0, 0, 0xFFFF), struct.pack("<HH", bit | 0x1F, 0)))
        assert got.rgba[0, 0].tolist() == [0, 0, 255, alpha] and got.has_alpha


def test_fixed_palette():
    palette = rng.integers(0, 256, (12, 3)).astype(np.uint8)
    image = gradient(20, 30)
    got = gif.decode(gif.encode(image, gif.EncodeOptions(palette=palette)))[0].frames[0].rgba
    d = ((image[:, :, None, :3].astype(int) - palette[None, None].astype(int)) ** 2).sum(-1)
    assert (got[..., :3] == palette[d.argmin(-1)]).all()


def test_headers_of_bitmaps_with_other_files_inside():
    for code, bits, kind in ((4, 0, "Unsupported"), (5, 0, "Unsupported"), (0, 0, "Invalid"), (0, 64, "Unsupported"), (3, 24, "Invalid")):
        data = b"BM" + struct.pack("<IHHI", 60, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 7, 1, bits, code, 0, 0, 0, 0, 0) + bytes(300)
        info = bmp.read_info(data)
        assert (info.width, info.height, info.bits_per_pixel) == (5, 7, bits)
        assert guarded(bmp.decode, data)[1].kind == kind


def test_palettes_that_are_longer_than_their_files():
    head = struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 0, 0, 0, 2**31, 0)
    info = bmp.read_info(b"BM" + struct.pack("<IHHI", 0, 0, 0, 0) + head + bytes(10))
    assert 54 <= info.pixels_at <= 64
    head = struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 8, 0, 0, 0, 0, 0, 0)
    info = bmp.read_info(b"BM" + struct.pack("<IHHI", 0, 0, 0, 62) + head + bytes(range(20)))
    assert info.palette_len == 2 and info.palette.tolist() == [[2, 1, 0], [6, 5, 4]] and info.pixels_at == 62
