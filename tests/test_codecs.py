import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.errors import RasterError
from tessera.functions import codecs, fax, palette
from tessera.functions.pixels import to_u8
from tessera.sources.gif import interlaced_rows

runny = st.lists(st.tuples(st.integers(0, 255), st.integers(1, 300)), max_size=60).map(lambda x: b"".join(bytes([v]) * n for v, n in x))


@settings(max_examples=60, deadline=None)
@given(runny | st.binary(max_size=6000))
def test_round_trips(data):
    assert codecs.gif_lzw_decode(8, codecs.gif_lzw_encode(8, data), len(data))[0] == data
    assert codecs.tiff_lzw_decode(codecs.tiff_lzw_encode(data), len(data) + 9) == data
    assert codecs.packbits_decode(codecs.packbits_encode(data), len(data) + 9) == data
    assert codecs.inflate(codecs.deflate(data), len(data) + 9) == data
    assert codecs.reverse_bits(codecs.reverse_bits(data)) == data


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 11))
def test_decoders_stop_at_the_limit_and_only_raise_their_error(data, size):
    for f in (lambda: codecs.gif_lzw_decode(size, data, 50)[0], lambda: codecs.tiff_lzw_decode(data, 50), lambda: codecs.packbits_decode(data, 50), lambda: codecs.inflate(data, 50)):
        try:
            assert len(f()) <= 50
        except RasterError as e:
            assert e.kind == "Invalid"


def test_lzw_code_for_an_entry_in_the_making():
    data = b"\x01" * 500
    assert codecs.gif_lzw_decode(2, codecs.gif_lzw_encode(2, data), 500) == (data, True)
    with pytest.raises(RasterError):
        codecs.gif_lzw_decode(2, b"\x3c", 4)


def test_packbits_example():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert codecs.packbits_decode(packed, 99) == plain
    assert codecs.packbits_decode(codecs.packbits_encode(plain), 99) == plain


def test_inflate_is_bounded():
    bomb = codecs.deflate(bytes(10 << 20))
    assert len(codecs.inflate(bomb, 1000)) == 1000


@pytest.mark.parametrize("codes", fax.CODES)
def test_fax_codes_leave_only_the_fill_prefix(codes):
    ordered = sorted(codes)
    assert len(codes) == 104 and not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))
    assert sum(2.0 ** -len(c) for c in codes) == 1 - 2.0**-8


@pytest.mark.parametrize("scheme", ["mh", "g3-1d", "g3-2d", "g4"])
def test_fax_round_trips(scheme):
    rng = np.random.default_rng(5)
    for k in range(40):
        h, w = int(rng.integers(1, 20)), int(rng.integers(1, 3000 if k % 8 == 0 else 80))
        rows = (rng.random((h, w)) < rng.random()).astype(np.uint8)
        rows = np.repeat(rows, 5, axis=1)[:, :w]
        assert fax.fax_decode(fax.fax_encode(rows, scheme), w, h, scheme) == np.packbits(rows, axis=1).tobytes()


def test_bitmap_run_lengths_of_the_format_description():
    code = bytes.fromhex("03 04 05 06 00 03 45 56 67 00 02 78 00 02 05 01 02 78 00 00 09 1E 00 01".replace(" ", ""))
    values, written = codecs.bmp_rle_decode(code, 8, 20, 3)
    first = [4] * 3 + [6] * 5 + [0x45, 0x56, 0x67] + [0x78] * 2
    assert values[0, : len(first), 0].tolist() == first and written[0].sum() == len(first)
    assert values[1, 18:, 0].tolist() == [0x78] * 2
    assert values[2, :9, 0].tolist() == [0x1E] * 9 and not written[2, 9:].any()


def test_interlaced_rows_are_a_permutation():
    assert interlaced_rows(10).tolist() == [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    for h in range(1, 40):
        assert sorted(interlaced_rows(h)) == list(range(h))


def test_palette_is_exact_when_it_fits_and_close_when_not():
    rgb = np.random.default_rng(1).integers(0, 256, (5000, 3))
    colours, counts = palette.histogram(rgb)
    assert len(palette.build(colours[:50], counts[:50], 64)) == 50
    small = palette.build(colours, counts, 64)
    got = small[palette.nearest(colours, small)]
    assert len(small) <= 64 and np.sqrt(((got - palette.unpack_rgb(colours)) ** 2).mean()) < 32


def test_samples_to_8_bits():
    assert to_u8(np.array([0, 128, 65535], np.uint16)).tolist() == [0, 0, 255]
    assert to_u8(np.array([np.nan, -1, 0.5 / 255, 1, 9, 0.5], np.float32)).tolist() == [0, 0, 1, 255, 255, 128]
