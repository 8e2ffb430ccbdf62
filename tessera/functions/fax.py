"""Facsimile decoding (modified Huffman, group 3 one- and two-dimensional, group 4) and a group 4 encoder."""

from __future__ import annotations

import numpy as np

from tessera.errors import RasterError

# Run-length codes of ITU-T T.4, for runs 0 to 63, then 64, 128, .. 1728.
WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100
011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
"""
BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011
0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
"""
# Codes for 1792, 1856, .. 2560 of either colour.
LONG = """
00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111
000000011100 000000011101 000000011110 000000011111
"""
# Two-dimensional modes.
MODES = {"1": 0, "011": 1, "010": -1, "000011": 2, "000010": -2, "0000011": 3, "0000010": -3, "0001": "pass", "001": "horizontal", "0000001": "extension"}
EOL = "000000000001"


def runs_of(table: str) -> dict[str, int]:
    codes = {c: n if n < 64 else (n - 63) * 64 for n, c in enumerate(table.split())}
    return codes | {c: 1792 + 64 * n for n, c in enumerate(LONG.split())}


CODES = (runs_of(WHITE), runs_of(BLACK))
LONGEST = 13
LONGEST_RUN = 1 << 20


def lookup(codes: dict) -> list:
    """For each 13 bits that may come next: (value, code length), or None."""
    out: list = [None] * (1 << LONGEST)
    for code, value in codes.items():
        free = LONGEST - len(code)
        start = int(code, 2) << free
        out[start : start + (1 << free)] = [(value, len(code))] * (1 << free)
    return out


RUNS = tuple(map(lookup, CODES))
MODE = lookup(MODES)


class Bits:
    """Most significant bit first; past the end come zeros."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        self.value = data + bytes(8)
        self.at = 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        word = int.from_bytes(self.value[i : i + 5].ljust(5, b"\0"), "big")
        return word >> 40 - (self.at & 7) - n & (1 << n) - 1

    def run(self, colour: int) -> int:
        """A whole run."""
        total = 0
        while True:
            found = RUNS[colour][self.peek(LONGEST)]
            if found is None:
                raise RasterError("Invalid", "no facsimile code")
            self.at += found[1]
            total += found[0]
            if found[0] < 64:
                return total
            if total > LONGEST_RUN:
                raise RasterError("Invalid", "facsimile run too long")

    def eol(self) -> bool:
        """Skips an end of line with its fill, if one comes next."""
        at = self.at
        while at <= self.size:
            save, self.at = self.at, at
            word = self.peek(12)
            self.at = save
            if word == 1:
                self.at = at + 12
                return True
            if word:
                break
            at += 1
        return False

    def check(self) -> None:
        if self.at > self.size:
            raise RasterError("Invalid", "facsimile data end within a row")


def next_change(line: list[int], at: int, colour: int) -> int:
    """Index into the changes of the first to the right of at that changes to the opposite of colour."""
    i = 0
    while i < len(line) and (line[i] <= at or i % 2 != colour):
        i += 1
    return i


def row_1d(bits: Bits, width: int) -> list[int]:
    """Changing positions of a row, the first to black."""
    out, x, colour = [], 0, 0
    while x < width:
        x += bits.run(colour)
        if x > width:
            raise RasterError("Invalid", "facsimile run past the row")
        bits.check()
        out.append(x)
        colour ^= 1
    return out


def row_2d(bits: Bits, reference: list[int], width: int) -> list[int]:
    out: list[int] = []
    a0, colour = -1, 0
    limit = len(reference)
    b = 0
    while a0 < width:
        found = MODE[bits.peek(LONGEST)]
        if found is None:
            raise RasterError("Invalid", "no facsimile code")
        if found[0] == "extension":
            raise RasterError("Unsupported", "facsimile in uncompressed mode")
        bits.at += found[1]
        # the first change to the right of a0 that has the opposite colour
        b = max(0, b - 2)
        while b < limit and (reference[b] <= a0 or b % 2 != colour):
            b += 1
        b1 = reference[b] if b < limit else width
        start = max(a0, 0)
        if found[0] == "pass":
            a0 = reference[b + 1] if b + 1 < limit else width
        elif found[0] == "horizontal":
            for c in (colour, colour ^ 1):
                start += bits.run(c)
                out.append(start)
            a0 = start
        else:
            a0 = b1 + found[0]
            if a0 < start:
                raise RasterError("Invalid", "facsimile change before its place")
            out.append(a0)
            colour ^= 1
        if a0 > width:
            raise RasterError("Invalid", "facsimile run past the row")
        bits.check()
    return out


def pack(changes: list[int], width: int) -> bytes:
    row = np.zeros(width, np.uint8)
    for start, end in zip(changes[::2], [*changes[1::2], width], strict=False):
        row[start:end] = 1
    return np.packbits(row).tobytes()


def fax_decode(data: bytes, width: int, height: int, scheme: str) -> bytes:
    """Rows packed to bytes, black 1. scheme: mh, g3-1d, g3-2d or g4. Damage within the rows asked for is an error."""
    bits = Bits(data)
    rows: list[bytes] = []
    reference: list[int] = []
    for y in range(height):
        two = scheme == "g4"
        if scheme.startswith("g3"):
            bits.eol()
            if scheme == "g3-2d":
                two = bits.peek(1) == 0
                bits.at += 1
        elif scheme == "mh" and y:
            bits.at = -(-bits.at // 8) * 8
        reference = row_2d(bits, reference, width) if two else row_1d(bits, width)
        rows.append(pack(reference, width))
    return b"".join(rows)


def code_run(n: int, colour: int) -> str:
    names = {v: k for k, v in CODES[colour].items()}
    out = ""
    while n >= 2560 + 64:
        out += names[2560]
        n -= 2560
    if n >= 64:
        out += names[n // 64 * 64]
        n %= 64
    return out + names[n]


def changes_of(row: np.ndarray) -> list[int]:
    return (np.flatnonzero(np.diff(row.astype(np.int8), prepend=0)) + 0).tolist()


def fax_encode(rows: np.ndarray, scheme: str) -> bytes:
    """Rows of 0 (white) and 1 (black); for fixtures and round trips."""
    out = ""
    height, width = rows.shape
    reference: list[int] = []
    modes = {v: k for k, v in MODES.items()}
    for y in range(height):
        changes = changes_of(rows[y])
        two = scheme == "g4" or scheme == "g3-2d" and y % 2 == 1
        if scheme == "g3-1d":
            out += EOL
        elif scheme == "g3-2d":
            out += EOL + ("0" if two else "1")
        if not two:
            x, colour = 0, 0
            for c in [*changes, width]:
                out += code_run(c - x, colour)
                x, colour = c, colour ^ 1
        else:
            a0, colour = -1, 0
            while a0 < width:
                i = next_change(reference, a0, colour)
                b1 = reference[i] if i < len(reference) else width
                b2 = reference[i + 1] if i + 1 < len(reference) else width
                own = next((c for c in changes if c > a0 and int(rows[y][c]) != colour), width) if a0 >= 0 or not (colour == 0 and changes and changes[0] == 0) else 0
                nxt = next((c for c in changes if c > own), width)
                if b2 < own:
                    out += modes["pass"]
                    a0 = b2
                elif abs(own - b1) <= 3:
                    out += modes[own - b1]
                    a0, colour = own, colour ^ 1
                else:
                    start = max(a0, 0)
                    out += modes["horizontal"] + code_run(own - start, colour) + code_run(nxt - own, colour ^ 1)
                    a0 = nxt
        reference = changes
        if scheme == "mh":
            out += "0" * (-len(out) % 8)
    if scheme == "g4":
        out += EOL * 2
    out += "0" * (-len(out) % 8)
    return int("1" + out, 2).to_bytes(len(out) // 8 + 1, "big")[1:] if out else b""
