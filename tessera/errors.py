"""Errors of the raster readers and writers, and their limits."""

from __future__ import annotations

from dataclasses import dataclass

KINDS = ("Truncated", "Invalid", "Unsupported", "LimitExceeded", "BadInput")


class RasterError(Exception):
    """kind is one of KINDS; readers turn it into an error row unless told to raise."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind
        self.message = message

    def __reduce__(self):
        return RasterError, (self.kind, self.message)


@dataclass(frozen=True)
class Limits:
    """Bounds that are checked before memory is taken; None is unbounded."""

    max_pixels: int | None = 100_000_000
    max_frames: int | None = 100_000
    max_total_bytes: int | None = 2 << 30
    max_alloc: int | None = 4 << 30
    max_pages: int | None = 65_536

    @classmethod
    def none(cls) -> Limits:
        return cls(None, None, None, None, None)

    def check_pixels(self, width: int, height: int) -> None:
        if width < 1 or height < 1:
            raise RasterError("Invalid", "a dimension is zero")
        if self.max_pixels is not None and width * height > self.max_pixels:
            raise RasterError("LimitExceeded", f"{width} x {height} pixels")


def guarded(read, *args):
    """(value, error) of a reader: damaged input of any sort is an error, never an exception."""
    try:
        return read(*args), None
    except RasterError as e:
        return None, e
    except MemoryError:
        return None, RasterError("LimitExceeded", "out of memory")
    except (IndexError, ValueError, KeyError, OverflowError, ArithmeticError, TypeError) as e:
        return None, RasterError("Invalid", f"{type(e).__name__}: {e}")
    except Exception as e:  # struct.error, zlib.error
        return None, RasterError("Truncated" if type(e).__name__ == "error" else "Invalid", str(e))
