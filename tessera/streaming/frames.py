"""Compositing of patches that arrive one by one, in any order, as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds that later patches wait for one that has not come.
PATIENCE_MS = 60_000


class Canvas:
    """Rows of a canvas, what the last patch asks to undo, and patches that wait for an earlier one."""

    def __init__(self, width: int, height: int):
        self.pixels = np.zeros((height, width), np.uint8)
        self.undo: tuple | None = None
        self.next = 0
        self.waiting: dict[int, tuple] = {}

    def draw(self, left: int, top: int, patch: np.ndarray, disposal: int) -> bytes:
        if self.undo is not None:
            at, before = self.undo
            self.pixels[at] = before
        height, width = self.pixels.shape
        inside = lambda a, n, most: slice(first := min(max(a, 0), most), max(first, min(a + n, most)))
        rows, cols = inside(top, patch.shape[0], height), inside(left, patch.shape[1], width)
        part = patch[rows.start - top : rows.stop - top, cols.start - left : cols.stop - left]
        below = self.pixels[rows, cols]
        self.undo = ((rows, cols), np.zeros_like(below) if disposal == 2 else below.copy()) if disposal in (2, 3) else None
        self.pixels[rows, cols] = np.where(part > 0, part, below)
        return self.pixels.tobytes()

    def ready(self, patient: bool) -> Iterator[tuple[int, bytes]]:
        """Frames that may be shown: those in turn, and where there is no more patience all that wait."""
        while self.waiting and (self.next in self.waiting or not patient):
            frame = self.next if self.next in self.waiting else min(self.waiting)
            yield frame, self.draw(*self.waiting.pop(frame))
            self.next = frame + 1


def composite_arriving(patches: DataFrame, animation: str, width: int, height: int, band: int | None = None, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """(animation, band, frame, pixels) of a stream of patches; pixels are the band's rows of the canvas after the frame.

    patches has animation, frame (0, 1, ...), left, top, w, h, disposal and index, like those
    of operators.rasters.composite. Each band of rows of a canvas is a state of its own, so
    large canvases spread. A patch waits for the frames before it; when none has come for
    patience_ms, those that wait are shown in order without them, and what comes later than
    that is dropped, as is a frame given twice.
    """
    band = band or height
    kind = patches.schema[animation].dataType.simpleString()
    rows = patches.select(animation, "frame", "left", "top", "w", "h", "disposal", "index").withColumn("band", F.explode(F.sequence(F.lit(0), F.lit((height - 1) // band))))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, k = key
        canvas = pickle.loads(state.get[0]) if state.exists else Canvas(width, min(band, height - k * band))
        for batch in batches if not state.hasTimedOut else ():
            for r in batch.itertuples():
                if r.frame >= canvas.next:
                    patch = np.frombuffer(r.index, np.uint8)[: r.w * r.h].reshape(r.h, r.w)
                    canvas.waiting.setdefault(int(r.frame), (int(r.left), int(r.top) - k * band, patch, int(r.disposal)))
        shown = list(canvas.ready(not state.hasTimedOut))
        state.update((pickle.dumps(canvas),))
        if canvas.waiting:
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame({animation: [name] * len(shown), "band": [k] * len(shown), "frame": [f for f, _ in shown], "pixels": [p for _, p in shown]})

    schema = f"{animation} {kind}, band int, frame long, pixels binary"
    return rows.groupBy(animation, "band").applyInPandasWithState(step, schema, "canvas binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
