"""Frame-by-frame processing of streams: state per signal, exact at the borders of micro-batches.

Input rows are long (signal_id, n, x), in any order within a micro-batch, in order of n across them. The state holds the samples that
no whole frame has used up, the number of the next frame and the next sample's position. Positions without a row are zero samples, as in
tables. A sample that comes after its position has been passed is late: an error, or left out if late is "drop" (of
rows that repeat a position in one micro-batch the first in value stays, and the others are late). With expire_s a signal that
has had no sample for so many seconds of processing time loses its state; if it comes back, it begins anew at the position it comes with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidInput, require
from ..params import StftParams
from ..plans import vector

_STATE = "tail binary, next_frame long, next_n long"


def _in_order(batches: Iterator[pd.DataFrame], expected: int | None, late: str) -> tuple[np.ndarray, int]:
    """The samples from the expected position on (or the first that there is), and the position after them."""
    rows = pd.concat(list(batches)).sort_values(["n", "x"])
    n = rows["n"].to_numpy(np.int64)
    keep = np.concatenate(([True], n[1:] != n[:-1]))
    expected = int(n[0]) if expected is None else expected
    keep &= n >= expected
    if late == "error" and not keep.all():
        raise InvalidInput(f"samples came late or twice, the first at position {n[~keep][0]}, where {expected} was due")
    n, x = n[keep], rows["x"].to_numpy(float)[keep]
    if not len(n):
        return np.zeros(0), expected
    out = np.zeros(int(n[-1]) - expected + 1)
    out[n - expected] = x
    return out, int(n[-1]) + 1


def _stateful(samples: DataFrame, step, schema: str, late: str, expire_s: float | None) -> DataFrame:
    """step(key, state values or None, samples, first position, next position) -> (rows, state values)."""
    require(late in ("error", "drop"), "late is error or drop")

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        # A signal that is seen for the first time begins at 0; one that comes back after its state expired begins where it comes.
        x, after = _in_order(batches, held[-1] if held is not None else (None if expire_s else 0), late)
        rows, new = step(key, held, x, after - len(x), after)
        state.update(new)
        if expire_s:
            state.setTimeoutDuration(int(1000 * expire_s))
        yield rows

    kind = GroupStateTimeout.ProcessingTimeTimeout if expire_s else GroupStateTimeout.NoTimeout
    return samples.groupBy("signal_id").applyInPandasWithState(run, schema, _STATE, "append", kind)


def spectra_stream(samples: DataFrame, p: StftParams, late: str = "error", expire_s: float | None = None) -> DataFrame:
    """signal_id, frame, power (array) of each whole frame; without centring, so that no end of stream is needed."""
    p = p.with_(centre=False)

    def step(key, held, x, first, after):
        tail, frame = (np.frombuffer(held[0]), held[1]) if held is not None else (np.zeros(0), 0)
        x = np.concatenate((tail, x))
        out = vector.power(vector.framed(x, p)) if len(x) >= p.n_fft else np.zeros((0, p.n_bins))
        rows = pd.DataFrame({"signal_id": key[0], "frame": np.arange(frame, frame + len(out)), "power": list(out)})
        return rows, (x[len(out) * p.hop :].tobytes(), frame + len(out), after)

    return _stateful(samples, step, "signal_id long, frame long, power array<double>", late, expire_s)


class OverlapSave:
    """Block filter with a fixed response: each block of samples gives as many filtered ones; the state is the last samples."""

    def __init__(self, response, block: int):
        self.h = np.asarray(response, float)
        require(len(self.h) > 0 and block > 0, "a response and a block size are needed")
        self.block = block
        self.n_fft = 1 << (block + len(self.h) - 2).bit_length() if block + len(self.h) > 2 else 1
        self.spectrum = np.fft.rfft(self.h, self.n_fft)
        self.reset()

    def reset(self) -> None:
        self.tail = np.zeros(self.n_fft - self.block)

    def process_block(self, x) -> np.ndarray:
        from ..errors import DimensionMismatch

        if len(x) != self.block:
            raise DimensionMismatch(self.block, len(x))
        whole = np.concatenate((self.tail, np.asarray(x, float)))
        self.tail = whole[self.block :]
        return np.fft.irfft(np.fft.rfft(whole) * self.spectrum, self.n_fft)[-self.block :]


def filter_stream(samples: DataFrame, response, late: str = "error", expire_s: float | None = None) -> DataFrame:
    """signal_id, n, y: the stream through a response, exact across micro-batches; the state is the last taps - 1 samples."""
    h = np.asarray(response, float)

    def step(key, held, x, first, after):
        tail = np.frombuffer(held[0]) if held is not None else np.zeros(len(h) - 1)
        whole = np.concatenate((tail, x))
        y = vector.fft_convolve(whole, h)[len(h) - 1 : len(whole)] if len(x) else np.zeros(0)
        return pd.DataFrame({"signal_id": key[0], "n": np.arange(first, after), "y": y}), (whole[len(whole) - len(h) + 1 :].tobytes(), 0, after)

    return _stateful(samples, step, "signal_id long, n long, y double", late, expire_s)
