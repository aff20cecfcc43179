"""Parameters of operators: immutable, validated when made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from .errors import InvalidInput, require
from .functions.windows import Window


def _finite(x: float) -> bool:
    return isinstance(x, (int, float)) and math.isfinite(x)


@dataclass(frozen=True)
class StftParams:
    n_fft: int
    hop: int
    window: Window = field(default_factory=Window)
    centre: bool = True

    def __post_init__(self):
        if isinstance(self.window, str):
            object.__setattr__(self, "window", Window.parse(self.window))
        require(self.n_fft > 0, "n_fft must be positive")
        require(0 < self.hop <= self.n_fft, "hop must be positive and at most n_fft")
        if self.window.kind == "custom":
            require(len(self.window.coefficients) == self.n_fft, "a custom window must have n_fft values")

    @property
    def pad(self) -> int:
        return self.n_fft // 2 if self.centre else 0

    @property
    def n_bins(self) -> int:
        return self.n_fft // 2 + 1

    def frame_count(self, n: int) -> int:
        """Frames of n samples: one at least, then one a hop as long as a whole frame fits."""
        require(n > 0, "a signal has at least one sample")
        padded = n + 2 * self.pad
        return 1 if padded < self.n_fft else (padded - self.n_fft) // self.hop + 1

    def with_(self, **changes) -> StftParams:
        return replace(self, **changes)


@dataclass(frozen=True)
class SpectroParams:
    stft: StftParams
    sample_rate: float

    def __post_init__(self):
        require(_finite(self.sample_rate) and self.sample_rate > 0, "the sample rate must be finite and positive")

    @staticmethod
    def speech(sample_rate: float = 16000.0) -> SpectroParams:
        return SpectroParams(StftParams(512, 160), sample_rate)

    @staticmethod
    def music(sample_rate: float = 44100.0) -> SpectroParams:
        return SpectroParams(StftParams(2048, 512), sample_rate)

    @property
    def nyquist(self) -> float:
        return self.sample_rate / 2

    @property
    def resolution(self) -> float:
        """Hz from one bin to the next."""
        return self.sample_rate / self.stft.n_fft

    @property
    def period(self) -> float:
        """Seconds from one frame to the next."""
        return self.stft.hop / self.sample_rate


MEL_NORMS = ("none", "slaney", "l1", "l2")


@dataclass(frozen=True)
class MelParams:
    n_mels: int
    f_min: float
    f_max: float
    norm: str = "none"

    def __post_init__(self):
        object.__setattr__(self, "norm", (self.norm or "none").lower())
        require(0 < self.n_mels <= 10_000, "n_mels must be from 1 to 10000")
        require(_finite(self.f_min) and self.f_min >= 0, "f_min must not be negative")
        require(_finite(self.f_max) and self.f_max > self.f_min, "f_max must exceed f_min")
        require(self.norm in MEL_NORMS, f"norm must be one of {MEL_NORMS}")

    @staticmethod
    def standard(sample_rate: float) -> MelParams:
        return MelParams(128, 0.0, sample_rate / 2)

    @staticmethod
    def speech() -> MelParams:
        return MelParams(40, 0.0, 8000.0)


@dataclass(frozen=True)
class LogHzParams:
    n_bins: int
    f_min: float
    f_max: float

    def __post_init__(self):
        require(self.n_bins >= 2, "a logarithmic axis needs two bins at least")
        require(_finite(self.f_min) and self.f_min > 0, "f_min must be positive")
        require(_finite(self.f_max) and self.f_max > self.f_min, "f_max must exceed f_min")

    @staticmethod
    def standard(sample_rate: float) -> LogHzParams:
        return LogHzParams(128, 20.0, sample_rate / 2)

    @staticmethod
    def music() -> LogHzParams:
        return LogHzParams(84, 27.5, 4186.0)


@dataclass(frozen=True)
class LogParams:
    floor_db: float = -80.0

    def __post_init__(self):
        require(_finite(self.floor_db), "floor_db must be finite")

    @property
    def least(self) -> float:
        return 10 ** (self.floor_db / 10)


@dataclass(frozen=True)
class ErbParams:
    n_filters: int
    f_min: float
    f_max: float
    spacing: str = "linear"
    db_floor: float | None = None

    def __post_init__(self):
        require(self.n_filters >= 2, "n_filters must be 2 at least")
        require(_finite(self.f_min) and self.f_min >= 0, "f_min must not be negative")
        require(_finite(self.f_max) and self.f_max > self.f_min, "f_max must exceed f_min")
        require(self.spacing in ("linear", "apple_tr35"), "spacing must be linear or apple_tr35")

    @staticmethod
    def speech() -> ErbParams:
        return ErbParams(40, 0.0, 8000.0)

    @staticmethod
    def music(sample_rate: float) -> ErbParams:
        return ErbParams(64, 0.0, sample_rate / 2)


@dataclass(frozen=True)
class CqtParams:
    bins_per_octave: int
    n_octaves: int
    f_min: float
    q: float | None = None
    window: Window = field(default_factory=Window)
    sparsity: float = 0.01
    normalize: bool = True

    def __post_init__(self):
        require(self.bins_per_octave > 0 and self.n_octaves > 0, "bins per octave and octaves must be positive")
        require(_finite(self.f_min) and self.f_min > 0, "f_min must be positive")
        if self.q is None:
            object.__setattr__(self, "q", 1 / (2 ** (1 / self.bins_per_octave) - 1))
        require(_finite(self.q) and self.q > 0, "q must be positive")

    @property
    def n_bins(self) -> int:
        return self.bins_per_octave * self.n_octaves

    def frequency(self, k: int) -> float:
        return self.f_min * 2 ** (k / self.bins_per_octave)


@dataclass(frozen=True)
class ChromaParams:
    tuning: float = 440.0
    f_min: float = 32.7
    f_max: float = 4186.0
    norm: str = "l2"

    def __post_init__(self):
        require(_finite(self.tuning) and self.tuning > 0, "tuning must be positive")
        require(_finite(self.f_min) and self.f_min > 0, "f_min must be positive")
        require(_finite(self.f_max) and self.f_max > self.f_min, "f_max must exceed f_min")
        require(self.norm in ("none", "l1", "l2", "max"), "norm must be none, l1, l2 or max")

    @property
    def n_octaves(self) -> int:
        return math.ceil(math.log2(self.f_max / self.f_min))


PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


@dataclass(frozen=True)
class MfccParams:
    n_mfcc: int = 13
    include_c0: bool = True
    lifter: int = 22

    def __post_init__(self):
        require(self.n_mfcc > 0 and self.lifter >= 0, "n_mfcc must be positive, lifter not negative")


@dataclass(frozen=True)
class MdctParams:
    window_size: int
    hop: int
    window: Window = field(default_factory=Window)

    def __post_init__(self):
        require(self.window_size >= 4 and self.window_size % 2 == 0, "the window size must be even and 4 at least")
        require(self.hop > 0, "hop must be positive")

    @property
    def n(self) -> int:
        return self.window_size // 2

    @staticmethod
    def sine(window_size: int) -> MdctParams:
        """The sine window with half overlap, which reconstructs perfectly."""
        require(window_size >= 4 and window_size % 2 == 0, "the window size must be even and 4 at least")
        return MdctParams(window_size, window_size // 2, Window.custom(math.sin(math.pi * (k + 0.5) / window_size) for k in range(window_size)))


@dataclass(frozen=True)
class BinauralParams:
    """A band of frequencies of a two-channel comparison; power and wrapped matter to time and phase differences."""

    spectro: SpectroParams
    start: float
    stop: float
    power: float = 1.0
    wrapped: bool = False

    def __post_init__(self):
        require(0 < self.start < self.stop <= self.spectro.nyquist, "the band must be 0 < start < stop <= Nyquist")

    @property
    def bins(self) -> range:
        step = self.spectro.resolution
        # Halves round away from zero.
        first, last = math.floor(self.start / step + 0.5), math.floor(self.stop / step + 0.5)
        if first >= last:
            raise InvalidInput("the band holds no bin")
        return range(first, last)

    def without_dc(self) -> range:
        if self.bins.start < 1:
            raise InvalidInput("the band begins at bin 0, which has no delay")
        return self.bins
