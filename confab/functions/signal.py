"""Signal functions: log-mel filter banks of speech."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrow import function


def mel(hz):
    return 1127.0 * np.log1p(np.asarray(hz, float) / 700.0)


def mel_bank(n_mels: int, n_fft: int, rate: int, low: float, high: float) -> np.ndarray:
    """Triangles equally wide in mel, over the bins of a real transform."""
    edges = np.linspace(mel(low), mel(high), n_mels + 2)
    bins = mel(np.arange(n_fft // 2 + 1) * rate / n_fft)[:, None]
    up, down = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    bank = np.maximum(0.0, np.minimum(up, down))
    bank[-1] = 0.0  # the last bin is not counted
    return bank


#: Window shapes by name; speaker models take hamming.
WINDOWS = {"hamming": np.hamming, "povey": lambda n: np.hanning(n) ** 0.85, "hanning": np.hanning, "rectangular": np.ones}


def frame_sizes(rate: int = 16_000, frame_ms: float = 25.0, hop_ms: float = 10.0) -> tuple[int, int]:
    """Samples of a frame, and from one frame's start to the next."""
    return int(rate * frame_ms / 1000), int(rate * hop_ms / 1000)


def log_energies(samples: np.ndarray, rate: int = 16_000, n_mels: int = 80, frame_ms: float = 25.0, hop_ms: float = 10.0, low: float = 20.0, high: float | None = None, window: str = "hamming") -> np.ndarray:
    """frames x ``n_mels``: log power of pre-emphasised, windowed frames without their mean."""
    x = np.asarray(samples, np.float64) * 32768.0
    size, hop = frame_sizes(rate, frame_ms, hop_ms)
    n_fft = 1 << (size - 1).bit_length()
    if len(x) < size:
        return np.zeros((0, n_mels))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop].copy()
    frames -= frames.mean(axis=1, keepdims=True)
    frames -= 0.97 * np.concatenate((frames[:, :1], frames[:, :-1]), axis=1)
    frames *= WINDOWS[window](size)
    power = np.abs(np.fft.rfft(frames, n_fft)) ** 2
    return np.log(np.maximum(power @ mel_bank(n_mels, n_fft, rate, low, high or rate / 2), np.finfo(np.float32).eps))


def log_mel(samples: np.ndarray, **settings) -> np.ndarray:
    """``log_energies`` less each column's mean over the recording."""
    out = log_energies(samples, **settings)
    return out - out.mean(axis=0) if len(out) else out


@function("array<array<float>>")
def filter_bank(samples: pa.Array) -> pa.Array:
    """Log-mel frames of each row's samples (16 kHz); null and too short ones have none."""
    return pa.array([log_mel(np.array(s or [], float)).astype(np.float32).tolist() for s in samples.to_pylist()], pa.list_(pa.list_(pa.float32())))
