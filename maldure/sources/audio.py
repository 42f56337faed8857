"""Audio from bytes: raw PCM and WAV decoding, channel mean, resampling. Arrow-batched; nothing is decoded per row in the JVM."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = T.ArrayType(T.FloatType())
WAV = T.StructType([T.StructField("samples", SAMPLES), T.StructField("sample_rate", T.IntegerType())])


def pcm_samples(data: bytes) -> np.ndarray:
    """16-bit little-endian samples between -1 and 1; an odd last byte is left out."""
    return np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2").astype("float32") / 32768.0


def wav_samples(data: bytes) -> tuple[np.ndarray, int] | None:
    """Mono samples and rate of a PCM WAV file of 8, 16, 24 or 32 bits; null for anything else."""
    try:
        with wave.open(io.BytesIO(data)) as file:
            width, channels, rate, n = file.getsampwidth(), file.getnchannels(), file.getframerate(), file.getnframes()
            frames = file.readframes(n)
    except (wave.Error, EOFError):
        return None
    frames = frames[: len(frames) // (width * channels) * width * channels]
    if width == 1:
        samples = (np.frombuffer(frames, dtype="u1").astype("float32") - 128.0) / 128.0
    elif width == 3:
        parts = np.frombuffer(frames, dtype="u1").reshape(-1, 3).astype("int32")
        value = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        samples = (value - ((value & 0x800000) << 1)).astype("float32") / 8388608.0
    elif width in (2, 4):
        samples = np.frombuffer(frames, dtype=f"<i{width}").astype("float32") / float(1 << (8 * width - 1))
    else:
        return None
    return (samples.reshape(-1, channels).mean(axis=1) if channels > 1 else samples), rate


def resampled(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation to another rate; at least one sample of a non-empty signal. Both signals' times begin at 0 and end before their length."""
    if rate == target or not len(samples):
        return samples
    n = max(1, round(len(samples) / rate * target))
    return np.interp(np.arange(n) * (len(samples) / n), np.arange(len(samples)), samples).astype("float32")


def read_samples(path: str) -> tuple[np.ndarray, int | None]:
    """Mono samples of a .wav or raw .pcm file, and its rate where it has one; an error for anything else."""
    with open(path.removeprefix("file:"), "rb") as file:
        data = file.read()
    if path.lower().endswith(".pcm"):
        return pcm_samples(data), None
    got = wav_samples(data) if path.lower().endswith(".wav") else None
    if got is None:
        raise ValueError(f"could not decode {path}: only PCM in .wav and raw .pcm are read")
    return got


@F.pandas_udf(WAV)
def read_audio(path: pd.Series) -> pd.DataFrame:
    """The files' samples and rates; the workers must see the files under these paths."""
    rows = [(None, None) if p is None else read_samples(p) for p in path]
    return pd.DataFrame({"samples": [r[0] for r in rows], "sample_rate": pd.array([r[1] for r in rows], dtype="Int32")})


@F.pandas_udf(SAMPLES)
def pcm_decode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else pcm_samples(b))


@F.pandas_udf(WAV)
def wav_decode(data: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if b is None or (got := wav_samples(b)) is None else got for b in data]
    return pd.DataFrame({"samples": [r[0] for r in rows], "sample_rate": pd.array([r[1] for r in rows], dtype="Int32")})


@F.pandas_udf(SAMPLES)
def resample_linear(samples: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or r is None or not r > 0 else resampled(np.asarray(s, dtype="float32"), int(r), int(t)) for s, r, t in zip(samples, rate, target)], dtype="object")
