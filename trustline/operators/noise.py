"""White noise at a chosen signal-to-noise ratio on decoded 16-bit audio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.align import noise_seed


def noisy(pcm: bytes, snr: float, utt_id: str) -> bytes:
    """Noise whose power is the signal's mean square over 10 ** (snr / 10), from a seed of utterance and level; clipped to 16 bits."""
    signal = np.frombuffer(pcm, "<i2").astype(np.float64)
    if not len(signal):
        return pcm
    power = max(float((signal**2).mean()) * 10 ** (-snr / 10), 1e-10)
    noise = np.random.default_rng(noise_seed(utt_id, snr)).normal(0, np.sqrt(power), len(signal))
    return np.clip(np.rint(signal + noise), -32768, 32767).astype("<i2").tobytes()


def add_noise(df: DataFrame, pcm: str = "pcm", snr: str = "snr", key: str = "utt_id") -> DataFrame:
    """df with its audio made noisy where snr is not null; null audio stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[pcm] = [noisy(p, float(s), str(k)) if p is not None and s is not None and s == s else p for p, s, k in zip(pdf[pcm], pdf[snr], pdf[key])]
            yield pdf

    return df.mapInPandas(run, df.schema)
