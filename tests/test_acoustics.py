"""Features by chunks are those of the whole recording."""

import numpy as np
import pytest

from confab.functions import signal
from confab.operators import acoustics


@pytest.mark.parametrize("chunk, sizes", [(400, (1234, 399, 400, 800, 2005)), (1000, (5000, 1399, 60)), (777, (777 * 3, 776, 1554 + 399))])
def test_chunked_features(spark, chunk, sizes):
    rng = np.random.default_rng(1)
    waves = [np.sin(np.arange(n) * 0.05 * (k + 1)) * 0.3 + 0.01 * rng.normal(size=n) for k, n in enumerate(sizes)]
    rows = [(k, a // chunk, w[a : a + chunk].tolist()) for k, w in enumerate(waves) for a in range(0, len(w), chunk)]
    got = acoustics.log_mel_features(spark.createDataFrame(rows, "recording_id long, chunk long, samples array<double>"), chunk=chunk, n_mels=20).collect()
    for k, w in enumerate(waves):
        want = signal.log_mel(w, n_mels=20)
        mine = sorted((r.frame, r.features) for r in got if r.recording_id == k)
        assert [f for f, _ in mine] == list(range(len(want)))
        assert len(want) == 0 or np.allclose([x for _, x in mine], want, atol=1e-9)


def test_features_of_short_and_missing_recordings(spark):
    none = spark.createDataFrame([(1, 0, [0.0] * 10), (None, 0, [0.0] * 800)], "recording_id long, chunk long, samples array<double>")
    assert acoustics.log_mel_features(none).collect() == []
    with pytest.raises(ValueError):
        acoustics.log_mel_features(none, chunk=100)


def test_speaker_models_take_hamming_windows():
    x = np.sin(np.arange(4000) * 0.3)
    assert np.allclose(signal.log_mel(x), signal.log_mel(x, window="hamming")) and not np.allclose(signal.log_mel(x), signal.log_mel(x, window="povey"), atol=1e-3)
