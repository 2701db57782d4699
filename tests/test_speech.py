"""Speech by composed state maps is the speech of one fold over the recording."""

import numpy as np
import pytest

from confab.operators import folds, speech

# limits between two numbers of frames, as the fold adds up seconds
SHORT = speech.Limits(min_silence=0.12, most=0.95, min_speech=0.06, pad=0.05)
USUAL = speech.Limits(most=19.99)


def folded(p, limits):
    return folds.speech_regions(p, limits.frame_s, limits.on, limits.off, limits.min_silence, limits.min_speech, limits.pad, limits.most)


def recordings(seed):
    """Talk with pauses, bands between the thresholds, no silence at all, nothing but silence."""
    rng = np.random.default_rng(seed)
    out = [np.clip(np.repeat(rng.random(60), rng.integers(1, 30, 60)) + 0.05 * rng.normal(size=1)[0], 0, 1) for _ in range(6)]
    return [*out, np.full(500, 0.9), np.full(300, 0.4), np.full(200, 0.1), rng.random(400), np.tile([0.9] + [0.4] * 9, 40), np.array([0.9]), np.tile([0.6, 0.4, 0.3], 100)]


@pytest.mark.parametrize("seed", [1, 2])
def test_maps_compose(seed):
    """Cut anywhere, the maps one after another lead where the fold does, from any state."""
    rng, silence, most = np.random.default_rng(seed), 4, 9
    lengths, quiets = speech.entries(silence, most)
    assert [speech.entry_index(a, b) for a, b in zip(lengths.tolist(), quiets.tolist())] == list(range(len(lengths)))
    for p in recordings(seed):
        kinds = SHORT.kinds(p)
        cuts = sorted(rng.integers(0, len(kinds) + 1, 4).tolist())
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)]) if b > a]
        for begin in [(-1, 0), (0, 0), (5, 2), (8, 8)]:
            at = begin
            for part in parts:
                first, length, quiet = speech.state_map(part, silence, most)
                k = int(np.searchsorted(first, speech.entry_index(*at), side="right")) - 1
                at = length[k], quiet[k]
            assert at == speech.follow(kinds, begin, silence, most)[1]


@pytest.mark.parametrize("limits, piece", [(SHORT, 7), (SHORT, 50), (USUAL, 37), (USUAL, 8192)])
def test_speech_over_many_tasks(spark, limits, piece):
    rows = [(m, 3 * k + m, float(x)) for m, p in enumerate(recordings(3)) for k, x in enumerate(p)]
    frames = spark.createDataFrame(rows, "meeting_id long, frame long, probability double").repartition(5)
    got = {}
    for r in speech.detected_speech(frames, limits=limits, piece_frames=piece).collect():
        got.setdefault(r.meeting_id, {})[r.region] = (r.start_s, r.end_s)
    for m, p in enumerate(recordings(3)):
        mine = got.get(m, {})
        assert [mine[k] for k in sorted(mine)] == [pytest.approx(x, abs=1e-9) for x in folded(p.tolist(), limits)]


def test_speech_of_odd_frames(spark):
    frames = spark.createDataFrame([("a", k, None if k % 2 else 0.9) for k in range(40)] + [(None, 1, 0.9)], "meeting_id string, frame long, probability double")
    got = speech.detected_speech(frames, piece_frames=8).collect()
    assert [(r.meeting_id, r.region, r.start_s, r.end_s) for r in got] == [("a", 0, 0.0, 1.28)]
    assert speech.detected_speech(frames.limit(0)).collect() == []
