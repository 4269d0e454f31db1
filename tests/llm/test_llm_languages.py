"""Mixtures among many learned languages."""

import numpy as np

from marketgrid.llm import language


def test_no_language_is_left_out_beforehand():
    """Six relatives share most letters with the larger part; the smaller part and a fifth language are still found."""
    rng = np.random.default_rng(3)
    common = [f"{c}{v}" for c in "bdgfr" for v in "aei"]
    sets = [common + [f"{c}{v}" for v in "ou"] for c in "hjkmnp"] + [
        [f"{c}{v}" for c in cs for v in "aeiou"] for cs in ("tvw", "xyz", "lqs", "çñß")]
    speak = lambda k, n: " ".join("".join(rng.choice(sets[k], 3)) for _ in range(n))
    counts = np.full((language.BUCKETS, len(sets)), 0.5)
    for k in range(len(sets)):
        np.add.at(counts[:, k], language.trigrams(speak(k, 4_000)), 1)
    log_p = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    two = speak(0, 300) + " " + speak(6, 200)
    five = " ".join(speak(k, 200) for k in (0, 6, 7, 8, 9))
    got = language.mixtures([language.trigrams(t) for t in (two, five)], log_p)
    assert abs(got[0][0] - 0.6) < 0.08 and abs(got[0][6] - 0.4) < 0.08
    assert all(abs(got[1][k] - 0.2) < 0.06 for k in (0, 6, 7, 8, 9))
