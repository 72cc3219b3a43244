"""The short ways of sentencepiece_sampling against the plain ones."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from rosterline.llm import sentencepiece_sampling as module


@pytest.fixture(scope="module")
def sampler():
    return module.Sampler(public_tokenizers.path("piece_bpe_32k.model"), 3, 0.5)


def test_units_as_the_pattern_cuts(sampler):
    r = random.Random(3)
    texts = ["", "▁", "\n", "▁a", "a▁", "▁▁a▁b", "a\n▁b\n\nc▁", "\0▁a\0b", "▁\n▁"] + ["".join(r.choices("ab▁\n\0é", [5, 5, 4, 2, r.randrange(2), 1], k=30)) for _ in range(2000)]
    for t in texts:
        assert sampler.units(t) == module.UNIT.findall(t)


def test_numbers_one_by_one():
    r = random.Random(4)
    for key in [0, 1, (1 << 64) - 1, *(r.getrandbits(64) for _ in range(500))]:
        assert module._mixed_int(key) == int(module._mixed(np.array([key], np.uint64))[0])
        assert module._uniform(key + (1 << 64)) == module.uniform(np.array([key], np.uint64))[0]


def test_samples_do_not_hang_on_their_batch(sampler):
    r = random.Random(5)
    texts = ["▁" + "▁".join(r.choices(["the", "ndonen", "é😀", "x\ny", "aaaa"], k=r.randrange(1, 400))) for _ in range(40)]
    seeds = np.arange(40, dtype=np.uint64)
    together = sampler.sample(texts, seeds)
    for i in range(40):
        for a, b in zip(together[i], sampler.sample(texts[i : i + 1], seeds[i : i + 1])[0], strict=True):
            assert a[0].tolist() == b[0].tolist() and a[1:] == pytest.approx(b[1:], rel=1e-9)
