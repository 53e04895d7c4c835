"""Hashed-word vectors by blocks against a loop over words, and what a batch of them holds in memory."""

import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from mnemara.functions import hashed

ROOT = Path(__file__).resolve().parents[1]
ODD = ["", " ", "?!", None, "Code7 memory the THE", "code7x CODE codes1 memtoken12 memtokenx xcode7 owns ownsx doctoken3", "Kelvin İstanbul straßeıx", "\ud800abc \U0001f600owns\n\n", "a" * 65, "z" * 64 + " " + "b" * 700]


def plain(text, dim):
    if text is None:
        return None
    v = np.zeros(dim)
    for word, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
        v[hashed.word_slot(word, dim)] += n * hashed.word_weight(word)
    size = np.sqrt((v * v).sum())
    if not size:
        v[0] = size = 1.0
    return (v / size).astype(np.float32).tolist()


def some_texts(n, seed=5):
    draw = random.Random(seed)
    words = ["a", "Of", "service", "memory", "code", "code12", "hybtoken9", "runbook", "été", "x1", "0", "longerword", "日本", "İx", "q" * 70]
    return [draw.choice(ODD[:7]) if draw.random() < 0.1 else draw.choice([" ", "\n", "-", ""]).join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(n)]


def test_blocks_equal_words(monkeypatch):
    texts = [t for t in ODD if t is None or "\ud800" not in t] + some_texts(600)
    want = [plain(t, 64) for t in texts]
    for chars in (1 << 18, 50, 1):
        monkeypatch.setattr(hashed, "CHARS_A_BLOCK", chars)
        assert hashed.vectors(pa.array(texts, pa.string()), 64).to_pylist() == want
    assert hashed._block([ODD[7]], 64)[0].tolist() == plain(ODD[7], 64)
    assert hashed.vectors(pa.array([None, None], pa.string()), 8).to_pylist() == [None, None] and len(hashed.vectors(pa.array([], pa.string()), 8)) == 0
    assert hashed.vectors(pa.array(texts, pa.string()).slice(3, 9), 64).to_pylist() == [plain(t, 64) for t in texts[3:12]]


def test_a_batch_holds_little():
    """Ten thousand chunks: their vectors (10 MB) and one block's work, not a Python object a text or vector; one long text is cut."""
    for texts, most in (([f"{i} some words of a chunk number " * 36 for i in range(10_000)], 20e6), (["some words of a text number " * 400_000], 36e6)):
        batch = pa.array(texts, pa.string())
        del texts
        tracemalloc.start()
        try:
            out = hashed.vectors(batch, 256)
            assert tracemalloc.get_traced_memory()[1] < most and len(out) == len(batch)
        finally:
            tracemalloc.stop()


def test_module_loads_no_pandas():
    """What a worker loads to embed."""
    check = "import sys, mnemara.functions.hashed; sys.exit('pandas' in sys.modules or 'pyspark' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", check], cwd=ROOT).returncode == 0
