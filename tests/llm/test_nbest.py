import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemara.llm import nbest

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(lattice, s, n):
    """Scores of the best of all segmentations."""
    out = []

    def go(i, score):
        if i == len(s):
            out.append(score)
            return
        if s[i] not in lattice.pieces:
            go(i + 1, score + lattice._bytes(s[i])[1])
        for j in range(i + 1, len(s) + 1):
            if p := lattice.pieces.get(s[i:j]):
                go(j, score + p[1])

    go(0, 0.0)
    return sorted(out, reverse=True)[:n]


TEXTS = ["the cat", "hi  yo\nab", "é日x a", "internat", " ", "\n", "a\n\n b ", "a\0b c", "   x   y", "réeuxment", "abab abab", "t", "▁▁", "a" * 12, "=" * 12, "-" * 9 + "ab"]


@pytest.mark.parametrize("text", TEXTS)
def test_n_best_against_all_segmentations(text):
    lattice = nbest.piece_lattice(PATH)
    ids, score, variants = lattice.encode(text, 4)
    marked = nbest.SPACE + text.replace(" ", nbest.SPACE)
    want = brute(lattice, marked, 4)
    assert np.allclose([s for s, _ in variants], want) and np.isclose(score, want[0])
    assert np.allclose([s for s, _ in lattice.n_best(marked, 4)], want)
    seen = set()
    for s, changes in variants:
        x = ids.tolist()
        for at, old, new in sorted(changes, reverse=True):
            x[at : at + old] = new
        assert lattice.decode(x) == text.replace(nbest.SPACE, " ")
        seen.add(tuple(x))
    assert len(seen) == len(variants)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aethr ▁\né.", max_size=9), min_size=1, max_size=4))
def test_batches_are_single_texts(texts):
    lattice = nbest.piece_lattice(PATH)
    flat, counts, scores, _ = lattice.encode_batch(texts)
    for t, ids, s in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), scores, strict=True):
        assert lattice.decode(ids.tolist()) == t.replace(nbest.SPACE, " ")
        if t:
            assert np.isclose(s, brute(lattice, nbest.SPACE + t.replace(" ", nbest.SPACE), 1)[0])


def test_odd_rows(spark, odd_docs, no_docs):
    out = nbest.encode_documents(odd_docs, PATH).collect()
    assert len(out) == odd_docs.count() and all(r["round_trip"] for r in out)
    assert {r["n_pieces"] for r in out if r["doc_id"] in (2, 3)} == {0}
    assert all(len(r["ids"]) == r["n_pieces"] and r["n_best"][0]["score"] == pytest.approx(r["score"]) for r in out)
    assert nbest.encode_documents(no_docs, PATH).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    whole = nbest.PieceLattice(PATH).encode_batch(TEXTS)
    monkeypatch.setattr(nbest, "CACHE_SEGMENTS", 2)
    small = nbest.PieceLattice(PATH)
    for _ in range(3):
        again = small.encode_batch(TEXTS)
        assert (again[0] == whole[0]).all() and np.allclose(again[2], whole[2])


@pytest.mark.parametrize("char", ["a", "=", "日", "é", "\0"])
def test_runs_of_one_character_end(char):
    """Ties everywhere: seconds for a million characters, and the same losses as in a short run."""
    import time

    began = time.time()
    lattice = nbest.piece_lattice(PATH)
    for n in (200, 5000, 1_000_000):
        ids, score, variants = lattice.encode(char * n, 4)
        assert variants and all(a >= b - 1e-6 for (a, _), (b, _) in zip(variants, variants[1:], strict=False))
        assert variants[0][0] == pytest.approx(score) and lattice.decode(ids.tolist()) == char * n
    assert time.time() - began < 60


def test_long_segments_are_searched_like_short_ones(monkeypatch):
    lattice = nbest.piece_lattice(PATH)
    text = nbest.SPACE + "".join("aabbaeeth"[i * i % 9] for i in range(40))
    want = lattice.n_best(text, 6)
    monkeypatch.setattr(nbest, "WIDEST", 4)
    monkeypatch.setattr(nbest, "FIRST_CUTOFF", 1e-3)
    assert np.allclose([s for s, _ in lattice.n_best(text, 6)], [s for s, _ in want])
