import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemara.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=700), st.integers(0, 255))
def test_matrix_against_array(ids, symbol):
    a = np.array(ids, np.uint16)
    m = wavelet.WaveletMatrix.build(a, 8)
    places = np.flatnonzero(a == symbol).tolist()
    assert m.decode().tolist() == ids
    assert m.occurrences(symbol) == places and m.count(symbol) == len(places) and m.select(symbol, len(places)) == -1
    for i in range(0, len(ids), 37):
        assert m.access(i) == ids[i] and m.rank(symbol, i) == (a[:i] == symbol).sum()


def brute(rows):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def result(df):
    key = lambda r: (r[1], r[0] or 0)
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=key)


def test_whole_table_against_tokenizer(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert result(wavelet.op1_wavelet(spark, f"{DATA}/sf0.001")) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, odd_docs):
    assert result(wavelet.token_table(odd_docs, PATH)) == brute([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])


def test_empty(spark, no_docs):
    assert wavelet.token_table(no_docs, PATH).count() == 0


def test_small_shards_and_occurrences(spark, odd_docs):
    shards = wavelet.write_shards(odd_docs, PATH, shard_tokens=40)
    assert shards.count() > 3
    assert wavelet.occurrences(shards, 1).count() == odd_docs.count()  # end ids


@pytest.mark.parametrize("text", ["a\x1cb c", "É\xa0x ΣΑΣ  ς", "it's I'LL don't", "Élan!? ÀB.; ÿß İx ªb", "a|b | ||", "x²y", "é ́x", ""])
def test_unusual_texts(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    ids, counts = wavelet.encoder(PATH).encode(pa.array([text, text, "plain words."]))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids[: counts[0]].tolist() == want and counts[1] == len(want)
