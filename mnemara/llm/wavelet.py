"""Token ids as wavelet matrices: one succinct, compressed file a shard.

Documents are dealt by ranges of ``doc_id`` and sorted; each task encodes its texts and closes a shard when it holds
``SHARD_TOKENS`` ids (a document never spans two shards). A shard is one row of a Parquet part file: for each bit of the
ids, from the highest, a packed bit-plane with ones counted before every 512 bits, the number of zeros of the plane,
and the documents' ids and lengths. From these alone come the token at a place (``access``), the count of an id before
a place (``rank``), the place of its k-th occurrence (``select``) and all its places (``occurrences``); ``decode`` undoes the
planes' stable partitions in sequence for a whole shard. Spark writes the files, so they can lie on any store it
reaches and a lost task leaves nothing behind.

A shard stores the ids before it in its range; the ranges' own offsets are a sum over one number a range.

Edge cases: null and empty texts hold the end id only; null ids sort first; rows repeated with one id follow each other
by text; an empty table gives no shards and an empty result; documents of any length are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemara.llm.common import Recent, materialise, ship, table, worker_state

SHARD_TOKENS = 1 << 21
END_ID = 1
RANK_BITS = 512
CACHE_WORDS = 600_000
CACHE_RUNS = 200_000
DOCS_AT_ONCE = 2048


class ChunkEncoder:
    """Encodes texts by their runs between ASCII white space.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its runs in order. A batch
    is split and dictionary-encoded by Arrow, so each different run of a batch is looked at once.

    Most runs are a word of Latin letters and some stops, of which the tokenizer makes the pieces of the lower-case word
    and those of the stops. Arrow splits these too, and what is looked up in Python are the different lower-case words of a
    batch; unknown ones skip the tokenizer's normaliser and pattern matching. Ids of words, and of other runs, that were met
    before come from bounded caches; unknown runs of the other kind are encoded in one call, as one text with a mark of a
    single id between them (runs that hold the mark's character are encoded alone).
    """

    MARK = "|"
    PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<stops>[.,;:!?]*)$"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.width = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.mark = self._ids(self.MARK)
        self.known, self.words = Recent(CACHE_RUNS), Recent(CACHE_WORDS)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(1 << self.width, bool)  # ids that end a word
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.fast = all(self._spell([x]) for x in ("a", "zé", "ß", "!?"))

    def _spell(self, words: list[str]) -> list[bytes] | None:
        """Ids of each of some lower-case words or runs of stops; None if the ids don't show where they end."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return None
        whole, stops = ids.tobytes(), (stops * ids.itemsize).tolist()
        return [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words or runs of stops."""
        out = self.words.find(words)
        if new := [w for w, x in zip(words, out, strict=True) if x is None and w]:
            spelt = self._spell(new) or [self._ids(w).tobytes() for w in new]
            learnt = dict(zip(new, spelt, strict=True))
            self.words.new |= learnt
            out = [learnt[w] if x is None and w else x for w, x in zip(words, out, strict=True)]
            self.words.forget_long(new)
        return [x or b"" for x in out]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of any other runs."""
        out = self.known.find(runs)
        new = [r for r, x in zip(runs, out, strict=True) if x is None]
        if not new:
            return out
        learnt, size = {}, self.dtype.itemsize
        if plain := [r for r in new if self.MARK not in r] if len(self.mark) == 1 else []:
            ids = self._ids(f" {self.MARK} ".join(plain))
            cuts = (np.flatnonzero(ids == self.mark[0]) * size).tolist()
            whole = ids.tobytes()
            for r, a, b in zip(plain, [-size, *cuts], [*cuts, len(whole)], strict=True):
                learnt[r] = whole[a + size : b]
        for r in new:
            if r not in learnt:
                learnt[r] = self._ids(r).tobytes()
        self.known.new |= learnt
        self.known.forget_long(new)
        return [learnt[r] if x is None else x for r, x in zip(runs, out, strict=True)]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts in a row, each text followed by ``end_id`` if given, and how many each has."""
        self.known.age()
        self.words.age()
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        runs, index = coded.dictionary, coded.indices.to_numpy()
        # Each run is two parts: a word and its stops, or the whole run and nothing.
        first, second, parts = np.zeros(len(runs), np.int32), np.zeros(len(runs), np.int32), [b""]
        plain = np.zeros(len(runs), bool)
        if self.fast and len(runs):
            split = pc.extract_regex(runs, self.PLAIN)
            plain = split.is_valid().to_numpy(zero_copy_only=False)
            for place, column in ((first, pc.utf8_lower(split.field("word"))), (second, split.field("stops"))):
                each = column.filter(pa.array(plain)).dictionary_encode()
                place[plain] = len(parts) + each.indices.to_numpy()
                parts += self._words(each.dictionary.to_numpy(zero_copy_only=False).tolist())
        others = np.flatnonzero(~plain)
        first[others] = len(parts) + np.arange(len(others))
        parts += self._runs(runs.take(pa.array(others)).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(parts), self.dtype)))
        both = np.stack([first, second], axis=1)[index].ravel()
        flat = ids.take(pa.array(both)).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum((sizes[first] + sizes[second])[index])])
        stops = upto[np.cumsum(np.asarray(lists.value_lengths()))] if len(lists) else np.zeros(0, np.int64)
        counts = np.diff(stops, prepend=0)
        if end_id is not None:
            flat, counts = np.insert(flat, stops, end_id), counts + 1
        return flat, counts


def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker, kept between its tasks of this kind."""
    return worker_state(("runs", path), lambda: ChunkEncoder(path))


@dataclass
class WaveletMatrix:
    n: int
    planes: list[np.ndarray]  # packed bits, highest plane first
    ones: list[np.ndarray]  # ones before every RANK_BITS bits
    zeros: list[int]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, ones, zeros, s = [], [], [], ids
        for level in range(width - 1, -1, -1):
            mask = (s & s.dtype.type(1 << level)) != 0
            packed = np.packbits(mask)
            planes.append(packed)
            padded = np.zeros(-(-len(packed) * 8 // RANK_BITS) * RANK_BITS // 8, np.uint8)
            padded[: len(packed)] = packed
            per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1, dtype=np.uint32)
            ones.append(np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4") if len(per) else np.zeros(0, "<u4"))
            low = np.flatnonzero(~mask)
            zeros.append(len(low))
            s = np.concatenate([s.take(low), s.take(np.flatnonzero(mask))])
        return cls(len(ids), planes, ones, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        width = len(self.planes)
        s = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            mask = np.unpackbits(self.planes[level], count=self.n).view(bool)
            out = np.empty_like(s)
            out[np.flatnonzero(~mask)] = s[: self.zeros[level]]
            out[np.flatnonzero(mask)] = s[self.zeros[level] :] | s.dtype.type(1 << (width - 1 - level))
            s = out
        return s

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        if i == 0:
            return 0
        if i >= self.n:
            return self.n - self.zeros[level]
        block = i // RANK_BITS
        start = block * RANK_BITS >> 3
        whole = int(np.bitwise_count(self.planes[level][start : i >> 3]).sum())
        rest = int(self.planes[level][i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self.ones[level][block]) + whole + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``bit`` of a plane, by binary search on its rank."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` within places ``start`` to ``stop`` stand after the last plane."""
        width = len(self.planes)
        if symbol >> width:
            return 0, 0
        for level in range(width):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if symbol >> (width - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def select(self, symbol: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence, or -1."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i, width = a + k, len(self.planes)
        for level in range(width - 1, -1, -1):
            if symbol >> (width - 1 - level) & 1:
                i = self._select(level, 1, i - self.zeros[level])
            else:
                i = self._select(level, 0, i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


SHARD_SCHEMA = (
    "part int, seq int, base long, n_tokens long, width int, doc_ids array<long>, lengths array<long>,"
    " planes array<binary>, ones array<binary>, zeros array<long>"
)


def _shard_batch(part: int, seq: int, base: int, tokens: np.ndarray, doc_ids: list, lengths: np.ndarray, enc: ChunkEncoder) -> pa.RecordBatch:
    w = WaveletMatrix.build(tokens, enc.width)
    row = {
        "part": part, "seq": seq, "base": base, "n_tokens": len(tokens), "width": enc.width, "doc_ids": doc_ids, "lengths": lengths,
        "planes": [p.tobytes() for p in w.planes], "ones": [o.tobytes() for o in w.ones], "zeros": w.zeros,
    }
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def write_shards(docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Encode, write and open the shards of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, counts = np.zeros(0, enc.dtype), [], np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, DOCS_AT_ONCE):
                piece = b.slice(at, DOCS_AT_ONCE)
                more, n = enc.encode(piece.column(1), end_id)
                ids, counts = np.concatenate([ids, more]), np.concatenate([counts, n])
                doc_ids += piece.column(0).to_pylist()
                while len(ids) > shard_tokens:  # close a shard at the last document that fits, or after the first
                    stops = np.cumsum(counts)
                    docs_in = max(1, int(np.searchsorted(stops, shard_tokens, side="right")))
                    cut = int(stops[docs_in - 1])
                    yield _shard_batch(part, seq, base, ids[:cut], doc_ids[:docs_in], counts[:docs_in], enc)
                    seq, base = seq + 1, base + cut
                    ids, doc_ids, counts = ids[cut:], doc_ids[docs_in:], counts[docs_in:]
        if doc_ids:
            yield _shard_batch(part, seq, base, ids, doc_ids, counts, enc)

    ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, SHARD_SCHEMA), "shards")


def open_shard(row) -> WaveletMatrix:
    """The matrix of one row of a shard table."""
    return WaveletMatrix(
        row["n_tokens"], [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(o, "<u4") for o in row["ones"]], list(row["zeros"])
    )


def read_documents(shards: DataFrame) -> DataFrame:
    """``part, doc_id, local, n_tokens, ids_crc32`` of every document, from the shards' planes; ``local``: ids before it in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: c[0].as_py() for k, c in zip(b.schema.names, b.slice(i, 1).columns, strict=True)}
                ids = memoryview(open_shard(row).decode().astype("<u4").tobytes())
                lengths = np.array(row["lengths"], np.int64)
                stops = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(crc), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + stops - lengths, pa.int64()),
                        pa.array(lengths), pa.array(crc, pa.int64()),
                    ],
                    ["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, symbol: int) -> DataFrame:
    """``part, seq, place`` of every occurrence of an id, by rank and select on the planes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: c[0].as_py() for k, c in zip(b.schema.names, b.slice(i, 1).columns, strict=True)}
                places = open_shard(row).occurrences(symbol)
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(places, pa.int64())], ["part", "seq", "place"]
                )

    return shards.select("part", "seq", "n_tokens", "planes", "ones", "zeros").mapInArrow(run, "part int, seq int, place long")


def token_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    shards = write_shards(docs, tokenizer_path)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return read_documents(shards).join(offsets, "part").select("doc_id", (F.col("_offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
