"""SentencePiece encoding and decoding with N-best segmentation.

A text's piece lattice has an edge for every piece that matches at a place (bytes stand in for characters without
one). A forward Viterbi pass gives the best score from the start to every place; a backward A* search from the end
uses these scores as heuristics, which are exact, so complete segmentations come off its queue in order of score.

Pieces have log-probabilities by Zipf's law on the vocabulary's merge ranks (the models at hand carry ranks, no
probabilities). The lattice falls apart wherever no piece spans two neighbouring characters, above all at spaces;
scores add up over such segments, so a text's best segmentation is that of its segments, and its N best differ from it in
at most N - 1 segments, those with the smallest loss from best to second best. Segments are solved once a batch and kept
in a bounded cache; the N-best search of a text runs over the few words that can matter.

Edge cases: null and empty texts have no pieces, score 0 and one (empty) segmentation; the model's own mark for a
space is read as a space; texts are read whole; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.llm.common import Recent, ship, table, worker_state

N_BEST = 4
CACHE_SEGMENTS = 100_000
BYTE_PENALTY = 10.0
SPACE = "▁"
CUT = "\0"
DOCS_AT_ONCE = 512
WIDEST = 64
PAIR_BITS = 20
CELLS = 1 << 15
FIRST_CUTOFF = 64.0


def best_paths(into: Callable[[int], list[tuple[int, object, float]]], best: Sequence[float], n: int, cutoff: float = math.inf) -> tuple[list[tuple[float, list]], bool]:
    """The ``n`` best paths through a lattice, from its end: ``into(j)`` lists ``(i, label, score)`` of edges i -> j.

    Of paths that score alike the one that has come further goes on first, and a place is gone on from at most ``n`` times:
    later paths through it can't be among the ``n`` best. Paths that lose more than ``cutoff`` are left out; the second
    value says whether there were any.
    """
    end = len(best) - 1
    queue, pushed, out, left_out, visits = [(-best[end], end, 0, 0.0, None)], 0, [], False, {}
    while queue and len(out) < n:
        f, at, _, g, path = heapq.heappop(queue)
        if at == 0:
            labels = []
            while path is not None:
                labels.append(path[0])
                path = path[1]
            out.append((-f, labels))
            continue
        visits[at] = visits.get(at, 0) + 1
        if visits[at] > n:
            continue
        for i, label, score in into(at):
            if visits.get(i, 0) >= n and i:
                continue
            total = g + score + best[i]
            if total < best[end] - cutoff:
                left_out = True
                continue
            pushed += 1
            heapq.heappush(queue, (-total, i, pushed, g + score, (label, path)))
    return out, left_out


#: Scores of segmentations with their changes against the best.
Variants = list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]
#: Ids of a best segmentation (int32 bytes), its score, and what the second best loses.
Solved = tuple[bytes, float, float]


_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class PieceTable:
    """Ids of pieces by a 64-bit hash of their characters, in an open-addressed array.

    Decoding every result against its text (``round_trip``) would show a clash of hashes.
    """

    def __init__(self, pieces: dict[str, tuple[tuple[int, ...], float]]) -> None:
        bits = (8 * len(pieces)).bit_length()
        self.size, self.shift = 1 << bits, 64 - bits
        self.hashes, self.ids = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32)
        for text, ((i,), _) in pieces.items():
            h = 0
            for c in text:
                h = (h * int(_MULTIPLIER) + ord(c) + 1) & (1 << 64) - 1
            at, step = self._slot(h), 0
            while self.ids[at + step & self.size - 1] >= 0:
                step += 1
            self.hashes[at + step & self.size - 1], self.ids[at + step & self.size - 1] = h, i

    def _slot(self, h: int) -> int:
        return ((h ^ h >> 29) * int(_MIX) & (1 << 64) - 1) >> self.shift

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids of some hashes, -1 for none."""
        slot = ((h ^ h >> np.uint64(29)) * _MIX >> np.uint64(self.shift)).ravel()
        h = h.ravel()
        met = self.hashes[slot] == h
        out = np.where(met, self.ids[slot], np.int32(-1))
        left = np.flatnonzero(~met & (self.ids[slot] >= 0))  # another piece's slot: look at the next
        while len(left):
            slot[left] = slot[left] + np.uint64(1) & np.uint64(self.size - 1)
            met = self.hashes[slot[left]] == h[left]
            out[left[met]] = self.ids[slot[left[met]]]
            left = left[~met & (self.ids[slot[left]] >= 0)]
        return out


class PieceLattice:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = sp = SentencePieceProcessor(model_file=path)
        ranks = {i: -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        first = min(ranks.values())
        total = math.log(sum(1 / (1 + r - first) for r in ranks.values()))
        self.pieces = {sp.id_to_piece(i): ((i,), -math.log(1 + r - first) - total) for i, r in ranks.items()}
        self.nothing = object()
        self.matches = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.pieces  # None: some piece goes on
        inside = sorted({p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)})
        pairs = np.array([[ord(c) for c in x] for x in inside], np.uint32)
        self.inside = np.zeros(1 << PAIR_BITS, bool)
        self.inside[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self.longest = max(map(len, self.pieces))
        self.table, self.logp = PieceTable(self.pieces), np.zeros(max(ranks) + 1)
        for (i,), x in self.pieces.values():
            self.logp[i] = x
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = min(s for _, s in self.pieces.values()) - BYTE_PENALTY
        # Words can be cut out by spaces and lines if no piece goes on across them.
        self.by_word = all(b[1] != SPACE or b[0] == SPACE for b in inside) and not any("\n" in b for b in inside)
        self.segments = Recent(CACHE_SEGMENTS)
        self.last: tuple[str, list[tuple[float, list[int]]]] = ("", [])
        self.short_alternatives = lru_cache(maxsize=20_000)(self._alternatives)

    def _bytes(self, char: str) -> tuple[tuple[int, ...], float]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw), self.byte_score * len(raw)

    def forward(self, s: str) -> array:
        """The best score up to every place of ``s`` (forward Viterbi)."""
        n, find, nothing, pieces = len(s), self.matches.get, self.nothing, self.pieces
        best = array("d", [0.0]) + array("d", [-math.inf]) * n
        for i in range(n):
            here = best[i]
            if s[i] not in pieces and (x := here + self._bytes(s[i])[1]) > best[i + 1]:
                best[i + 1] = x
            for j in range(i + 1, n + 1):
                p = find(s[i:j], nothing)
                if p is nothing:
                    break
                if p is not None and (x := here + p[1]) > best[j]:
                    best[j] = x
        return best

    def into(self, s: str, j: int) -> list[tuple[int, tuple[int, ...], float]]:
        """Edges of the lattice that end at a place."""
        out = [(i, *p) for i in range(max(0, j - self.longest), j) if (p := self.pieces.get(s[i:j])) is not None]
        if s[j - 1] not in self.pieces:
            out.append((j - 1, *self._bytes(s[j - 1])))
        return out

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a lattice text as ``(score, ids)``.

        In long texts, paths that lose much are left out at first, so the queue stays short.
        """
        best, cutoff = self.forward(s), FIRST_CUTOFF if len(s) > WIDEST else math.inf
        while True:
            found, left_out = best_paths(lambda j: self.into(s, j), best, n, cutoff)
            if len(found) == n or not left_out:
                return [(score, [i for ids in labels for i in ids]) for score, labels in found]
            cutoff *= 4

    def _second(self, s: str) -> Solved:
        """Ids of the best segmentation, its score, and what the second best loses, for any segment."""
        found = self.n_best(s, max(2, N_BEST))
        if len(s) > Recent.LONG:
            self.last = (s, found)  # most likely asked for its alternatives next
        return array("i", found[0][1]).tobytes(), found[0][0], found[0][0] - found[1][0] if len(found) > 1 else math.inf

    def _solve(self, segments: list[str]) -> None:
        """Solve segments by length, all of a length class at once; those with bytes or of great length one by one."""
        known, classes = self.segments.new, {}
        for s in segments:
            classes.setdefault(len(s) if len(s) <= 16 else 1 << (len(s) - 1).bit_length(), []).append(s)
        for width, group in classes.items():
            if width > WIDEST:
                known.update((s, self._second(s)) for s in group)
                continue
            for at in range(0, len(group), CELLS // width):
                part = group[at : at + CELLS // width]
                known.update(zip(part, self._viterbi(part, width), strict=True))

    def _viterbi(self, segments: list[str], width: int) -> list[Solved]:
        """Forward and backward Viterbi over many lattices at once.

        The second best has an edge outside the best path, and the best path over an edge scores forward plus edge plus
        backward, so its loss is read off without a search.
        """
        n, longest = len(segments), min(self.longest, width)
        length = np.fromiter(map(len, segments), np.int64, n)
        chars = np.frombuffer("".join(s.ljust(width, "\0") for s in segments).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        score = np.full((longest, n, width), -np.inf)  # by piece length - 1, segment, start
        piece = np.zeros((longest, n, width), np.int32)
        h = np.zeros((n, width), np.uint64)
        for k in range(longest):
            span = width - k
            h = h[:, :span] * _MULTIPLIER + chars[:, k:].astype(np.uint64) + np.uint64(1)
            found = self.table.find(h).reshape(n, span)
            piece[k, :, :span] = found
            score[k, :, :span] = np.where(found >= 0, self.logp[found], -np.inf)
        forward = np.full((n, width + 1), -np.inf)
        forward[:, 0], came = 0.0, np.zeros((n, width + 1), np.int64)
        for j in range(1, width + 1):
            for k in range(min(longest, j)):
                over = forward[:, j - 1 - k] + score[k, :, j - 1 - k]
                better = over > forward[:, j]
                forward[better, j], came[better, j] = over[better], k
        rows = np.arange(n)
        backward = np.full((n, width + 1), -np.inf)
        backward[rows, length] = 0.0
        for i in range(width - 1, -1, -1):
            for k in range(min(longest, width - i)):
                np.maximum(backward[:, i], score[k, :, i] + backward[:, i + 1 + k], out=backward[:, i])
        best = forward[rows, length]
        ids, at, live, count = np.zeros((n, width), np.int32), length.copy(), rows[np.isfinite(best)], np.zeros(n, np.int64)
        while len(live):
            k = came[live, at[live]]
            at[live] -= k + 1
            count[live] += 1
            ids[live, width - count[live]] = piece[k, live, at[live]]
            score[k, live, at[live]] = -np.inf  # off the best path from here on
            live = live[at[live] > 0]
        second = np.full(n, -np.inf)
        for k in range(longest):
            span = width - k
            np.maximum(second, (forward[:, :span] + score[k, :, :span] + backward[:, k + 1 : width + 1]).max(axis=1), out=second)
        gap = np.where(np.isfinite(best), np.where(np.isfinite(best), best, 0.0) - second, 0.0)
        out = [(x[width - c :].tobytes(), b, g) for x, c, b, g in zip(ids, count.tolist(), best.tolist(), gap.tolist(), strict=True)]
        return [x if x[1] > -math.inf else self._second(s) for s, x in zip(segments, out, strict=True)]

    def _segments_of(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Words cut wherever no piece spans two neighbouring characters, and where each word's segments begin.

        ``inside`` is a table by a hash of the two characters; a clash leaves a segment longer and changes nothing else.
        """
        whole = "".join(words.to_numpy(zero_copy_only=False).tolist())
        c = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = np.ones(len(c), bool)
        cut[1:] = ~self.inside[self._pair(c[:-1], c[1:])]
        cut[np.concatenate([[0], ends[:-1]])[pc.utf8_length(words).to_numpy(zero_copy_only=False) > 0]] = True
        start = np.flatnonzero(cut)
        size = np.ones(len(c), np.int64) + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        place = np.concatenate([[0], np.cumsum(size)])
        offsets = np.concatenate([place[start], place[-1:]]).astype(np.int32)
        segments = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.encode()))
        return segments, np.searchsorted(start, np.concatenate([[0], ends]))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)

    def _words(self, words: pa.StringArray) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each word, its score, and what the second best loses."""
        segments, bounds = self._segments_of(words)
        coded = segments.dictionary_encode()
        each = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.segments.age()
        solved = self.segments.find(each)
        if None in solved:
            self._solve([s for s, x in zip(each, solved, strict=True) if x is None])
            known = self.segments.new
            solved = [known[s] if x is None else x for s, x in zip(each, solved, strict=True)]
            self.segments.forget_long(each)
        ids, score, gap = ([x[i] for x in solved] for i in range(3))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        at, some = coded.indices.to_numpy(), bounds[:-1] < bounds[1:]
        first = bounds[:-1][some]
        counts, scores, gaps = np.zeros(len(words), np.int64), np.zeros(len(words)), np.full(len(words), math.inf)
        if len(first):
            counts[some] = np.add.reduceat(sizes[at], first)
            scores[some] = np.add.reduceat(np.array(score)[at], first)
            gaps[some] = np.minimum.reduceat(np.array(gap)[at], first)
        flat = lists.take(coded.indices).flatten()
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat), scores, gaps

    def alternatives(self, s: str, n: int) -> tuple[tuple[float, tuple[int, ...] | None], ...]:
        return (self.short_alternatives if len(s) <= Recent.LONG else self._alternatives)(s, n)

    def _alternatives(self, s: str, n: int) -> tuple[tuple[float, tuple[int, ...] | None], ...]:
        """Losses against the best of the ``n`` best segmentations of a word; the best has no ids here."""
        found = self.last[1][:n] if self.last[0] == s and n <= N_BEST else self.n_best(s, n)
        return ((0.0, None), *((found[0][0] - score, tuple(ids)) for score, ids in found[1:]))

    def marked(self, text: str) -> str:
        """The text as the lattice reads it, with a mark where it falls into words: spaces as the model's sign, one in front."""
        if not self.by_word or CUT in text:
            return SPACE + text.replace(" ", SPACE)
        out = SPACE + text.replace("\n", f"{CUT}\n{CUT}").replace(" ", CUT + SPACE)
        while f"{SPACE}{CUT}{SPACE}" in out:  # a run of spaces stays together
            out = out.replace(f"{SPACE}{CUT}{SPACE}", SPACE + SPACE)
        return out

    def encode_batch(self, texts: list[str | None], n: int = N_BEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Variants]]:
        """Ids of all texts in a row, and for each text their number, the best score and the ``n`` best segmentations."""
        marked = [self.marked(t) if t else "" for t in texts]
        if any(CUT in t for t in texts if t):
            lists = pa.array([[m] if t and CUT in t else m.split(CUT) for t, m in zip(texts, marked, strict=True)], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pa.array(marked, pa.string()), CUT)
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        ids, score, gap = self._words(words)
        sizes = np.asarray(ids.value_lengths())
        flat = ids.take(coded.indices).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes[index])])
        stops = np.cumsum(np.asarray(lists.value_lengths()))
        starts = np.concatenate([[0], stops[:-1]])
        score, gap = score[index], gap[index]
        scores = np.add.reduceat(score, starts) if len(starts) else np.zeros(0)
        variants = []
        for a, b, total in zip(starts.tolist(), stops.tolist(), scores.tolist(), strict=True):
            close = np.argsort(gap[a:b], kind="stable")[: n - 1] + a
            # Over the words that can differ, a chain lattice of losses whose best score is 0 everywhere.
            into = [[]]
            for place, k in enumerate(np.sort(close[gap[close] < math.inf]).tolist()):
                into.append([(place, (k, alt), -loss) for loss, alt in self.alternatives(words[index[k]].as_py(), n)])
            best, _ = best_paths(into.__getitem__, [0.0] * len(into), n)
            variants.append([(total + loss, [(int(upto[k] - upto[a]), int(sizes[index[k]]), alt) for k, alt in labels if alt is not None]) for loss, labels in best])
        return flat, upto[stops] - upto[starts], scores, variants

    def encode(self, text: str | None, n: int = N_BEST) -> tuple[np.ndarray, float, Variants]:
        """Ids and score of the best segmentation, and the ``n`` best as ``(score, changes)``.

        A change ``(at, old, ids)`` replaces ``old`` ids at place ``at`` of the best segmentation.
        """
        flat, _, scores, variants = self.encode_batch([text], n)
        return flat, float(scores[0]), variants[0]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def piece_lattice(path: str) -> PieceLattice:
    """One lattice a Python worker, kept between its tasks of this kind."""
    return worker_state(("pieces", path), lambda: PieceLattice(path))


ENCODED = (
    "doc_id long, n_pieces int, ids array<int>, score double, round_trip boolean,"
    " n_best array<struct<score: double, changes: array<struct<at: int, old: int, ids: array<int>>>>>"
)
_CHANGE = pa.struct([("at", pa.int32()), ("old", pa.int32()), ("ids", pa.list_(pa.int32()))])
_VARIANT = pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))])


def encode_documents(docs: DataFrame, model_path: str, n: int = N_BEST) -> DataFrame:
    """Ids of every whole text, whether they decode to it, and its ``n`` best segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = piece_lattice(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(at, DOCS_AT_ONCE)
                texts = b.column(1).to_pylist()
                flat, counts, scores, variants = lattice.encode_batch(texts, n)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                good = [
                    lattice.decode(flat[x:y].tolist()) == (t or "").replace(SPACE, " ")
                    for t, x, y in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                ]
                rows = [[{"score": s, "changes": [{"at": k, "old": o, "ids": i} for k, o, i in c]} for s, c in v] for v in variants]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(scores),
                        pa.array(good, pa.bool_()), pa.array(rows, pa.list_(_VARIANT)),
                    ],
                    ["doc_id", "n_pieces", "ids", "score", "round_trip", "n_best"],
                )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def op5_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
