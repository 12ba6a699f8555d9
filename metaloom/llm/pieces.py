"""SentencePiece encoding with seeded merge-dropout, lossless decoding, and exact piece counts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20240501
DROPOUT = 0.1
#: Entries of a worker's caches of runs, emptied when full.
CACHE_ENTRIES = 120_000
#: Runs of this many characters or more are segmented one by one, without a cache.
LONG = 30
MARK = "▁"

_RUNS = re.compile(" +[^ ]*")
_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """The splitmix64 finalizer; _mixed_many is the same for arrays."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _mixed_many(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_STEP = 0x9E3779B97F4A7C15


@lru_cache(4)
def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("a piece spans a space inside: texts can't be cut before spaces")
    return sp


def runs(text: str) -> list[str]:
    """Spaces with the characters after them, less the first space; no piece crosses their borders."""
    if "  " not in text and text[:1] != " " != text[-1:]:
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


class Bounded(dict):
    """A cache that is emptied at a size; missing keys are computed."""

    def __init__(self, make, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


@lru_cache(4)
def counter(path: str):
    """Number of pieces of a text, as the library's encoder gives them."""
    sp = processor(path)
    held = Bounded(lambda run: len(sp.encode(run)) if run else 1)

    def count(text: str) -> int:
        return sum(map(held.__getitem__, runs(text.replace(MARK, " ")))) if text else 0

    return count


class Pairs:
    """Hash table from two adjacent pieces, given by rank, to the rank of the piece that they make."""

    def __init__(self, rank: dict[str, int]):
        keys, made = [], []
        for piece, r in rank.items():
            for i in range(1, len(piece)):
                a, b = rank.get(piece[:i]), rank.get(piece[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    made.append(r)
        self.none = len(rank)
        self.bits = max(16, (len(keys) * 6).bit_length())
        self.key, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        left, value = np.array(keys, np.int64), np.array(made, np.int32)
        slot = self._slot(left)
        while len(left):
            first = np.unique(slot, return_index=True)[1]
            won = first[self.key[slot[first]] == -1]
            self.key[slot[won]], self.made[slot[won]] = left[won], value[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, value, slot = left[stay], value[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the joined pieces; `none` where there is no such piece or a side is negative."""
        key, out = (a.astype(np.int64) << 20) | b, np.full(len(a), self.none, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        key = key[at]
        slot = self._slot(key)
        while len(at):
            there = self.key[slot]
            hit = there == key
            out[at[hit]] = self.made[slot[hit]]
            on = ~hit & (there != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """Merge-type segmentation of a sentencepiece BPE model with keyed merge-dropout.

    The agenda takes the adjacent pair whose piece has the best score, leftmost first; for a long run it is a heap over
    a linked list, so that a run of n characters takes time n log n. Each candidate that it
    takes is skipped for good with the probability of the dropout, by a draw keyed with (seed, text's key,
    place of the run in the text, number of the candidate). So each occurrence of a run has its own draws.
    The draws are made as gaps between skips. Only the segmentation without skips is cached; an occurrence
    whose first skip lies within its candidates goes through the agenda with its own draws.
    Characters without a piece, and the space mark itself where a text has it, become byte pieces, so
    that decoding gives every text back.
    """

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        sp = processor(path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: Piece to its place by score; of equal scores, the lower id comes first.
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.rank = {sp.id_to_piece(i): r for r, i in enumerate(ranked)}
        self.piece = {sp.id_to_piece(i): i for i in plain}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("lossless coding needs a model with byte pieces")
        self.text_of = [b""] * n
        for piece, i in self.piece.items():
            self.text_of[i] = piece.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.text_of[i] = bytes([b])
        #: A gap of more than k candidates has probability (1 - dropout) ** (k + 1), here of 2**53; descending, negated.
        self.dropout, left = dropout, []
        while 0 < dropout < 1 and (t := int((1 - dropout) ** (len(left) + 1) * 2**53)):
            left.append(-t)
        self.gaps = np.array(left, np.int64)
        self.gap_list = left
        self.pairs = Pairs(self.rank)
        self.id_of_rank = np.array(ranked, np.int32)
        self.rank_of_point = np.full(0x110000, -1, np.int32)
        for piece, r in self.rank.items():
            if len(piece) == 1:
                self.rank_of_point[ord(" " if piece == MARK else piece)] = r
        self.seed = seed
        self.arrow_text = pa.array(self.text_of, pa.binary())
        self._empty()

    def _empty(self) -> None:
        #: Run to its row: its symbols, their number, the number of candidates taken without skips, its ids in `plain`.
        self.root: dict[str, int] = {}
        self.symbols, self.plain = np.zeros((0, LONG), np.int32), np.zeros(0, np.int32)
        self.size, self.taken, self.start, self.count = (np.zeros(0, np.int64) for _ in range(4))

    #: Draw 0 skips nothing; its segmentations are those that are held by run.
    variants = 1

    @property
    def held(self) -> list[dict[str, bytes]]:
        return [{run: self._expanded(self.plain[(a := self.start[r]) : a + self.count[r]])[0].tobytes() for run, r in self.root.items()}]

    def gap(self, draw: int, number: int) -> int:
        """Candidates kept before the skip of this number (from 0)."""
        if self.dropout >= 1:
            return 0
        return bisect_left(self.gap_list, -(_mixed(draw + number * _STEP & _MASK) >> 11))

    def _gaps(self, draws: np.ndarray, number: int | np.ndarray) -> np.ndarray:
        if self.dropout >= 1:
            return np.zeros(len(draws), np.int64)
        return np.searchsorted(self.gaps, -(_mixed_many(draws + np.asarray(number, np.uint64) * np.uint64(_STEP)) >> np.uint64(11)).astype(np.int64))

    def _draws(self, key: str, n: int) -> np.ndarray:
        """One number for each run of a text; never 0."""
        base = xxhash.xxh3_64_intdigest(key.encode(), self.seed & _MASK)
        return _mixed_many(np.uint64(base) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

    def segment(self, run: str, draw: int = 0) -> tuple[int, ...]:
        """Ids of a run under the skips of a draw; draw 0 skips nothing."""
        def drawn():
            at = -1
            for number in range(1 << 62):
                at += 1 + self.gap(draw, number)
                yield at

        return self._segment(run, drawn() if draw and self.dropout else iter(()))[0]

    def _segment(self, run: str, skips: Iterator[int]) -> tuple[tuple[int, ...], int]:
        """Ids of a run, and the number of candidates taken, when those at the given (ascending) numbers are skipped."""
        symbols = [MARK, *run.replace(" ", MARK)]
        if MARK in run:  # a mark of the text itself must not turn into a space
            symbols = [MARK, *(MARK if c == " " else "\0" + c if c == MARK else c for c in run)]
        rank, end, taken, skip = self.rank.get, len(symbols), 0, next(skips, -1)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        versions = [0] * end  # of a place: how often its symbol has grown; -1: it is part of another
        agenda = [(r, i, i + 1, 0, 0) for i in range(end - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)

        def offer(i: int, j: int) -> None:
            if (r := rank(symbols[i] + symbols[j])) is not None:
                heappush(agenda, (r, i, j, versions[i], versions[j]))

        while agenda:
            _, i, j, left, right = heappop(agenda)
            if versions[i] != left or versions[j] != right:  # a side has grown or gone since
                continue
            taken += 1
            if skip == taken - 1:
                skip = next(skips, -1)
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            versions[i] += 1
            versions[j] = -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                offer(i, k)
            if i:
                offer(before[i], i)
        out: list[int] = []
        for s in filter(None, symbols):
            if (got := self.piece.get(s)) is not None:
                out.append(got)
            else:
                out += map(self.byte.__getitem__, (MARK if s == "\0" + MARK else s).encode())
        return tuple(out), taken

    def encode(self, text: str, key: str = "") -> list[int]:
        return np.frombuffer(self.encode_many([text], [key])[0], np.int32).tolist()

    def encode_many(self, texts: list[str], keys: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers; the occurrences of a run draw their skips by the text's key and their places."""
        parts = [runs(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        if not flat:
            return [b""] * len(texts)
        distinct = set(flat)
        long = {run for run in distinct if len(run) >= LONG}
        if len(self.root) + len(missing := (distinct - long).difference(self.root)) > CACHE_ENTRIES:
            self._empty()
            missing = distinct - long
        self._add(sorted(missing))
        row = np.fromiter(map(self.root.get, flat, [-1] * len(flat)) if long else map(self.root.__getitem__, flat), np.int64, len(flat))
        start, count, store = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), [self.plain]
        short = row >= 0
        start[short], count[short] = self.start[row[short]], self.count[row[short]]
        draws = np.concatenate([self._draws(k, len(p)) for k, p in zip(keys, parts, strict=True)])
        if self.dropout:
            at = np.flatnonzero(short)
            at = at[self._gaps(draws[at], 0) < self.taken[row[at]]]
            own, back = self._distinct(row[at], draws[at])
            ids, n, _ = self._segmented(row[at[own]], draws[at[own]])
            start[at], count[at] = (np.cumsum(n) - n + len(self.plain))[back], n[back]
            store.append(ids)
        upto = sum(map(len, store))
        for i in np.flatnonzero(~short).tolist():
            store.append(np.array(self.segment(flat[i], int(draws[i]) if self.dropout else 0), np.int32))
            start[i], count[i] = upto, len(store[-1])
            upto += len(store[-1])
        end = np.cumsum(count)
        ids, grown = self._expanded(np.concatenate(store)[np.repeat(start - end + count, count) + np.arange(end[-1])])
        border = grown[np.concatenate([[0], end])[np.cumsum([0, *map(len, parts)])]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(border, border[1:], strict=False)]

    def _distinct(self, row: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that stand for all (their places), and the place of each one's stand-in: those of a run with the same skips are one.

        Skip number k (from 0) of a run with n symbols is never reached beyond candidate n - 2 + k.
        """
        key, at, most = row, np.full(len(row), -1), self.size[row] - 2
        for k in range(4):
            at = np.minimum(at + 1 + self._gaps(draws, k), 255)
            at[at > most + k] = 255
            if k < 3:
                key = key << 8 | at
        key = np.where(at < 255, -1 - np.arange(len(row)), key)  # four skips or more: not compared
        _, own, back = np.unique(key, return_index=True, return_inverse=True)
        return own, back

    def _add(self, missing: list[str]) -> None:
        """Rows of new runs, with their segmentations without skips."""
        if not missing:
            return
        first = len(self.root)
        self.root.update(zip(missing, range(first, first + len(missing)), strict=True))
        points = np.frombuffer("".join([(" " + run).ljust(LONG, "\0") for run in missing]).encode("utf-32-le"), np.int32).reshape(-1, LONG)
        size = np.array([len(run) + 1 for run in missing])
        inside = np.arange(LONG) < size[:, None]
        symbols = np.where(inside, self.rank_of_point[points], -1)
        alone = inside & (symbols < 0)  # characters without a piece, the mark among them: never merged, coded as bytes
        symbols[alone] = -2 - points[alone]
        self.symbols, self.size = np.concatenate([self.symbols, symbols]), np.concatenate([self.size, size])
        ids, count, taken = self._segmented(np.arange(first, len(self.size)), None)
        self.start = np.concatenate([self.start, len(self.plain) + np.cumsum(count) - count])
        self.plain, self.count, self.taken = (np.concatenate(x) for x in ((self.plain, ids), (self.count, count), (self.taken, taken)))

    def _segmented(self, row: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each row end to end (negative: a character to be coded as bytes), their numbers, and the candidates taken; equal to segment()."""
        size, parts, order = self.size[row], [np.zeros(0, np.int32)], []
        count, taken = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for low, width in ((0, 5), (5, 8), (8, 12), (12, 18), (18, LONG)):
            places = np.flatnonzero((size > low) & (size <= width))
            for k in range(0, len(places), 4096):
                at = places[k : k + 4096]
                ids, count[at], taken[at] = self._merged(self.symbols[row[at], :width], None if draws is None else draws[at], width)
                parts.append(ids)
                order.append(at)
        flat, at = np.concatenate(parts), np.concatenate(order or [np.zeros(0, np.int64)])
        begin = np.zeros(len(row), np.int64)
        begin[at] = np.cumsum(count[at]) - count[at]
        end = np.cumsum(count)
        return flat[np.repeat(begin - end + count, count) + np.arange(end[-1] if len(end) else 0)], count, taken

    def _expanded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with byte pieces in the places of characters without a piece; the new place of each border."""
        odd = np.flatnonzero(ids < 0)
        own = [[self.byte[b] for b in chr(-2 - x).encode()] for x in ids[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(x) for x in own]
        grown = np.concatenate([[0], np.cumsum(times)])
        out = np.repeat(ids, times)
        out[out < 0] = list(chain.from_iterable(own))
        return out, grown

    def _merged(self, symbol: np.ndarray, draws: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The agenda of all rows in step, a candidate of each at a time. A row's symbols are a linked list over its first borders."""
        n, w, none = len(symbol), width + 1, self.pairs.none
        sym = np.full((n, w), -1, np.int32)
        sym[:, :width] = symbol
        offer = np.full((n, w), none, np.int32)
        offer[:, :-1] = self.pairs.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
        after, before = np.tile(np.arange(1, w + 1), n), np.tile(np.arange(-1, w - 1), n)
        flat_sym, flat_offer = sym.ravel(), offer.ravel()
        live, taken, step, skipped = np.arange(n), np.zeros(n, np.int64), 0, np.zeros(n, np.int64)
        following = np.full(n, -1) if draws is None else self._gaps(draws, 0)
        while len(live):
            p = offer[live].argmin(1)
            base = live * w
            best = flat_offer[base + p]
            on = best < none
            live, p, base, best = live[on], p[on], base[on], best[on]
            q = after[base + p]
            end = after[base + q]
            skip = following[live] == step
            step += 1
            taken[live] = step
            if skip.any():
                gone = live[skip]
                skipped[gone] += 1
                following[gone] += 1 + self._gaps(draws[gone], skipped[gone])
                flat_offer[(base + p)[skip]] = none
                p, q, end, base, best = (x[~skip] for x in (p, q, end, base, best))
            flat_sym[base + p], flat_sym[base + q] = best, -1
            flat_offer[base + q] = none
            after[base + p] = end
            inside = end < w
            before[(base + end)[inside]] = p[inside]
            flat_offer[base + p] = self.pairs.find(best, np.where(inside, flat_sym[base + np.minimum(end, width)], -1))
            inner = before[base + p] >= 0
            base, p, best = base[inner], p[inner], best[inner]
            o = before[base + p]
            flat_offer[base + o] = self.pairs.find(flat_sym[base + o], best)
        stay = sym != -1
        last = sym[stay]
        return np.where(last < 0, last, self.id_of_rank[np.maximum(last, 0)]).astype(np.int32), stay.sum(1), taken

    def decode(self, ids) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))[1:]

    def decode_many(self, lists: pa.ListArray) -> list[str | None]:
        """Texts of an Arrow array of id lists: the pieces' bytes lie end to end once they are gathered."""
        start = lists.offsets.to_numpy()
        flat = self.arrow_text.take(lists.values.slice(start[0], start[-1] - start[0]))
        data, place = b"".join(flat.buffers()[2:3]) if len(flat) else b"", np.frombuffer(flat.buffers()[1], np.int32) if len(flat) else np.zeros(1, np.int32)
        at = place[start - start[0]].tolist()
        return [data[a + 1 : b].decode() if ok else None for a, b, ok in zip(at, at[1:], lists.is_valid().to_pylist(), strict=False)]


@lru_cache(4)
def codec(path: str, dropout: float, seed: int) -> Codec:
    return Codec(path, dropout, seed)


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, `ids` (its piece ids), and the columns named in carry.

    The segmentation is drawn by the keyed hash alone: the same seed, id and text give the same ids on any
    partitioning. dropout 0 gives the library's own encoding (but for the literal space mark).

    Null text: null ids; empty text: no ids. Null id: keyed as ''. Repeated rows: equal ids. Very long
    texts are coded run by run in memory of their own size; time is n log n in the longest run without a space. Empty table: no rows. Extra columns, clashing
    or not, are ignored unless carried.
    """

    def code(ids, column):
        texts = column.to_pylist()
        coded = codec(path, dropout, seed).encode_many([t or "" for t in texts], ["" if i is None else str(i) for i in ids])
        place = pa.array(np.cumsum([0] + [len(x) // 4 for x in coded]), pa.int32(), mask=np.array([t is None for t in texts] + [False]))
        return pa.ListArray.from_arrays(place, pa.array(np.frombuffer(b"".join(coded), np.int32)))

    return _mapped(docs, id_col, text_col, "ids", "array<int>", code, carry)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per coded document: the id, its `text`, and the columns in carry. Null ids give a null text, no ids an empty one.

    Null and repeated document ids pass through, a row each. Ids outside the model: an error. Very long lists are joined
    as one text. Empty table: no rows. Extra columns, clashing or not, are ignored unless carried.
    """

    def text_of(_, ids):
        return pa.array(codec(path, 0.0, 0).decode_many(ids), pa.string())

    return _mapped(coded, id_col, ids_col, "text", "string", text_of, carry)


def _mapped(df: DataFrame, id_col: str, of: str, name: str, kind: str, make, carry: tuple[str, ...]) -> DataFrame:
    rows = df.select(F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("key"), F.col(of).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = make(part.column(0).field(0).to_pylist(), part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["key", "made"])

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, made {kind}")
    return out.select(F.col("key.id").alias(id_col), F.col("made").alias(name), *[F.col(f"key.c{k}").alias(c) for k, c in enumerate(carry)])
