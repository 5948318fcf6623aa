"""Best-fit packing of tokenised documents into sequences, with a swap-based local search.

Tasks tokenise whole texts.  A unit, a run of text between safe cuts, is encoded once per worker and then looked up, so
the tokenizer sees each distinct unit once.  Documents longer than a sequence are cut into full pieces, each of which is
a sequence; only the rest goes on.  Rests are dealt by hash into groups of about ``group_rows`` pieces; each group packs
on its own with best fit by decreasing length, then exchanges pieces between underfull bins: one for one, two for one or a
move, always such that the fuller bin grows, so the sum of squared fills rises until the emptiest bins are gone.  A group
wastes less than a bin, so many groups cost nothing, and no task holds more than a group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .textops import LOWER, SPACE, Words, chunks

#: Units of text that a worker remembers; when there are more it starts anew.
REMEMBERED = 3 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_PUNCT = np.zeros(256, dtype=bool)
for _a, _b in ((0x21, 0x27), (0x28, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
    _PUNCT[_a:_b] = True
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


def _units(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs without white space, also cut between an ASCII letter and ASCII punctuation other than the apostrophe: places
    where a lower-casing tokenizer that splits letters from symbols always cuts."""
    n = len(data)
    inside = ~SPACE[data]
    letter, punct = _LETTER[data], _PUNCT[data]
    begins, ends = inside.copy(), inside.copy()
    if n > 1:
        turn = (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
        begins[1:] &= ~inside[:-1] | turn
        ends[:-1] &= ~inside[1:] | turn
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


class Encoder:
    """Token ids of whole texts through remembered units: a large sorted table and a small one that is merged into it."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.tables = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))] * 2
        self.ids = np.zeros(1 << 16, dtype=np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    def _learn(self, texts: list[str], keys: np.ndarray) -> None:
        """``keys`` are sorted and new."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(c) for c in coded], dtype=np.int32)
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + total] = np.fromiter((i for c in coded for i in c), dtype=self.ids.dtype, count=total)
        ats = self.used + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.used += total
        self.tables[1] = _merged(self.tables[1], (keys, ats, sizes))
        if len(self.tables[1][0]) > max(20_000, len(self.tables[0][0]) // 8):
            self.tables = [_merged(*self.tables), (keys[:0], ats[:0], sizes[:0])]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int32)
        for known, ats, sizes in self.tables:
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[place] == keys
                at[hit], size[hit] = ats[place[hit]], sizes[place[hit]]
        return at, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the bounds of each document's."""
        lower = LOWER[data]
        units = _units(lower, offsets)
        distinct, first, inverse = np.unique(units.hashes(), return_index=True, return_inverse=True)
        if sum(len(t[0]) for t in self.tables) > REMEMBERED:
            self.clear()
        at, size = self._find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = lower.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(units.start[first[new]].tolist(), units.end[first[new]].tolist(), strict=True)], distinct[new])
            at[new], size[new] = self._find(distinct[new])
        at, size = at[inverse], size[inverse]
        total = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(at - total[:-1], size) + np.arange(int(total[-1]))
        return self.ids[source], total[units.bounds]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _merged(a: tuple, b: tuple) -> tuple:
    """Two tables of sorted keys as one."""
    place = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, place, y) for x, y in zip(a, b, strict=True))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker, also across tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(df: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row; null texts have the end id only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                ids, bounds = encoder.encode(data, offsets)
                raw = data.tobytes()
                special = any(s in raw for s in SPECIAL)
                doc = batch.column(0).slice(a, b - a).to_pylist()
                rows: list[tuple] = []
                for i in range(b - a):
                    own = ids[bounds[i] : bounds[i + 1]]
                    if special and any(s in raw[offsets[i] : offsets[i + 1]] for s in SPECIAL):
                        own = encoder.whole(raw[offsets[i] : offsets[i + 1]].decode())
                    own = np.concatenate((own, end)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append((doc[i], k, s, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; ``lengths`` in decreasing order."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels: list[int] = []
    for i, n in enumerate(lengths):
        at = bisect_left(levels, n)
        if at == len(levels):
            own, room = len(bins), capacity
            bins.append([])
        else:
            room = levels[at]
            own = free[room].pop()
            if not free[room]:
                levels.pop(at)
        bins[own].append(i)
        left = room - n
        if not free[left]:
            insort(levels, left)
        free[left].append(own)
    return bins


def _best_exchange(low: list[int], high: list[int], room: int) -> tuple[int, list[int], list[int]] | None:
    """(gain, lengths given, lengths taken) of the step with the largest gain of ``room`` at most: one piece for none or one, or two
    pieces for one.  Bins are sorted lengths; equal pieces count once, so a bin has few sums and all of them are looked at."""
    single = sorted(set(low))
    double = {p + q: (p, q) for x, p in enumerate(single) for q in single[x:] if p != q or low[bisect_left(low, p) + 1 : bisect_left(low, p) + 2] == [p]}
    sums = sorted(double)
    best = None
    for back in (0, *sorted(set(high))):
        for values, pair in ((single, False), (sums, True)):
            at = bisect_right(values, back + room) - 1
            if (pair and not back) or at < 0 or values[at] - back <= (best[0] if best else 0):
                continue
            best = values[at] - back, list(double[values[at]]) if pair else [values[at]], [back] if back else []
    return best


def empty_bins(bins: list[list[int]], lengths: list[int], capacity: int, tries: int = 64) -> list[list[int]]:
    """Local search: the emptiest bin gives pieces to fuller underfull bins until it is empty or nothing fits.

    Each step moves a piece or exchanges one or two of its pieces for one of the fuller bin, with the largest gain that
    fits there; the sum of squared fills rises with every step.  The search ends when as many bins are
    left as the pieces need at least, or when ``tries`` bins in a row couldn't be emptied.
    """
    own = [sorted(lengths[i] for i in b) for b in bins]
    fill = [sum(b) for b in own]
    order = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: (-fill[k], k))
    stuck, left, least = 0, len(bins), -(-sum(fill) // capacity)
    while len(order) > 1 and stuck < tries and left > least:
        low = order.pop()
        for k in order:
            while fill[k] < capacity and own[low]:
                step = _best_exchange(own[low], own[k], capacity - fill[k])
                if step is None:
                    break
                gain, given, taken = step
                for n in given:
                    own[low].remove(n)
                    insort(own[k], n)
                for n in taken:
                    own[k].remove(n)
                    insort(own[low], n)
                fill[k] += gain
                fill[low] -= gain
            if not own[low]:
                break
        stuck = stuck + 1 if own[low] else 0
        left -= not own[low]
        order = [k for k in order if fill[k] < capacity]
    pieces: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        pieces.setdefault(n, []).append(i)
    return [[pieces[n].pop() for n in b] for b in own if b]


def packed(parts: DataFrame, *, capacity: int = 4096, group_rows: int = 20_000) -> DataFrame:
    """``parts`` (doc_id, piece, length and more) with sequence_id and offset; sequences are filled gapless from 0.

    ``parts`` has to be a stored table, so that its rows come in the same order when a task runs again: groups and numbers
    follow the row numbers, which also deals out rows that repeat.  Full pieces are sequences of their own.  Rows that repeat, and null ids, are pieces like any other; an empty input gives an
    empty result; lengths are from 1 to ``capacity``.  Other columns may have any name but sequence_id and offset, which are refused.
    """
    if clash := {"sequence_id", "offset"} & set(parts.columns):
        raise ValueError(f"columns have names of new ones: {sorted(clash)}")
    own = {"doc_id", "piece", "length"}
    plain = {c: c if c in own else f"__c{i}" for i, c in enumerate(parts.columns)}
    names = list(plain.values())
    part = parts.select(*(F.col(f"`{c}`").alias(n) for c, n in plain.items()), F.monotonically_increasing_id().alias("__row"))
    full = part.where(F.col("length") == capacity)
    rest = part.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))
    group = F.pmod(F.xxhash64("__row"), F.lit(groups))
    schema = rest.select(*names).withColumn("__group", F.lit(0).cast("long")).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        lengths = pdf["length"].astype(int).tolist()
        bins = empty_bins(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for b, own in enumerate(bins):
            at = 0
            for i in own:
                sequence[i], offset[i] = b, at
                at += lengths[i]
        return pdf[names].assign(__group=key[0], sequence_id=sequence, offset=offset)

    out = rest.withColumn("__group", group).drop("__row").groupBy("__group").applyInPandas(run, schema)
    out = out.withColumn("sequence_id", (F.col("__group") + 1) * F.lit(1 << 32) + F.col("sequence_id")).drop("__group")
    alone = full.withColumns({"sequence_id": -1 - F.col("__row"), "offset": F.lit(0).cast("long")}).drop("__row")
    return out.unionByName(alone).select(*(F.col(n).alias(c) for c, n in plain.items()), "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed(written_pieces(parts)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def written_pieces(parts: DataFrame) -> DataFrame:
    """The pieces as a table, so that counting and packing don't tokenise twice."""
    from .common import written

    return written(parts, "pieces")
