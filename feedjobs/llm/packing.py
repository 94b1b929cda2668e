"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Each document becomes its tokens and a closing id 0. One that is longer than a sequence is cut so that all
pieces but the first fill a sequence of their own. The other pieces are dealt to groups of about GROUP
pieces by a hash; each group is packed by itself in one task (so memory is bounded and a lost task repeats
the same packing), and a group wastes at most part of a sequence more than one packing of everything would.

Packing a group: best fit in a random order, then swap-based local search over the bins that are not full. The
least full bin gives its pieces away: a piece moves to a bin with room, or takes the place of one or two shorter
pieces there, whichever raises the sum of the squared fills most. All open bins are looked at in each step. A bin
without a step waits until another bin is emptied. The search ends at the bound that the sum of the lengths sets, or
when no bin has a step left; in the second case it runs once more from best fit of the longest first, and the better
of both counts. Every step raises the sum of squares, so no limit on steps is needed. Groups are drawn by a number of
the row, so equal rows spread.

Defined results: a null text is empty and yields the closing id alone; equal rows are packed as documents of
their own; an empty table gives an empty result; other columns pass through `tokenise`.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, sliced

LENGTH, GROUP = 2048, 5_000
TOKENIZER = "byte_bpe_50k"
#: Words that an encoder remembers, and their longest length.
_CACHE, _CACHED_CHARS = 200_000, 64
_ODD_BLANK = re.compile(r" (?:(?<=\s\s)|\s)")


def vocabulary(name: str = TOKENIZER) -> tuple[str, str]:
    """Paths of the vocabulary as tokenizer file and as ranks of the same tokens."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Ids of texts as bytes (little-endian uint32).

    The pre-tokeniser never joins what stands before and after a blank between two words, so a text is
    encoded word by word, each with the blank before it, and ids of frequent words come from a bounded
    cache. Texts in which a blank meets other white space, or with the text of a special token, go to the
    tokenizer as a whole.
    """

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(paths[0])
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
        self.words = tiktoken.Encoding(TOKENIZER, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        found = np.array(self.words.encode_ordinary(w), "<u4").tobytes()
        if len(self.cache) < _CACHE and len(w) <= _CACHED_CHARS:
            self.cache[w] = found
        return found

    def __call__(self, text: str) -> bytes:
        if "\0" in text or _ODD_BLANK.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, word = self.cache.get, self.word
        return b"".join([get(w) or word(w) for w in text.replace(" ", "\0 ").split("\0")])


def _pieces(paths: tuple[str, str], length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(paths)
        for b in sliced(batches, "_text"):
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b["_text"].to_pylist()):
                data = encode(text or "") + b"\0\0\0\0"
                n = len(data) // 4
                at = 0
                for k, end in enumerate(range(n % length or length, n + 1, length) if n > length else [n]):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(end - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * end]))
                    ids.append(data[4 * at : 4 * end] if keep_ids else None)
                    at = end
            rest = [b.column(n).take(pa.array(row, pa.int64())) for n in b.schema.names if n != "_text"]
            out = [*rest, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = [*[n for n in b.schema.names if n != "_text"], "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary())] if keep_ids else out, [*names, "ids"] if keep_ids else names)

    return run


def tokenise(docs: DataFrame, text: str = "text", length: int = LENGTH, paths: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece: the other columns of docs, piece, start, length, ids_crc32 and, if asked for, ids."""
    rest = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32", "ids")]
    df = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in df.dtypes if n != "_text") + "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return df.mapInArrow(_pieces(paths or vocabulary(), length, keep_ids), schema)


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins as lists of indexes: in the order given, each to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    spare: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    for i, n in enumerate(lengths):
        at = bisect_left(spare, (n, -1))
        if at < len(spare):
            free, b = spare.pop(at)
        else:
            free, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > n:
            insort(spare, (free - n, b))
    return bins


@lru_cache(64)
def _two_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class LocalSearch:
    """Bins and the steps between those that are not full. Every step raises the sum of the squared fills, so the
    search ends; it stops once no packing can have fewer bins."""

    def __init__(self, bins: list[list[int]], lengths: list[int], room: int):
        self.room, self.length = room, np.asarray(lengths, np.int64)
        self.bins = [list(b) for b in bins]
        self.bin = np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            self.bin[b] = k
        self.fill = np.array([self.length[b].sum() for b in bins], np.int64)
        self.least = -(-int(self.length.sum()) // room)
        self.pieces = np.argsort(self.length, kind="stable")
        self._pairs: list[np.ndarray] | None = None
        self._changed: set[int] = set()
        self._refresh()

    def _refresh(self) -> None:
        """Open bins and the pieces in them. Bins only leave in between, so both lists stay supersets."""
        self.open = np.flatnonzero((self.fill > 0) & (self.fill < self.room))
        self.pieces = self.pieces[self.fill[self.bin[self.pieces]] < self.room]
        self.lengths = self.length[self.pieces]

    def _gain(self, src: int, dst: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """What the sum of squares gains when `moved` tokens more go from src to dst than come back; -1 if they can't."""
        f = self.fill[dst]
        return np.where((moved > 0) & (moved <= self.room - f) & (dst != src) & (f > 0), 2 * moved * (f - self.fill[src] + moved), -1)

    def _best(self, src: int, dst: np.ndarray, moved: np.ndarray) -> tuple[int, int]:
        if not len(dst):
            return -1, -1
        gain = self._gain(src, dst, moved)
        at = int(gain.argmax())
        return int(gain[at]), at

    def _pairs_of(self, bins: list[int]) -> list[np.ndarray]:
        """Any two pieces of a bin: both indexes, their bin."""
        found = []
        for k in bins:
            b = np.array(self.bins[k], np.int64)
            i, j = _two_of(len(b)) if len(b) <= 64 else np.triu_indices(len(b), 1)
            found.append((b[i], b[j], np.full(len(i), k)))
        return [np.concatenate([x[n] for x in found] or [np.zeros(0, np.int64)]) for n in range(3)]

    def _all_pairs(self) -> list[np.ndarray]:
        """Pairs of all open bins. The pairs of bins that have changed are made anew, those of all bins only now and then."""
        if self._pairs is None or len(self._changed) > 50:
            self._pairs, self._changed = self._pairs_of(self.open.tolist()), set()
        if not self._changed:
            return self._pairs
        keep = ~np.isin(self._pairs[2], list(self._changed))
        fresh = self._pairs_of([k for k in self._changed if 0 < self.fill[k] < self.room])
        self._pairs = [np.concatenate([x[keep], y]) for x, y in zip(self._pairs, fresh, strict=True)]
        self._changed = set()
        return self._pairs

    def most_room(self, src: int) -> int:
        fill = self.fill[self.open]
        return self.room - int(fill[(self.open != src) & (fill > 0)].min(initial=self.room))

    def step(self, src: int) -> bool:
        """The best step for the longest piece of src that has one: a move, one for one, or two for one."""
        done: set[int] = set()
        for i in sorted(self.bins[src], key=lambda i: -self.length[i]):
            n = int(self.length[i])
            if n in done:
                continue
            done.add(n)
            move, m = self._best(src, self.open, np.full(len(self.open), n))
            # a shorter piece that comes back lacks at most the room of the emptiest other bin
            low, high = np.searchsorted(self.lengths, (n - self.most_room(src), n))
            one, o = self._best(src, self.bin[self.pieces[low:high]], n - self.lengths[low:high])
            o += low
            best, dst, back = max((move, int(self.open[m]), ()), (one, int(self.bin[self.pieces[o]]), (int(self.pieces[o]),)))
            if best <= 0:
                a, b, at = self._all_pairs()
                two, t = self._best(src, at, n - self.length[a] - self.length[b])
                if two > 0:
                    best, dst, back = two, int(at[t]), (int(a[t]), int(b[t]))
            if best > 0:
                self._exchange(src, dst, i, back)
                return True
        return False

    def _exchange(self, src: int, dst: int, i: int, back: tuple[int, ...]) -> None:
        self.bins[src].remove(i)
        self.bins[dst].append(i)
        self.bin[i] = dst
        for j in back:
            self.bins[dst].remove(j)
            self.bins[src].append(j)
            self.bin[j] = src
        moved = self.length[i] - self.length[list(back)].sum()
        self.fill[src] -= moved
        self.fill[dst] += moved
        self._changed |= {src, dst}
        if self.fill[dst] == self.room or not self.bins[src]:
            self._refresh()

    def run(self) -> list[list[int]]:
        """The least full bin gives its pieces away until it is empty; one without a step waits until another is emptied."""
        used, stuck = int((self.fill > 0).sum()), np.zeros(len(self.bins), bool)
        while used > self.least:
            waiting = self.open[~stuck[self.open]]
            if not len(waiting):
                break
            src = int(waiting[self.fill[waiting].argmin()])
            while self.bins[src] and self.step(src):
                pass
            stuck[src] = True
            if not self.bins[src]:
                used -= 1
                stuck[:] = False
        return [b for b in self.bins if b]


def pack_lengths(lengths: list[int], room: int = LENGTH) -> list[list[int]]:
    """Best fit, then the search; where that ends above the bound, once more from best fit of the longest first."""
    bins = LocalSearch(best_fit(lengths, room), lengths, room).run()
    if len(bins) > -(-sum(lengths) // room):
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        start = [[order[k] for k in b] for b in best_fit([lengths[i] for i in order], room)]
        bins = min(bins, LocalSearch(start, lengths, room).run(), key=len)
    return bins


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP, label: str = "pieces") -> DataFrame:
    """pieces (length, ids_crc32, piece, any others) with sequence_id and offset. Pieces that fill a
    sequence get one of their own without being gathered."""
    pieces = materialise(pieces, label)
    salt = F.xxhash64(F.monotonically_increasing_id())
    n = pieces.where(F.col("length") < length).count()
    groups = max(1, -(-n // group))
    full = pieces.where(F.col("length") >= length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for s, b in enumerate(pack_lengths(sizes, length)):
            at = 0
            for i in b:
                seq[i], off[i] = s, at
                at += sizes[i]
        return pdf.assign(sequence_id=pdf["_group"] * (1 << 32) + seq, offset=off).drop(columns=["_group", "_key"])

    rest = pieces.where(F.col("length") < length).withColumn("_key", salt).withColumn("_group", F.pmod("_key", F.lit(groups)))
    schema = "".join(f"`{a}` {t}, " for a, t in pieces.dtypes) + "sequence_id long, offset long"
    return rest.groupBy("_group").applyInPandas(run, schema).unionByName(full)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(tokenise(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
