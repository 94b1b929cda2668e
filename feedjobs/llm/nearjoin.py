"""Exact Jaccard join on 5-word shingles by token-combination prefixes, and the groups that its links form.

Plan
1. Census: each document becomes its set of shingle hashes (64 bits). Equal sets are collapsed to one
   representative, the smallest doc_id, by a 128-bit digest of the set. Tasks also count shingles in a fixed
   number of slots; the merged counts give each slot a level, exact for small counts and logarithmic
   beyond. The array of levels has a fixed size and is broadcast.
2. Signatures: tokens are ordered by level, rarest first; those of a slot with at most `freq` shingles are
   called rare. A partner at similarity 0.8 lacks at most
   d = floor(n / 5) of the n tokens of a set, so a prefix from which d tokens can be taken away without
   destroying all its signatures is enough. Rare tokens are signatures by themselves and cover 1 each.
   Where they do not suffice the prefix is extended over frequent tokens, which are dealt to small
   classes; each pair of tokens of one class is a signature, and k tokens of a class cover k - 1. The
   number of classes follows the size of the set, so a set writes its pairs for its own size band and for
   the next one; sets that can link share a band. A set that cannot be covered at all also writes the plain
   prefix filter, in which any two such sets meet.
3. Buckets: sets that share a signature. Within buckets of at most SMALL sets all pairs are candidates. A larger
   bucket compares one hub with its other sets, gives the hub up, and is dropped once its sets are all in one
   component; after ROUNDS hubs the pairs left between different components are taken in blocks of BLOCK sets,
   so no link between different sets is lost and no task gets a whole bucket.
   Candidates that the place of the shared token rules out are skipped at once, most others by parity sketches
   of the sets (about 1/30 of their size), which never rule out a link; what is left is verified on whole sets.
4. Components by repeated hooking to the smallest neighbour and pointer jumping; new links only hook the
   components that they touch.

Bounds: the array of levels has 2^24 bytes at most, so in a corpus of very many more tokens only those far above the
average of a slot count as frequent. A task remembers the digests of its first 500,000 texts and counts up to
65,000 per slot; beyond, copies raise counts. All this only changes the order of tokens, never the result.

Defined results: a text without words has an empty set and links with nothing; fewer than five words form one
shingle of the whole sequence; equal rows are copies; rows with a null doc_id link with nothing (their component is null).
Hashes of 64 bits stand for shingles: two different shingles of one comparison agree by chance with
probability below 1e-13 for sets of 1,000.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, filter_places, id_filter, in_filter, materialise, mix, sliced, text_bytes, word_hashes, word_spans

K = 5
#: Jaccard threshold as a ratio of integers, and the share of a set that a partner may lack: 1 - threshold.
NUM, DEN, LACK = 4, 5, 5
MAX_SLOT_BITS = 24
#: Buckets of at most SMALL sets are joined directly; larger ones go through ROUNDS of hubs, then in blocks of BLOCK sets.
SMALL, ROUNDS, BLOCK = 4, 2, 1000
#: So many of the smallest signatures of a set tell in which bucket two sets meet first.
LOWEST = 16
#: Levels are counts up to this, then 8 steps for each doubling.
_EXACT = 64
_SEGMENT = 1 << 16
_COEF = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BAND = np.log(1.26)  # a little over 1 / 0.8: sets that link are in one band or in two neighbouring ones


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    w, _ = word_hashes(data, starts, ends)
    n = len(w)
    rolled = np.zeros(max(0, n - K + 1), dtype=np.uint64)
    for i in range(K if len(rolled) else 0):
        rolled += w[i : n - K + 1 + i] * _COEF[i]
    rolled = mix(rolled)
    out = []
    pa.default_memory_pool().release_unused()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= K:
            out.append(np.unique(rolled[a : b - K + 1]))
        elif b > a:
            out.append(mix((w[a:b] * _COEF[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ------------------------------------------------------------------ 1. census

_CENSUS = "doc_id long, n long, fp binary, segment int, counts binary"


def _census(slot_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << slot_bits, np.uint16), set()
        for b in sliced(batches, "text"):
            sizes, digests = [], []
            for s in shingle_sets(b["text"]):
                fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                sizes.append(len(s))
                digests.append(fp)
                if fp is not None and fp not in seen:
                    if len(seen) < 500_000:  # copies beyond only raise counts a little
                        seen.add(fp)
                    slot = (s >> np.uint64(64 - slot_bits)).astype(np.int64)
                    np.add.at(counts, slot[counts[slot] < 65_000], 1)
            none = lambda t, n=len(sizes): pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), none(pa.int32()), none(pa.binary())], ["doc_id", "n", "fp", "segment", "counts"])
        width = min(_SEGMENT, len(counts))
        for s in np.flatnonzero(counts.reshape(-1, width).any(axis=1)):
            cut = zlib.compress(counts[s * width : (s + 1) * width].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([s], pa.int32()), pa.array([cut], pa.binary())], ["doc_id", "n", "fp", "segment", "counts"])

    return run


def level_of(counts: np.ndarray) -> np.ndarray:
    """One byte that grows with the count."""
    steps = _EXACT + 8 * np.log2(np.maximum(counts, _EXACT) / _EXACT)
    return np.where(counts <= _EXACT, counts, np.minimum(steps, 255)).astype(np.uint8)


def _sum_counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b["segment"].to_pylist(), b["counts"].to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(c), np.uint16).astype(np.int64)
                state[s] = state[s] + c if s in state else c
        levels = [level_of(c).tobytes() for c in state.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.int32()), pa.array(levels, pa.binary())], ["segment", "levels"])

    return run


def slot_levels(census: DataFrame, slot_bits: int) -> np.ndarray:
    """One byte for each slot: the level of the number of shingles that fall into it."""
    rows = census.where("segment IS NOT NULL").select("segment", "counts").repartition("segment").mapInArrow(_sum_counts(), "segment int, levels binary")
    out, width = np.zeros(1 << slot_bits, np.uint8), min(_SEGMENT, 1 << slot_bits)
    for r in rows.toLocalIterator():
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out


# ------------------------------------------------------------------ 2. signatures


def pair_signatures(tokens: np.ndarray, need: int, band: int, offset: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Pairs of tokens of one class over the shortest prefix of `tokens` that covers `need`; for each the place of
    its first token and what the prefix up to its second token covers besides it (both from offset); and whether
    the prefix covers."""
    classes = max(1, round(1.26**band / LACK / 2))
    cls = (mix(tokens ^ np.uint64(0xB5297A4D)) % np.uint64(classes)).astype(np.int64)
    order = np.argsort(cls, kind="stable")
    rank = np.empty(len(cls), np.int64)  # place of a token within its class, in prefix order
    rank[order] = np.arange(len(cls)) - np.searchsorted(cls[order], cls[order])
    covers = np.cumsum(rank > 0)
    end = int(np.searchsorted(covers, need)) + 1
    covered = end <= len(tokens)
    out, places, ranks, salt = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.uint64((band * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    cls, prefix = cls[:end], tokens[:end]
    order = np.argsort(cls, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(cls[order])) + 1):
        if len(at) > 1:
            i, j = np.triu_indices(len(at), 1)
            out.append(mix(prefix[at[i]] * np.uint64(0xD6E8FEB86659FD93) + prefix[at[j]] + salt))
            places.append(at[i] + offset)
            ranks.append(covers[at[j]] - 1 + offset)
    return np.concatenate(out), np.concatenate(places), np.concatenate(ranks), covered


def signatures(s: np.ndarray, levels: np.ndarray, slot_bits: int, freq: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Single-token signatures of one set (sorted hashes) in order, so their index is their place and rank; other
    signatures; and for each of those its place and its rank: the number of tokens that can be missing for it to
    be needed. freq is a level."""
    lack = len(s) // LACK
    level = levels[(s >> np.uint64(64 - slot_bits)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    ordered, n_rare = s[order], int((level <= freq).sum())
    if n_rare > lack:
        return ordered[: lack + 1], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rare, common = ordered[:n_rare], ordered[n_rare:]
    band, sets, places, ranks, sure = int(np.log(len(s)) / _BAND), [], [], [], True
    for p in (band, band + 1):
        sig, at, rank, covered = pair_signatures(common, lack + 1 - len(rare), p, len(rare))
        sets.append(sig)
        places.append(at)
        ranks.append(rank)
        sure &= covered
    if not sure:
        sets.append(mix(ordered[: lack + 1] ^ np.uint64(0x5851F42D)))
        places.append(np.arange(lack + 1))
        ranks.append(np.arange(lack + 1))
    other, first = np.unique(np.concatenate(sets), return_index=True)
    return rare, other, np.concatenate(places)[first], np.concatenate(ranks)[first]


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens in 2^k classes, at least one for each token, as 64-bit words. Each token
    that only one of two sets has turns one bit, so two sets differ in at least as many tokens as their sketches
    in bits; a sketch of twice the length is folded by exclusive or of its halves."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _lists(xs: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *xs])))


_SIGNATURES = "rep long, copy boolean, n long, sketch array<long>, single array<long>, other array<long>, places array<long>, ranks array<long>"


def _signatures(levels, slot_bits: int, freq: int, copies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            maybe = in_filter(copies.value, b["at"])
            for i, copy, s in zip(b["doc_id"].to_pylist(), maybe.tolist(), shingle_sets(b["text"]), strict=True):
                if len(s):
                    one, more, at, rank = signatures(s, levels.value, slot_bits, freq)
                    row = (i, copy, len(s), sketch_of(s), one.view(np.int64), more.view(np.int64), at, rank)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            plain = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64())]
            yield pa.RecordBatch.from_arrays([*plain, *map(_lists, out[3:])], [f.split()[0] for f in _SIGNATURES.split(", ")])

    return run


def _sets(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            b = b.filter(pa.array(in_filter(wanted.value, b["at"])))
            yield pa.RecordBatch.from_arrays([b["doc_id"], _lists([s.view(np.int64) for s in shingle_sets(b["text"])])], ["doc_id", "tokens"])

    return run


# ------------------------------------------------------------------ 3. buckets and links


def find_buckets(sig_rows: DataFrame) -> DataFrame:
    """sig_rows (rep, n, single, other, places, ranks) -> sig, pos, rank, rep, n, c for all signatures that two sets
    share; c is the number of sets that do."""
    one = sig_rows.select(F.posexplode("single").alias("pos", "sig"), "rep", "n").select("sig", "pos", F.col("pos").alias("rank"), "rep", "n")
    more = sig_rows.select(F.explode(F.arrays_zip("other", "places", "ranks")).alias("x"), "rep", "n")
    more = more.select(F.col("x.other").alias("sig"), F.col("x.places").cast("int").alias("pos"), F.col("x.ranks").cast("int").alias("rank"), "rep", "n")
    # few sets share a rare token, so those are counted where they meet; any number can share a pair, so those are
    # counted with sums that combine before the shuffle
    one = one.withColumn("c", F.count("*").over(Window.partitionBy("sig"))).where("c > 1")
    shared = more.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    return one.unionByName(more.join(shared, "sig").select("sig", "pos", "rank", "rep", "n", "c"))


def sketch_distance(a: str, b: str) -> Column:
    """Bits in which two sketches differ, the longer folded to the length of the shorter: never more than the
    number of tokens that only one of the sets has."""
    half = lambda x: (F.size(x) / 2).cast("int")
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    folded = lambda x, y: F.when(F.size(x) > F.size(y), xor(F.slice(x, 1, half(x)), F.slice(x, half(x) + 1, half(x)))).otherwise(F.col(x))
    return F.aggregate(xor(folded(a, b), folded(b, a)), F.lit(0), lambda n, w: n + F.bit_count(w))


def close_sketches(a: str, b: str) -> Column:
    return (NUM + DEN) * sketch_distance(a, b) <= (2 * DEN - (NUM + DEN)) * (F.col("na") + F.col("nb"))


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link: two sets that reach the threshold differ in at most (n_a + n_b) / 9 tokens."""
    left, right = (sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return pairs.join(right, "b").join(left, "a").where(close_sketches("sa", "sb")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, with n_a, n_b and common."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(right, "b").join(left, "a")
    both = both.select("a", "b", F.size("ta").alias("n_a"), F.size("tb").alias("n_b"), F.size(F.array_intersect("ta", "tb")).alias("common"))
    return both.where(DEN * F.col("common") >= NUM * (F.col("n_a") + F.col("n_b") - F.col("common")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, label: the smallest node that it can reach. Labels only ever fall; the loop
    ends when no link joins two labels."""
    links = materialise(links.select("a", "b").where("a != b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        for _ in range(2):  # pointer jumping: the label of the label
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            labels = materialise(labels.join(up, "label").select("node", F.col("higher").alias("label")), "labels")
        la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        open_ = materialise(links.join(la, "a").join(lb, "b").where("la != lb").select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("lower")).groupBy("label").agg(F.min("lower").alias("lower")), "open-links")
        if open_.isEmpty():
            return labels
        labels = materialise(labels.join(open_, "label", "left").select("node", F.coalesce("lower", "label").alias("label")), "labels")


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of all nodes after new links (a, b): only the components that the new links touch are hooked anew."""
    if labels is None:
        return components(links)
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    between = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(between).select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = moved.join(labels.select("node"), F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return materialise(known.unionByName(fresh), "labels")


def _may_link(a: str, b: str) -> Column:
    """Can two sets that share a signature reach the threshold, and is this one of those that show it?

    They have at most min(places) tokens in common before the shared one and at most the shorter rest behind
    it. And sets of sizes n and m that link have at least 4 (n + m) / 9 tokens in common, so each lacks fewer
    than the general bound: signatures of a rank beyond that are not needed for this pair."""
    c = lambda x: F.col(x)
    both = NUM * (c(f"n{a}") + c(f"n{b}"))
    needed = ((NUM + DEN) * (c(f"n{a}") - c(f"r{a}")) >= both) & ((NUM + DEN) * (c(f"n{b}") - c(f"r{b}")) >= both)
    common = F.least(c(f"p{a}"), c(f"p{b}")) + 1 + F.least(c(f"n{a}") - c(f"p{a}"), c(f"n{b}") - c(f"p{b}")) - 1
    return (c(a) != c(b)) & needed & (DEN * common >= NUM * (c(f"n{a}") + c(f"n{b}") - common))


def _side(buckets: DataFrame, x: str) -> DataFrame:
    rest = [c for c in buckets.columns if c not in ("sig", "pos", "rank", "rep", "n", "c", "comp", "sketch", "low", "low_ranks")]
    rest += [F.col(c).alias(f"{to}{x}") for c, to in (("sketch", "k"), ("low", "low_"), ("low_ranks", "low_ranks_")) if c in buckets.columns]
    return buckets.select(*rest, F.col("sig").alias(f"s{x}"), F.col("pos").alias(f"p{x}"), F.col("rank").alias(f"r{x}"), F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"))


def lowest_signatures(buckets: DataFrame) -> DataFrame:
    """rep, low, low_ranks: the LOWEST smallest signatures that a set has in these buckets, with their ranks."""
    low = F.slice(F.array_sort(F.collect_list(F.struct("sig", "rank"))), 1, LOWEST)
    return buckets.groupBy("rep").agg(low.alias("low")).select("rep", F.col("low.sig").alias("low"), F.col("low.rank").alias("low_ranks"))


def _met_first(a: str, b: str) -> Column:
    """Is this the bucket of the smallest signature that the two sets share and that this pair needs?

    If their lists of smallest signatures share one, the smallest that the lists share is the smallest of all, as any
    smaller one would be in both lists. If they share none, every bucket may be the first."""
    both = NUM * (F.col(f"n{a}") + F.col(f"n{b}"))
    needed = lambda x: F.filter(f"low_{x}", lambda s, i: (NUM + DEN) * (F.col(f"n{x}") - F.get(f"low_ranks_{x}", i)) >= both)
    return F.coalesce(F.array_min(F.array_intersect(needed(a), needed(b))), F.col(f"s{a}")) == F.col(f"s{a}")


def met_pairs(buckets: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b) of different components within buckets that may link, by their sketches too where the rows have
    them, and only in the bucket where they meet first where the rows have their lowest signatures. A bucket of more
    than `block` sets is cut into chunks; each two chunks meet under a key of their own, so no task gets more than two
    chunks of a bucket."""
    k = F.ceil(F.col("c") / block).cast("int")
    chunk = F.pmod(F.xxhash64("rep", F.lit("chunk")), k).cast("int")
    left = _side(buckets.withColumn("i", chunk).withColumn("j", F.explode(F.sequence("i", k - 1))), "a")
    right = _side(buckets.withColumn("j", chunk).withColumn("i", F.explode(F.sequence(F.lit(0), "j"))), "b")
    same = (F.col("sa") == F.col("sb")) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    once = (left["i"] < left["j"]) | (F.col("a") < F.col("b"))
    may = _may_link("a", "b")
    if "sketch" in buckets.columns:
        may = may & close_sketches("ka", "kb")
    if "low" in buckets.columns:
        may = may & _met_first("a", "b")
    met = left.join(right, same & once & (F.col("ca") != F.col("cb")) & may)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def block_pairs(buckets: DataFrame, block: int = BLOCK) -> DataFrame:
    return met_pairs(buckets, block).distinct()


def hub_pairs(buckets: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs of the hub of each bucket with those of its other sets that are in other components and may link."""
    h = hubs.select("sig", F.col("hub.rep").alias("a"), F.col("hub.n").alias("na"), F.col("hub.pos").alias("pa"), F.col("hub.rank").alias("ra"), F.col("hub.comp").alias("ca"))
    met = _side(buckets, "b").join(h, (F.col("sb") == F.col("sig")) & (F.col("ca") != F.col("cb")) & _may_link("a", "b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def true_links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) that link: sketches rule out most others, then whole sets decide. Only
    documents whose id is in a Bloom filter of the ids still needed become sets and shuffle."""
    near = materialise(alike(pairs, sketches), "alike")
    if near.isEmpty():
        return near
    ids = materialise(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    bits, found = id_filter(ids, "doc_id")
    some = docs.withColumn("at", filter_places(F.col("doc_id"), bits)).mapInArrow(_sets(docs.sparkSession.sparkContext.broadcast(found)), "doc_id long, tokens array<long>")
    sets = materialise(some.join(ids, "doc_id", "left_semi"), "sets", "uncompressed")
    links = materialise(verified(near, sets).select("a", "b"), "true-links")
    discard(near, ids, sets)
    return links


def similar_groups(buckets: DataFrame, sketches: DataFrame, docs: DataFrame, small: int = SMALL, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """node, label over all links between sets that share a bucket (see step 3 above).

    buckets: sig, pos, rank, rep, n, c. The first round takes all pairs of small buckets and the hub of each larger
    one (the smallest id, often the original), later ones another hub, chosen by a hash, of the buckets whose sets
    are not yet in one component. After `rounds`, the pairs left between different components are taken in blocks."""
    buckets = buckets.withColumn("comp", F.col("rep"))
    few, labels = buckets.where(F.col("c") <= small), None
    buckets = buckets.where(F.col("c") > small)
    for turn in range(rounds + 1):
        if turn < rounds:
            hub = F.min_by(F.struct("rep", "n", "pos", "rank", "comp"), F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep"))
            hubs = materialise(buckets.groupBy("sig").agg(hub.alias("hub")), "hubs")
            pairs = hub_pairs(buckets, hubs)
        else:
            known = sketches.select("rep", "sketch").join(lowest_signatures(buckets), "rep")  # one row for each set
            pairs = block_pairs(buckets.join(known, "rep"), block)
        if not turn:
            pairs = pairs.unionByName(block_pairs(few, max(2, small))).distinct()
        links = true_links(materialise(pairs, "candidates"), sketches, docs)
        if labels is None or not links.isEmpty():
            labels = extended(labels, links)
        if turn == rounds:
            return labels
        rest = buckets.join(hubs.select("sig", F.col("hub.rep").alias("_hub")), "sig").where("rep != _hub").drop("_hub", "comp")
        rest = rest.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
        mixed = rest.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("sig", "c")
        done, buckets = buckets, materialise(rest.drop("c").join(mixed, "sig"), "buckets", "uncompressed")
        if turn:
            discard(done)
        if buckets.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_slot_bits: int = MAX_SLOT_BITS, small: int = SMALL, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    slot_bits = min(max_slot_bits, max(12, (int(chars) // 20).bit_length()))
    census = materialise(docs.mapInArrow(_census(slot_bits), _CENSUS), "census", "uncompressed")
    rows = census.where("segment IS NULL").select("doc_id", "n", "fp")
    tokens = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    levels = spark.sparkContext.broadcast(slot_levels(census, slot_bits))
    freq = int(level_of(np.array([max(16, 4 * int(tokens) >> slot_bits)]))[0])
    first = materialise(rows.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    members = materialise(rows.join(first, "fp", "left").select("doc_id", "n", "rep"), "members")
    # copies need no signatures; a filter of their ids finds them in place, and a join only clears up what it can't tell
    bits, copies = id_filter(members.where("doc_id != rep"), "doc_id")
    marked = docs.where("doc_id IS NOT NULL").withColumn("at", filter_places(F.col("doc_id"), bits))
    signed = materialise(marked.mapInArrow(_signatures(levels, slot_bits, freq, spark.sparkContext.broadcast(copies)), _SIGNATURES), "signatures", "uncompressed")
    reps = members.where("doc_id = rep").select("rep").distinct()
    sig_rows = signed.where("NOT copy").unionByName(signed.where("copy").join(reps, "rep", "left_semi"))
    buckets = materialise(find_buckets(sig_rows), "buckets", "uncompressed")
    sketches = materialise(sig_rows.select("rep", "n", "sketch"), "sketches", "uncompressed")
    discard(census, first, signed)
    labels = similar_groups(buckets, sketches, docs.where("doc_id IS NOT NULL"), small, rounds, block)
    discard(buckets, sketches)
    out = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the rows of docs whose doc_id names its component, and all rows without a doc_id.
    Where different texts share a doc_id, each of them is a document of its own, in order of doc_id and a hash."""
    named = docs.where(F.col(doc_id).isNotNull())
    texts = named.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"))
    key = doc_id
    if not texts.groupBy("_id").agg(F.min("_hash").alias("lo"), F.max("_hash").alias("hi")).where("lo < hi").isEmpty():
        keys = materialise(texts.distinct().orderBy("_id", "_hash").withColumn("_key", F.monotonically_increasing_id()), "document-keys")
        key = "_key"
        named = materialise(named.withColumn("_h", F.xxhash64(text)).join(keys, (F.col(doc_id) == F.col("_id")) & (F.col("_h") == F.col("_hash"))).drop("_h", "_id", "_hash"), "keyed-documents")
    groups = near_duplicates(named, key, text)
    first = materialise(groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "first-documents")
    keep = named.join(first.withColumnRenamed("doc_id", "_first"), F.col(key) == F.col("_first"), "left_semi")
    once = Window.partitionBy(key).orderBy(text)
    keep = keep.withColumn("_turn", F.row_number().over(once)).where("_turn = 1")
    return keep.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
