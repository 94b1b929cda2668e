"""Repair of conversations by cheapest edits, with the least audit among equally cheap ones.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant, told by the
initials of roles. Edits are Keep (0), Rerole to user or assistant (1), Delete (2; the only one allowed for blank
and duplicate rows) and Insert an empty user or assistant turn (5); a truncated row that stays adds 5. Costs are
distances in a layered graph, with one node for each number of rows used up and state of that pattern.

1. Equal rows are counted together first: what counts is (conv_id, turn, role, text), told by a hash. Faults need no
   text after that, so all steps but the last run on narrow rows.
2. The rows are sorted by range over all conversations and cut into segments of at most `ROWS` rows, so a
   conversation of any length is spread over tasks. A segment is summed up by its 4 x 4 matrix of cheapest costs.
3. Costs to the end of the conversation come from these matrices, backwards (one row of 150 bytes for each 4,096 rows of a
   conversation of more than one segment; since an audit is one value, of 2^31 characters at most, that group
   stays under 100 MB). Conversations of one segment, nearly all, need no exchange for it.
4. Within a segment the arcs on cheapest paths are ranked by their least audits of 1, 2, 4, ... letters: a rank of
   2k letters is the rank of the pair (k letters, k letters from where these end), found through the pointer that
   is doubled with each round. The pattern lets no letter lead from a node to two others, so pointers are
   certain from the first round. The least path doubles its known beginning with each pointer, for each state in
   which the segment can be entered; which it is, segments tell each other as in step 3.
5. Texts and edits meet by sorting: one exchange of the texts.

Defined results: null role and text are one space; rows with a null conv_id are a conversation of their own. Rows
are in order of turn, nulls first, those of one turn by the hash of role and text (equal rows are interchangeable
and adjacent). A role is kept as it is, whatever follows its initial. Rows without a conversation don't exist:
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, materialise

ROWS = 4096
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FAR = np.int64(1) << 60
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. 0 and 3 may end a conversation.
_KEEP = {0: (1, 2, None), 1: (None, 2, None), 2: (None, None, 3), 3: (None, 2, None)}  # next state on s, u, a
_NEXT = np.array([2, 2, 3, 2])  # on a turn whose role is free
#: Cost to the end where no row is left: by inserts only.
_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
#: A row's code: initial (0 s, 1 u, 2 a, 3 other) + 4 * fault (0 none, 1 truncated, 2 must be deleted).
_GONE = 11


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code and state: cost of Keep and where it leads, cost of Rerole; _FAR where it isn't allowed."""
    keep, to, rerole = np.full((12, 4), _FAR), np.zeros((12, 4), np.int64), np.full((12, 4), _FAR)
    for code in range(8):
        more = TRUNCATED * (code // 4)
        for state in range(4):
            rerole[code, state] = REROLE + more
            if code % 4 < 3 and _KEEP[state][code % 4] is not None:
                keep[code, state], to[code, state] = more, _KEEP[state][code % 4]
    return keep, to, rerole


_KEEP_COST, _KEEP_TO, _REROLE_COST = _tables()


def _layer(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to the end before a row, given those after it: codes [n], after [n, 4] -> [n, 4]."""
    i = np.arange(len(codes))[:, None]
    best = np.minimum(after + DELETE, _KEEP_COST[codes] + after[i, _KEEP_TO[codes]])
    best = np.minimum(best, _REROLE_COST[codes] + after[:, _NEXT])
    two, three = np.minimum(best[:, 2], best[:, 3] + INSERT), np.minimum(best[:, 3], best[:, 2] + INSERT)
    return np.stack([np.minimum(best[:, 0], two + INSERT), np.minimum(best[:, 1], two + INSERT), two, three], axis=1)


def _costs(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to the end before each row of conversations of one length: codes [n, rows], end [n, 4] -> [n, rows + 1, 4]."""
    out = np.empty((len(codes), codes.shape[1] + 1, 4), np.int64)
    out[:, -1] = end
    for i in range(codes.shape[1] - 1, -1, -1):
        out[:, i] = _layer(codes[:, i], out[:, i + 1])
    return out


def _matrices(codes: np.ndarray) -> np.ndarray:
    """Cheapest costs from each state before the rows to each state after them: [n, 4, 4]."""
    n = len(codes)
    units = np.where(np.eye(4, dtype=bool), np.int64(0), _FAR)
    out = _costs(np.repeat(codes, 4, axis=0), np.tile(units, (n, 1)))[:, 0]
    return np.minimum(out.reshape(n, 4, 4).transpose(0, 2, 1), _FAR)


# ------------------------------------------------------------------ least audits

_LETTERS = np.frombuffer(b"DIKR", np.uint8)  # in the order of ASCII


def _least_paths(codes: np.ndarray, end: np.ndarray, last: bool, starts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least of the cheapest paths through segments of one length, from each of the states in `starts`: rows
    before each step, its letter (0 to 3, 4 past the end) and the state that it leads to, each [n * starts, steps]."""
    n, rows = codes.shape
    h = _costs(codes, end)
    shape = (n, rows + 1, 4, 4)  # segment, rows used up, state, letter
    cost, head = np.full(shape, _FAR), np.zeros(shape, np.int64)
    node = np.arange(n * (rows + 1) * 4).reshape(n, rows + 1, 4)
    seg = np.arange(n)[:, None, None]
    layer = np.arange(rows)[None, :, None]
    to = _KEEP_TO[codes]
    cost[:, :-1, :, 0], head[:, :-1, :, 0] = DELETE + h[:, 1:], node[:, 1:]
    cost[:, :-1, :, 2], head[:, :-1, :, 2] = _KEEP_COST[codes] + h[seg, layer + 1, to], node[seg, layer + 1, to]
    cost[:, :-1, :, 3], head[:, :-1, :, 3] = _REROLE_COST[codes] + h[:, 1:][:, :, _NEXT], node[:, 1:][:, :, _NEXT]
    within = rows + 1 if last else rows
    cost[:, :within, :, 1], head[:, :within, :, 1] = INSERT + h[:, :within][:, :, _NEXT], node[:, :within][:, :, _NEXT]
    best = cost == h[..., None]
    if last:
        best[:, -1, [0, 3]] = False  # the end itself
    else:
        best[:, -1] = False
    best, head = best.reshape(-1, 4), head.reshape(-1)
    arcs = best.size
    first = np.where(best.any(axis=1), np.arange(len(best)) * 4 + best.argmax(axis=1), arcs)  # the arc of least letter, or the end
    rank = np.append(np.where(best.reshape(-1), 1 + np.tile(np.arange(4), len(best)), 5), 0)  # the end comes before all letters
    jump = np.append(np.where(best.reshape(-1), first[head], arcs), arcs)
    jumps = []
    for _ in range(int(3 * rows + 4).bit_length()):
        jumps.append(jump)
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1].reshape(-1)
        jump = jump[jump]
    ranked = np.where(best, rank[:-1].reshape(-1, 4), len(rank) + 1)
    chosen = np.where(best.any(axis=1), np.arange(len(best)) * 4 + ranked.argmin(axis=1), arcs)
    path = chosen[node[:, 0][:, list(starts)].reshape(-1)][:, None]
    for jump in jumps:
        if (path[:, -1] == arcs).all():
            break
        path = np.concatenate([path, jump[path]], axis=1)
    there = np.append(head, 0)[path] % 4
    return np.where(path == arcs, rows, path // 16 % (rows + 1)), np.where(path == arcs, 4, path % 4), there


_SEGMENT = "conv_id long, part int, seg int, codes binary, unit array<int>, turns array<long>, hashes array<binary>, copies array<long>"


def _segments(most: int):
    """Sorted rows of one partition, cut where a conversation or a batch ends, or after `most` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        for b in batches:
            conv, code, copies = b["conv_id"].to_pylist(), b["code"].to_numpy().astype(np.int64), b["copies"].to_numpy().astype(np.int64)
            turn, hash_ = b["turn"].to_pylist(), b["hash"].to_pylist()
            out, at = [], 0
            for key, run in groupby(conv):
                size = sum(1 for _ in run)
                ends = np.cumsum(copies[at : at + size])
                for low in range(0, int(ends[-1]), most):
                    row = np.arange(low, min(low + most, int(ends[-1])))
                    unit = np.searchsorted(ends, row, side="right")
                    codes = np.where(row == ends[unit] - copies[at + unit], code[at + unit], _GONE).astype(np.uint8)
                    places, own, n = np.unique(unit, return_inverse=True, return_counts=True)
                    out.append((key, part, seg, codes.tobytes(), own.reshape(-1).astype(np.int32), [turn[at + u] for u in places], [hash_[at + u] for u in places], n))
                    seg += 1
                at += size
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "part", "seg", "codes", "unit", "turns", "hashes", "copies"])

    return run


def _by_length(codes: list[bytes], most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of segments of one length, at most about `most` rows at once, and their codes as a matrix."""
    n = np.array([len(c) for c in codes])
    for rows in np.unique(n):
        places = np.flatnonzero(n == rows)
        step = max(1, most // int(rows))
        for i in range(0, len(places), step):
            at = places[i : i + step]
            yield at, np.frombuffer(b"".join(codes[j] for j in at), np.uint8).reshape(len(at), rows).astype(np.int64)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.empty((b.num_rows, 16), np.int64)
        for at, codes in _by_length(b["codes"].to_pylist()):
            out[at] = _matrices(codes).reshape(len(at), 16)
        yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], b["seg"], pa.array(list(out), pa.list_(pa.int64()))], ["conv_id", "part", "seg", "matrix"])


def _ends(segments: pd.DataFrame) -> pd.DataFrame:
    """Costs to the end of the conversation behind each of its segments."""
    s = segments.sort_values(["part", "seg"], ignore_index=True)
    m, end, cost = np.stack(s["matrix"].to_list()).reshape(-1, 4, 4), np.empty((len(s), 4), np.int64), _END
    for i in range(len(s) - 1, -1, -1):
        end[i] = cost
        cost = (m[i] + cost[None, :]).min(axis=1)
    return pd.DataFrame({"part": s["part"], "seg": s["seg"], "costs": list(end), "last": np.arange(len(s)) == len(s) - 1})


def _entries(segments: pd.DataFrame) -> pd.DataFrame:
    """The state in which the least path enters each segment."""
    s = segments.sort_values(["part", "seg"], ignore_index=True)
    state, entry = 0, []
    for exits in s["exits"]:
        entry.append(state)
        state = int(exits[state])
    return pd.DataFrame({"part": s["part"], "seg": s["seg"], "entry": entry}).astype({"entry": "int32"})


#: Letters of edits with the role that they give: K, D; U, A rerole; u, a insert.
_EDITS = np.zeros((5, 4), np.uint8)
_EDITS[0], _EDITS[2] = ord("D"), ord("K")
_EDITS[3, [2, 3]], _EDITS[1, [2, 3]] = list(b"UA"), list(b"ua")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the edits of its rows, and the state after it, for each state before it (only 0, if it is
    a whole conversation)."""
    for b in batches:
        codes, unit, n_units = b["codes"].to_pylist(), b["unit"], [len(t) for t in b["turns"]]
        costs, last = b["costs"].to_pylist(), b["last"].to_numpy(zero_copy_only=False)
        whole = np.array([c is None for c in costs])
        edits, exits = [None] * b.num_rows, [None] * b.num_rows
        for kind in ((True, True), (False, True), (False, False)):
            mine = np.flatnonzero((whole == kind[0]) & (last == kind[1]))
            starts = (0,) if kind[0] else (0, 1, 2, 3)
            for at, matrix in _by_length([codes[i] for i in mine]):
                at = mine[at]
                end = np.array([_END if costs[i] is None else costs[i] for i in at], np.int64)
                rows, letter, state = _least_paths(matrix, end, kind[1], starts)
                steps = (letter < 4).sum(axis=1)
                text = _EDITS[letter, state]
                for k, i in enumerate(at):
                    own, found, ways = np.asarray(unit[int(i)].values), [], []
                    for j in range(k * len(starts), (k + 1) * len(starts)):
                        of = own[np.minimum(rows[j, : steps[j]], len(own) - 1)]
                        cuts = np.searchsorted(of, np.arange(n_units[i] + 1))
                        line = text[j, : steps[j]].tobytes().decode()
                        ways.append([line[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
                        found.append(int(state[j, steps[j] - 1]))
                    edits[i], exits[i] = ways, found
        names = ["conv_id", "part", "seg", "turns", "hashes", "copies"]
        yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(exits, pa.list_(pa.int32())), pa.array(edits, pa.list_(pa.list_(pa.string())))], [*names, "exits", "edits"])


# ------------------------------------------------------------------ rows


def _hash(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def filled(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with one space for a null role or text."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def row_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, hash, copies, initial and fault ('', blank, duplicate or truncated) of the first copy: one row
    for equal rows, the rest of which are duplicates (or blank)."""
    bare = F.rtrim("text", F.lit(SPACES))
    own = F.when(bare == "", "blank").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    units = materialise(
        filled(rows).groupBy("conv_id", "turn", _hash(F.col("role"), F.col("text")).alias("hash"))
        .agg(F.count("*").alias("copies"), F.first(F.substring("role", 1, 1)).alias("initial"), F.first(own).alias("own")),
        "turns",
    )
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = units.groupBy(F.col("conv_id").alias("c"), F.col("hash").alias("h")).agg(F.count("*").alias("n"), F.min(when).alias("at")).where("n > 1")
    seen = units.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")), "left")
    repeated = F.col("h").isNotNull() & ~when.eqNullSafe(F.col("at"))
    fault = F.when((F.col("own") != "blank") & repeated, "duplicate").otherwise(F.col("own"))
    return seen.select("conv_id", "turn", "hash", "copies", "initial", fault.alias("fault"))


_ORDER = (F.asc_nulls_first, "conv_id"), (F.asc_nulls_first, "turn"), (F.asc, "hash")


def edit_plan(faults: DataFrame, most: int = ROWS) -> DataFrame:
    """conv_id, turn, hash, part, seg, copies, edits: the edits of the least audit, row by row. A K keeps a row, D
    deletes it, U and A rerole it; u and a insert a turn there. Equal rows of one turn share a row here, two
    where a segment ends between them; (part, seg) is their order. `faults` is read several times: give a stored table."""
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    fault = F.when(F.col("fault") == "", 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    order = [f(c) for f, c in _ORDER]
    coded = faults.select("conv_id", "turn", "hash", "copies", (initial + 4 * fault).cast("int").alias("code"))
    segments = materialise(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(most), _SEGMENT), "segments")
    several = segments.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).where("n > 1").select("c")
    long = segments.select("conv_id", "part", "seg", "codes").join(several, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    costs = long.mapInArrow(_sum_up, "conv_id long, part int, seg int, matrix array<long>").groupBy("conv_id").applyInPandas(_ends, "part int, seg int, costs array<long>, last boolean")
    asked = segments.join(costs, ["part", "seg"], "left").withColumn("last", F.coalesce("last", F.lit(True)))
    solved = materialise(asked.mapInArrow(_solve, "conv_id long, part int, seg int, turns array<long>, hashes array<binary>, copies array<long>, exits array<int>, edits array<array<string>>"), "ways")
    entries = solved.where(F.size("exits") > 1).select("conv_id", "part", "seg", "exits").groupBy("conv_id").applyInPandas(_entries, "part int, seg int, entry int")
    way = F.get("edits", F.coalesce("entry", F.lit(0)))
    rows = solved.join(entries, ["part", "seg"], "left").select("conv_id", "part", "seg", F.explode(F.arrays_zip("turns", "hashes", "copies", way.alias("way"))).alias("x"))
    return rows.select("conv_id", F.col("x.turns").alias("turn"), F.col("x.hashes").alias("hash"), "part", "seg", F.col("x.copies").alias("copies"), F.col("x.way").alias("edits"))


#: What a row of the merged stream is: a conversation that exists, edits, a text.
_MARK, _EDIT, _TEXT = 0, 1, 2


def _merged(rows: DataFrame, faults: DataFrame, plan: DataFrame, marks: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Edits and texts of each row next to each other, in order; with `whole` a conversation is in one partition."""
    keys = ("conv_id", "turn", "hash")
    edits = plan.join(faults.select(*[F.col(k).alias(f"f_{k}") for k in keys], "initial", "fault"), (F.col("hash") == F.col("f_hash")) & F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & F.col("turn").eqNullSafe(F.col("f_turn")))
    edits = edits.select(*keys, F.lit(_EDIT).alias("kind"), "part", "seg", "copies", "initial", "fault", "edits")
    texts = filled(rows).select("conv_id", "turn", _hash(F.col("role"), F.col("text")).alias("hash"), F.lit(_TEXT).alias("kind"), "role", "text")
    out = edits.unionByName(texts, allowMissingColumns=True)
    if marks is not None:
        out = out.unionByName(marks.select("conv_id", F.lit(_MARK).alias("kind")), allowMissingColumns=True)
    order = [f(c) for f, c in _ORDER]
    out = out.repartition("conv_id") if whole else out.repartitionByRange(*order)
    return out.sortWithinPartitions(*order, F.asc("kind"), F.asc("part"), F.asc("seg"))


def _turns(columns: dict, i: int, edits: list[int]) -> list[tuple[str, str]]:
    """Role and text of the turns that the rows of one (conv_id, turn, hash) become; its text is in row i."""
    out = []
    for j in edits:
        for e in columns["edits"][j]:
            if e == "K":
                out.append((columns["role"][i], columns["text"][i]))
            elif e in "UA":
                out.append(("user" if e == "U" else "assistant", columns["text"][i]))
            elif e in "ua":
                out.append(("user" if e == "u" else "assistant", ""))
    return out


_COLUMNS = ("conv_id", "turn", "hash", "kind", "copies", "initial", "fault", "edits", "role", "text")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, list[tuple], list[tuple[str, str]]]]:
    """conv_id, turn, (copies, initial, fault, edits) of each edit row, repaired turns: one for each unit, and one with
    neither edits nor turns for each mark."""
    waiting: list[tuple] = []
    previous = None
    for b in batches:
        for row in zip(*[b[c].to_pylist() for c in _COLUMNS], strict=True):
            conv, turn, hash_, kind, copies, initial, fault, edits, role, text = row
            if kind == _MARK:
                yield conv, None, [], []
            elif kind == _EDIT:
                waiting.append((copies, initial, fault, edits))
            elif previous != (conv, turn, hash_):
                previous = (conv, turn, hash_)
                columns = {"edits": [w[3] for w in waiting], "role": [role], "text": [text]}
                yield conv, turn, waiting, _turns(columns, 0, list(range(len(waiting))))
                waiting = []


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, place, out = TaskContext.get().partitionId(), 0, []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], ["conv_id", "part", "place", "role", "text"])

    size = 0
    for conv, _, _, turns in _units(batches):
        for role, text in turns:
            out.append((conv, part, place, role, text))
            place, size = place + 1, size + len(text) + 64
        if size > 1 << 22:
            yield batch()
            out, size = [], 0
    yield batch()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, part, place, role, text: the turns of the repaired conversations, in order of (part, place)."""
    faults = materialise(row_faults(rows), "faults")
    return _merged(rows, faults, edit_plan(faults)).mapInArrow(_repaired, "conv_id long, part int, place long, role string, text string")


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_AUDIT = str.maketrans("UAua", "RRII")


class _Report:
    """What is known of one conversation, row by row; only the audit grows with it."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.low, self.high, self.last_turn = conv, 0, None, None, None
        self.count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.cost, self.audit, self.sha, self.before, self.begun, self.unit = 0, 0, [], hashlib.sha256(), None, False, None

    def add(self, turn: int | None, edits: list[tuple], turns: list[tuple[str, str]]) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns, self.low, self.high, self.last_turn = self.turns + 1, turn if self.low is None else self.low, turn, turn
        for i, (copies, initial, fault, letters) in enumerate(edits):
            rest = copies - (i == 0)
            if fault:
                self.count[fault] += i == 0
            self.count["blank" if fault == "blank" else "duplicate"] += rest
            if self.before is not None:
                self.illegal += f"{self.before}{initial}" not in ("su", "ua", "au")
            self.illegal += copies - 1
            self.before = initial
            self.cost += sum({"D": DELETE, "U": REROLE, "A": REROLE, "u": INSERT, "a": INSERT}.get(e, 0) for e in letters)
            if fault == "truncated" and i == 0 and next(e for e in letters if e not in "ua") != "D":
                self.cost += TRUNCATED
            self.audit.append(letters.translate(_AUDIT))
        for role, text in turns:
            self.sha.update(("\n" * self.begun + f"{role}:{text}").encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k > 6 else pa.int64()) for k in range(9)], names)

    now, out = None, []
    for conv, turn, edits, turns in _units(batches):
        if now is None or conv != now.conv:
            if now is not None:
                out.append(now.row())
            now = _Report(conv)
        now.add(turn, edits, turns)
        if len(out) >= 5_000:
            yield batch(out)
            out = []
    yield batch([*out, *([now.row()] if now is not None else [])])


def report(rows: DataFrame, conversations: DataFrame | None = None, most: int = ROWS) -> DataFrame:
    """A row for each conversation of rows (and of `conversations`, which may have no rows left): its faults, the cost
    of the repair, the audit, and the hash of the repaired conversation. A hash takes its turns one after the other, so
    a conversation streams through one task here, holding no more than the audit."""
    faults = materialise(row_faults(rows), "faults")
    marks = (conversations if conversations is not None else rows).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return _merged(rows, faults, edit_plan(faults, most), marks, whole=True).mapInArrow(_reports, _REPORT)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a hash of conv_id and turn."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    hit = filled(rows).withColumn("hit", F.crc32(key) % 20).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damaged(rows), rows)


def op12_sql() -> str:
    """Row by row the cheapest (cost, audit, repaired) for each of the four states; the least of equal cost is the
    least audit, since no audit of a cost is the beginning of another of the same cost."""
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
    bare = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
    step = lambda s, cost, letter, turn: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + {cost}, 'audit': {s}.audit || '{letter}', 'out': {s}.out || [{turn}]}} END"
    drop = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + 2, 'audit': {s}.audit || 'D', 'out': {s}.out}} END"
    keep = lambda s, initial: f"CASE WHEN fault IN ('', 'truncated') AND initial = '{initial}' THEN {step(s, 'late', 'K', 'role || chr(58) || text')} END"
    give = lambda s, role: f"CASE WHEN fault IN ('', 'truncated') THEN {step(s, 'late + 1', 'R', repr(role + ':') + ' || text')} END"
    least = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"
    ins = lambda s, role: step(s, 5, "I", repr(role + ":"))
    rows = {
        "r0": least(drop("s0")),
        "r1": least(drop("s1"), keep("s0", "s")),
        "r2": least(drop("s2"), *[keep(f"s{i}", "u") for i in (0, 1, 3)], *[give(f"s{i}", "user") for i in (0, 1, 3)]),
        "r3": least(drop("s3"), keep("s2", "a"), give("s2", "assistant")),
    }
    close = lambda p: f"{p}0 AS s0, {p}1 AS s1, {least(f'{p}2', *[ins(f'{p}{i}', 'user') for i in (0, 1, 3)])} AS s2"
    return f"""
    WITH RECURSIVE crc AS (SELECT {table} AS t),
    filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    hit AS (SELECT f.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 20 AS hit FROM filled f, crc),
    damaged AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE hit <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair, {bare} AS bare FROM placed),
    faults AS (SELECT *, role[1] AS initial, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN bare[-1] IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault FROM seen),
    rows AS (SELECT *, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM faults),
    dp AS (
        SELECT conv_id, 0::BIGINT AS i, s0, s1, s2, {least('r3', ins('s2', 'assistant'))} AS s3
        FROM (SELECT conv_id, r3, {close('r')} FROM (SELECT DISTINCT conv_id, {{'cost': 0, 'audit': '', 'out': []::VARCHAR[]}} AS r0, NULL::STRUCT(cost INTEGER, audit VARCHAR, out VARCHAR[]) AS r1, r1 AS r2, r1 AS r3 FROM conversations))
        UNION ALL
        SELECT conv_id, i, s0, s1, s2, {least('r3', ins('s2', 'assistant'))} AS s3
        FROM (SELECT conv_id, i, r3, {close('r')} FROM (SELECT dp.conv_id, rows.i, {', '.join(f'{v} AS {k}' for k, v in rows.items())} FROM dp JOIN rows ON rows.conv_id IS NOT DISTINCT FROM dp.conv_id AND rows.i = dp.i + 1))
    ),
    done AS (SELECT conv_id, {least('s0', 's3')} AS s FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
    SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        s.cost::BIGINT AS cost, s.audit AS audit, sha256(array_to_string(s.out, chr(10))) AS repaired_sha256
    FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
    """
