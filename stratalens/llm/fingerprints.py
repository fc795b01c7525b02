"""Context-triggered piecewise hashing of texts.

A rolling hash over 7 bytes sets chunk boundaries where it is -1 modulo the block size; every
chunk gives one of 64 letters by its own hash. A fingerprint holds the letters at a block
size and at its double, "size:letters:letters", so texts whose sizes differ by a factor of
two can still be compared. The block size is the smallest 3 * 2^k that keeps the letters to
64; the last chunk is the rest of the text. Likeness is by edit distance between the letters
at a block size that both have: 1 - distance / (length of both together), where a changed
letter costs 2, so unrelated letters get about 0.2; 0 without a common block size, 1 for equal
fingerprints.

Null texts count as empty; an empty text has the fingerprint "3::" and is like only another
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, small_batches, stored

WINDOW, LETTERS, LEAST_BLOCK = 7, 64, 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_P, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_inverse = np.uint64(pow(int(_P), -1, 1 << 64))
_grown: list[np.ndarray] = [_powers(_P, 1 << 16), _powers(_inverse, 1 << 16)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _R
    return x ^ (x >> np.uint64(29))


def fingerprint(data: bytes) -> str:
    """The fingerprint of a byte string, in a few vectorised passes."""
    n = len(data)
    if not n:
        return "3::"
    if n + 1 > len(_grown[0]):
        _grown[0], _grown[1] = _powers(_P, 2 * n), _powers(_inverse, 2 * n)
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    # sums[i] = hash of the first i bytes; the hash of bytes i..j-1 is (sums[j] - sums[i]) / P^i
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(b * _grown[0][:n], out=sums[1:])
    roll = np.zeros(0, np.uint64)
    if n >= WINDOW:
        roll = _mix((sums[WINDOW:] - sums[:-WINDOW]) * _grown[1][: n - WINDOW + 1]) >> np.uint64(16)
    block = LEAST_BLOCK
    ends = np.flatnonzero(roll % np.uint64(block) == np.uint64(block - 1)) + WINDOW
    while len(ends) >= LETTERS:
        # a boundary of the double size is one of the size itself
        block *= 2
        ends = ends[roll[ends - WINDOW] % np.uint64(block) == np.uint64(block - 1)]
    double = ends[roll[ends - WINDOW] % np.uint64(2 * block) == np.uint64(2 * block - 1)]
    return f"{block}:{_letters(sums, ends, n)}:{_letters(sums, double, n)}"


def _letters(sums: np.ndarray, ends: np.ndarray, n: int) -> str:
    cuts = np.concatenate([[0], ends, [n]] if not len(ends) or ends[-1] != n else [[0], ends]).astype(np.int64)
    chunk = _mix((sums[cuts[1:]] - sums[cuts[:-1]]) * _grown[1][cuts[:-1]])
    return ALPHABET[(chunk >> np.uint64(40)).astype(np.int64) & 63].tobytes().decode()


def edit_distance(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distances (a change counts as a deletion and an insertion) of pairs of at most LETTERS letters, all pairs in one dynamic programme."""
    if not pairs:
        return np.zeros(0, np.int64)
    la, lb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    wa, wb = int(la.max()), int(lb.max())
    a, b = (np.frombuffer(b"".join(p[k].encode().ljust(w, b"\0") for p in pairs), np.uint8).reshape(len(pairs), w) if w else np.zeros((len(pairs), 0), np.uint8) for k, w in ((0, wa), (1, wb)))
    row = np.broadcast_to(np.arange(wb + 1, dtype=np.int16), (len(pairs), wb + 1)).copy()
    steps = np.arange(wb + 1, dtype=np.int16)
    out = np.where(la == 0, lb, 0)
    for i in range(wa):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + 2 * (b != a[:, i : i + 1]), row[:, 1:] + 1)
        # insertions: new[j] = min over k <= j of new[k] + j - k
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if (at := np.flatnonzero(la == i + 1)).size:
            out[at] = row[at, lb[at]]
    return out


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """Likeness in [0, 1] of pairs of fingerprints."""
    todo, owner, out = [], [], [0.0] * len(pairs)
    for k, (x, y) in enumerate(pairs):
        if x == y:
            out[k] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        for a, b in [(x1, y1), (x2, y2)] if bx == by else [(x2, y1)] if 2 * bx == by else [(x1, y2)] if bx == 2 * by else []:
            if a and b:
                todo.append((a, b))
                owner.append(k)
    for k, (a, b), d in zip(owner, todo, edit_distance(todo), strict=True):
        out[k] = max(out[k], 1.0 - float(d) / (len(a) + len(b)))
    return [min(x, 0.999) if p[0] != p[1] else x for x, p in zip(out, pairs, strict=True)]


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of a text column (null: of the empty text)."""

    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def of(s):
        return s.map(lambda x: fingerprint((x or "").encode("utf-8")))

    return df.withColumn(out, of(F.col(text)))


_FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SIDE = _SCHEMA + ", part long, first boolean, text string"


def _compared(rows: list[tuple[int | None, str, str]]) -> dict[str, list]:
    """rows: (doc_id, its text, the next text)."""
    prints: dict[str, str] = {}

    def of(text: str) -> str:
        if text not in prints:
            prints[text] = fingerprint(text.encode("utf-8"))
        return prints[text]

    edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, nxt in rows]
    own, after, new = [of(t) for _, t, _ in rows], [of(x) for _, _, x in rows], [fingerprint(e.encode("utf-8")) for e in edited]
    near = likeness([*zip(own, new, strict=True), *zip(own, after, strict=True)])
    return {"doc_id": [d for d, _, _ in rows], "n_chars": [len(t) for _, t, _ in rows], "edited_sha256": [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], "fingerprint": own, "edited_fingerprint": new, "near_edited": near[: len(rows)], "near_next": near[len(rows) :]}


def compare_neighbours(docs: DataFrame, batch: int = 512, chars: int = 4_000_000) -> DataFrame:
    """Fingerprints of every text, of the text edited by the next document's beginning, and the likenesses.

    "Next" is by ascending doc_id (null first, ties by a hash of the text), after the last the first.
    One range shuffle by both, so rows without an id or with the same one spread too; a task walks its sorted rows and holds two. The last row of a task lacks
    its successor: it and every task's first row (two rows a task) are matched afterwards.
    A single document is its own next. Rows are compared in batches of `batch`, or of `chars`
    characters if that is less.
    """

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, waiting, any_yet, size = TaskContext.get().partitionId(), None, [], False, 0

        def emit(rows, side=()):
            cols = _compared(rows)
            n = len(rows)
            arrays = [pa.array(cols[k] + [None] * len(side), v) for k, v in _FIELDS.items()]
            if side:
                arrays[0] = pa.array(cols["doc_id"] + [s[0] for s in side], pa.int64())
            arrays += [pa.array([None] * n + [part] * len(side), pa.int64()), pa.array([None] * n + [s[1] for s in side], pa.bool_()), pa.array([None] * n + [s[2] for s in side], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, [*_FIELDS, "part", "first", "text"])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                now = (doc_id.as_py(), text.as_py() or "")
                if held is not None:
                    waiting.append((*held, now[1]))
                    size += len(held[1])
                elif not any_yet:
                    any_yet = True
                    yield emit([], [(now[0], True, now[1])])
                held = now
                if len(waiting) >= batch or size >= chars:
                    yield emit(waiting)
                    waiting, size = [], 0
        if waiting:
            yield emit(waiting)
        if held is not None:
            yield emit([], [(held[0], False, held[1])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    done = stored(in_arrow(dealt, walk, _SIDE), "fingerprints")
    names = [*_FIELDS]
    # two rows a task: their window is as long as the list of tasks
    firsts = done.where("first").select("part", "text")
    order = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    nexts = order.join(firsts.select(F.col("part").alias("after"), F.col("text").alias("next")), "after").select("part", "next")
    ends = done.where("not first").select("part", "doc_id", "text").join(nexts, "part").select("doc_id", "text", "next")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = _compared(list(zip(*(c.to_pylist() for c in b.columns), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(cols[k], v) for k, v in _FIELDS.items()], names)

    return done.where("part is null").select(names).unionByName(in_arrow(ends, finish, _SCHEMA))
