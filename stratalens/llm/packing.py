"""Packing by deficit round-robin over source queues.

Every source is a queue of token ids: its documents, each with the end id, one after another.
A window of `length` tokens is filled from the queues. In each window a queue's deficit grows
by its share of the window; queues are served by largest deficit, those under `least` tokens
wait and carry the deficit on, also beyond the task that reads the documents: the schedule is
one function of the sources' totals, and each piece finds its place in it by arithmetic.

The schedule repeats a cycle of `CYCLE` windows with whole quanta per source as long as every
source in it lasts; what is left (sources that ended, rounding) starts a new phase with new
shares, until less than a cycle is left. All ids are packed; only the last window is short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, join_small, stored
from .tokens import default_path, encoder

LENGTH, CYCLE, LEAST = 1024, 32, 128
#: Queues at most; more sources than that share queues by a hash of their names, so the schedule stays small.
QUEUES = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def apportion(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole numbers that sum to `total`, by largest remainder (ties: by name)."""
    whole = sum(shares.values())
    exact = {s: total * v / whole for s, v in shares.items()}
    out = {s: int(v) for s, v in exact.items()}
    for s in sorted(shares, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def cycle(quanta: dict[str, int], length: int = LENGTH, least: int = LEAST) -> dict[str, list[tuple[int, int, int]]]:
    """A cycle's service by source: (tokens of the source before, window, offset in the window) of each slot; windows are full but the last."""
    total, left, deficit = sum(quanta.values()), dict(quanta), dict.fromkeys(quanta, 0.0)
    slots: dict[str, list[tuple[int, int, int]]] = {s: [] for s in quanta}
    for w in range(-(-total // length)):
        room = min(length, total - w * length)
        size = room
        for s in quanta:
            deficit[s] += quanta[s] * size / total
        order = sorted((s for s in quanta if left[s]), key=lambda s: (-deficit[s], s))
        give = dict.fromkeys(order, 0)
        for s in order:  # those whose deficit is worth a slot, or their rest
            want = min(room, left[s], round(deficit[s]))
            if want >= min(least, left[s]):
                give[s], room = want, room - want
        for s in order:  # fill up: served ones first, on credit
            if not room:
                break
            if give[s] or not any(give.values()):
                more = min(room, left[s] - give[s])
                give[s], room = give[s] + more, room - more
        for s in order:
            more = min(room, left[s] - give[s])
            give[s], room = give[s] + more, room - more
        at = 0
        for s in order:
            if give[s]:
                slots[s].append((quanta[s] - left[s], w, at))
                at, left[s], deficit[s] = at + give[s], left[s] - give[s], deficit[s] - give[s]
    return slots


@dataclass
class Phase:
    """`turns` cycles over the sources' next tokens: from token `first[s]` of source s and from window `window`."""

    window: int
    turns: int
    windows: int
    quanta: dict[str, int]
    first: dict[str, int]
    slots: dict[str, list[tuple[int, int, int]]]
    cuts: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        self.cuts = {s: [x[0] for x in v] for s, v in self.slots.items()}


def schedule(totals: dict[str, int], target: dict[str, float] | None = None, length: int = LENGTH) -> list[Phase]:
    """Phases that serve all `totals`. target: weights by source (None: the sources' own shares); sources without one follow last."""
    left, done, window, phases = {s: v for s, v in totals.items() if v > 0}, dict.fromkeys(totals, 0), 0, []
    while left:
        total, size = sum(left.values()), CYCLE * length
        shares = {s: (target.get(s, 0.0) if target else left[s]) for s in left}
        shares = {s: v for s, v in shares.items() if v > 0} or dict(left)
        quanta = {s: q for s, q in apportion(size, shares).items() if q}
        turns = min(left[s] // q for s, q in quanta.items()) if total >= size else 0
        if not turns:  # less than a cycle of some source: its rest, with the others in proportion
            if total <= size or not target:
                quanta, turns = dict(left), 1
            else:
                k = min(left[s] / shares[s] for s in shares)
                rest = {s: min(left[s], int(k * shares[s])) for s in shares}
                s = min(shares, key=lambda s: (left[s] / shares[s], s))
                quanta, turns = {t: v for t, v in (rest | {s: left[s]}).items() if v}, 1
                if len(left) > len(quanta) or any(left[t] > v for t, v in quanta.items()):  # not the last phase: whole windows
                    for t in sorted(left, key=lambda t: (-(left[t] - quanta.get(t, 0)), t)):
                        add = min(-sum(quanta.values()) % length, left[t] - quanta.get(t, 0))
                        if add:
                            quanta[t] = quanta.get(t, 0) + add
        windows = -(-sum(quanta.values()) // length)
        phases.append(Phase(window, turns, windows, quanta, {s: done[s] for s in quanta}, cycle(quanta, length)))
        window += turns * windows
        for s, q in quanta.items():
            done[s] += turns * q
            left[s] -= turns * q
        left = {s: v for s, v in left.items() if v}
    return phases


def pieces(phases: list[Phase], source: str, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Where tokens at..at+n-1 of a source go: (tokens before within the range, length, window, offset)."""
    got = 0
    for p in phases:
        if got >= n:
            return
        q = p.quanta.get(source, 0)
        if not q:
            continue
        first, end = p.first[source], p.first[source] + p.turns * q
        cuts, slots = p.cuts[source], p.slots[source]
        while got < n and first <= at + got < end:
            turn, r = divmod(at + got - first, q)
            k = bisect_right(cuts, r) - 1
            before, w, offset = slots[k]
            size = min(n - got, (cuts[k + 1] if k + 1 < len(cuts) else q) - r)
            yield got, size, p.window + turn * p.windows + w, offset + r - before
            got += size


def token_rows(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Ids of every document, in place (no shuffle): doc_id, source, part, before (ids of its source before it in the task), n, ids."""
    path = tokenizer or default_path()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(enc.width, "little")
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                out, before, sources = [], [], batch.column(1).to_pylist()
                for source, text in zip(sources, batch.column(2), strict=True):
                    out.append(enc.encode(text.as_py() or "") + end)
                    before.append(seen.get(source, 0))
                    seen[source] = before[-1] + len(out[-1]) // enc.width
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "source": batch.column(1), "part": pa.array([part] * len(out), pa.int64()), "before": pa.array(before, pa.int64()), "n": pa.array([len(x) // enc.width for x in out], pa.int64()), "width": pa.array([enc.width] * len(out), pa.int32()), "ids": pa.array(out, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return in_arrow(rows, encode, "doc_id long, source string, part long, before long, n long, width int, ids binary")


def pack_documents(docs: DataFrame, length: int = LENGTH, target: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece of (doc_id, text, source): PIECES; every id, end ids included, is in exactly one piece.

    Null text: empty (only the end id). Null source: "". Null or repeated doc_id: rows are packed
    one by one and keep their doc_id. Empty table: no rows. Within a source documents follow one
    another as read. The token table is written once in the shared folder, so that the totals
    and the pieces see the same order; the driver holds one total per queue and one cycle. Up to
    QUEUES sources have a queue each, more share them (source is then the queue's name).
    """
    docs = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    if len(docs.select("source").distinct().limit(QUEUES + 1).take(QUEUES + 1)) > QUEUES:
        if target and len(target) >= QUEUES:
            raise ValueError(f"at most {QUEUES - 1} sources can have targets where more than {QUEUES} are packed")
        own = F.col("source").isin(*target) if target else F.lit(False)
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(QUEUES - len(target or ()))).cast("string"))
        docs = docs.withColumn("source", F.when(own, F.col("source")).otherwise(shared))
    rows = stored(token_rows(docs, tokenizer, end_id), "tokens")
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("v"))
    bases = sums.select("source", "part", F.coalesce(F.sum("v").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    phases = schedule({r.source: r.v for r in sums.groupBy("source").agg(F.sum("v").alias("v")).toLocalIterator()}, target, length)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                out: list[list] = [[] for _ in names]
                c = big.slice(lo, 500).to_pydict()
                for doc_id, source, at, n, width, ids in zip(c["doc_id"], c["source"], c["at"], c["n"], c["width"], c["ids"], strict=True):
                    wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                    for start, size, window, offset in pieces(phases, source, at, n):
                        for col, v in zip(out, (doc_id, start, size, zlib.crc32(wide[start : start + size]), n, window, offset, source), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "source" else pa.int64()) for k, v in zip(names, out, strict=True)], names)

    placed = join_small(rows, bases, ["source", "part"], "inner").select("doc_id", "source", (F.col("before") + F.col("base")).alias("at"), "n", "width", "ids")
    return in_arrow(placed, emit, PIECES)
