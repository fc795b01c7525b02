"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Documents of equal shingle sets form a class; classes are joined. A class's signature holds
POSITIONS minwise tokens. A tree is a family of nodes: its root takes every class; a node picks
one of the positions by its own hash (a second one for some nodes, so that a similar pair is
split by chance but found by another branch), and classes with equal tokens there go to the same
child. A node of at most LIMIT classes is a leaf, whose classes are compared exhaustively, by
signature first and then on the full sets; a larger one branches on, DEPTH times at most. Nodes
that are still larger are compared block by block, so no size goes without an exact way. TREES
independent trees bring the recall of a pair at the threshold above 0.999.

Only the components of the links are wanted, so classes known to be in one component are not
compared with each other. A first pass over one tree, in chunks, unites the large groups of
copies, and a second one unites the chunks by their roots; what they cost follows the number of
classes, not of pairs. No pass emits pairs that are not verified links, and a task emits a
spanning forest of them.

Null texts and texts without words have an empty set and stand alone. Documents of one doc_id
are compared like others; a component's id is its least doc_id, null ones apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, settle, stored, stored_buckets, written

SHINGLE, PERCENT = 5, 85
POSITIONS, TREES, DEPTH, LIMIT = 64, 12, 4, 512
#: Words of more bytes are hashed one by one; the others by polynomials, which collide by design only on longer ones.
LONG = 512
#: Stands for a null doc_id; a class with any other id takes that.
NO_ID = 2**63 - 1

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_rng = np.random.default_rng(20_240_601)
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED, _TIMES = (_rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1) for _ in range(2))
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bytes whose prefix sums are taken at once.
CHUNK = 1 << 16
_up, _down = _powers(_P, CHUNK + LONG + 1), _powers(_INVERSE, CHUNK + LONG + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of a text's words in order, A-Z lower-cased: the same for a word wherever it stands."""
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(_SPACE[b].astype(np.int8), prepend=1, append=1)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(start), np.uint64)
    sums = np.zeros(CHUNK + LONG + 1, np.uint64)
    first = 0
    for at in range(0, len(b), CHUNK):
        last = int(np.searchsorted(start, at + CHUNK))
        if last > first:
            part = b[at : at + CHUNK + LONG]
            np.cumsum(_LOWER[part] * _up[: len(part)], out=sums[1 : len(part) + 1])
            i, j = start[first:last] - at, np.minimum(stop[first:last] - at, len(part))
            out[first:last] = (sums[j] - sums[i]) * _down[i]
            first = last
    out = _mix(out)
    for k in np.flatnonzero(stop - start > LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]].lower())
    return out


def shingle_set(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words than `size` make one shingle."""
    words = _word_hashes(data) if data else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return _mix(np.array([np.sum(words * _ODD[:n], dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = words[: n - size + 1] * _ODD[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * _ODD[k]
    return np.unique(_mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """POSITIONS minwise tokens (32 bits) of a set."""
    if not len(found):
        return np.zeros(POSITIONS, np.uint32)
    least = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1 << 13):
        part = found[None, i : i + (1 << 13)]
        np.minimum(least, ((part ^ _SEED) * _TIMES).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def second_pick(percent: int) -> int:
    """Chance in 256 that a node picks a second position: a pair at the threshold then meets in one child on average."""
    return round(256 * (100.3 / percent - 1))


def likely(percent: int) -> int:
    """Equal positions that a pair must have to be verified: 4.3 deviations below those expected at the threshold."""
    p = percent / 100
    return math.floor(POSITIONS * p - 4.3 * math.sqrt(POSITIONS * p * (1 - p)))


def children(nodes: np.ndarray, sigs: np.ndarray, second: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of every branch that rows in `nodes` with signatures `sigs` take; `second` of 256 nodes have two."""
    at = np.arange(len(nodes))
    pick = _mix(nodes)
    first = (pick % np.uint64(POSITIONS)).astype(np.int64)
    more = at[(pick >> np.uint64(40)) % np.uint64(256) < second]
    other = (first[more] + 1 + ((pick[more] >> np.uint64(20)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
    rows, position = np.concatenate([at, more]), np.concatenate([first, other])
    return rows, _mix(nodes[rows] * _ODD[9] + sigs[rows, position].astype(np.uint64) * _ODD[10] + position.astype(np.uint64) * _ODD[11])


def roots(trees: Iterable[int]) -> list[int]:
    return [int(_mix(np.array([t * 7919 + 17], np.uint64))[0]) for t in trees]


def shingle_rows(docs: DataFrame) -> DataFrame:
    """Per document: did, n, key (of the set), sig as bytes, and text, from which the set is made again: it compresses, the hashes don't."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                batch = big.slice(lo, 200)
                sets = [shingle_set(x.as_py() or b"") for x in batch.column(1)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary()), batch.column(1)], ["did", "n", "key", "sig", "text"])

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.col("text").cast("binary").alias("text"))
    return in_arrow(d, rows, "did long, n long, key binary, sig binary, text binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by task, cut where a task ends; a table holds whole tasks."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        task = rows["task"].to_numpy()
        cut = int(np.flatnonzero(task == task[-1])[0]) if len(task) else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _signatures(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(rows.num_rows, POSITIONS)


def _near_pairs(task: np.ndarray, comp: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs within tasks (sorted), between components: rows at distance 1, at distance 2, and so on."""
    least = likely(percent)
    for d in range(1, len(task)):
        i = np.flatnonzero(task[d:] == task[:-d])
        if not len(i):
            return
        i = i[comp[i] != comp[i + d]]
        i = i[100 * np.minimum(sizes[i], sizes[i + d]) >= percent * np.maximum(sizes[i], sizes[i + d])]
        if len(i) and len(i := i[(sigs[i] == sigs[i + d]).sum(axis=1) >= least]):
            yield i, i + d


def _candidates(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task with a likely partner in another component."""
    for rows in _groups(batches):
        comp = np.unique(np.array(rows["comp"].to_pylist(), dtype="S16"), return_inverse=True)[1]
        hit = np.zeros(rows.num_rows, bool)
        for i, j in _near_pairs(rows["task"].to_numpy(), comp, rows["n"].to_numpy(), _signatures(rows), percent):
            hit[i] = hit[j] = True
        yield from rows.select(["task", "key", "did", "comp"]).filter(pa.array(hit)).combine_chunks().to_batches()


def _links(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Verified links of tasks between components: (a, b), per task a spanning forest with b the least component of each tree."""
    for rows in _groups(batches):
        task, comps, keys = rows["task"].to_numpy(), rows["comp"].to_pylist(), rows["key"].to_pylist()
        numbered = np.unique(np.array(comps, dtype="S16"), return_inverse=True)[1]
        sets: dict[bytes, np.ndarray] = {}
        parent: dict[tuple[int, bytes], bytes] = {}

        def top(t, c):
            while (up := parent.get((t, c), c)) != c:
                c = up
            return c

        def full(i):
            if keys[i] not in sets:
                sets[keys[i]] = shingle_set(rows["text"][i].as_py() or b"")
            return sets[keys[i]]

        for first, second in _near_pairs(task, numbered, rows["n"].to_numpy(), _signatures(rows), percent):
            for i, j in zip(first.tolist(), second.tolist(), strict=True):
                t = int(task[i])
                a, b = top(t, comps[i]), top(t, comps[j])
                if a != b and _linked(full(i), full(j), percent):
                    parent[t, max(a, b)] = min(a, b)
        found = sorted({(c, top(t, c)) for t, c in parent})
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def _resolve(tasks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of tasks (task, key, did, n, sig, comp): a task's rows meet in one partition, many tasks to a batch.

    The candidates are dealt to the buckets of the table of texts, which stays where it is.
    """
    together = lambda d: d.repartition("task").sortWithinPartitions("task", "key")
    slim = together(tasks.select("task", "key", "did", "n", "sig", "comp"))
    few = stored(in_arrow(slim, lambda b: _candidates(b, percent), "task long, key binary, did long, comp binary"), "candidates")
    own = texts.join(few.hint("shuffle_hash"), ["key", "did"]).select("task", "key", "n", "sig", "text", "comp")
    return in_arrow(together(own), lambda b: _links(b, percent), "a binary, b binary")


def _branch(rows: DataFrame, own: str, second: int, trees: list[int] | None = None) -> DataFrame:
    """Rows (…, sig) with the children of their nodes: of the trees' roots, or of column node."""
    names = [c for c in own.split(", ") if not c.startswith("node ")]

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, POSITIONS)
            if trees is None:
                rows, nodes = children(batch.column("node").to_numpy().view(np.uint64), sigs, second)
            else:
                parts = [children(np.full(batch.num_rows, r, np.uint64), sigs, second) for r in trees]
                rows, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *(batch.column(c.split()[0]).take(take) for c in names)], ["node", *(c.split()[0] for c in names)])

    return in_arrow(rows, go, own)


_SLIM = "node long, key binary, comp binary"


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (node, key, comp) of nodes with several components, with the node's number of classes.

    Both sides of the join are written tables, so a node with many rows can be split over tasks.
    """
    rows = stored(rows, "branches")
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node", "size")
    return rows.join(stored(nodes, "sizes"), "node")


def _hash(*cols) -> F.Column:
    return F.xxhash64(*cols)


def components(links: DataFrame) -> DataFrame:
    """(a, b): every vertex of the links (a, b) but the least of its component, with that one. Alternates large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least neighbours are written, so that a vertex with many can be split over tasks
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        # large star: neighbours above the vertex go to its least neighbour
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "stars")
        # small star: neighbours below the vertex, and itself, go to the least of them
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = stored(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges
        seen = state


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, reps): every document's text and set's key, in buckets by key and did, and one row per distinct nonempty set: key, did (its least), n, sig."""
    texts = stored_buckets(shingle_rows(docs), "texts", ["key", "did"])
    reps = texts.where("n > 0").groupBy("key").agg(F.min("did").alias("did"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return texts, stored(reps, "reps")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document of (doc_id, text): doc_id, n_shingles, component_id, kept. Links are of Jaccard similarity percent / 100 or more."""
    second, spark, before = second_pick(percent), docs.sparkSession, written()
    texts, reps = classes_of(docs)
    with_sig = lambda rows: rows.join(reps.select("key", "did", "n", "sig"), "key")
    sized = lambda rows, mark: rows.withColumn("task", _hash("node", F.pmod(_hash("key"), F.ceil(F.col("size") / LIMIT)), F.lit(mark)))
    apply = lambda rows, links: rows.join(links.select(F.col("a").alias("comp"), "b"), "comp", "left").select("key", F.coalesce("b", "comp").alias("comp"))
    resolve = lambda tasks: stored(_resolve(with_sig(tasks), texts, percent), "links")

    # First pass: one tree, large nodes in chunks; a class is in one task, so the links are stars.
    comps = reps.select("key", F.col("key").alias("comp"))
    first = stored(_mixed(_branch(reps.withColumn("comp", F.col("key")), _SLIM, second, roots([0])).groupBy("key", "comp").agg(F.min("node").alias("node"))), "nodes")
    comps = stored(apply(comps, resolve(sized(first, 1))), "comps")
    settle(spark, before, texts, reps, comps, first)
    # Its roots, at the nodes that were cut into chunks.
    again = _mixed(first.where(f"size > {LIMIT}").select("node", "key").join(comps, "key").where("key = comp").select("node", "key", "comp"))
    comps = stored(apply(comps, resolve(sized(again, 2))), "comps")
    settle(spark, before, texts, reps, comps)

    # All trees, down to small nodes; then blocks of the nodes that stay large.
    rows = _branch(reps.select("key", "sig").join(comps, "key"), _SLIM, second, roots(range(TREES)))
    leaves = None
    for depth in range(1, DEPTH + 1):
        rows = stored(_mixed(rows.distinct()), "nodes")
        small = rows.where(f"size <= {LIMIT}").withColumn("task", _hash("node", F.lit(3)))
        leaves = small if leaves is None else leaves.unionByName(small)
        settle(spark, before, texts, reps, comps, leaves, rows)
        rows = rows.where(f"size > {LIMIT}")
        if depth < DEPTH:
            rows = _branch(rows.join(reps.select("key", "sig"), "key"), _SLIM, second)
    large = rows.withColumn("parts", F.ceil(F.col("size") / (LIMIT // 2)).cast("int")).withColumn("i", F.pmod(_hash("key"), F.col("parts")).cast("int"))
    large = large.withColumn("j", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("task", _hash("node", F.least("i", "j"), F.greatest("i", "j"), F.lit(4)))
    links = resolve(leaves.select("task", "key", "comp").unionByName(large.select("task", "key", "comp")))
    settle(spark, before, texts, reps, comps, links)
    found = components(links)
    comps = stored(apply(comps, found), "comps")
    settle(spark, before, texts, reps, comps)

    own = reps.select("key", F.nullif("did", F.lit(NO_ID)).alias("did")).join(comps, "key")
    least = own.groupBy("comp").agg(F.min("did").alias("component_id"))
    named = own.join(least, "comp").select("key", "component_id")
    # The same key for all copies of a text: a side of one row per class, and the other's large groups can be split.
    out = texts.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    id_ = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", id_.alias("component_id"), F.coalesce(F.col("doc_id") == id_, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that near_duplicates() keeps, with their columns; rows without doc_id stay, and of rows with a kept id each one."""
    kept = near_duplicates(docs, percent).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
