"""Jaccard similarity join on word shingles by chosen paths (operator 2).

Sets are embedded as ``COORDS`` minwise tokens. A run splits the sets recursively: a node picks random coordinates, about 1 / threshold
of them, by a hash of its path, and each set follows its own tokens there, so that similar sets share a child about once and unlike
ones seldom do. A bucket of a few sets is compared by brute force; a larger one is split further; one that is still large at the last level
is taken as one candidate group. Runs repeat until a pair at the threshold is missed with probability under 1 - recall.
Candidates are joined into groups, and inside a group every pair is compared exactly on its whole shingle
sets, in blocks, so a group of any size is spread over tasks and no pair is emitted: tasks return link counts and
spanning links only. Rows with equal shingle sets are one set throughout and are never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernels as K
from tideline.llm.tables import near, stored

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDS = 64
#: Sets that one brute-force bucket or one block of the exact comparison holds.
SMALL = 48
BLOCK = 192
LEVELS = 3
#: Estimates from COORDS tokens spread by about 0.05 at the threshold; candidates reach four times lower.
SLACK = 0.2

_LOW = np.uint64((1 << 44) - 1)
_SEEDS = K.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_needed(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold is missed with probability ``1 - recall``: each run keeps it through
    ``levels`` rounds of a branching process with one expected child."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def signatures(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, key, sig, t): per row a digest of its set of shingles and minwise tokens (null for a text without words); ``t`` is the text where the id is null.

    Words are runs of non-whitespace with A-Z lower-cased. A text of fewer than ``words`` words is one shingle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys: list[bytes | None] = []
            sig = np.zeros((n, COORDS), np.uint32)
            for at, end, raw, offsets in K.slices(batch.column(1)):
                values, first = distinct(*K.shingles(K.lower_ascii(raw), offsets, words))
                keys += digests(values, first)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                with np.errstate(over="ignore"):
                    for k in range(COORDS):
                        x = (values ^ _SEEDS[k]) * np.uint64(0xD6E8FEB86659FD93)
                        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                        sig[at + some, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), first[:-1][some])
            sigs = [None if keys[i] is None else sig[i].tobytes() for i in range(n)]
            none = batch.column(0).is_null().to_pylist()
            texts = pa.array([t.as_py() if x else None for x, t in zip(none, batch.column(1))], pa.string()) if any(none) else pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), texts], names=["id", "key", "sig", "t"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(K.returned(run), f"id {kind}, key binary, sig binary, t string")


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, as 44-bit hashes (a slice holds fewer than 2**20 texts)."""
    keys = np.sort((K.owners(first).astype(np.uint64) << np.uint64(44)) | (values & _LOW))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys & _LOW, np.searchsorted((keys >> np.uint64(44)).astype(np.int64), np.arange(len(first)))


def digests(values: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each set, whatever the order of its values; null for an empty set."""
    size = np.diff(first)
    some = np.flatnonzero(size)
    out: list[bytes | None] = [None] * len(size)
    if len(some):
        keys = np.empty((len(some), 2), np.uint64)
        with np.errstate(over="ignore"):
            keys[:, 0] = np.add.reduceat(K.mix(values + np.uint64(1)), first[:-1][some])
            keys[:, 1] = np.add.reduceat(K.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[:-1][some])
        for i, k in zip(some.tolist(), keys):
            out[i] = k.tobytes()
    return out


def _paths(seed: int, runs: int, threshold: float):
    """mapInArrow body: (path, node, sig) -> (path, node) of the children a set follows. At the root ``path`` is null."""
    rate = np.uint64(int(min(1.0, 1 / (threshold * COORDS)) * (1 << 62)))
    coords = np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDS).astype(np.uint64)
                if batch.column(0).null_count:
                    roots = K.mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64(seed))
                    rows = np.repeat(np.arange(len(sig)), runs)
                    path = np.tile(roots, len(sig))
                else:
                    rows, path = np.arange(len(sig)), np.asarray(batch.column(0)).astype(np.uint64)
                for at in range(0, len(rows), 20_000):
                    r, p = rows[at : at + 20_000], path[at : at + 20_000]
                    picks = (K.mix(p[:, None] + coords[None, :]) >> np.uint64(2)) < rate
                    i, k = np.nonzero(picks)
                    child = K.mix(p[i] * np.uint64(0x9E3779B97F4A7C15) + coords[k] + (sig[r[i], k] << np.uint64(17)))
                    keys = batch.column(1).take(pa.array(r[i]))
                    yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), keys], names=["path", "node"])

    return run


def _brute(threshold: float):
    """mapInArrow body: small buckets (lists of sets) -> candidate links that span what is similar in each."""
    least = int(math.floor((threshold - SLACK) * COORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            keys = pc.struct_field(flat, "node")
            sig = np.frombuffer(b"".join(pc.struct_field(flat, "sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            start = np.concatenate([[0], np.cumsum(sizes)])
            left, right = [], []
            pair = np.flatnonzero(sizes == 2)
            a = start[:-1][pair]
            same = (sig[a] == sig[a + 1]).sum(axis=1) >= least
            left.append(a[same])
            right.append(a[same] + 1)
            for b in np.flatnonzero(sizes > 2).tolist():
                s = sig[start[b] : start[b + 1]]
                close = (s[:, None, :] == s[None, :, :]).sum(axis=2) >= least
                u, v = _forest(close)
                left.append(u + start[b])
                right.append(v + start[b])
            u, v = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
            yield pa.RecordBatch.from_arrays([keys.take(u), keys.take(v)], names=["u", "v"])

    return run


def _forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a symmetric relation, each from a tree's first member's side."""
    n = len(close)
    waiting = np.ones(n, bool)
    us, vs = [], []
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        edge = [root]
        while edge:
            x = edge.pop()
            found = np.flatnonzero(close[x] & waiting)
            waiting[found] = False
            us += [x] * len(found)
            vs += found.tolist()
            edge += found.tolist()
    return np.array(us, np.int64), np.array(vs, np.int64)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that links (u, v) connect a node with. Nodes without a link are absent.

    Alternating star contraction; each round is written tables, so a lost executor costs one round. It ends when every node
    is its component's least one or linked to that one only. No table of a round has many more rows than the links at its start.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(rounds):
        rows = now.count()
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        # written first, so that both sides of the join are plain exchanges and a hot node's rows can be split
        ends = both.groupBy("n").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.sum((F.col("m") < F.col("n")).cast("long")).alias("below"))
        least = stored(ends.select("n", F.least("lo", "n").alias("lo"), F.expr("below > 1 or (below = 1 and hi > n)").alias("open")), "least", rows)
        if least.where("open").isEmpty():
            return least.select(F.col("n").alias("node"), F.col("lo").alias("root"))
        # every node's larger neighbours go under its least neighbour
        large = stored(both.where("m > n").join(least.select("n", "lo"), "n").select(F.col("m").alias("u"), F.col("lo").alias("v")), "links", rows)
        # every node and its smaller neighbours go under the least of them
        root = stored(large.groupBy("u").agg(F.min("v").alias("lo")), "least", rows)
        small = large.join(root, "u").select(F.explode(F.array(F.struct("v", "lo"), F.struct(F.col("u").alias("v"), "lo"))).alias("e"))
        now = stored(small.select(F.col("e.v").alias("u"), F.col("e.lo").alias("v")).where("u <> v").distinct(), "links", rows)
    raise RuntimeError("components did not settle")


def candidates(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS, small: int = SMALL, seed: int = 1) -> DataFrame:
    """Candidate links (u, v) between nodes (64-bit numbers of sets), spanning what the runs found similar."""
    runs = runs_needed(recall, levels)
    # coordinates are drawn a little oftener than 1 / threshold, for the spread of the embedding
    split = _paths(seed, runs, threshold - 0.05)
    schema = "path bigint, node bigint"
    sigs = sets.select("node", "sig")
    front = sets.select(F.lit(None).cast("bigint").alias("path"), "node", "sig")
    links = []
    for level in range(levels):
        paths = stored(front.mapInArrow(split, schema), "paths")
        rows = paths.count()
        sizes = stored(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo")).where("n > 1"), "buckets", rows)
        few = paths.join(sizes.where(F.col("n") <= small).select("path"), "path").join(sigs, "node")
        lists = few.groupBy("path").agg(F.collect_list(F.struct("node", "sig")).alias("s")).select("s")  # at most ``small`` each
        links.append(stored(lists.mapInArrow(_brute(threshold), "u bigint, v bigint").distinct(), "found", rows))
        many = paths.join(sizes.where(F.col("n") > small).select("path", "lo"), "path")
        if level + 1 < levels:
            front = many.join(sigs, "node").select("path", "node", "sig")
        else:
            links.append(many.where("node <> lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct())
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _exact(threshold: float):
    """mapInArrow body over rows sorted by (root, i, j): exact comparison of two blocks of a group at a time.

    Emits (key, links, rows, u): for each set its new links and the rows they stand for, and a neighbour that keeps the tree spanned.
    """
    def solve(block: np.ndarray, own: tuple[int, int], keys: list[bytes], weight: np.ndarray, sets: list[np.ndarray]):
        n = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        often = np.bincount(column, minlength=len(values)) > 1
        good = often[column]
        column, row = (np.cumsum(often) - 1)[column[good]], row[good]
        width = int(often.sum())
        shared = np.zeros((n, n), np.float32)
        for at in range(0, width, 8192):
            part = (column >= at) & (column < at + 8192)
            dense = np.zeros((n, min(8192, width - at)), np.float32)
            dense[row[part], column[part] - at] = 1
            shared += dense @ dense.T
        union = size[:, None] + size[None, :] - shared
        close = shared >= threshold * union - 1e-6
        np.fill_diagonal(close, False)
        if own[0] != own[1]:
            close &= block[:, None] != block[None, :]
        count = close.sum(axis=1)
        copies = close.astype(np.int64) @ weight
        u, v = _forest(close)
        return count, copies, u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups(batches, ["root", "i", "j"]):
            if group.num_rows < 2:
                continue
            keys = group.column("key").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            weight = np.asarray(group.column("copies"))
            block = np.asarray(group.column("block"))
            own = (group.column("i")[0].as_py(), group.column("j")[0].as_py())
            count, copies, u, v = solve(block, own, keys, weight, sets)
            some = np.flatnonzero(count).tolist()
            near = {int(b): int(a) for a, b in zip(u, v)}
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in some], pa.binary()), pa.array(count[some].astype(np.int64)), pa.array(copies[some].astype(np.int64)),
                pa.array([keys[near[i]] if i in near else None for i in some], pa.binary()),
            ], names=["key", "links", "rows", "u"])

    return run


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal ``by`` in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_pylist() for c in by]
        rows = list(zip(*cols))
        at = 0
        for i in range(len(rows) + 1):
            if i < len(rows) and rows[i] == rows[at]:
                continue
            if last is not None and rows[at] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, i - at))
            last = rows[at]
            at = i
            if i == len(rows):
                break
    if last is not None:
        yield last, pa.Table.from_batches(held)


_MEMBER = ["key", "root", "parts", "block", "copies"]


def _gram_sets(words: int):
    """mapInArrow body: members with a text -> members with their shingles, where the text is the one the key was made from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, raw, offsets in K.slices(batch.column("t")):
                values, first = distinct(*K.shingles(K.lower_ascii(raw), offsets, words))
                part = batch.slice(at, end - at)
                good = [a == b for a, b in zip(part.column("key").to_pylist(), digests(values, first))]
                sets = [values[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                made = pa.RecordBatch.from_arrays([*(part.column(c) for c in _MEMBER), pa.array(sets, pa.binary())], names=[*_MEMBER, "grams"])
                yield made.filter(pa.array(good, pa.bool_()))

    return run


def similar(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, block: int = BLOCK, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """One row per input row: id, ``class_id``, ``n_links``, ``n_texts``, ``n_copies``.

    ``class_id`` is the smallest id of the rows that links of similarity ``threshold`` or more connect; ``n_links`` counts other rows at
    that similarity, rows with the same shingle set included (``n_copies`` of them); ``n_texts`` counts the other sets. Texts without a word
    link to nothing and are classes of their own (null class for a null id). Null ids join classes by their text but never name one.
    Repeated rows are copies of each other. An empty table gives an empty result; other columns are ignored.
    """
    rows = stored(signatures(df, id_col, text, words), "signatures")
    sets = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("t").alias("t"))
    sets = stored(sets.withColumn("node", F.xxhash64("key")), "sets")
    group = components(candidates(sets, threshold, recall, levels, small))
    size = group.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    member = (
        group.join(size, "root").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(sets.select("node", "key", "id", "copies", "t"), "node")
    )
    member = stored(member.select(*_MEMBER, "id", "t"), "members")
    texts = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    named = member.where("id is not null").drop("t")
    read = near(texts, named, ["id"])[0].join(named, "id").select(*_MEMBER, "t").unionByName(member.where("id is null").select(*_MEMBER, "t"))
    made = read.mapInArrow(_gram_sets(words), "key binary, root bigint, parts int, block int, copies bigint, grams binary")
    # an id that several rows have gives a set's text more than once
    grams = stored(made.groupBy(*_MEMBER).agg(F.first("grams").alias("grams")), "grams")
    pairs = grams.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("key", "root", "block", "copies", "grams", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    exact = stored(
        pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_exact(threshold), "key binary, links bigint, rows bigint, u binary"), "exact",
    )
    final = components(exact.where("u is not null").select("u", F.col("key").alias("v")))
    title = final.join(sets.select(F.col("key").alias("node"), "id"), "node")
    names = title.groupBy("root").agg(F.min("id").alias("class_id"))
    links = exact.groupBy("key").agg(F.sum("links").alias("n_texts"), F.sum("rows").alias("rows"))
    classes = stored(
        sets.select("key", "id", "copies").join(final.withColumnRenamed("node", "key"), "key", "left").join(names, "root", "left").join(links, "key", "left")
        .select("key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), (F.coalesce("rows", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies")), "classes",
    )
    out = rows.select("id", "key").join(classes, "key", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_texts", zero).alias("n_texts"), F.coalesce("n_copies", zero).alias("n_copies"),
    )
