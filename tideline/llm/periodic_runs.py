"""Periodic runs of words by descending common prefixes (operator 12).

The suffixes of a document's words are sorted, and neighbours in that order are united by decreasing length of their common prefix, as Kruskal's
algorithm takes edges by weight. A class keeps its positions in order; when two classes meet at prefix length L, positions i < j that become neighbours
in the united order repeat each other over exactly L words, and if j - i is within L they lie in a run of period j - i that ends at j + L. Positions whose
preceding words are equal too were met at L + 1 already, so every run is seeded once, at its first word, and by its smallest period.

Runs below the least length and exponent need no prefix shorter than ``reach`` words, so only documents in which a passage of that many words
occurs twice are sorted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words and holds its period at least so often.
LEAST_WORDS, LEAST_TURNS = 24, 3


def reach(least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> int:
    """The shortest prefix that the first words of two neighbouring turns of a run can share."""
    return min(max(least, turns * q) - q for q in range(1, least + 1))


def words_of(text: str | None) -> list[bytes]:
    """Words parted by blanks and the ASCII controls 0x09-0x0D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers from 1."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64)


def doubled(rank: np.ndarray, span: int) -> np.ndarray:
    """Ranks of passages of 2 * ``span`` words from those of ``span``; passages that the end cuts short sort before longer ones."""
    n = len(rank)
    key = rank * (n + 1)
    if span < n:
        key[: n - span] += rank[span:]
    return np.unique(key, return_inverse=True)[1].reshape(-1) + 1


def repeats(ids: np.ndarray, words: int) -> bool:
    """Whether some passage of ``words`` words, or of the power of two below, occurs twice."""
    rank, span = ids, 1
    while span * 2 <= words:
        whole = len(ids) - 2 * span + 1
        if whole < 2:
            return False
        rank = doubled(rank, span)
        span *= 2
        if np.bincount(rank[:whole]).max() < 2:
            return False
    return True


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before it (0 for the first)."""
    n = len(ids)
    rank, span = np.unique(ids, return_inverse=True)[1].reshape(-1) + 1, 1
    levels = [rank.astype(np.int32)]
    while rank.max() < n:
        rank = doubled(rank, span)
        levels.append(rank.astype(np.int32))
        span *= 2
    order = np.empty(n, np.int64)
    order[rank - 1] = np.arange(n)
    i, j = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        rank = levels[k]
        # equal ranks of passages that the end cuts short do not occur: their lengths differ
        inside = np.flatnonzero(np.maximum(i, j) + size <= n)
        same = inside[rank[i[inside]] == rank[j[inside]]]
        shared[same + 1] += size
        i[same] += size
        j[same] += size
    return order, shared


def runs(ids: np.ndarray, least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ``turns`` is 3 or more."""
    shortest = reach(least, turns)
    if len(ids) < least or not repeats(ids, shortest):
        return []
    order, shared = sorted_suffixes(ids)
    edges = np.flatnonzero(shared >= shortest)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    # a class is a stretch of the order; its two ends know its number
    members: dict[int, list[int]] = {}
    out: list[tuple[int, int, int]] = []
    words = ids.tolist()
    suffix = order.tolist()
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, root)
        return root

    def seed(i: int, j: int, common: int) -> None:
        period = j - i
        if period <= common and (i == 0 or words[i - 1] != words[j - 1]) and period + common >= max(least, turns * period):
            out.append((i, period + common, period))

    for e, common in zip(edges.tolist(), shared[edges].tolist()):
        a, b = find(e - 1), find(e)
        few = members.pop(a, None) or [suffix[a]]
        many = members.pop(b, None) or [suffix[b]]
        if len(few) > len(many):
            few, many = many, few
        places = [bisect_left(many, x) for x in few]
        for k, (x, p) in enumerate(zip(few, places)):
            # only the outer ones of several that fall between two positions get a new neighbour
            if p and (k == 0 or places[k - 1] < p):
                seed(many[p - 1], x, common)
            if p < len(many) and (k + 1 == len(few) or places[k + 1] > p):
                seed(x, many[p], common)
        if len(few) * 16 < len(many):
            for x, p in zip(reversed(few), reversed(places)):
                many.insert(p, x)
        else:
            many = sorted(many + few)
        up[a] = b
        members[b] = many
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def wound(words: list[bytes], mark: int) -> list[bytes]:
    """The words with those behind a place repeated in turns; place, period and turns follow from ``mark``."""
    n = len(words)
    a = mark % n
    p = 1 + (n - a) // (3 + mark % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_DIGEST = "id string, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def detect(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> DataFrame:
    """``df`` with ``runs``: an array of (start, length, period) by start, then period, and ``collapsed``: the words that no run repeats, joined by blanks.

    Every row is searched whole and by itself; nothing is shuffled. Null and empty texts have no runs and collapse to an empty text. Null and repeated ids and repeated
    rows change nothing. Columns named ``runs`` or ``collapsed`` are replaced. A document of n words takes about n log n steps and 4 n log n bytes.
    """
    kept = [c for c in df.columns if c not in ("runs", "collapsed")]
    packed = df.select(F.col(text).cast("string").alias("t"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found, left = [], []
            for t in batch.column(0):
                words = words_of(t.as_py())
                some = runs(numbered(words), least, turns)
                keep = kept_words(len(words), some)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in some])
                left.append(b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, made), pa.array(left, pa.string())], names=[*batch.schema.names[1:], "runs", "collapsed"])

    schema = ", ".join([*(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"])
    return packed.mapInArrow(run, schema).toDF(*kept, "runs", "collapsed")


def digests(df: DataFrame, id_col: str = "doc_id", text: str = "text", mark: bool = True, least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> DataFrame:
    """One row per input row: id, number of runs, the strongest run, hashes of all runs and of the collapsed words.

    With ``mark``, documents whose id's crc32 ends in 0 are wound first (a null id never is). Other rules are those of ``detect``; texts stay in their task.
    """
    kind = df.schema[id_col].dataType.simpleString()
    packed = df.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, t in zip(batch.column(1), batch.column(2)):
                words = words_of(t.as_py())
                code = crc32(name.as_py().encode()) if mark and name.is_valid else 1
                if code % 10 == 0 and words:
                    words = wound(words, code // 10)
                some = runs(numbered(words), least, turns)
                best = strongest(some) or (None, None, None)
                if some:
                    words = [w for w, k in zip(words, kept_words(len(words), some)) if k]
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in some)
                milli = None if best[0] is None else 1000 * best[1] // best[2]
                rows.append((len(some), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return packed.mapInArrow(run, _DIGEST.replace("id string", f"id {kind}")).withColumnRenamed("id", id_col)
