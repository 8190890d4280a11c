"""Language identification by rank-order profiles (operator 9).

A language's profile is its ``top`` most frequent character n-grams (1 to 3 letters, words padded by
blanks) in order; a document's distance to it is the sum, over the document's own most frequent n-grams, of how far
each lies out of place. Profiles come from counts over every training document; counting a text is a numpy
sort over a slice of an Arrow batch, so no n-gram rows leave a task before they are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernels as K

TOP = 300
SIZES = (1, 2, 3)
_LOW = np.uint64((1 << 44) - 1)
_ROWS = 1 << 18


def _class_table() -> np.ndarray:
    """Code point -> letter code after lower-casing; 0 for anything that is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0])
    return out


_cache: dict[str, np.ndarray] = {}


def letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter codes, byte position of each code point) of UTF-8 bytes; malformed bytes count as non-letters."""
    if "table" not in _cache:
        _cache["table"] = _class_table()
    head = np.flatnonzero((raw & 0xC0) != 0x80)
    b = raw.astype(np.uint32)
    at = lambda k: b[np.minimum(head + k, len(b) - 1)] & 0x3F if len(b) else b
    lead = b[head]
    code = lead.copy()
    two, three, four = (lead >= 0xC0) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0), lead >= 0xF0
    code[two] = (((lead & 0x1F) << 6) | at(1))[two]
    if three.any():
        code[three] = (((lead & 0x0F) << 12) | (at(1) << 6) | at(2))[three]
    if four.any():
        code[four] = (((lead & 0x07) << 18) | (at(1) << 12) | (at(2) << 6) | at(3))[four]
    return _cache["table"][np.minimum(code, 0x10FFFF)], head


def grams(raw: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 44-bit n-gram code, letters per text): n-grams over letters with runs of others as one blank."""
    codes, head = letters(raw)
    first = np.searchsorted(head, offsets)
    owner = K.owners(first)
    is_letter = codes > 0
    n_letters = np.bincount(owner[is_letter], minlength=len(offsets) - 1)
    # keep letters and the first non-letter after one, per text; a text's own edge is a blank too
    border = np.zeros(len(codes), bool)
    border[first[:-1][first[:-1] < len(codes)]] = True
    after = np.concatenate([[False], is_letter[:-1]])
    keep = is_letter | (after & ~border)
    codes, owner = codes[keep], owner[keep]
    # a blank in front of every text and behind it
    texts = np.flatnonzero(n_letters)
    at = np.searchsorted(owner, texts)
    codes = np.insert(codes, at, 0).astype(np.uint64)
    owner = np.insert(owner, at, texts)
    out_t, out_c = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        same = owner[: len(codes) - n + 1] == owner[n - 1 :]
        span = K.windows(codes + np.uint64(7 * n), n)
        solid = codes[: len(span)] > 0
        for k in range(1, n):
            solid |= codes[k : k + len(span)] > 0
        good = same & solid
        out_t.append(owner[: len(span)][good])
        out_c.append(span[good] & _LOW)
    if not out_t:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), n_letters
    return np.concatenate(out_t), np.concatenate(out_c), n_letters


def counted(texts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, count), sorted by text and code. Texts are numbered below 2**20."""
    keys = np.sort((texts.astype(np.uint64) << np.uint64(44)) | codes)
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(keys)]]))
    return (keys[at] >> np.uint64(44)).astype(np.int64), keys[at] & _LOW, counts


def ranked(texts: np.ndarray, codes: np.ndarray, counts: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, rank) of each text's ``top`` n-grams; equal counts rank by code."""
    if not len(texts):
        return texts, codes, counts
    # counts so low that a text has ``top`` others above them need no sorting
    steps = 64
    low = np.minimum(counts, steps - 1)
    per = np.bincount(texts * steps + low, minlength=(int(texts[-1]) + 1) * steps).reshape(-1, steps)
    above = np.cumsum(per[:, ::-1], axis=1)[:, ::-1]
    least = np.maximum((above >= top).sum(axis=1) - 1, 0)
    good = low >= least[texts]
    texts, codes, counts = texts[good], codes[good], counts[good]
    # already in order of text and code, so a stable sort by falling count leaves ties in order of code
    order = np.argsort((texts << 40) - counts, kind="stable")
    t, c = texts[order], codes[order]
    start = np.searchsorted(t, np.arange(int(t[-1]) + 2))
    rank = np.arange(len(t)) - start[t]
    good = rank < top
    return t[good], c[good], rank[good]


def profiles(df: DataFrame, lang: str = "lang", text: str = "text", where: Column | None = None, top: int = TOP) -> dict[str, np.ndarray]:
    """Language -> its ``top`` n-gram codes, most frequent first, counted over every row with a language.

    The result is bounded by the number of languages times ``top``.
    """
    rows = df.where(F.col(lang).isNotNull())
    if where is not None:
        rows = rows.where(where)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            known = sorted(set(names))
            number = {v: i for i, v in enumerate(known)}
            which = np.array([number[v] for v in names], np.int64)
            parts = []
            for at, end, raw, offsets in K.slices(batch.column(1)):
                t, c, _ = grams(raw, offsets)
                parts.append(counted(which[at:end][t], c))
            if not parts:
                continue
            t, c, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((c, t))
            t, c, n = t[order], c[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])) if len(t) else np.zeros(0, np.int64)
            n = np.add.reduceat(n, new) if len(new) else n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([known[i] for i in t[new].tolist()], pa.string()), "code": pa.array(c[new].astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    totals = (
        rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
        .mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    best = _top(totals, top)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        found.setdefault(r.lang, []).append((-r.n, r.code))
    return {k: np.array([c for _, c in sorted(v)[:top]], np.uint64) for k, v in sorted(found.items())}


def _top(totals: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each language: ranked inside hash parts first, so that no task sorts a whole language."""
    from pyspark.sql import Window

    part = Window.partitionBy("lang", F.pmod("code", F.lit(64))).orderBy(F.desc("n"), "code")
    few = totals.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top)
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= top).select("lang", "code", "n")


def identify(df: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` and ``distance``.

    ``score`` is 1 less the mean displacement as a share of the largest possible one. A null text or one without letters,
    and any text when nothing was learned, gives ``und`` with score 0. Equal distances go to the first language by name.
    Repeated rows and null ids are predicted like any other row; other columns are ignored.
    """
    names = sorted(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.uint64)]).astype(np.uint64))
        place = np.full((len(names), len(known) + 1), -1, np.int64)
        for i, name in enumerate(names):
            place[i, np.searchsorted(known, learned[name])] = np.arange(len(learned[name]))
        for batch in batches:
            pred = np.full(batch.num_rows, -1, np.int64)
            score = np.zeros(batch.num_rows)
            dist = np.zeros(batch.num_rows, np.int64)
            for at, end, raw, offsets in K.slices(batch.column(1)):
                t, c, n_letters = grams(raw, offsets)
                t, c, rank = ranked(*counted(t, c), top)
                n = end - at
                size = np.bincount(t, minlength=n)
                if not names:
                    continue
                where = np.searchsorted(known, c)
                where[(where >= len(known)) | (known[np.minimum(where, len(known) - 1)] != c)] = len(known)
                sums = np.empty((len(names), n), np.int64)
                for i in range(len(names)):
                    p = place[i, where]
                    sums[i] = np.bincount(t, np.where(p < 0, top, np.abs(p - rank)), n).astype(np.int64)
                best = np.argmin(sums, axis=0)
                good = n_letters > 0
                d = sums[best, np.arange(n)]
                pred[at:end] = np.where(good, best, -1)
                dist[at:end] = np.where(good, d, 0)
                score[at:end] = np.where(good, 1 - d / np.maximum(size * top, 1), 0.0)
            cols = [batch.column(0), pa.array([names[i] if i >= 0 else "und" for i in pred.tolist()], pa.string()), pa.array(score), pa.array(dist)]
            yield pa.RecordBatch.from_arrays(cols, names=["c0", "lang_pred", "score", "distance"])

    picked = df.select(F.col(id_col).alias("c0"), F.col(text).cast("string").alias("c1"))
    kind = picked.schema["c0"].dataType.simpleString()
    return picked.mapInArrow(run, f"c0 {kind}, lang_pred string, score double, distance bigint").withColumnRenamed("c0", id_col)
