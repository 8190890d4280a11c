"""Quality rules as a short-circuit cascade (operator 7).

A rule reads measures of a text; measures differ widely in cost (counting bytes against finding
repeated five-word windows). On a sample every rule is timed and its rejections counted; the cascade then
runs the rule with the most rejections per second first, and a text that one rule rejects is not
measured for the next. The verdict is the same for every order, so a sample that misjudges costs time only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernels as K

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5
#: Texts that ``plan`` times, about: the documented bound of the sample.
SAMPLE_ROWS = 2000


class Texts:
    """Lazy measures of a slice of texts; parts already computed are shared between measures."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self._parts = raw, offsets, {}

    def part(self, name: str, make: Callable[[], object]):
        if name not in self._parts:
            self._parts[name] = make()
        return self._parts[name]

    @property
    def spans(self):
        return self.part("spans", lambda: K.word_spans(self.raw, self.offsets))

    def pick(self, rows: np.ndarray) -> Texts:
        """The texts at ``rows`` only."""
        if len(rows) == len(self.offsets) - 1:
            return self
        lengths = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[rows] - offsets[:-1], lengths)
        return Texts(self.raw[at], offsets)

    def count_bytes(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def n_words(t: Texts) -> np.ndarray:
    return np.diff(t.spans[2])


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words: bytes that are neither whitespace nor continuations."""
    return t.part("word_chars", lambda: t.count_bytes(~K.IS_SPACE[t.raw] & ((t.raw & 0xC0) != 0x80)))


def n_symbols(t: Texts) -> np.ndarray:
    return t.part("n_symbols", lambda: t.count_bytes(SYMBOLS[t.raw]))


def n_upper(t: Texts) -> np.ndarray:
    return t.count_bytes((t.raw >= 65) & (t.raw <= 90))


def n_letters(t: Texts) -> np.ndarray:
    return t.count_bytes(((t.raw | 32) >= 97) & ((t.raw | 32) <= 122))


def longest_word(t: Texts) -> np.ndarray:
    starts, ends, first = t.spans
    out = np.zeros(len(t.offsets) - 1, np.int64)
    some = first[1:] > first[:-1]
    if len(starts):
        out[some] = np.maximum.reduceat(ends - starts, first[:-1][some])
    return out


def n_dup_lines(t: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    out = np.zeros(len(t.offsets) - 1, np.int64)
    data = t.raw.tobytes()
    for i, (a, b) in enumerate(zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())):
        lines = data[a:b].split(b"\n")
        if len(lines) > 1:
            full = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            out[i] = len(full) - len(set(full))
    return out


def n_repeat_words(t: Texts) -> np.ndarray:
    """Words inside a five-word window that the text has twice or more."""
    def make():
        starts, ends, first = t.spans
        n = len(starts)
        grams = K.windows(K.span_hashes(t.raw, starts, ends), WINDOW)
        out = np.zeros(len(t.offsets) - 1, np.int64)
        if not len(grams):
            return out
        owner = K.owners(first)
        inside = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :])
        with np.errstate(over="ignore"):
            keys = K.mix(grams[inside] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(WINDOW):
            covered[inside[twice] + k] = True
        total = np.concatenate([[0], np.cumsum(covered)])
        return total[first[1:]] - total[first[:-1]]

    return t.part("n_repeat_words", make)


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_letters, longest_word)}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets one array per name in ``reads`` and returns true for texts to reject."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable[..., np.ndarray] = field(compare=False)


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 100 * s > 20 * n),
    Rule("shouting", ("n_upper", "n_letters"), lambda u, n: (n >= 40) & (100 * u > 70 * n)),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
    Rule("giant_word", ("longest_word",), lambda n: n > 1000),
    Rule("dup_lines", ("n_dup_lines", "n_words"), lambda d, n: 10 * d > np.maximum(n, 50)),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
)


def judge(t: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """Index of the first rule that rejects each text, -1 where none does."""
    out = np.full(len(t.offsets) - 1, -1, np.int64)
    left, texts = np.arange(len(out)), t
    for i, rule in enumerate(rules):
        if not len(left):
            break
        bad = rule.rejects(*(MEASURES[m](texts) for m in rule.reads))
        out[left[bad]] = i
        # survivors are copied only when enough fell out for the smaller slice to pay
        if bad.any():
            left = left[~bad]
            texts = texts.pick(np.flatnonzero(~bad))
    return out


def plan(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by falling rejections per second, measured in the tasks on a sample of about ``sample_rows`` texts.

    An empty table leaves the order as given. Ties keep the given order.
    """
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for _, _, raw, offsets in K.slices(batch.column(0)):
                seen += len(offsets) - 1
                for i, rule in enumerate(rules):
                    t = Texts(raw, offsets)
                    began = time.perf_counter()
                    hits[i] += int(rule.rejects(*(MEASURES[m](t) for m in rule.reads)).sum())
                    cost[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "cost": cost, "hits": hits, "seen": [seen] * len(rules)})

    texts = df.select(F.col(text).cast("string").alias("text"))
    sample = texts.sample(min(1.0, sample_rows / max(df.count(), 1)), seed=1)  # nothing is moved
    found = (
        sample.mapInArrow(probe, "rule bigint, cost double, hits bigint, seen bigint")
        .groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect()
    )
    rate = {r.rule: (r.hits / r.seen) / max(r.cost / r.seen, 1e-12) if r.seen else 0.0 for r in found}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate.get(i, 0.0), i))]


def apply_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, measures: Sequence[str] = (), order: Sequence[Rule] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, the asked ``measures`` (always of the whole text), ``rejected_by``, ``passed``, and the ``keep`` columns.

    Null and empty texts have no words; the rule ``few_words`` rejects them. Repeated rows and null ids are judged
    like any other row; other columns are ignored unless kept. An empty table gives an empty result.
    """
    order = list(order or plan(df, text, rules))
    names = [r.name for r in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {m: np.zeros(batch.num_rows, np.int64) for m in measures}
            verdict = np.full(batch.num_rows, -1, np.int64)
            for at, end, raw, offsets in K.slices(batch.column(1)):
                t = Texts(raw, offsets)
                for m in measures:
                    got[m][at:end] = MEASURES[m](t)
                verdict[at:end] = judge(t, order)
            by = pa.array([names[i] if i >= 0 else None for i in verdict.tolist()], pa.string())
            cols = [batch.column(0), *(pa.array(got[m]) for m in measures), by, pa.array(verdict < 0), *(batch.column(2 + i) for i in range(len(keep)))]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    picked = df.select(F.col(id_col).alias("c0"), F.col(text).cast("string").alias("c1"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    out = [id_col, *measures, "rejected_by", "passed", *keep]
    types = [picked.schema["c0"].dataType.simpleString(), *["bigint"] * len(measures), "string", "boolean", *(picked.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep)))]
    return picked.mapInArrow(K.returned(run), ", ".join(f"c{i} {t}" for i, t in enumerate(types))).toDF(*out)


def passing(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that every rule accepts, all columns unchanged; the text passes through the same tasks, so nothing is joined."""
    order = plan(df, text, rules)
    packed = df.select(F.lit(0).alias("n"), F.col(text).cast("string").alias("t"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for at, end, raw, offsets in K.slices(batch.column(1)):
                good[at:end] = judge(Texts(raw, offsets), order) < 0
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(kept.columns[2:], names=kept.schema.names[2:])

    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    return packed.mapInArrow(K.returned(run), schema).toDF(*df.columns)
