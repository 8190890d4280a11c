"""Toxicity behind a noisy channel (operator 4).

Writers hide words by look-alike signs (``1d10t``), spacing (``i d i o t``), inserted marks and repetition. A token
that may hide one becomes a character lattice: each sign stands for itself, for letters it resembles or for nothing,
and a run of one letter for one or two of it, each at a channel cost. Viterbi decoding under a character trigram model
restores the likeliest word. The model's counts come from every training document. Restored words and their
beginnings are then scored by how much oftener labelled toxic documents have them than clean ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernels as K
from tideline.llm.tables import stored

#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Natural-log costs of the channel: a look-alike, an inserted mark, an inserted look-alike.
SIGN_COST, DROP_COST, WASTE_COST = 0.7, 0.3, 8.0
#: A pair of letters is mostly meant, a longer run mostly is not.
PAIR_COST, RUN_COST = 1.0, 0.2
#: Labelled rows of a class the scorer is fitted on, about; more are thinned by a hash of the text.
LABELLED_ROWS = 20_000
#: The least P(toxic | text has it) that counts, of a word and of a beginning, which clean words may share; weaker evidence would add up over long texts.
STRONG, STRONG_PREFIX = 0.85, 0.93
PREFIXES = (4, 5, 6, 7)
#: Toxic texts that must have a word or beginning before it is evidence, and the pseudo count (Jeffreys' prior) of clean texts that have it: a word of no clean
#: text that five toxic ones hold passes, also where a language has few of them.
SUPPORT, PSEUDO = 5, 0.5
MEMORY = 600_000
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_EDGE = re.compile(r"^[\W_]*[\"'«»().,;:?\[\]{}*%&#]+(?=\w)|(?:[.,;:?!\"'*%&#)\]}»]+|\$\$\$+)+$")
_RUN = re.compile(r"(.)\1")


@dataclass
class CharModel:
    """Trigram counts over the letters; ``^`` opens and ``$`` closes a word."""

    counts: dict[str, int]
    pairs: dict[str, int] = field(default_factory=dict)
    alphabet: frozenset[str] = frozenset()
    _cost: dict[tuple[str, str, str], float] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[str, int]) -> CharModel:
        pairs: Counter[str] = Counter()
        for gram, n in counts.items():
            pairs[gram[:2]] += n
        return cls(counts, dict(pairs), frozenset(g[2] for g in counts) - {"$"})

    def cost(self, a: str, b: str, c: str) -> float:
        """-ln P(c | a, b), add-0.1 smoothed over the alphabet."""
        known = self._cost.get((a, b, c))
        if known is None:
            size = len(self.alphabet) + 1
            known = -math.log((self.counts.get(a + b + c, 0) + 0.1) / (self.pairs.get(a + b, 0) + 0.1 * size))
            self._cost[a, b, c] = known
        return known


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per sign, what it may emit and at which cost. A run of one letter becomes one step."""
    steps: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c, n = token[at], 1
        while at + n < len(token) and token[at + n] == c:
            n += 1
        once, twice = (PAIR_COST if n == 2 else RUN_COST if n > 2 else 0.0), RUN_COST * (n > 2)
        if c.isalpha():
            options = [(c, once)]
            if n > 1:
                options.append((c + c, twice))
        else:
            options = [("", WASTE_COST if c in LOOKALIKES else DROP_COST)]
            for letter in LOOKALIKES.get(c, ""):
                options.append((letter, SIGN_COST + once))
                if n > 1:
                    options.append((letter + letter, SIGN_COST + twice))
        steps.append(options)
        at += n
    return steps


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind ``token``: Viterbi over (the last two letters), one back pointer per step and state."""
    live: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    for options in lattice(token):
        after: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in live.items():
            for out, extra in options:
                total, last = cost + extra, state
                for c in out:
                    total += model.cost(last[0], last[1], c)
                    last = last[1] + c
                if last not in after or total < after[last][0]:
                    after[last] = (total, (path, out) if out else path)
        live = after
    best = min(live.items(), key=lambda kv: (kv[1][0] + model.cost(kv[0][0], kv[0][1], "$"), kv[0]))
    parts, path = [], best[1][1]
    while path:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))


def restore(token: str, model: CharModel) -> str:
    """A lower-case token's word: plain tokens without repeated neighbours lose edge marks only, others are decoded."""
    word = _EDGE.sub("", token)
    if word.isalpha() and not _RUN.search(word):
        return word
    signs = sum(1 for c in word if c.isalpha() or c in LOOKALIKES)
    if not any(c.isalpha() for c in word) and signs < 3:
        return word
    return decode(word, model)


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens, runs of three or more single signs joined as further ones."""
    low = text.lower()
    return {*low.split(), *("".join(m.split(" ")) for m in _SPACED.findall(low))}


def restored_text(text: str, model: CharModel) -> str:
    """``text`` with hidden words restored; line ends stay."""
    def line(x: str) -> str:
        x = _SPACED.sub(lambda m: m.group().replace(" ", ""), x.lower())
        return " ".join(restore(t, model) for t in x.split())

    return "\n".join(line(x) for x in text.split("\n"))


def features(word: str) -> list[str]:
    """The word and its beginnings (marked by a trailing ``-``)."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def learn_chars(df: DataFrame, text: str = "text") -> CharModel:
    """Character trigrams of all alphabetic words of ``df``, of every script; their number follows the alphabets in use, not the rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            for t in batch.column(0):
                if (s := t.as_py()) is not None:
                    words.update(s.lower().split())
            plain = [(w, n) for w, n in words.items() if w.isalpha()]
            if not plain:
                continue
            flat = np.frombuffer("".join(f"^^{w}$" for w, _ in plain).encode("utf-32-le"), np.uint32).astype(np.uint64)
            times = np.repeat([n for _, n in plain], [len(w) + 3 for w, _ in plain])[2:]
            codes = (flat[:-2] << np.uint64(42)) | (flat[1:-1] << np.uint64(21)) | flat[2:]
            inside = (flat[2:] != ord("^")) & (flat[1:-1] != ord("$")) & (flat[:-2] != ord("$"))
            codes, at = np.unique(codes[inside], return_inverse=True)
            total = np.bincount(at, times[inside], len(codes)).astype(np.int64)
            mask = (1 << 21) - 1
            grams = [chr(c >> 42) + chr(c >> 21 & mask) + chr(c & mask) for c in codes.tolist()]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams, pa.string()), "n": pa.array(total)})

    grams = df.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel.of({r.gram: r.n for r in grams.collect()})


def labelled(labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", rows: int = LABELLED_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(id, y) of about ``rows`` labelled rows of each class, thinned by a hash of the id, and the classes' sizes before it."""
    base = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    sizes = {r.y: r.n for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.when(F.col("y") == 1, min(1.0, rows / sizes.get(1, 1))).otherwise(min(1.0, rows / sizes.get(0, 1)))
    return base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * (1 << 30)), sizes


def learn_evidence(df: DataFrame, labels: DataFrame, chars: CharModel, id_col: str = "doc_id", label: str = "toxic", text: str = "text", rows: int = LABELLED_ROWS) -> dict[str, float]:
    """Feature -> P(toxic | a text has it), for features that point to toxic texts; from about ``rows`` labelled rows of a class, near copies mostly counted once.

    There is at most one feature for ``SUPPORT`` words of those rows, so ``rows`` bounds the result.
    """
    some, sizes = labelled(labels, id_col, label, rows)
    if not sizes.get(1) or not sizes.get(0):
        return {}
    texts = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).where("t is not null")
    fit = texts.join(F.broadcast(some), "id")  # at most about 2 * rows rows of two numbers

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, np.int64)
            for at, end, raw, offsets in K.slices(batch.column(1)):
                values, first = K.shingles(raw, offsets, 5)
                has = np.flatnonzero(np.diff(first))
                if len(has):
                    h[at + has] = np.minimum.reduceat(values, first[:-1][has]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], names=["y", "t", "h"])

    # near copies mostly share their least shingle: they count once in their class, or a copied text would make evidence of all its words
    with_mark = fit.select("y", "t").mapInArrow(marked, "y int, t string, h bigint")
    once = stored(with_mark.groupBy("y", "h").agg(F.min("t").alias("t")).select("y", "t"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[str]] = {}
        for batch in batches:
            seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {""}  # counts the texts
                for w in tokens(t.as_py()):
                    known = memory.get(w)
                    if known is None:
                        known = features(restore(w, chars))
                        if len(memory) > MEMORY // 4:
                            memory.clear()
                        memory[w] = known
                    found.update(known)
                seen[y].update(found)
            every = list({**seen[0], **seen[1]})
            yield pa.RecordBatch.from_pydict({"f": pa.array(every, pa.string()), "good": pa.array([seen[0][f] for f in every], pa.int64()), "bad": pa.array([seen[1][f] for f in every], pa.int64())})

    totals = stored(once.mapInArrow(count, "f string, good bigint, bad bigint").groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "evidence")
    n = totals.where("f = ''").first()
    if n is None or not n.bad or not n.good:
        return {}
    prior = sizes[1] / (sizes[0] + sizes[1])
    for_it = F.lit(prior) * F.col("bad") / n.bad
    against = F.lit(1 - prior) * (F.col("good") + PSEUDO) / (n.good + 2 * PSEUDO)
    strong = totals.where((F.col("f") != "") & (F.col("bad") >= SUPPORT)).withColumn("p", for_it / (for_it + against))
    strong = strong.where(F.col("p") >= F.when(F.col("f").endswith("-"), STRONG_PREFIX).otherwise(STRONG))
    return {r.f: r.p for r in strong.select("f", "p").collect()}


def score(df: DataFrame, chars: CharModel, evidence: dict[str, float], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1), ``n_evidence`` distinct toxic words, ``strongest`` restored word.

    Scores combine the distinct words' probabilities as independent causes. Null and empty texts score 0. Repeated rows and null
    ids are scored like any other; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast((chars, evidence))  # bounded by the alphabets in use and the labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = sent.value
        memory: dict[str, tuple[float, str] | None] = {}

        def weigh(token: str) -> tuple[float, str] | None:
            word = restore(token, model)
            p = max((weights.get(f, 0.0) for f in features(word)), default=0.0)
            if len(memory) >= MEMORY:
                memory.clear()
            memory[token] = out = (p, word) if p else None
            return out

        for batch in batches:
            scores, counts, words = [], [], []
            for t in batch.column(1):
                clean, found = 1.0, {}
                for token in tokens(t.as_py() or ""):
                    known = memory[token] if token in memory else weigh(token)
                    if known is not None:
                        found[known[1]] = known[0]
                for word in sorted(found):
                    clean *= 1 - found[word]
                scores.append(1 - clean)
                counts.append(len(found))
                words.append(min(found, key=lambda w: (-found[w], w)) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(words, pa.string())], names=["c0", "score", "n_evidence", "strongest"])

    picked = df.select(F.col(id_col).alias("c0"), F.col(text).cast("string").alias("c1"))
    kind = picked.schema["c0"].dataType.simpleString()
    return picked.mapInArrow(run, f"c0 {kind}, score double, n_evidence bigint, strongest string").withColumnRenamed("c0", id_col)


def restored(df: DataFrame, chars: CharModel, text: str = "text", out: str = "restored") -> DataFrame:
    """``df`` with a column ``out``: the text with hidden words restored (null stays null)."""
    sent = df.sparkSession.sparkContext.broadcast(chars)

    @F.pandas_udf("string")
    def fix(s):
        return s.map(lambda t: None if t is None else restored_text(t, sent.value))

    return df.withColumn(out, fix(F.col(text).cast("string")))


def training(id_col: Column) -> Column:
    """True where a row may be learned from: crc32 of the id as text, modulo 3, is not 1. A null id never is."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 != 1, F.lit(False))
