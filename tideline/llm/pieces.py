"""SentencePiece encoding and decoding by a weighted transducer (operator 8).

The transducer is compiled from a model file: a normaliser (dummy prefix, blanks to U+2581), an arc for each
piece, and byte arcs for characters without a piece. For a unigram model an arc weighs less its log-probability and the
tropical shortest path is the encoding. A BPE model's arcs are composed with a bigram acceptor that lets
piece b follow piece a only if merging the text of a+b gives back (a, b); over that composition every input has one path, so the shortest
path is the library's own segmentation. Blanks start pieces only, so the path falls apart at word starts and each distinct word is solved once a worker.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernels as K

BLANK = "▁"
#: Words that a task remembers in each of two generations, and pairs of pieces that a worker does; what does not fit is solved again, which changes cost only.
MEMORY, PAIRS = 150_000, 400_000
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Model:
    """What the transducer is compiled from: pieces, scores, kinds and normaliser flags. Bounded by the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.scores = [sp.get_score(i) for i in range(size)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.special = [i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        self.unknown = sp.unk_id()
        self.kind, self.prefix, self.squeeze = _flags(path)
        if any(BLANK in p.lstrip(BLANK) for i, p in enumerate(self.pieces) if i not in set(self.special)):
            raise ValueError("a piece holds a blank behind a letter; words cannot be solved one by one")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


def _flags(path: str) -> tuple[str, bool, bool]:
    """(model kind, dummy prefix, extra blanks removed). Field numbers are those of the public model format."""
    kind, prefix, squeeze = 1, True, True
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a compiled character map are not supported")
                prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return {1: "unigram", 2: "bpe"}.get(kind, "other"), prefix, squeeze


class Transducer:
    """Arcs by text in an automaton that finds all pieces ending at each sign, and for BPE the bigram acceptor, filled as pairs are met.

    A worker compiles it once; the words that a task meets belong to the task (``fresh``, ``forget``).
    """

    def __init__(self, model: Model):
        special = set(model.special) | set(model.byte.values())
        self.model = model
        self.arcs = {p: i for i, p in enumerate(model.pieces) if i not in special}
        if any(c not in self.arcs for p in self.arcs for c in p):
            raise ValueError("a character of a piece has no piece of its own")
        self.found = ahocorasick.Automaton()
        for p, i in self.arcs.items():
            self.found.add_word(p, (i, len(p)))
        self.found.make_automaton()
        self.inner = {p[i : i + 2] for p in self.arcs for i in range(len(p) - 1)}
        self.size = len(model.pieces)
        self.weight = [-s for s in model.scores]
        self.size_of = [len(p) for p in model.pieces]
        self.code = [i.to_bytes(4, "little") for i in range(self.size)]
        special = set(model.special)
        self.surface = ["" if i in special else p.replace(BLANK, " ") for i, p in enumerate(model.pieces)]
        self.value = {i: b for b, i in model.byte.items()}
        #: whether piece b may follow a, by a * size + b; a piece that starts has a = size
        self.follows: dict[int, bool] = {}
        self.forget()

    def fresh(self) -> Transducer:
        """The same arcs and acceptor without remembered words."""
        out = copy.copy(self)
        out.forget()
        return out

    def forget(self) -> None:
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        """The input side: blanks, and a leading one for a text that is not empty."""
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.model.prefix:
            text = " " + text
        return text.replace(" ", BLANK)

    def merged(self, text: str) -> list[int]:
        """Best-first merging of a short text: the acceptor's criterion."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.arcs.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.model.scores[piece] > best):
                    best, at = self.model.scores[piece], i
            if best is None:
                return [self.arcs[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allows(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text gives the two back; a first piece (a = size) must give itself."""
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        pieces = self.model.pieces
        good = self.merged(pieces[b]) == [b] if a == self.size else self.merged(pieces[a] + pieces[b]) == [a, b]
        self.follows[a * self.size + b] = good
        return good

    def fallback(self, ch: str) -> bytes:
        if self.model.byte:
            return b"".join(self.code[self.model.byte[b]] for b in ch.encode("utf-8", "surrogatepass"))
        return self.code[self.model.unknown]

    def path(self, word: str) -> bytes:
        """Shortest path of one word, as 32-bit little-endian ids."""
        out = self.older.get(word)
        if out is None:
            out = self.best(word)
        if out is None:
            out = self.parted(word)
        if len(self.memory) >= MEMORY:
            self.older, self.memory = self.memory, {}
        self.memory[word] = out
        return out

    def parted(self, word: str) -> bytes:
        """A word with characters that no arc takes: they stand alone. No piece holds the two characters at a cut, so the parts have paths of their own."""
        out, at = b"", 0
        for i in range(1, len(word) + 1):
            if i < len(word) and word[i - 1 : i + 1] in self.inner:
                continue
            part, at = word[at:i], i
            out += self.fallback(part) if len(part) == 1 and part not in self.arcs else self.best(part)
        return out

    def best(self, text: str) -> bytes | None:
        """Viterbi over (position, last piece): for BPE the acceptor leaves one live piece a position, for unigram the weights choose. None if no path takes all signs."""
        last = self._live(text) if self.model.kind == "bpe" else self._lightest(text)
        out, n = [], len(text)
        while n:
            piece = last[n]
            if piece < 0:
                return None
            out.append(self.code[piece])
            n -= self.size_of[piece]
        return b"".join(out[::-1])

    def _lightest(self, text: str) -> list[int]:
        """The last piece of the lightest path to each position: weights add along a path, the minimum is kept."""
        n = len(text)
        cost: list[float | None] = [0.0] + [None] * n
        last = [-1] * (n + 1)
        for at, (piece, size) in self.found.iter(text):
            before, end = cost[at + 1 - size], at + 1
            if before is not None and (cost[end] is None or before + self.weight[piece] < cost[end]):
                cost[end], last[end] = before + self.weight[piece], piece
        return last

    def _live(self, text: str) -> list[int]:
        """The last piece of the one path that the acceptor leaves to each position."""
        last = [-1] * (len(text) + 1)
        last[0] = start = self.size
        known = self.follows.get
        for at, (piece, size) in self.found.iter(text):
            at += 1
            if last[at] < 0:
                before = last[at - size]
                if before >= 0:
                    good = known(before * start + piece)
                    if good or (good is None and self.allows(before, piece)):
                        last[at] = piece
        return last

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit little-endian numbers."""
        path, seen = self.path, self.memory
        out = []
        for word in _WORD.findall(self.normalise(text)):
            ids = seen.get(word)
            if ids is None:
                ids = path(word)
                seen = self.memory
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The inverse: pieces to text, byte runs to characters (malformed bytes to U+FFFD), dummy prefix dropped."""
        surface, value = self.surface, self.value
        if not value or value.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts, held = [], bytearray()
            for i in ids:
                b = value.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    parts.append(_text(held))
                    held = bytearray()
                parts.append(surface[i])
            if held:
                parts.append(_text(held))
            text = "".join(parts)
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def _text(held: bytearray) -> str:
    """UTF-8 with every malformed byte as one U+FFFD."""
    try:
        return held.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(held):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(held[at : at + n]).decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_built: dict[str, Transducer] = {}


def _transducer(key: str, model: Model) -> Transducer:
    if key not in _built:
        _built.clear()
        _built[key] = Transducer(model)
    return _built[key]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` (array of int, replacing a column of that name). Null texts give null, empty ones an empty array.

    The model is read where the driver runs and sent to the tasks; its size is that of the vocabulary. Every other column passes unchanged.
    """
    model = df.sparkSession.sparkContext.broadcast(Model(path))
    kept = [c for c in df.columns if c != ids]
    packed = df.select(F.col(text).cast("string").alias("t"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(path, model.value).fresh()
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [None if t is None else fst.encode(t) for t in texts.slice(at, 256).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in rows])]).astype(np.int32)
                flat = np.frombuffer(b"".join(x or b"" for x in rows), "<i4")
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)), mask=pa.array([x is None for x in rows]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], made], names=[*part.schema.names[1:], "ids"])

    schema = ", ".join([*(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "ids array<int>"])
    return packed.mapInArrow(K.returned(run), schema).toDF(*kept, ids)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with ``text`` made from ``ids`` (replacing a column of that name); null ids give null."""
    model = df.sparkSession.sparkContext.broadcast(Model(path))
    kept = [c for c in df.columns if c != text]
    packed = df.select(F.col(ids).cast("array<int>").alias("i"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(path, model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array([None if x is None else fst.decode(x) for x in part.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], made], names=[*part.schema.names[1:], "t"])

    schema = ", ".join([*(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "t string"])
    return packed.mapInArrow(K.returned(run), schema).toDF(*kept, text)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``n_ids``, ``n_bytes`` (byte pieces), ``ids_sha256`` of the ids as little-endian 32-bit words, ``exact``: decoding gives the text back.

    Encoding and decoding happen in one task, so ids are not moved. Null counts as empty here.
    """
    import hashlib

    model = df.sparkSession.sparkContext.broadcast(Model(path))
    picked = df.select(F.col(id_col).alias("c0"), F.col(text).cast("string").alias("c1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(path, model.value).fresh()
        is_byte = np.zeros(len(model.value.pieces), bool)
        is_byte[list(model.value.byte.values())] = True
        for batch in batches:
            n, nb, sha, exact = [], [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                ids = fst.encode(t)
                arr = np.frombuffer(ids, "<i4")
                n.append(len(arr))
                nb.append(int(is_byte[arr].sum()))
                sha.append(hashlib.sha256(ids).hexdigest())
                exact.append(fst.decode(arr.tolist()) == t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nb, pa.int64()), pa.array(sha, pa.string()), pa.array(exact, pa.bool_())], names=["c0", "n_ids", "n_bytes", "ids_sha256", "exact"])

    kind = picked.schema["c0"].dataType.simpleString()
    return picked.mapInArrow(K.returned(run), f"c0 {kind}, n_ids bigint, n_bytes bigint, ids_sha256 string, exact boolean").withColumnRenamed("c0", id_col)
