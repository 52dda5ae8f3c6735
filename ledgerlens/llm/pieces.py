"""SentencePiece encoding and decoding by streaming Viterbi over the lattice of pieces.

The models at hand are byte-pair models: a piece's score is its merge rank, and a path is allowed
where every two neighbouring pieces would not merge differently when encoded together.  Every prefix
of a text has exactly one such path, so the best path to a position has one backpointer, found among
the pieces that end there.  Only the positions within one maximal piece length can still be continued;
as soon as their backpointer paths meet in one boundary, the ids before it are final and are given out.
Memory is bounded by the longest piece, not by the text.

A boundary that no piece crosses is such a meeting point by itself: a space mark after another
character, and a character that no longer piece contains.  Stretches between them (words) are encoded
once and remembered in a bounded cache.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B

SPACE = "▁"
CACHE = 1 << 18
LONGEST_WORD = 64  # longer ones are not remembered


class Words(dict):
    """Ids of words as int32 bytes, encoded when first asked for; emptied when full."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST_WORD:
            return np.fromiter(self.model.stream(word), np.int32).tobytes()
        ids = array("i", self.model.short(word)).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


class PieceModel:
    """Pieces, scores and byte pieces of a SentencePiece model file with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes = [-1] * 256
        for i in range(p.get_piece_size()):
            self.score.append(p.get_score(i))
            if p.is_byte(i):
                self.bytes[int(p.id_to_piece(i)[1:-1], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.ids[p.id_to_piece(i)] = i
        if min(self.bytes) < 0:
            raise ValueError("the model needs a piece for each byte")
        self.pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.longest = max(map(len, self.ids))
        joined = {c for piece in self.ids if len(piece) > 1 for c in piece}
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        alone = "".join(re.escape(chr(c)) for c in range(33) if chr(c) not in joined)
        self._cuts = None if inner else re.compile(f"[{alone}]|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+")
        self._ends: dict = {}  # the pieces letter by letter from their ends
        for piece in self.ids:
            node = self._ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        self._pairs: dict[tuple[str | None, str], bool] = {}
        self._parts: dict[str, tuple[str, str] | None] = {}
        marks = [x.replace(SPACE, " ").encode() for x in self.pieces]
        for b, i in enumerate(self.bytes):
            marks[i] = bytes([b])
        self._spelled = np.frombuffer(b"".join(marks), np.uint8)
        self._from = np.concatenate([[0], np.cumsum([len(m) for m in marks])])
        self.words = Words(self)

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging of a few characters: the best-scored pair first, the leftmost of equals."""
        symbols = list(symbols)
        while True:
            best = None
            for i in range(len(symbols) - 1):
                k = self.ids.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or self.score[k] > best[0]):
                    best = (self.score[k], i)
            if best is None:
                return symbols
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece; None for one character, or if the piece never comes out."""
        if piece not in self._parts:
            symbols, last = list(piece), None
            while len(symbols) > 1:
                best = None
                for i in range(len(symbols) - 1):
                    k = self.ids.get(symbols[i] + symbols[i + 1])
                    if k is not None and (best is None or self.score[k] > best[0]):
                        best = (self.score[k], i)
                if best is None:
                    break
                i = best[1]
                last = (symbols[i], symbols[i + 1])
                symbols[i : i + 2] = ["".join(last)]
            self._parts[piece] = last if len(symbols) == 1 else None
        return self._parts[piece]

    def _joins(self, left: str | None, piece: str) -> bool:
        """``_apart``, remembered."""
        if len(self._pairs) >= CACHE:
            self._pairs.clear()
        known = self._pairs[left, piece] = self._apart(left, piece)
        return known

    def _apart(self, left: str | None, piece: str) -> bool:
        """Whether ``piece`` may follow ``left`` on a path: at no time would their touching parts have merged.

        Parts are undone from the last merge to the first.  A merge across the border comes before the merge that
        used up a part if it scores better, and, as merging goes from left to right, on equal scores before the right one's.
        """
        if len(piece) > 1 and self._split(piece) is None:
            return False
        if left is None:
            return True
        if left[-1] == SPACE and piece[0] == SPACE:  # runs of spaces share one score
            return self.merged(left + piece) == [left, piece]
        ids, score = self.ids, self.score
        bound, strict = None, True  # score of the merge that used up the part undone last; whether equals come later
        while True:
            k = ids.get(left + piece)
            if k is not None and (bound is None or score[k] > bound or (score[k] == bound and not strict)):
                return False
            a = score[ids[left]] if len(left) > 1 else None
            b = score[ids[piece]] if len(piece) > 1 else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and a < b):
                bound, strict, left = a, True, self._split(left)[1]
            else:
                bound, strict, piece = b, False, self._split(piece)[0]

    def stream(self, chars):
        """Ids of a stream of characters, each given out as soon as it is final."""
        window = ""  # characters after the last boundary given out
        base = at = 0  # position of its first character, and of the next one
        back: dict[int, tuple[int, str]] = {}  # position -> (previous position, piece) of its only path
        ends, longest, pairs, joins = self._ends, self.longest, self._pairs, self._joins
        for c in chars:
            window += c
            at += 1
            node, start = ends, at - base
            while node is not None and start:  # backwards through the pieces that end here, the shortest first
                start -= 1
                node = node.get(window[start])
                piece = node[""] if node is not None and "" in node else c if base + start == at - 1 else None
                if piece is not None:
                    before = back.get(base + start)
                    if before is not None:
                        left = before[1]
                    elif base + start == 0:
                        left = None
                    else:
                        continue
                    known = pairs.get((left, piece))
                    if known or (known is None and joins(left, piece)):
                        back[at] = (base + start, piece)
                        break
            if at - base > 2 * longest:
                # Positions at which a later piece may still begin: where their paths meet, all before is final.
                meet = self._meeting(back, [p for p in range(at - longest + 1, at + 1) if p in back], base)
                if meet > base:
                    yield from self._path(back, meet, base)
                    window = window[meet - base :]
                    back = {p: v for p, v in back.items() if p >= meet}
                    base = meet
        yield from self._path(back, at, base)

    def short(self, word: str) -> list[int]:
        """``stream`` for a word that is held whole: the same path, with nothing given out before its end."""
        ends, pairs, joins, ids = self._ends, self._pairs, self._joins, self.ids
        last: list[str | None] = [None]  # the last piece of the only path to each position
        for at, c in enumerate(word):
            node = ends.get(c)
            if node is None:  # a character that ends no piece is one by itself
                piece, start = c, at
                if not pairs.get((last[at], c)) and not joins(last[at], c):
                    return list(self.stream(word))
            else:
                piece, start = node.get("") or c, at
                while True:
                    if piece is not None:
                        left = last[start]
                        known = pairs.get((left, piece))
                        if known or (known is None and joins(left, piece)):
                            break
                    start -= 1
                    node = node.get(word[start]) if start >= 0 else None
                    if node is None:
                        return list(self.stream(word))
                    piece = node.get("")
            last.append(piece)
        found, at = [], len(word)
        while at:
            piece = last[at]
            i = ids.get(piece)
            if i is not None:
                found.append(i)
            else:
                found += [self.bytes[b] for b in reversed(piece.encode())]
            at -= len(piece)
        found.reverse()
        return found

    @staticmethod
    def _meeting(back, live, base) -> int:
        """The last position that the paths to all live positions share."""
        heads = set(live)
        while len(heads) > 1:
            last = max(heads)
            heads.discard(last)
            heads.add(back[last][0] if last > base else base)
        return heads.pop()

    def _path(self, back, to: int, base: int):
        """Ids on the path from ``base`` to ``to``."""
        found = []
        while to > base:
            to, piece = back[to]
            found.append(piece)
        for piece in reversed(found):
            i = self.ids.get(piece)
            if i is not None:
                yield i
            else:
                yield from (self.bytes[b] for b in piece.encode())

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as int32 bytes; an empty text has none."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        words = [marked] if self._cuts is None else self._cuts.findall(marked)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, runs of byte pieces read as UTF-8, space marks as spaces, the leading one dropped."""
        ids = np.asarray(ids, dtype=np.int64)
        begin, size = self._from[ids], self._from[ids + 1] - self._from[ids]
        at = np.cumsum(size) - size
        text = self._spelled[np.repeat(begin - at, size) + np.arange(size.sum())].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, PieceModel] = {}


def _model(name: str) -> PieceModel:
    """The model file that the driver sent to every executor, read once per worker."""
    if name not in _loaded:
        _loaded[name] = PieceModel(SparkFiles.get(name))
    return _loaded[name]


def _send(spark, model_path: str) -> str:
    """Send a model file (a few hundred KB) to the executors; returns its name there."""
    spark.sparkContext.addFile(model_path)
    return model_path.rsplit("/", 1)[-1]


def _id_lists(coded: list[bytes | None]) -> pa.Array:
    """Lists of int32 from their bytes; None gives a null list."""
    off = np.concatenate([[0], np.cumsum([len(c or b"") // 4 for c in coded])]).astype(np.int32)
    ids = pa.array(np.frombuffer(b"".join(c or b"" for c in coded), np.int32))
    mask = pa.array([c is None for c in coded], pa.bool_()) if None in coded else None
    return pa.ListArray.from_arrays(pa.array(off), ids, mask=mask)


def _encoded(model: PieceModel, col: pa.Array) -> pa.Array:
    return _id_lists([None if x is None else model.encode_bytes(x) for x in col.to_pylist()])


def _decoded(model: PieceModel, col: pa.Array) -> pa.Array:
    off, ids = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    null = col.is_null().to_numpy(zero_copy_only=False)
    return pa.array([None if n else model.decode(ids[a:b]) for a, b, n in zip(off[:-1], off[1:], null, strict=True)], pa.string())


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids_col``: the whole text's ids.  A null text has null ids, an empty one none.

    One row per input row, in place, without a shuffle.  A column of that name that ``docs`` has already is replaced.
    """
    return _mapped(docs, model_path, text_col, {ids_col: T.ArrayType(T.IntegerType())}, lambda m, c: [_encoded(m, c)])


def decode_documents(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and ``text_col``: the text of the ids.  Null ids give a null text; a column of that name is replaced."""
    return _mapped(docs, model_path, ids_col, {text_col: T.StringType()}, lambda m, c: [_decoded(m, c)])


def _mapped(docs: DataFrame, model_path: str, source: str, targets: dict, make) -> DataFrame:
    """Columns made from one column, added to the others in place."""
    if source in targets:
        raise ValueError(f"the result would replace its source {source}")
    docs = docs.drop(*targets)
    name = _send(docs.sparkSession, model_path)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(source)
    src = docs.toDF(*names)
    out = [f"out{i}" for i in range(len(targets))]

    def run(batches):
        model = _model(name)
        for batch in batches:
            text = pa.types.is_string(batch.column(at).type) or pa.types.is_large_string(batch.column(at).type)
            for part in B.slices(batch, names[at]) if text else (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(model, part.column(at))], names=[*names, *out])

    fields = [T.StructField(o, t) for o, t in zip(out, targets.values(), strict=True)]
    return src.mapInArrow(run, T.StructType([*src.schema.fields, *fields])).toDF(*docs.columns, *targets)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, n_ids, n_bytes, round_trip``: the ids of every whole text and whether decoding gives the text back.

    Null counts as empty: no ids, and the round trip holds.  A text that holds the space mark itself (U+2581) does not
    come back: the mark is read as a space, as in the library.
    """

    def both(model, col):
        ids = _encoded(model, col)
        back = _decoded(model, ids)
        return [ids, pa.array([a == b for a, b in zip(col.to_pylist(), back.to_pylist(), strict=True)])]

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = _mapped(src, model_path, "text", {"ids": T.ArrayType(T.IntegerType()), "same": T.BooleanType()}, both)
    return made.select(F.col("id").alias(id_col), "ids", F.size("ids").cast("bigint").alias("n_ids"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.col("same").alias("round_trip"))
