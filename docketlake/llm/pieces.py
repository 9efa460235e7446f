"""SentencePiece encoding and decoding of notice texts by a streaming Viterbi search.

The vocabulary is read from a ``.model`` file given by path; nothing is trained here.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docketlake.llm import kernel
from docketlake.llm.notices import TEXT

SPACE = "▁"        # the mark that stands for a space
ENCODE_BYTES = 2 << 20  # text encoded at once
PAIRS = 500_000         # pairs of pieces a worker remembers, at most
SHORT_WORD = 64         # characters up to which words are searched together
DECODE_ROWS = 250        # rows decoded at once
UNKNOWN_PENALTY = 10.0  # an unknown character scores this much below the worst piece

# Piece and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Vocabulary(NamedTuple):
    """What the search needs of a model file; its size is that of the vocabulary."""

    ids: dict[str, int]          # normal pieces
    score: dict[int, float]
    text: list[str]
    byte_ids: tuple[int, ...]    # id of every byte, or none
    byte_of: dict[int, int]
    hidden: frozenset[int]       # control pieces, which decode to nothing
    unknown: int
    longest: int
    merges: bool                 # BPE: paths are judged by merge order, not by score sums
    prefix: bool                 # a space is put before the text
    splits: bool                 # no piece runs from a word into the space of the next


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model whose normalizer keeps the text as it is; others are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rule = model.normalizer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix \
            or any(p.type == USER_DEFINED for p in model.pieces):
        raise ValueError("only models with an identity normalizer and no user-defined pieces are supported")
    kinds = [p.type for p in model.pieces]
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == BYTE}
    back = {b: i for i, b in byte_of.items()}
    return Vocabulary(
        ids, {i: p.score for i, p in enumerate(model.pieces) if p.type == NORMAL}, [p.piece for p in model.pieces],
        tuple(back[b] for b in range(256)) if model.trainer_spec.byte_fallback else (), byte_of,
        frozenset(i for i, k in enumerate(kinds) if k == CONTROL), kinds.index(UNKNOWN), max(map(len, ids), default=1),
        model.trainer_spec.model_type == BPE, rule.add_dummy_prefix,
        not any(SPACE in p.lstrip(SPACE) for p in ids))


class Encoder:
    """Viterbi search over one vocabulary, with a bounded memory of which pieces may follow each other."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.floor = min(vocabulary.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.met, self.allowed = np.full(1, -1, np.int64), np.zeros(1, bool)
        self.fresh: dict[int, bool] = {}
        self.table = self._piece_table()

    # -- which step may follow which ---------------------------------------------------

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece when merging starts from its characters.

        Merging takes the best score first and the leftmost among equals.  A piece that its
        own characters do not merge to, as one, has no halves and no place in a path.
        """
        if piece in self.halves:
            return self.halves[piece]
        ids, score = self.v.ids, self.v.score
        parts, last = list(piece), None
        while len(parts) > 1:
            found = [(score[ids[x + y]], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ids]
            if not found:
                break
            at = -max(found)[1]
            last = parts[at], parts[at + 1]
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def _follows(self, left: str, right: str) -> bool:
        """Does merging the joint text of two pieces give both back?

        It does unless a merge across their border comes first.  The two pieces are taken
        apart again, the later merge before the earlier one; at each state the parts that
        touch must not merge before one of them is used up by its own piece.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, x: str, y: str) -> bool:
        ids, score = self.v.ids, self.v.score
        used_up, ties_lose = -math.inf, False      # score of the merge that ends this state
        while True:
            k = ids.get(x + y)
            if k is not None and (score[k] > used_up or ties_lose and score[k] == used_up):
                return False
            in_x = score[ids[x]] if len(x) > 1 else math.inf
            in_y = score[ids[y]] if len(y) > 1 else math.inf
            if in_x == in_y == math.inf:
                return True
            if in_x < in_y:
                used_up, ties_lose, x = in_x, False, self._halves(x)[1]
            else:
                used_up, ties_lose, y = in_y, True, self._halves(y)[0]

    # -- the search --------------------------------------------------------------------

    def stream(self, text: str) -> Iterator[str]:
        """Pieces of a text, given out as soon as they are certain.

        Only a window of the last ``longest`` boundaries can still begin a piece.  The paths
        to those boundaries are the survivors; every ``longest`` characters they are followed
        back, and when all run through one boundary, everything before it is final, is given
        out and is forgotten.  With scores the best sum survives at a boundary; with merges
        the one step that merging allows.
        """
        v = self.v
        best: dict[int, float] = {0: 0.0}          # score of each boundary that a path reaches
        step: dict[int, int] = {}                  # boundary -> boundary before it
        done, end = 0, 0
        while end < len(text):
            first, end = end + 1, min(end + v.longest, len(text))
            self._extend(text, first, end, done, best, step)
            meet = self._meeting(step, end - v.longest + 1, end, done) if end < len(text) else done
            if meet > done:
                before = step[meet]
                yield from self._path(text, step, done, meet)
                best = {b: s for b, s in best.items() if b >= meet}
                step = {b: s for b, s in step.items() if b > meet}
                done = meet
                if v.merges:
                    step[meet] = before            # the piece before the cut still decides what may follow
        yield from self._path(text, step, done, len(text))

    def _extend(self, text: str, first: int, last: int, done: int, best: dict[int, float], step: dict[int, int]) -> None:
        """Find the surviving step to each boundary from ``first`` to ``last``."""
        ids, score, longest, pairs, halves = self.v.ids, self.v.score, self.v.longest, self.pairs, self.halves
        if self.v.merges:
            for end in range(first, last + 1):
                for begin in range(max(done, end - longest), end):
                    piece = text[begin:end]
                    if (piece in ids and (halves.get(piece) or self._halves(piece)) or end - begin == 1) and begin in best:
                        if begin in step:
                            left = text[step[begin]:begin]
                            known = pairs.get((left, piece))
                            if not (self._follows(left, piece) if known is None else known):
                                continue
                        best[end], step[end] = 0.0, begin
                        break
                else:
                    best.pop(end, None)
            return
        for end in range(first, last + 1):
            top, at = best[end - 1] + self.floor, end - 1
            for begin in range(max(done, end - longest), end):
                k = ids.get(text[begin:end])
                if k is not None and best[begin] + score[k] > top:
                    top, at = best[begin] + score[k], begin
            best[end], step[end] = top, at

    def _codes(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of a text with the tables for hashing its spans."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        powers, inverse = kernel._tables(len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(kernel.mix(code.astype(np.uint64) + np.uint64(1)) * powers[: len(code)], dtype=np.uint64, out=sums[1:])
        return code, sums, inverse

    def _piece_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all pieces that can stand in a path, sorted, with their ids."""
        own = [(p, i) for p, i in self.v.ids.items() if not self.v.merges or len(p) == 1 or self._halves(p)]
        end = np.cumsum([len(p) for p, _ in own])
        _, sums, inverse = self._codes("".join(p for p, _ in own))
        begin = end - np.array([len(p) for p, _ in own])
        code = kernel.mix((sums[end] - sums[begin]) * inverse[begin])
        order = np.argsort(code)
        return code[order], np.array([i for _, i in own], np.int64)[order]

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_follows`` for arrays of ids, by a sorted table of the pairs met so far."""
        size = len(self.v.text) + 1
        key = left * size + right
        at = np.minimum(np.searchsorted(self.met, key), len(self.met) - 1)
        known = self.met[at] == key
        out = known & self.allowed[at]
        new = np.flatnonzero(~known)
        if len(new):
            keys, which = np.unique(key[new], return_inverse=True)
            found = []
            for k in keys.tolist():
                ok = self.fresh.get(k)
                if ok is None:
                    x, y = divmod(k, size)
                    # A character without a piece is part of no piece, so it never merges.
                    ok = self.fresh[k] = size - 1 in (x, y) or self._border_holds(self.v.text[x], self.v.text[y])
                found.append(ok)
            out[new] = np.array(found)[which]
        return out

    def _remember(self) -> None:
        if self.fresh:
            keys = np.concatenate([self.met if len(self.met) < PAIRS else self.met[:1], np.array(list(self.fresh), np.int64)])
            allowed = np.concatenate([self.allowed if len(self.met) < PAIRS else self.allowed[:1], np.array(list(self.fresh.values()), bool)])
            order = np.argsort(keys)
            self.met, self.allowed = keys[order], allowed[order]
            self.fresh = {}

    def short_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words at once, end to end, and how many each word has.

        The same search as ``stream``, one boundary of all words at a time.  A word is its own
        window here, so nothing has to be given out before its end.
        """
        v, none = self.v, len(self.v.text)
        code, sums, inverse = self._codes("".join(words))
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        piece, begin = np.full(len(code), -1, np.int64), np.zeros(len(code), np.int64)
        best = np.full(len(code), -np.inf)
        score = np.append([v.score.get(i, 0.0) for i in range(none)], self.floor)
        hashes, ids = self.table
        for end in range(1, int(size.max(initial=0)) + 1):
            first = start[size >= end]
            last = first + end - 1
            open_ = np.ones(len(first), bool)
            for width in range(min(end, v.longest), 0, -1):
                rows = np.flatnonzero(open_) if v.merges else np.arange(len(first))
                low = last[rows] - width + 1
                want = kernel.mix((sums[last[rows] + 1] - sums[low]) * inverse[low])
                at = np.minimum(np.searchsorted(hashes, want), len(hashes) - 1)
                found = np.where(hashes[at] == want, ids[at], none if width == 1 else -1)
                inner = low > first[rows]
                left = np.where(inner, piece[low - 1], -1)
                fits = (found >= 0) & (~inner | (left >= 0))
                if v.merges:
                    check = np.flatnonzero(fits & inner)
                    fits[check] = self._may_follow(left[check], found[check])
                    gain = np.zeros(len(rows))
                else:
                    gain = np.where(inner, best[low - 1], 0.0) + score[found]
                    fits &= gain > best[last[rows]]
                rows, to = rows[fits], last[rows[fits]]
                piece[to], begin[to], best[to] = found[fits], low[fits], gain[fits]
                open_[rows] = False
        self._remember()
        # Follow all paths back at once.
        owner, step, ids_out = [], [], []
        at, word, turn = start + size - 1, np.flatnonzero(size > 0), 0
        at = at[word]
        while len(at):
            k = piece[at]
            owner.append(word)
            step.append(np.full(len(word), -turn))
            ids_out.append(np.where(k == none, -1 - code[begin[at]].astype(np.int64), k))
            at = begin[at] - 1
            go = at >= start[word]
            at, word, turn = at[go], word[go], turn + 1
        if not owner:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, step, flat = (np.concatenate(x) for x in (owner, step, ids_out))
        order = np.lexsort((step, owner))
        owner, flat = owner[order], flat[order]
        lost = np.flatnonzero(flat < 0)
        if len(lost):
            # Characters without a piece become their bytes, or one unknown id for neighbours.
            if v.byte_ids:
                spelled = [[v.byte_ids[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in flat[lost].tolist()]
            else:
                after = (lost > 0) & (flat[lost - 1] < 0) & (owner[lost - 1] == owner[lost])
                spelled = [[] if a else [v.unknown] for a in after.tolist()]
            count = np.ones(len(flat), np.int64)
            count[lost] = [len(x) for x in spelled]
            bounds = np.cumsum(count) - count
            out = np.repeat(flat, count)
            for at_, x in zip(bounds[lost].tolist(), spelled, strict=True):
                out[at_: at_ + len(x)] = x
            flat, owner = out, np.repeat(owner, count)
        return flat.astype(np.int32), np.bincount(owner, minlength=len(words))

    @staticmethod
    def _path(text: str, step: dict[int, int], done: int, end: int) -> list[str]:
        path = []
        while end > done:
            path.append(text[step[end]:end])
            end = step[end]
        return path[::-1]

    @staticmethod
    def _meeting(step: dict[int, int], low: int, high: int, done: int) -> int:
        """Last boundary that the paths to all boundaries in ``[low, high]`` share."""
        meet = None
        for end in range(max(low, done), high + 1):
            if end == done:
                return done
            if end not in step:
                continue
            if meet is None:
                meet = end
                continue
            at = end
            while at != meet:
                if at > meet:
                    at = step[at] if at > done else done
                else:
                    meet = step[meet] if meet > done else done
                if at <= done or meet <= done:
                    return done
        return done if meet is None else meet

    def _ids(self, path: Iterator[str]) -> Iterator[int]:
        v, unknown = self.v, False
        for piece in path:
            k = v.ids.get(piece)
            if k is not None:
                yield k
            elif v.byte_ids:
                yield from (v.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            elif not unknown:                      # neighbouring unknown characters are one id
                yield v.unknown
            unknown = k is None

    def encode_slice(self, s: kernel.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, with the bounds of each row.

        Rows are cut where every path has a boundary: before the spaces that follow a word.
        Each distinct word of the slice is searched once.
        """
        space = s.buf == 0x20
        cut = np.zeros(len(s.buf), bool)
        if self.v.splits:
            # A space mark written in the text counts as a space.
            mark = np.zeros(len(s.buf), bool)
            mark[2:] = (s.buf[:-2] == 0xE2) & (s.buf[1:-1] == 0x96) & (s.buf[2:] == 0x81)
            cut[1:] = space[1:] & ~space[:-1] & ~mark[:-1]
        filled = s.start < s.end
        first = s.start[filled]
        cut[first] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(s.buf))
        code = kernel.ordered_hashes(s.buf, begin, end)
        leads = np.zeros(len(begin), bool)
        leads[np.searchsorted(begin, first)] = True
        code[leads] ^= np.uint64(0x94D049BB133111EB)
        _, at, which = np.unique(code, return_index=True, return_inverse=True)
        raw, mark = s.buf.tobytes(), SPACE.encode() if self.v.prefix else b""
        spelled = [mark + raw[b:e] if lead else raw[b:e]
                   for b, e, lead in zip(begin[at].tolist(), end[at].tolist(), leads[at].tolist(), strict=True)]
        words = [word.decode().replace(" ", SPACE) for word in spelled]
        long = [i for i, word in enumerate(words) if len(word) > SHORT_WORD]
        flat, size = self.short_words(["" if len(word) > SHORT_WORD else word for word in words])
        for i in long:
            ids = np.fromiter(self._ids(self.stream(words[i])), np.int32)
            flat, size[i] = np.concatenate([flat, ids]), len(ids)
        begin_of = np.cumsum(size) - size
        if long:
            short = size.copy()
            short[long] = 0
            begin_of = np.cumsum(short) - short
            begin_of[long] = len(flat) - np.cumsum(size[long][::-1])[::-1]
        bounds = np.concatenate([[0], np.cumsum(size[which])])
        row = np.searchsorted(begin, s.start), np.searchsorted(begin, s.end)
        return gather(flat, begin_of[which], size[which]), bounds[np.append(row[0], row[1][-1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_slice(kernel.from_texts([text]))[0].tolist()


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[start:start + size]``."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class Decoder:
    """Piece bytes in one table; rows of ids become rows of text without a loop over ids."""

    def __init__(self, v: Vocabulary):
        parts = [b"" if i in v.hidden else bytes([v.byte_of[i]]) if i in v.byte_of
                 else " \u2047 ".encode() if i == v.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(v.text)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.prefix = v.prefix

    def decode_rows(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        raw = gather(self.data, self.start[ids], self.size[ids]).tobytes()
        at = np.concatenate([[0], np.cumsum(self.size[ids])])[bounds].tolist()
        return [raw[b + (self.prefix and raw[b:e].startswith(b" ")):e] for b, e in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_rows(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary, number: int) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; what it remembers serves the next task too."""
    if number not in _encoders:
        _encoders.clear()
        _encoders[number] = Encoder(vocabulary)
    return _encoders[number]


def encode_notices(notices: DataFrame, model_path: str, text: str = TEXT, ids: str = "piece_ids") -> DataFrame:
    """Adds the piece ids of every whole text, as the model's own library gives them, without added marks.

    NULL and empty texts have no ids.  Rows, ties and repeats stay as they are; a column named
    like ``ids`` is replaced.  The model file is read on the driver and its vocabulary sent to the
    tasks.  Texts are encoded where they lie, in slices of a few MB, so memory is bounded by
    the slice or by one longer text; nothing is shuffled.
    """
    kept = [f for f in notices.schema.fields if f.name != ids]
    vocabulary = load_vocabulary(model_path)
    sent, number = notices.sparkSession.sparkContext.broadcast(vocabulary), zlib.crc32(repr(vocabulary.text).encode())

    def encode(batches):
        encoder = _encoder(sent.value, number)
        for s in kernel.slices(batches, text, ENCODE_BYTES):
            flat, bounds = encoder.encode_slice(s)
            column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([s.batch.column(f.name) for f in kept] + [column],
                                             [f.name for f in kept] + [ids])

    return notices.select(*dict.fromkeys([*(f.name for f in kept), text])).mapInArrow(
        encode, T.StructType([*kept]).add(ids, T.ArrayType(T.IntegerType())))


def decode_notices(encoded: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Adds the text that piece ids stand for; NULL ids give an empty text.

    Bytes that are no UTF-8 become replacement characters.  A column named like ``text`` is replaced.
    """
    kept = [f for f in encoded.schema.fields if f.name != text]
    sent = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def decode(batches):
        decoder = Decoder(sent.value)
        for whole in batches:
            for first in range(0, whole.num_rows, DECODE_ROWS):
                batch = whole.slice(first, DECODE_ROWS)
                column = batch.column(ids)
                size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                rows = decoder.decode_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                                           np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name) for f in kept] + [pa.array([r.decode("utf-8", "replace") for r in rows], pa.string())],
                    [f.name for f in kept] + [text])
        kernel.release()

    return encoded.mapInArrow(decode, T.StructType([*kept]).add(text, "string"))
