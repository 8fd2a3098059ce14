"""Problem 8: cutting texts into pieces within a token limit, at natural boundaries, with overlap.

A text is tokenized once. Cuts lie at ends of words, before the blanks that
follow; there the tokens on both sides are the same as in the whole text, so
the size of any piece is a difference of token numbers. Cuts have levels: section,
paragraph, sentence, word, part of a long word. A part that is too large is divided at the coarsest
level that has cuts in it, and so on down; a long word is divided where letters,
digits and signs meet, and at last between characters. The resulting units are packed greedily, each piece
starting with the last words of the piece before it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.tokens import VOCABULARY, byte_lengths, encode

SECTION, PARAGRAPH, SENTENCE, WORD, PART = range(5)
#: Words before whose full stop no sentence ends. Fixed values.
ABBREVIATIONS = {w.encode() for w in ("e.g.", "i.e.", "cf.", "approx.", "ca.", "vs.", "etc.", "fig.", "figs.", "tab.", "eq.", "no.", "nr.", "n.b.", "al.", "dr.", "prof.", "mr.", "mrs.", "st.", "z.b.", "d.h.", "bzw.", "u.a.", "vgl.", "abb.", "p.ej.", "p.", "pp.", "vol.", "ref.", "refs.", "resp.")}
#: An overlap that would grow by more tokens than this to reach a cut starts inside the word instead.
WIDEN = 16
#: A rest that exceeds the room by no more tokens than this may still fit once encoded by itself.
NEAR = 64


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Which bytes end a sentence, may follow its end, end a line that stands alone, begin a line of a list, table or heading, are lower case.
_STOPS, _CLOSERS, _LINE_ENDS, _MARKS, _LOWER = map(_among, (b".!?", b")]\"'*_`", b".!?:;|", b"-*|#>+0123456789", bytes(range(97, 123))))
_BLANK = _among(bytes([32, *range(9, 14)]))
#: Letters 1, digits 2, signs 3 and 0 for bytes next to which a long word isn't cut. No token of the vocabulary's pattern spans two kinds, but for apostrophes.
_KIND = np.array([0 if c >= 128 or c == 39 or _BLANK[c] else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.int8)
LONG_WORD = 32
_WIDE_STOPS, _WIDE_COMMAS = ("。", "！", "？", "；"), ("，", "、", "：")


def _blank(data: np.ndarray, raw: bytes) -> np.ndarray:
    """Bytes of blanks, those of other scripts included."""
    blank = _BLANK[data]
    if not raw.isascii():
        for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))):
            code = c.encode()
            if code in raw:
                at = raw.find(code)
                while at >= 0:
                    blank[at : at + len(code)] = True
                    at = raw.find(code, at + len(code))
    return blank


def cuts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the text may be cut without changing its tokens, in order, and the level of each."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    blank = _blank(data, raw)
    turn = np.flatnonzero(blank[:-1] != blank[1:]) + 1
    head = 0
    if blank[0]:
        head, turn = (int(turn[0]) if len(turn) else len(data)), turn[1:]
    turn = turn[: len(turn) // 2 * 2]  # blanks at the end have no word after them
    end, begin = turn[::2], turn[1::2]
    first = np.concatenate([[head], begin])  # where each word begins; the last one ends the text
    parts = _parts(data, first, np.append(end, len(data)))
    first = first[:-1]
    lines = np.flatnonzero(data == 10)
    n = np.searchsorted(lines, begin) - np.searchsorted(lines, end)
    last, prior, ahead = data[end - 1], data[np.maximum(end - 2, 0)], data[begin]
    stop = (_STOPS[last] | (_CLOSERS[last] & _STOPS[prior])) & ~_LOWER[ahead]
    wide = last >= 0x80
    for i in np.flatnonzero(stop & (last == 46) & (end - first <= 10)):
        word = raw[first[i] : end[i]].lstrip(b"([\"'").lower()
        if word in ABBREVIATIONS or (len(word) == 2 and word.isascii() and word[:1].isalpha()):
            stop[i] = False
    if wide.any():
        for i in np.flatnonzero(wide):
            tail = raw[max(0, end[i] - 6) : end[i]].decode("utf-8", "ignore").rstrip("”’»）」")
            stop[i] |= tail.endswith((*_WIDE_STOPS, ".", "!", "?", "…"))
    level = np.full(len(end), WORD, np.int8)
    level[stop | ((n > 0) & (_LINE_ENDS[last] | _MARKS[ahead]))] = SENTENCE
    level[n > 1] = PARAGRAPH
    level[(n > 0) & (ahead == 35)] = SECTION
    more, rank = [parts], [np.full(len(parts), PART)]
    if not raw.isascii():
        for marks, of in ((_WIDE_STOPS, SENTENCE), (_WIDE_COMMAS, WORD)):
            for code in (m.encode() for m in marks):
                at = raw.find(code)
                while at >= 0:
                    p = at + len(code)
                    if p < len(raw) and (0xE4 <= data[p] <= 0xE9 or 65 <= data[p] <= 90 or 97 <= data[p] <= 122 or 48 <= data[p] <= 57):
                        more.append([p])
                        rank.append([of])
                    at = raw.find(code, p)
    if len(parts) or len(more) > 1:
        end, level = np.concatenate([end, *more]).astype(np.int64), np.concatenate([level, *rank]).astype(np.int8)
        order = np.lexsort((level, end))
        end, level = end[order], level[order]
        first = np.append(True, end[1:] != end[:-1])
        end, level = end[first], level[first]
    return end, level


def _parts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions inside long words where the kind of character changes."""
    out = [np.zeros(0, np.int64)]
    for i in np.flatnonzero(end - begin > LONG_WORD):
        k = _KIND[data[begin[i] : end[i]]]
        out.append(begin[i] + 1 + np.flatnonzero((k[:-1] != k[1:]) & (k[:-1] > 0) & (k[1:] > 0)))
    return np.concatenate(out)


class Text:
    """A tokenized text with its cuts as token numbers."""

    def __init__(self, text: str, path: str = VOCABULARY):
        self.enc = partial(encode, path=path)
        self.raw = text.encode("utf-8", "replace")
        tokens = np.array(self.enc(text), np.int64)
        self.n = len(tokens)
        self.at = np.zeros(self.n + 1, np.int64)  # byte where each token starts
        np.cumsum(byte_lengths(path)[tokens], out=self.at[1:])
        pos, level = cuts(self.raw)
        token = np.searchsorted(self.at, pos)
        fits = self.at[np.minimum(token, self.n)] == pos
        if not fits.all():
            token, level = token[fits], level[fits]
        self.all = token.tolist()
        self.levels = [token[level == k].tolist() for k in range(3)] + [token[level <= WORD].tolist(), self.all]
        self.inside: set[int] = set()  # token numbers inside a word at which this text was cut

    def count(self, a: int, b: int) -> int:
        """Tokens of the piece between two token numbers, encoded by itself."""
        if a in self.inside or b in self.inside:
            return len(self.enc(self.raw[self.at[a] : self.at[b]].decode("utf-8", "replace")))
        return b - a

    def _aligned(self, t: int, floor: int) -> int:
        """The last token number from ``floor`` + 1 to t that starts with a whole character; the next one after t if there is none."""
        back = t
        while back > floor and back < self.n and self.raw[self.at[back]] & 0xC0 == 0x80:
            back -= 1
        if back > floor:
            return back
        while t < self.n and self.raw[self.at[t]] & 0xC0 == 0x80:
            t += 1
        return t

    def _characters(self, a: int, b: int, room: int, out: list[int]) -> None:
        while a < b:
            if b - a <= room + NEAR and self.count(a, b) <= room:  # only a rest of about the right size is encoded
                out.append(b)
                return
            e = self._aligned(min(b - 1, a + room) if b - a > 1 else b, a)
            self.inside.add(e)
            while (over := self.count(a, e) - room) > 0:
                shorter = self._aligned(max(a + 1, e - over), a)
                if shorter >= e:
                    break  # a single character has more tokens than the limit
                e = shorter
                self.inside.add(e)
            out.append(min(e, b))
            a = e

    def _units(self, a: int, b: int, level: int, room: int, out: list[int]) -> None:
        if b - a <= room:
            out.append(b)
            return
        while level <= PART:
            c = self.levels[level]
            lo, hi = bisect_right(c, a), bisect_left(c, b)
            level += 1
            if lo < hi:
                for x in c[lo:hi]:
                    self._units(a, x, level, room, out)
                    a = x
                self._units(a, b, level, room, out)
                return
        self._characters(a, b, room, out)

    def _overlap(self, a: int, b: int, want: int, unit: int, limit: int) -> int:
        """Where the piece after [a, b) starts: the last words of it with at least ``want`` tokens, or fewer where the next unit needs the room."""
        if want == 0 or b - a <= 1:
            return b
        goal = max(a + 1, b - want)
        i = bisect_right(self.all, goal)
        start = self.all[i - 1] if i and self.all[i - 1] > a and goal - self.all[i - 1] <= WIDEN else None
        if start is None:  # no cut is near: inside the stretch before the goal, at a whole character
            exact, tried = self._aligned(goal, a), set()
            while a < exact <= goal:
                if self.all[bisect_left(self.all, exact) : bisect_right(self.all, exact)] == []:
                    tried |= {exact} - self.inside
                    self.inside.add(exact)
                if self.count(exact, unit) > limit:
                    break
                if self.count(exact, b) >= want or exact - 1 <= a:
                    return exact
                exact = self._aligned(exact - 1, a)
            self.inside -= tried
        if start is None or self.count(start, unit) > limit:
            later = self.all[i] if i < len(self.all) and self.all[i] <= b else b
            if later - goal <= WIDEN and self.count(later, unit) <= limit and (later < b or start is not None):
                return later
            start = min(b, self._aligned(goal, a))
            if start < b and start not in self.all[bisect_left(self.all, start) : bisect_right(self.all, start)]:
                self.inside.add(start)
        while start < b and (over := self.count(start, unit) - limit) > 0:
            start = min(b, self._aligned(min(b, start + over), start))
            if start < b:
                self.inside.add(start)
        return start

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(first byte, end byte, tokens, tokens shared with the piece before) of each piece, in order."""
        if not self.n:
            return []
        self.inside = set()
        units: list[int] = []
        self._units(0, self.n, SECTION, limit - overlap, units)
        out, i, begin, prior = [], 0, 0, 0
        while i < len(units):
            start = self._overlap(prior, begin, overlap, units[i], limit) if out else begin
            top = bisect_right(units, start + limit) - 1
            if self.inside:
                while i < top and self.count(start, units[i + 1]) <= limit:
                    i += 1
            else:
                i = max(i, top)
            end = units[i]
            out.append((int(self.at[start]), int(self.at[end]), self.count(start, end), self.count(start, begin) if start < begin else 0))
            prior, begin, i = start, end, i + 1
        return out


def cut_text(text: str | None, limits: Sequence[tuple[int, int]], path: str = VOCABULARY) -> list[int]:
    """For each (limit, overlap) in turn its pieces as eight numbers each: number of the limit, of the piece, first and end character, tokens, shared tokens, first and end byte."""
    if not text:
        return []
    t, out, ascii_only = Text(text, path), [], text.isascii()
    if not ascii_only:  # characters before each byte
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(t.raw, np.uint8) & 0xC0) != 0x80)])
    for i, (limit, overlap) in enumerate(limits):
        p = np.array(t.pieces(limit, overlap), np.int64).reshape(-1, 4)
        rows = np.empty((len(p), 8), np.int64)
        rows[:, 0], rows[:, 1], rows[:, 6:], rows[:, 4:6] = i, np.arange(len(p)), p[:, :2], p[:, 2:]
        rows[:, 2:4] = p[:, :2] if ascii_only else chars[p[:, :2]]
        out.append(rows.ravel())
    return np.concatenate(out) if out else []


def cut_texts(documents: DataFrame, limits: Mapping[str, tuple[int, int]], path: str = VOCABULARY) -> DataFrame:
    """(limit_name, doc_id, piece_no, start_char, end_char, n_tokens, overlap_tokens, piece) for every piece of every text and limit.

    ``limits`` maps names to (max_tokens, overlap_tokens) with an overlap below the
    limit. Pieces number from 0; without their overlaps they join to the text.
    ``overlap_tokens`` is what a piece shares with the one before: at least the
    wanted number, up to a word more, or less where the next unit needs the room.
    Null and empty texts have no pieces, texts within the limit one. Further
    columns are ignored. Only piece bounds come back from Python; the text itself
    stays where it is and is cut there.
    """
    for name, (limit, overlap) in limits.items():
        if not 0 <= overlap < limit:
            raise ValueError(f"{name}: the overlap must be below the limit")
    pairs, names = list(limits.values()), list(limits)

    @F.pandas_udf("array<long>")
    def bounds(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, pairs, path) for t in texts])

    bounds = bounds.asNondeterministic()  # else the optimizer evaluates it once for every use of its result

    flat = documents.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''").withColumn("b", bounds("text"))
    # The text is bound once as bytes, where a piece is found without counting characters, and left behind before the rows multiply.
    row = ", ".join(f"b[8 * i + {k}] AS {c}" for k, c in enumerate("lksent"))
    piece = "cast(substring(t, cast(b[8 * i + 6] + 1 as int), cast(b[8 * i + 7] - b[8 * i + 6] as int)) as string) AS p"
    pieces = f"transform(array(cast(text as binary)), t -> transform(sequence(0, cast(size(b) / 8 as int) - 1), i -> struct({row}, {piece})))[0]"
    each = flat.filter("size(b) > 0").select("doc_id", F.expr(pieces).alias("a")).select("doc_id", F.explode("a").alias("x"))
    return each.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("x.l") + 1).cast("int")).alias("limit_name"), "doc_id", F.col("x.k").cast("int").alias("piece_no"),
        F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char"), F.col("x.n").alias("n_tokens"), F.col("x.t").alias("overlap_tokens"), F.col("x.p").alias("piece"),
    )
