"""Problem 7: held-out passages inside corpus texts, by winnowing.

Texts become words as a reader reads them, words become 64-bit hashes, and of
every W consecutive K-word hashes the least is a fingerprint on both sides. Any
run of K + W - 1 equal words shares one. Fingerprints of both sides are joined and
hits extended to both sides, over at most one changed, missing or added word.
A held-out set of bounded size is sent to the tasks as an index, so that nothing
about the documents is shuffled but the result; a larger one is joined by shuffling.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.plans.lineage import Scratch

#: A case is a stretch of MIN_WORDS words with one edit, so one of its two exact runs has at least (MIN_WORDS - 1 + 1) // 2 words.
MIN_WORDS, K = 22, 8
W = MIN_WORDS // 2 - K + 1
#: Words of held-out items that go to the tasks as an index; larger sets are joined.
BLOCK_WORDS = 2_000_000
CHUNK = 1 << 20

#: Letters of other scripts that look like Latin ones. Fixed values.
ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "А": "a", "В": "b", "Е": "e", "Ё": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "Ѕ": "s", "І": "i", "Ї": "i", "Ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ɑ": "a",
}
_ALIKE = str.maketrans(ALIKE)
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|sub|sup|code|font|mark|small|tt|kbd|del|ins|q|cite|abbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--[^<>]*-->")
_LINK = re.compile(r"\]\([^()\s]*\)")
_BREAK = re.compile(r"(?<=[^\W_])-[ \t]*\r?\n[ \t>|*#]*(?=[^\W_])")
_UNSEEN = re.compile("[\\u0300-\\u036f\\u00ad\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u2066-\\u206f\\ufe00-\\ufe0f\\ufeff]")
_NO_WORD = re.compile(r"[^\w\s|]+")
_TABLE = bytes(ord(" ") if c <= 32 or c in (ord("|"), 127) else ord(chr(c).lower()) if c < 128 else c for c in range(256))
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "|")


def plain(text: str | None) -> bytes:
    """The text's words as a reader reads them, lower case, without punctuation and markup, with blanks between them, in UTF-8."""
    if not text:
        return b""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).translate(_ALIKE)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _BREAK.sub("", text)
    if not text.isascii():
        text = " ".join(_NO_WORD.sub("", _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).casefold()).split())
    return text.encode("utf-8", "replace").translate(_TABLE, _DROP)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)]))
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``plain`` bytes. Works in slices cut at blanks, so memory stays small for any length."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = at + CHUNK
        end = len(data) if end >= len(data) or (found := data.find(b" ", end)) < 0 else found
        b = np.frombuffer(data, np.uint8, end - at, at)
        blank = np.concatenate([[True], b == 32])
        s = np.flatnonzero(blank[:-1] & ~blank[1:])
        if len(s):
            length = np.diff(np.append(s, len(b)))
            within = np.arange(s[0], len(b)) - np.repeat(s, length)
            body = b[s[0] :].astype(np.uint64)
            body[body == 32] = 0  # blanks add nothing
            hashes.append(_mix(np.add.reduceat(body * _powers(int(length.max()) + 1)[within], s - s[0])))
            starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def fingerprints(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints; ``owner`` numbers the text of each word, and no window leaves its text."""
    n = len(words) - K - W + 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(words) - K + 1, np.uint64)
    for j in range(K):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(grams)]
    grams = _mix(grams)
    shifted = np.stack([grams[W - 1 - o : W - 1 - o + n] for o in range(W)])  # rightmost first, so ties take it
    at = np.arange(n) + W - 1 - shifted.argmin(0)
    at = at[owner[:n] == owner[K + W - 2 : K + W - 2 + n]]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, grams[at]


def _run(a: np.ndarray, i: int, b: np.ndarray, j: int, step: int) -> int:
    """Equal words from a[i] and b[j] on, forwards or backwards, up to 2 * MIN_WORDS."""
    n = min(2 * MIN_WORDS, len(a) - i, len(b) - j) if step > 0 else min(2 * MIN_WORDS, i + 1, j + 1)
    if n <= 0:
        return 0
    x, y = (a[i : i + n], b[j : j + n]) if step > 0 else (a[i - n + 1 : i + 1][::-1], b[j - n + 1 : j + 1][::-1])
    off = np.flatnonzero(x != y)
    return int(off[0]) if len(off) else n


def stretch(doc: np.ndarray, p: int, item: np.ndarray, q: int) -> int:
    """Words of the longest stretch of the item around equal words doc[p] and item[q] with at most one word changed, missing or added inside it."""
    left, right = _run(doc, p - 1, item, q - 1, -1), _run(doc, p, item, q, 1)
    best = left + right
    for step, i, j in ((1, p + right, q + right), (-1, p - 1 - left, q - 1 - left)):
        for di, dj in ((step, step), (0, step), (step, 0)):
            if more := _run(doc, i + di, item, j + dj, step):
                best = max(best, left + right + more + (dj != 0))
    return best


class Items:
    """Fingerprints and words of one block of held-out items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.words = [word_hashes(plain(t))[0] for _, t in rows]
        found = [fingerprints(w, np.zeros(len(w), np.int8)) for w in self.words]
        keys = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner = np.repeat(np.arange(len(rows)), [len(h) for _, h in found])[order]
        self.at = np.concatenate([p for p, _ in found])[order] if found else np.zeros(0, np.int64)

    def leaks(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(index of text, item id) of every case in the ``plain`` texts."""
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        words, starts = word_hashes(b" ".join(texts))
        owner = np.searchsorted(offsets, starts, "right") - 1
        at, keys = fingerprints(words, owner)
        if not len(at) or not len(self.keys):
            return
        lo = np.searchsorted(self.keys, keys, "left")
        hit = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == keys)
        done, tested = set(), {}
        for h in hit:
            p, text = int(at[h]), int(owner[at[h]])
            first, last = np.searchsorted(owner, [text, text + 1])
            doc = words[first:last]
            for x in range(int(lo[h]), int(np.searchsorted(self.keys, keys[h], "right"))):
                i, q = int(self.owner[x]), int(self.at[x])
                if (text, i) in done or tested.get((text, i, p - q), -1) >= p:
                    continue
                item = self.words[i]
                tested[text, i, p - q] = p + _run(doc, p - first, item, q, 1) - K  # later hits within this run say the same
                if stretch(doc, p - first, item, q) >= MIN_WORDS:
                    done.add((text, i))
                    yield text, self.ids[i]


def _word_batches(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Indexes of texts, their words and the text of each word (by its place among the indexes), some CHUNK bytes at a time."""
    at, waiting, size = [], [], 0
    for i, t in enumerate(texts):
        at.append(i)
        waiting.append(plain(t))
        size += len(waiting[-1])
        if size >= CHUNK or i == len(texts) - 1:
            offsets = np.cumsum([0, *[len(t) + 1 for t in waiting]])
            words, starts = word_hashes(b" ".join(waiting))
            yield at, words, np.searchsorted(offsets, starts, "right") - 1
            at, waiting, size = [], [], 0


def _marks(df: DataFrame, name: str) -> DataFrame:
    """(name_id, key, name_at) for every fingerprint of the texts of (name_id, text); ``name_at`` is the word where it starts."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, words, owner in _word_batches(b.column(1).to_pylist()):
                place, keys = fingerprints(words, owner)
                first = np.searchsorted(owner, owner[place])
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(at, int)[owner[place]]], pa.int64()), pa.array(keys.view(np.int64)), pa.array((place - first).astype(np.int32))], [f"{name}_id", "key", f"{name}_at"])

    return df.mapInArrow(run, f"{name}_id bigint, key bigint, {name}_at int")


def _around(df: DataFrame, name: str) -> DataFrame:
    """(name_id, name_at, name_left, name_words): the words around each place of (name_id, text, places), and how many come before it; enough for ``stretch`` to say whether there are MIN_WORDS."""

    def run(batches):
        for b in batches:
            ids, places, out = b.column(0).to_pylist(), b.column(2).to_pylist(), ([], [], [], [])
            for i, text in enumerate(b.column(1).to_pylist()):
                words = word_hashes(plain(text))[0]
                for p in places[i]:
                    lo = max(0, p - 2 * MIN_WORDS - 2)
                    for column, x in zip(out, (ids[i], p, p - lo, words[lo : p + 2 * MIN_WORDS + 2].tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], [f"{name}_id", f"{name}_at", f"{name}_left", f"{name}_words"])

    return df.mapInArrow(run, f"{name}_id bigint, {name}_at int, {name}_left int, {name}_words binary")


@F.pandas_udf(T.BooleanType())
def _holds(doc: pd.Series, p: pd.Series, item: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series([stretch(np.frombuffer(d, np.uint64), int(i), np.frombuffer(t, np.uint64), int(j)) >= MIN_WORDS for d, i, t, j in zip(doc, p, item, q)], dtype=bool)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The cases by a join of fingerprints, for held-out sets of any size: equal items are one, and only words around hits travel."""
    scratch = Scratch(docs.sparkSession, "leaks")
    given = scratch.write(items.groupBy("text").agg(F.min("item_id").alias("class_id")))
    classes = given.select("class_id", "text")
    marks = _marks(docs, "doc").join(_marks(classes, "class"), "key").select("doc_id", "doc_at", "class_id", "class_at").distinct()
    hits = scratch.write(marks)
    of = lambda name, texts: _around(texts.join(hits.groupBy(f"{name}_id").agg(F.collect_set(f"{name}_at").alias("places")), f"{name}_id").select(f"{name}_id", "text", "places"), name)
    full = hits.join(of("doc", docs), ["doc_id", "doc_at"]).join(of("class", classes), ["class_id", "class_at"])
    found = full.filter(_holds("doc_words", "doc_left", "class_words", "class_left")).select("doc_id", "class_id").distinct()
    return found.join(given, "class_id").join(items, "text").select("doc_id", "item_id").distinct()


def leaks(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id), each once, for every document that holds a case of an item.

    ``documents`` has doc_id and text, ``items`` item_id and item_text; further
    columns are ignored. Null ids and null or short texts have no cases. Ids may
    repeat. Held-out sets of up to about ``block_words`` words go to the tasks as an
    index, which meets the documents in one scan; for larger ones the fingerprints of
    both sides are shuffled and joined, and the words around each hit decide. Both
    ways give the same rows. Without items or documents there are none.
    """
    spark = documents.sparkSession
    docs = documents.selectExpr("cast(doc_id as bigint) AS doc_id", "text").dropna()
    held = items.selectExpr("cast(item_id as bigint) AS item_id", "item_text AS text").dropna()
    if (held.agg(F.sum(F.length("text"))).first()[0] or 0) > 2 * block_words:
        return _joined(docs, held)
    index = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in held.collect()]))  # at most block_words words

    def scan(batches):
        for batch in batches:
            ids, found, waiting, size = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                waiting.append((doc, plain(text.as_py())))
                size += len(waiting[-1][1])
                if size >= CHUNK:
                    for at, item in index.value.leaks([t for _, t in waiting]):
                        ids.append(waiting[at][0])
                        found.append(item)
                    waiting, size = [], 0
            for at, item in index.value.leaks([t for _, t in waiting]):
                ids.append(waiting[at][0])
                found.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return docs.mapInArrow(scan, "doc_id bigint, item_id bigint").distinct()
