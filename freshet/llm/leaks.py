"""Evaluation passages that leaked into a corpus: n-gram sets over normalised words.

The test side is made into a table of all its n-grams of words, kept by hash; it is small by nature (its size is checked) and goes to
every worker. Texts are read once: normalised, cut into words, every word replaced by its number in the test vocabulary (0: unknown),
and all windows of n known words are hashed at once over many texts. A hash that is in the set is a candidate; the words themselves are
then compared, so nothing is reported by chance. Spans are found, and cut out, in that same pass.

A test side beyond MAX_NGRAMS is never sent whole: workers get a Bloom filter of its hashes, of a fixed size, and only the windows that
pass it meet the test side's n-grams in a join by hash. Both ways give the same windows, hence the same documents, items and spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = 13
MAX_NGRAMS = 2_000_000  # about 100 MB of hashes and places on each worker; beyond that grams are matched by a shuffle
_WORD = re.compile(r"[^\W_]+")
_DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> str:
    """Compatibility decomposition and case folding, without combining marks and invisible format characters."""
    if text.isascii():
        return text.lower()
    x = unicodedata.normalize("NFKD", text).casefold()
    return _DROPPED.sub("", unicodedata.normalize("NFKD", x))


def words(text: str) -> list[str]:
    """Runs of letters and digits of the normalised text."""
    return _WORD.findall(normalised(text))


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """Words with the part text[start:end] of the original they come from; marks and format characters at a word's edge go with it."""
    if text.isascii():
        return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text.lower())]
    out: list[tuple[str, int, int]] = []
    cur, start, end = [], 0, 0
    for i, ch in enumerate(text):
        x = ch.lower() if ch.isascii() else unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold())
        dropped = bool(x) and _DROPPED.fullmatch(x) is not None
        if dropped:
            if cur:
                end = i + 1
            continue
        for y in _DROPPED.sub("", x):
            if y.isalnum():
                if not cur:
                    start = i
                cur.append(y)
                end = i + 1
            elif cur:
                out.append(("".join(cur), start, end))
                cur = []
    if cur:
        out.append(("".join(cur), start, end))
    return out


def placed_at(text: str, need: Iterable[int]) -> dict[int, tuple[int, int]]:
    """Part of the text that the words of these numbers come from. Line breaks separate words, so only lines that hold one are gone through
    character by character."""
    out, left = {}, sorted(set(need), reverse=True)
    base = at = 0
    for line in text.split("\n"):
        if not left:
            break
        n = len(words(line))
        if left[-1] < base + n:
            place = placed_words(line)
            while left and left[-1] < base + n:
                _, s, e = place[left[-1] - base]
                out[left.pop()] = (s + at, e + at)
        base, at = base + n, at + len(line) + 1
    return out


def hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n numbers (wrapping arithmetic); len(ids) - n + 1 values."""
    m = len(ids) - n + 1
    h = np.zeros(max(m, 0), np.uint64)
    if m > 0:
        x = ids.astype(np.uint64)
        x = (x ^ (x >> np.uint64(7))) * _BASE
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + x[j : j + m]
    return h


class TestSet:
    """All n-grams of the test items: sorted hashes, and for each where it occurs."""

    def __init__(self, items: Iterable[tuple[int, str | None]], n: int) -> None:
        self.n, self.vocabulary = n, {}
        seqs, owner = [], []
        for item, text in items:
            ws = words(text or "")
            if len(ws) >= n:
                seqs.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64))
                owner.append(item)
        self.words = np.concatenate(seqs) if seqs else np.empty(0, np.int64)
        starts = np.cumsum([0, *map(len, seqs)])
        at = [np.arange(s, s + len(q) - n + 1) for s, q in zip(starts, seqs)]
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)
        self.item = np.concatenate([np.full(len(a), o, np.int64) for a, o in zip(at, owner)]) if at else np.empty(0, np.int64)
        h = hashes(self.words, n)[self.at] if len(self.at) else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.at, self.item = h[order], self.at[order], self.item[order]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of every verified n-gram. ids: numbers of words, 0 for words that no test item has and between texts."""
        n = self.n
        if len(ids) < n or not len(self.hash):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        window = np.flatnonzero(unknown[n:] == unknown[:-n])
        if not len(window):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = hashes(ids, n)[window]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        found = hi > lo
        window, lo, hi = window[found], lo[found], hi[found]
        w = np.repeat(window, hi - lo)
        g = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]) if len(lo) else np.empty(0, np.int64)
        span = np.arange(n)
        same = (ids[w[:, None] + span] == self.words[self.at[g][:, None] + span]).all(1)
        return w[same], self.item[g[same]]


SPAN = "id long, item_id long, span_start long, span_end long"
CHUNK_CHARS = 4_000_000


def _windows(test: TestSet, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, first word) of every verified window, for so many characters of texts at a time."""
    get, at = test.vocabulary.get, 0
    while at < len(texts):
        flat: list[int] = []
        begin, chars, first = [], 0, at
        while at < len(texts) and (at == first or chars < CHUNK_CHARS):
            t = texts[at] or ""
            begin.append(len(flat))
            flat.extend([get(w, 0) for w in words(t)])
            flat.append(0)
            chars += len(t)
            at += 1
        w, item = test.hits(np.array(flat, np.int64))
        if len(w):
            begin = np.array(begin)
            row = np.searchsorted(begin, w, "right") - 1
            yield first + row, item, w - begin[row]


def _spans_of_text(text: str, item: np.ndarray, w: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(item, start, end) in characters. Windows of an item that overlap or touch are one span."""
    runs = []
    for i in np.unique(item):
        at = np.unique(w[item == i])
        new = np.flatnonzero(np.diff(at, prepend=-(10**9)) > n)
        runs += [(int(i), int(s), int(e)) for s, e in zip(at[new], at[np.append(new[1:], len(at)) - 1] + n - 1)]
    place = placed_at(text, (x for _, s, e in runs for x in (s, e)))
    return [(i, place[s][0], place[e][1]) for i, s, e in runs]


def _by_row(row: np.ndarray, item: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(row, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
        yield int(row[part[0]]), item[part], w[part]


def _scan(test: TestSet, spans: bool):
    target = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), *([("span_start", pa.int64()), ("span_end", pa.int64())] if spans else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            for row, item, w in _windows(test, texts):
                if spans:
                    rows = [(doc[r], *x) for r, of, at in _by_row(row, item, w) for x in _spans_of_text(texts[r], of, at, test.n)]
                else:
                    rows = [(doc[r], i) for r, i in np.unique(np.stack([row, item], 1), axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=target)

    return run


def _cut(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the spans (in order of start); what overlaps is cut once."""
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at : max(at, s)])
        at = max(at, e)
    return "".join([*kept, text[at:]])


def _test_set(items: DataFrame, item_id: str, passage: str, n: int) -> TestSet | None:
    """The test side on the driver if it is small enough to be sent to every worker, else None. Checked before anything is collected."""
    size = items.agg(F.sum(F.length(F.col(f"`{passage}`")))).first()[0] or 0
    if size > MAX_NGRAMS * 2:  # a word and what divides it take two characters at least
        return None
    return TestSet(((r[0], r[1]) for r in items.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{passage}`")).where(F.col(f"`{item_id}`").isNotNull()).collect()), n)


# --- test sides of any size

BLOOM_BITS = 27  # 2^27 bits are 16 MB on each worker, however large the test side
_GRAM = T.StructType([T.StructField("k", T.LongType()), T.StructField("version", T.LongType()), *(T.StructField(x, T.LongType()) for x in ("w", "span_start", "span_end", "h")), T.StructField("gram", T.StringType())])


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the Bloom filter that a hash goes to, and its three bits there."""
    word = (h >> np.uint64(64 - BLOOM_BITS + 6)).astype(np.int64)
    one, six = np.uint64(1), np.uint64(63)
    return word, (one << (h & six)) | (one << ((h >> np.uint64(6)) & six)) | (one << ((h >> np.uint64(12)) & six))


def _text_grams(n: int, bloom: np.ndarray | None, placed: bool):
    """mapInArrow: the windows of each text as rows of _GRAM; with a filter only those that may be in it. Words are hashed by themselves, so
    both sides agree without a vocabulary."""
    from xxhash import xxh3_64_intdigest

    target = pa.schema([(f.name, pa.string() if f.name == "gram" else pa.int64()) for f in _GRAM])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for k, version, t in zip(b.column("k").to_pylist(), b.column("version").to_pylist(), b.column("t").to_pylist()):
                ws = words(t)
                if len(ws) < n:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                ids = np.array([seen[w] if w in seen else seen.setdefault(w, xxh3_64_intdigest(w)) for w in ws], np.uint64)
                h = hashes(ids, n)
                h = (h ^ (h >> np.uint64(31))) * _BASE
                at = np.arange(len(h))
                if bloom is not None:
                    word, mask = _bits(h)
                    at = np.flatnonzero(bloom[word] & mask == mask)
                if not len(at):
                    continue
                place = placed_at(t, (int(i) for x in (at, at + n - 1) for i in x)) if placed else None
                for x in np.split(at, range(10_000, len(at), 10_000)):
                    start = [place[int(i)][0] for i in x] if place else [None] * len(x)
                    end = [place[int(i) + n - 1][1] for i in x] if place else [None] * len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(([k] * len(x), [version] * len(x), x, start, end, h[x].view(np.int64), [" ".join(ws[i : i + n]) for i in x]), target)],
                        schema=target,
                    )

    return run


def _filter_of(grams: DataFrame) -> np.ndarray:
    """Bloom filter of the hashes of the test side: at most 2^BLOOM_BITS bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, mask = _bits(b.column("h").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    bits = grams.select("h").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    out[bits.column("word").to_numpy()] = bits.column("mask").to_numpy().view(np.uint64)
    return out


def _matched(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int, placed: bool) -> DataFrame:
    """k (document), version (hash of its text, so that rows of one id stay apart), w, span_start, span_end, i (item): windows of documents
    that an item has. The join also compares the words."""
    side = lambda df, k, t: df.select(F.col(f"`{k}`").cast("long").alias("k"), F.xxhash64(F.col(f"`{t}`")).alias("version"), F.col(f"`{t}`").alias("t")).where("k is not null and t is not null")
    test = side(items, item_id, passage).mapInArrow(_text_grams(n, None, False), _GRAM).select("k", "h", "gram").distinct()
    bloom = docs.sparkSession.sparkContext.broadcast(_filter_of(test))
    scan = lambda batches: _text_grams(n, bloom.value, placed)(batches)
    found = side(docs, doc_id, text).mapInArrow(scan, _GRAM)
    return found.join(test.withColumnRenamed("k", "i"), ["h", "gram"]).select("k", "version", "w", "span_start", "span_end", "i")


def _matched_spans(*sides, n: int) -> DataFrame:
    """id, version, item_id, span_start, span_end. A window over one document's and item's windows, at most as many as the text has words."""
    from pyspark.sql import Window

    by = Window.partitionBy("k", "version", "i").orderBy("w")
    x = _matched(*sides, n=n, placed=True).distinct()
    x = x.withColumn("new", F.when(F.col("w") - F.lag("w").over(by) <= n, 0).otherwise(1)).withColumn("no", F.sum("new").over(by))
    return x.groupBy(F.col("k").alias("id"), "version", F.col("i").alias("item_id"), "no").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("no")


# --- what is asked for


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int = N) -> DataFrame:
    """`doc_id`, `item_id`: documents that hold at least n consecutive words of an item's passage.

    NULL and empty texts and passages match nothing, nor do passages of fewer than n words; rows whose id is NULL are left out.
    Repeated rows give one result. Texts are read whole, however long. The test side may have any size.
    """
    test = _test_set(items, item_id, passage, n)
    if test is None:
        found = _matched(docs, doc_id, text, items, item_id, passage, n, placed=False).select(F.col("k").alias("id"), F.col("i").alias("item_id"))
    else:
        x = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
        found = x.mapInArrow(_scan(test, spans=False), "id long, item_id long")
    return found.distinct().select(F.col("id").alias(doc_id), F.col("item_id").alias(item_id))


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int = N) -> DataFrame:
    """`doc_id`, `item_id`, span_start, span_end: the characters of the text that come from the item (end exclusive). Rules as in
    leaked()."""
    test = _test_set(items, item_id, passage, n)
    if test is None:
        found = _matched_spans(docs, doc_id, text, items, item_id, passage, n=n)
    else:
        x = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
        found = x.mapInArrow(_scan(test, spans=True), SPAN)
    return found.select(F.col("id").alias(doc_id), F.col("item_id").alias(item_id), "span_start", "span_end").distinct()


def cleaned(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n: int = N) -> DataFrame:
    """All rows and columns of docs, the leaked spans cut out of `text`; what overlaps is cut once. Texts without spans stay as they are,
    and so do rows whose id is NULL. Rules as in leaked(). One pass over the texts, nothing shuffled, unless the test side exceeds
    MAX_NGRAMS: then the spans join the texts by id and hash of the text.
    """
    test = _test_set(items, item_id, passage, n)
    if test is None:
        per = _matched_spans(docs, doc_id, text, items, item_id, passage, n=n).groupBy(F.col("id").alias("_id"), F.col("version").alias("_version"))
        return _joined(docs, doc_id, text, per.agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("_spans")), versions=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.schema.get_field_index(text)
            texts = [t if d is not None else None for t, d in zip(b.column(col).to_pylist(), b.column(b.schema.get_field_index(doc_id)).to_pylist())]
            new = {}
            for row, item, w in _windows(test, texts):
                for r, of, at in _by_row(row, item, w):
                    new[r] = _cut(texts[r], sorted(x[1:] for x in _spans_of_text(texts[r], of, at, n)))
            if new:
                changed = pa.array([new.get(r, t) for r, t in enumerate(b.column(col).to_pylist())], b.schema.field(col).type)
                b = b.set_column(col, b.schema.field(col), changed)
            yield b

    return docs.mapInArrow(run, docs.schema)


def without_spans(docs: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """docs with given spans cut out of `text`: overlapping spans count once. Documents without spans stay as they are."""
    per = spans.groupBy(F.col(f"`{doc_id}`").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("_spans"))
    return _joined(docs, doc_id, text, per, versions=False)


def _joined(docs: DataFrame, doc_id: str, text: str, per: DataFrame, versions: bool) -> DataFrame:
    @F.pandas_udf("string")
    def cut(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or spans is None else _cut(x, ((y["span_start"], y["span_end"]) for y in spans)) for x, spans in zip(t, s)])

    t = F.col(f"`{text}`")
    on = F.col(f"`{doc_id}`") == F.col("_id")
    j = docs.join(per, on & (F.xxhash64(t) == F.col("_version")) if versions else on, "left")
    return j.select(*[F.when(F.col("_spans").isNotNull(), cut(t, F.col("_spans"))).otherwise(t).alias(text) if x == text else F.col(f"`{x}`") for x in docs.columns])
