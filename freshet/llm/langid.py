"""Languages of documents and of the segments of mixed ones: a linear-chain conditional random field over words.

Every word is scored for each language by the weights of its features (prefixes, suffixes, character n-grams, script, the word itself
and its membership in the languages' lexicons); learned transitions say how readily a text changes language between two words.
Forward-backward gives each word its probabilities, and a line, which is in one language, the language that its words have together.

Training: on a bounded sample of labelled documents (SAMPLE_DOCS per language, SAMPLE_LINES whole lines of each, of at most SAMPLE_CHARS
characters), documents and lines chosen by hash. Labels may be wrong and lines in another language than their document: before training,
word counts per language relabel the lines again and again until they agree, and lines that stay unsure or look garbled are left out.
Training sequences are joined from pieces of different languages, so the transitions see switches. The lexicons are part of the
classifier and come from the same sample. Everything else covers all documents and all of their text.

Text that was decoded with the wrong character set is recognised by its lexicon: if another reading of the same bytes has clearly
more known words, that reading is labelled.

Scale: one pass over the texts, nothing shuffled; a worker scores the distinct words of a batch at once, as arrays, and keeps the scores in
a cache of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "de", "fr", "es", "pt", "nl", "pl", "ru", "uk", "ja"]
MIN_LINE = 60
SAMPLE_DOCS, SAMPLE_LINES = 200, 6
SAMPLE_CHARS = 2_000  # longer lines are not trained on
MIN_DOCS = 3  # documents of the sample that must have a word of the lexicon
DIM_BITS = 16
DIMS = 1 << DIM_BITS
BATCHES, EPOCHS = 8, 5
CACHE = 200_000
BATCH_WORDS = 100_000
SCORE_CHARS = 200_000
SURE_SHARE = 0.75  # of letters in known words: no other reading is tried

# Usual notations of the languages (fixed values): ISO 639-1, 639-2/B, 639-2/T, English and own names.
NOTATIONS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands flemish",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "uk": "uk ukr ukrainian українська ua",
    "ja": "ja jpn japanese 日本語 jp",
}
NAMES = {n: k for k, v in NOTATIONS.items() for n in v.split()}
# Character sets that pages are written in or wrongly read as (fixed values).
WRITTEN_AS = ["utf-8", "cp1251", "koi8-u", "cp1250", "iso-8859-2", "cp932", "euc_jp", "iso-8859-5", "cp866"]
READ_AS = ["cp1252", "cp1251"]

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿々ー]{1,3}|[^\W\d_]+")
# the same where a line has no such letters, and where it has ASCII only
_EAST, _PLAIN_TOKEN, _ASCII_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]"), re.compile(r"[^\W\d_]+"), re.compile(r"[a-z]+")
# a lead byte of UTF-8 and a continuation byte, both read as Western European letters and signs
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")
_HIGH = re.compile("[\u0080-ÿ]")
_SUSPECT = re.compile("[\u0080-ÿƒ‚„†‡€ŠŒŽ‰Ђ-Џђ-џ�]")


def label_language(label: str | None) -> str | None:
    """The language that a label names, whatever its notation: code, code with region, or name. None if it names none."""
    parts = re.split(r"[-_;, ./()]+", (label or "").strip().casefold())
    return NAMES.get(parts[0]) if parts else None


def label_column(label: Column) -> Column:
    """label_language() as a column."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.try_element_at(names, F.element_at(F.split(F.lower(F.trim(label)), r"[-_;, ./()]+"), 1))


def tokens(line: str) -> list[str]:
    if line.isascii():
        return _ASCII_TOKEN.findall(line.lower())
    line = unicodedata.normalize("NFKC", line).lower()
    return (_TOKEN if _EAST.search(line) else _PLAIN_TOKEN).findall(line)


# Places of the weights behind the hashed features: a word's languages by the lexicons, words in none, and scripts.
_IN, _UNKNOWN, _SCRIPT = DIMS, DIMS + len(LANGUAGES), DIMS + len(LANGUAGES) + 1
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _hashed(h: np.ndarray, kind: int) -> np.ndarray:
    """Place of a feature by its hash and kind."""
    h = (h + np.uint64(kind)) * _SPREAD
    return (((h ^ (h >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of the words as pairs (place of the word, place of the weight), each in order of the words: affixes, n-grams, the script, the
    words that a lexicon has, and the lexicons that have it. All words are hashed at once, over one array of their characters."""
    cp = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(cp)) - start[of]
    left = size[of] - at
    out, h = [], np.zeros(len(cp), np.uint64)
    for n in range(1, 6):
        # hash of the n characters from each place on; those that reach into the next word are not used
        h = h * _BASE
        h[: max(len(cp) - n + 1, 0)] += cp[n - 1 :]
        if n <= 3:
            ok = np.flatnonzero(left >= n if n > 1 else (at > 0) & (left > 1))
            out.append((of[ok], _hashed(h[ok], n)))
        if n >= 2:
            long = np.flatnonzero(size > n)
            out += [(long, _hashed(h[start[long]], 10 + n)), (long, _hashed(h[start[long] + size[long] - n], 20 + n))]
    mask = np.array([lexicon.get(w, 0) for w in words], np.int64)
    known = np.flatnonzero(mask)
    power = np.cumprod(np.full(int(size.max()), _BASE, np.uint64))
    out.append((known, _hashed(np.add.reduceat(cp * power[at], start)[known], 30)))
    out += [(w := np.flatnonzero(mask >> k & 1), np.full(len(w), _IN + k)) for k in range(len(LANGUAGES))]
    none = np.flatnonzero(mask == 0)
    out.append((none, np.full(len(none), _UNKNOWN)))
    first = cp[start + 1]
    script = np.select([(first >= 0x3040) & (first <= 0x9FFF), (first >= 0x400) & (first <= 0x52F), first < 0x250], [0, 1, 2], 3)
    out.append((np.arange(len(words)), _SCRIPT + script))
    return out


WEIGHTS = _SCRIPT + 4


def _scored(groups: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights of each of n words."""
    out = np.zeros((n, weights.shape[1]), weights.dtype)
    for word, col in groups:
        if len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.add.reduceat(weights[col], first, axis=0) if len(first) < len(word) else weights[col]
    return out


def forward_backward(em: np.ndarray, trans: np.ndarray, length: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """em: (batch, time, language) log scores; trans: log scores. Posteriors (batch, time, language), 0 beyond a sequence's length, and
    the expected transitions summed over everything."""
    em = em.transpose(1, 0, 2)  # by time, so that a step's rows lie together
    t, b, k = em.shape
    e = np.exp(em - em.max(2, keepdims=True))
    tr = np.exp(trans).astype(e.dtype)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    one = np.ones((k, 1), e.dtype)  # row sums as products: there are few columns
    alpha[0] = e[0] / (e[0] @ one)
    for i in range(1, t):
        a = alpha[i - 1] @ tr
        a *= e[i]
        np.divide(a, a @ one, out=alpha[i])
    beta[t - 1] = 1.0
    inside = np.arange(t)[:, None] < length[None, :]
    back = np.ascontiguousarray(tr.T)
    for i in range(t - 2, -1, -1):
        x = (e[i + 1] * beta[i + 1]) @ back
        np.divide(x, x @ one, out=beta[i])
        over = ~inside[i + 1]
        if over.any():
            beta[i, over] = 1.0
    g = alpha * beta
    g /= g @ one
    g *= inside[:, :, None]
    if not pairs:
        return g.transpose(1, 0, 2), None
    if t < 2:
        return g.transpose(1, 0, 2), np.zeros((k, k))
    right = (e[1:] * beta[1:]).reshape(-1, k)
    before = alpha[:-1].reshape(-1, k)
    w = inside[1:].reshape(-1) / (((before @ tr) * right) @ one)[:, 0]
    pair = (before * w[:, None].astype(before.dtype)).T @ right * tr
    return g.transpose(1, 0, 2), pair


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, int]) -> None:
        self.weights, self.trans, self.lexicon = weights, trans, lexicon
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scored = 0
        self.scores = np.zeros((1024, len(LANGUAGES)), np.float32)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "trans": self.trans, "lexicon": self.lexicon}

    def __setstate__(self, s: dict) -> None:
        self.__init__(**s)

    def ids(self, words: list[str]) -> list[int]:
        """Places of the words in `scores`. Those that are new get theirs now and their scores by score(), all of a batch at once."""
        place = self.place
        return [place.setdefault(w, len(place)) for w in words]

    def score(self) -> None:
        have, want = self.scored, len(self.place)
        if want == have:
            return
        new = list(islice(self.place, have, None))
        if want > len(self.scores):
            grown = np.zeros((2 * want, len(LANGUAGES)), np.float32)
            grown[:have] = self.scores[:have]
            self.scores = grown
        at = 0
        while at < len(new):
            # so many characters at a time; a longer word goes alone
            n = chars = 0
            while at + n < len(new) and (n == 0 or chars + len(new[at + n]) < SCORE_CHARS):
                chars += len(new[at + n])
                n += 1
            part = new[at : at + n]
            self.scores[have + at : have + at + n] = _scored(features(part, self.lexicon), self.weights, n)
            at += n
        self.scored = want

    def posteriors(self, lines: list[list[int]]) -> np.ndarray:
        """Sum of the words' probabilities for each line (numbers of words by ids())."""
        self.score()
        out = np.zeros((len(lines), len(LANGUAGES)))
        length = np.array([len(x) for x in lines], np.int64)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        at = 0
        while at < len(order):
            # lines of like length together: at most BATCH_WORDS places at a time
            n = max(1, min(len(order) - at, 4096))
            while n > 1 and n * length[order[at + n - 1]] > BATCH_WORDS:
                n //= 2
            rows = order[at : at + n]
            at += n
            t = int(length[rows[-1]])
            idx = np.zeros((t, n), np.int64)
            idx.T[np.arange(t)[None, :] < length[rows][:, None]] = np.fromiter(chain.from_iterable(lines[r] for r in rows), np.int64, int(length[rows].sum()))
            g, _ = forward_backward(self.scores[idx].transpose(1, 0, 2), self.trans, length[rows], pairs=False) if n * t <= 4 * BATCH_WORDS else self._long(idx[:, 0])
            out[rows] = g.sum(1)
        return out

    def _long(self, ids: np.ndarray) -> tuple[np.ndarray, None]:
        """A very long line, in pieces that overlap, so that memory stays bounded and no word is without its neighbours."""
        size, edge, total = BATCH_WORDS, 100, np.zeros(len(LANGUAGES))
        for s in range(0, len(ids), size):
            a, z = max(0, s - edge), min(len(ids), s + size + edge)
            g, _ = forward_backward(self.scores[ids[a:z]][None], self.trans, np.array([z - a]), pairs=False)
            total += g[0, s - a : min(s + size, len(ids)) - a].sum(0)
        return total[None, None], None

    def known(self, words: list[str]) -> int:
        """Letters in words that some lexicon has."""
        has = self.lexicon
        return sum(len(w) for w in words if w in has)


def _train(lines: list[tuple[list[str], int]], lexicon: dict[str, int], seed: int = 5) -> Model:
    """Maximum likelihood by Adam over BATCHES parts of the lines, EPOCHS times, with a little shrinkage."""
    k = len(LANGUAGES)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for ws, _ in lines]
    label = [y for _, y in lines]
    # pieces of random length, joined in random order: one sequence holds one to four languages
    pieces = []
    for ws, y in zip(coded, label):
        at = 0
        while at < len(ws):
            n = int(rng.integers(6, 30))
            pieces.append((ws[at : at + n], y))
            at += n
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    seqs = [pieces[i : i + 3] for i in range(0, len(pieces), 3)]
    batches = [_Batch(seqs[i::BATCHES], list(vocabulary), lexicon) for i in range(BATCHES) if seqs[i::BATCHES]]
    w, trans = np.zeros((WEIGHTS, k), np.float32), np.eye(k, dtype=np.float32) * 2
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans)]
    mean_w, mean_trans, taken, step = np.zeros_like(w), np.zeros_like(trans), 0, 0
    for epoch in range(EPOCHS):
        for batch in batches:
            step += 1
            gw, gt = batch.gradient(w, trans)
            for x, grad, (m, v), shrink in ((w, gw, moments[0], 1e-6), (trans, gt, moments[1], 1e-5)):
                grad -= np.float32(shrink) * x
                m += np.float32(0.1) * (grad - m)
                v += np.float32(0.02) * (grad * grad - v)
                x += np.float32(0.15 / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.98**step)) + np.float32(1e-8))
            if epoch == EPOCHS - 1:  # the mean over the last epoch is steadier than its end
                taken += 1
                mean_w += (w - mean_w) / taken
                mean_trans += (trans - mean_trans) / taken
    return Model(mean_w, mean_trans, lexicon)


class _Batch:
    """Some of the training sequences, with the features of their words."""

    def __init__(self, seqs: list[list[tuple[np.ndarray, int]]], vocabulary: list[str], lexicon: dict[str, int]) -> None:
        k = len(LANGUAGES)
        seqs = sorted(seqs, key=lambda s: sum(len(p) for p, _ in s))
        self.length = np.array([sum(len(p) for p, _ in s) for s in seqs])
        own, flat = np.unique(np.concatenate([p for s in seqs for p, _ in s]), return_inverse=True)
        gold = np.concatenate([np.full(len(p), c) for s in seqs for p, c in s])
        self.n, self.words, self.end = len(gold), len(own), np.cumsum(self.length)
        self.flat = flat.astype(np.int64)
        self.gold_words = np.bincount(flat * k + gold, minlength=len(own) * k).reshape(-1, k)
        inner = np.ones(self.n - 1, bool)
        inner[self.end[:-1] - 1] = False
        self.gold_pairs = np.bincount((gold[:-1] * k + gold[1:])[inner], minlength=k * k).reshape(k, k)
        self.groups = features([vocabulary[i] for i in own], lexicon)
        # the same features by weight, for the gradient; and the places of the text by word
        word, col = (np.concatenate(x) for x in zip(*self.groups))
        order = np.argsort(col, kind="stable")
        self.word, col = word[order], col[order]
        self.first = np.flatnonzero(np.diff(col, prepend=-1))
        self.col = col[self.first]
        self.by_word = np.argsort(self.flat, kind="stable")
        self.first_of_word = np.flatnonzero(np.diff(self.flat[self.by_word], prepend=-1))

    def gradient(self, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log likelihood of a word."""
        em = _scored(self.groups, w, self.words)
        prob, pair = np.empty((self.n, len(LANGUAGES)), np.float32), np.zeros((len(LANGUAGES),) * 2)
        for at in range(0, len(self.length), 1024):
            length = self.length[at : at + 1024]
            a, z = self.end[at] - length[0], self.end[at + len(length) - 1]
            here = np.arange(length[-1])[None, :] < length[:, None]
            part = np.zeros(here.shape, np.int64)
            part[here] = self.flat[a:z]
            g, p = forward_backward(em[part.T].transpose(1, 0, 2), trans, length)
            prob[a:z] = g[here]
            pair += p
        d = self.gold_words - np.add.reduceat(prob[self.by_word], self.first_of_word, axis=0)
        gw = np.zeros_like(w)
        gw[self.col] = np.add.reduceat(d.astype(np.float32)[self.word], self.first, axis=0) / np.float32(self.n)
        return gw, ((self.gold_pairs - pair) / self.n).astype(np.float32)


def _garbled(line: str) -> bool:
    return "�" in line or len(_HIGH.findall(line)) > 0.25 * len(line) or _MOJIBAKE.search(line) is not None


def _relabelled(lines: list[tuple[list[str], int, int]], rounds: int = 8) -> list[tuple[list[str], int, int]]:
    """(words, language, document): lines under the language that the words of all lines give them, until nothing changes; without
    those that stay unsure. Words in few documents have no say, so a wrong label can't vouch for itself."""
    k = len(LANGUAGES)
    seen: dict[str, set[int]] = {}
    for ws, _, doc in lines:
        for w in set(ws):
            seen.setdefault(w, set()).add(doc)
    place = {w: i for i, w in enumerate(w for w, d in seen.items() if len(d) >= MIN_DOCS)}
    coded = [np.array([place[w] for w in ws if w in place], np.int64) for ws, _, _ in lines]
    y = np.array([c for _, c, _ in lines], np.int64)
    flat, of = np.concatenate([*coded, np.empty(0, np.int64)]), np.repeat(np.arange(len(coded)), [len(x) for x in coded])
    sure = np.zeros(len(y), bool)
    for _ in range(rounds):
        n = np.zeros((len(place), k))
        np.add.at(n, (flat, y[of]), 1)
        p = np.log((n + 0.1) / (n.sum(0) + 0.1 * len(place)))
        score = np.zeros((len(y), k))
        np.add.at(score, of, p[flat])
        new = np.where(np.bincount(of, minlength=len(y)) > 0, score.argmax(1), y)
        top = np.sort(score, 1)
        sure = top[:, -1] - top[:, -2] > 5
        if (new == y).all():
            break
        y = new
    return [(ws, int(c), doc) for (ws, _, doc), c, s in zip(lines, y, sure) if s]


def _lexicon(lines: list[tuple[list[str], int, int]]) -> dict[str, int]:
    """Words in at least MIN_DOCS documents of a language, as bits of the languages in which they are frequent."""
    docs: list[dict[str, set[int]]] = [{} for _ in LANGUAGES]
    for ws, y, doc in lines:
        for w in set(ws):
            docs[y].setdefault(w, set()).add(doc)
    total = [max(1, len(set().union(*d.values()))) for d in docs]
    out: dict[str, int] = {}
    for w in sorted(set().union(*docs)):
        share = [len(d[w]) / n if len(d.get(w, ())) >= MIN_DOCS else 0.0 for d, n in zip(docs, total)]
        top = max(share)
        if top:
            out[w] = sum(1 << i for i, s in enumerate(share) if s > 0.25 * top)
    return out


def fit(sample: list[tuple[str, list[str]]]) -> Model:
    """sample: (language of the label, lines) of each document. Without any usable line all languages are equally likely."""
    lines = [(tokens(x), LANGUAGES.index(lang), doc) for doc, (lang, xs) in enumerate(sample) for x in xs if not _garbled(x)]
    lines = _relabelled([x for x in lines if len(x[0]) >= 3])
    if not lines:
        return Model(np.zeros((WEIGHTS, len(LANGUAGES)), np.float32), np.zeros((len(LANGUAGES),) * 2), {})
    return _train([(ws, y) for ws, y, _ in lines], _lexicon(lines))


def sample(docs: DataFrame, doc_id: str, text: str, label: str) -> list[tuple[str, list[str]]]:
    """SAMPLE_DOCS documents per language of the label (all, if there are fewer), those with the smallest hashes of id and text; of each at
    most SAMPLE_LINES whole counted lines of at most SAMPLE_CHARS characters, by hash as well.

    However many documents a language has, the hash's range is 63 bits wide, so the share that is asked for doesn't vanish; if a language
    that labels name comes out without any document all the same, that is an error.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"), label_column(F.col(f"`{label}`")).alias("y"))
    count = {r[0]: r[1] for r in named.where("y is not null").groupBy("y").count().collect()}  # a row per language
    if not count:
        return []
    place = F.shiftrightunsigned(F.xxhash64("id", F.length("t")), 1)
    chosen = F.lit(False)
    for y, n in sorted(count.items()):
        chosen = chosen | ((F.col("y") == y) & (place <= sample_limit(n)))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(x).between(MIN_LINE, SAMPLE_CHARS))
    some = F.transform(F.slice(F.array_sort(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, SAMPLE_LINES), lambda x: x["x"])
    rows = named.where(chosen).select("y", place.alias("h"), "id", F.coalesce(some, F.array().cast("array<string>")).alias("lines"))
    by: dict[str, list] = {}
    for r in rows.collect():  # about 1.5 * SAMPLE_DOCS rows per language
        by.setdefault(r["y"], []).append((r["h"], r["id"] is None, r["id"] or 0, list(r["lines"])))
    if missing := sorted(set(count) - set(by)):
        raise RuntimeError(f"no sample of labelled documents for {missing}")
    return [(y, x[3]) for y in sorted(by) for x in sorted(by[y])[:SAMPLE_DOCS]]


def sample_limit(n: int) -> int:
    """The largest of the 63-bit hashes that are looked at where n documents have a label: half as many again as are taken, or all."""
    return (1 << 63) - 1 if n <= 1.5 * SAMPLE_DOCS else ((1 << 63) * 3 * SAMPLE_DOCS) // (2 * n)


def _bytes(text: str, charset: str) -> bytes:
    """Inverse of a wrong reading: what the charset lacks is taken for a byte of its own value."""
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(charset)
            except UnicodeEncodeError:
                out += bytes([ord(ch)]) if ord(ch) < 256 else b"?"
        return bytes(out)


def repaired(model: Model, lines: list[str]) -> list[list[str]]:
    """Tokens of the lines; of garbled text those of the reading that has the most known words."""
    plain = [tokens(x) for x in lines]
    joined = "\n".join(lines)
    if joined.isascii() or not _SUSPECT.search(joined):
        return plain
    total = sum(len(w) for ws in plain for w in ws)
    base = sum(model.known(ws) for ws in plain)
    if base > SURE_SHARE * total:
        return plain
    best, best_share = None, (base / total if total else 0.0) + 0.05
    for read in READ_AS:
        raw = _bytes(joined, read)
        for written in WRITTEN_AS:
            if written == read:
                continue
            other = raw.decode(written, "replace")
            parts = other.split("\n")
            if len(parts) != len(lines):
                continue
            toks = [tokens(x) for x in parts]
            n = sum(len(w) for ws in toks for w in ws)
            share = sum(model.known(ws) for ws in toks) / n if n else 0.0
            if share > best_share:
                best, best_share = toks, share
                if share > SURE_SHARE:
                    return best
    return best or plain


SEGMENT = "id long, segment_no int, lang string, confidence double, n_chars long, main_lang string, n_langs int, named string"


def segments(docs: DataFrame, doc_id: str, text: str, label: str, model: Model) -> DataFrame:
    """`doc_id`, segment_no, lang, confidence, n_chars, main_lang (the document's main language), n_langs, named (the language
    that the label names, NULL if none).

    Lines of at least MIN_LINE characters count; successive ones in one language are a segment. The main language is that of most
    characters, of equal ones the one that comes first. Confidence is the mean probability of the segment's words. NULL and empty
    texts, and texts without a counted line, have no segments; a counted line without any letter goes with the line before it, or
    the one after it if it is the first. Repeated rows give repeated results.
    """
    target = pa.schema([("id", pa.int64()), ("segment_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_chars", pa.int64()), ("main_lang", pa.string()), ("n_langs", pa.int32()), ("named", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                yield from labelled(big.slice(at, 256))

    def labelled(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(model.place) > CACHE:
            model.clear()
        of, chars, ids = [], [], []
        for row, t in enumerate(b.column("text").to_pylist()):
            lines = [x for x in t.split("\n") if len(x) >= MIN_LINE]
            if lines:
                of += [row] * len(lines)
                chars += [len(x) for x in lines]
                ids += [model.ids(ws) for ws in repaired(model, lines)]
        if not of:
            return
        p = model.posteriors(ids)
        out: dict[str, list] = {f.name: [] for f in target}
        doc, named = b.column("id").to_pylist(), b.column("named").to_pylist()
        i = 0
        while i < len(of):
            j = i
            while j < len(of) and of[j] == of[i]:
                j += 1
            for k, x in zip(out, zip(*((*r, named[of[i]]) for r in _of_document(doc[of[i]], p[i:j], chars[i:j])))):
                out[k] += x
            i = j
        yield pa.RecordBatch.from_pydict(out, schema=target)

    x = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), label_column(F.col(f"`{label}`")).alias("named")).where(F.col("text").isNotNull() & (F.length("text") >= MIN_LINE))
    return x.mapInArrow(run, SEGMENT).withColumnRenamed("id", doc_id)


def _of_document(doc: int | None, p: np.ndarray, chars: list[int]) -> list[tuple]:
    lang = np.where(p.sum(1) > 0, p.argmax(1), -1)
    for i in range(1, len(lang)):
        if lang[i] < 0:
            lang[i] = lang[i - 1]
    for i in range(len(lang) - 2, -1, -1):
        if lang[i] < 0:
            lang[i] = lang[i + 1]
    if lang[0] < 0:
        return []
    size: dict[int, int] = {}
    for x, n in zip(lang.tolist(), chars):
        size[x] = size.get(x, 0) + n
    main = max(size, key=size.__getitem__)  # the first of equals
    cuts = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), len(lang)]
    rows = []
    for no, (a, z) in enumerate(zip(cuts, cuts[1:]), 1):
        x = int(lang[a])
        words = p[a:z].sum()
        rows.append((doc, no, LANGUAGES[x], float(p[a:z, x].sum() / words) if words else 0.0, int(sum(chars[a:z])), LANGUAGES[main], len(size)))
    return rows
