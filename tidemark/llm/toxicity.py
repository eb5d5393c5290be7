"""Abusive, hateful or sexual content: a classifier chain over sentences.

Spelling is undone first: look-alike letters of other scripts, digits for letters, letters set apart, starred or
stretched words, invisible characters.  A sentence's features are its words, their letter groups and its word
pairs, hashed.  There are no word lists: what a starred word stands for is looked up among the words of the
marked documents and of the examples.

Linear models for the categories are fitted in the order of the chain; each gets the log-odds that the earlier
ones give, which for fitting are predicted out of fold.  The last says whether the sentence is offensive, and a
text scores as its worst sentence.  Categories are learned from labelled examples.  Reviewers' marks are of whole
documents and some are mistaken, so the verdict is fitted by expectation maximisation: a document is offensive if
one of its sentences is, a mark differs from the truth at rates estimated on the way, and every sentence counts as
often as it occurs.  A phrase that stands beside offences and beside harmless sentences alike is thereby
explained by the sentences it stands beside.

The threshold is chosen by cross-fitting: every marked document is scored by a model that was fitted without it.
The model is fitted on at most ``MAX_LABELLED`` marked documents; every document is scored, and scored whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lexicon

#: Marked documents a model is fitted on, chosen by hash of their id where there are more.
MAX_LABELLED = 20_000
BITS = 18
FOLDS = 3
#: Words from which a sentence is also read in windows of ``WINDOW`` words.
LONG, WINDOW = 16, 12
#: Weight of the penalty on squared weights, in sentences.
PENALTY = 0.03
#: Rounds of expectation maximisation, and how often the categories are fitted again with what was found.
ROUNDS, PASSES = 20, 2
#: Belief, before any mark is seen, in how often a mark says yes of a harmless document and no of an offensive one.
NOISE = (0.05, 0.05)
#: How many times rarer offensive documents are in the corpus than among the marked ones, whom reviewers were sent.
RARER = 4

# fixed values: letters of other scripts that look like Latin ones
_LOOKALIKE = str.maketrans("авеѕіјкмнорсԁтухһԛԝɡαβεικνορτυχՏ", "abesijkmhopcdtyxhqwgabeiknoptuxs")
_LEET = str.maketrans("013457@$|!", "oieastasii")
_MARK = re.compile(r"^(?:\s*(?:>+|#+|[-*•]|\d+[.)]|\[\d+:\d+(?::\d+)?\]|[\w-]{1,40}:(?=\s)|\"\"\"|//+|/\*+))+\s*")
_SPLIT = re.compile(r"(?<=[.!?;])[\"')\]]*\s+|[\n\r]+")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Cc}--[\n\r\t]]", regex.V1)
_CODE = re.compile(r"`[^`\n]*`|\b\w+(?:[/.]\w+)+\b|\b[a-z]+(?:_[a-z0-9]+)+\b|\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\b[a-z]+(?:[A-Z][a-z]+)+\b|https?://\S+")
_APART = re.compile(r"(?<![^\W\d_])[^\W_*](?:([ .\-_*/])[^\W_*])(?:\1[^\W_*])+(?![^\W_])")
_SEAM = re.compile(r"[`/._]+|(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+(?:[*@$!|]+[^\W_]+|\*+)*(?:['’][^\W_]+)?")
_TWICE = re.compile(r"(.)\1+")


@lru_cache(maxsize=200_000)
def _spelled(word: str) -> str:
    """A word in lower case, Latin, without accents and without digits for letters; '9' for a number."""
    w = word.lower().replace("ß", "ss")
    if w.isascii():
        if w.isalpha():
            return w
    else:
        if any("a" <= c <= "z" for c in w):
            w = w.translate(_LOOKALIKE)
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    if w.isdigit():
        return "9"
    if re.search(r"[a-z]", w) and re.search(r"[0-9@$!|]", w) and len(w) > 3 or re.fullmatch(r"[0-9@$!|]{2,}[a-z]+[0-9@$!|]*", w):
        w = w.translate(_LEET)
    return w


def _short(word: str) -> str:
    return _TWICE.sub(r"\1", word)


def plain_word(word: str) -> str:
    """A word with its spelling undone but for stars: also without repeated letters."""
    return _short(_spelled(word))


def sentences(text: str | None) -> Iterator[str]:
    """The sentences and lines of a whole text, without marks at their beginning; none of an empty or null text."""
    if not text:
        return
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    for s in _SPLIT.split(text):
        s = _MARK.sub("", s).strip()
        if s:
            yield s


class Reader:
    """Splits texts into words.  ``suspects``: words a starred one may stand for, the likeliest first."""

    def __init__(self, suspects: Iterable[str]):
        self.by_length: dict[int, list[str]] = {}
        self.short = set()
        for w in suspects:
            self.by_length.setdefault(len(w), []).append(w)
            self.short.add(_short(w))
        self.known: dict[str, str] = {}

    def word(self, word: str) -> str:
        w = self.known.get(word)
        if w is None:
            w = _spelled(word)
            if "*" in w:
                shape = re.compile(re.escape(w).replace(r"\*", "."))
                w = next((s for s in self.by_length.get(len(w), ()) if shape.fullmatch(s)), w)
            w = _short(w)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = w
        return w

    def _suspect(self, word: str) -> bool:
        return len(word) > 1 and self.word(word) in self.short

    def _join(self, m: re.Match) -> str:
        """Letters set apart as one word: from four on, or three that are a suspect; numbers stay as they are."""
        w = re.sub(r"[ .\-_*/]", "", m.group())
        return w if any(c.isalpha() for c in w) and (len(w) > 3 or self._suspect(w)) else m.group()

    def _name(self, m: re.Match) -> str:
        """A mark for a name of code; its words stay where one is a suspect, as in words joined by '/' or '.'."""
        parts = _SEAM.sub(" ", m.group())
        return f" qcode {parts} " if any(self._suspect(w) for w in _WORD.findall(parts)) else " qcode "

    def words(self, sentence: str) -> tuple[str, ...]:
        s = _CODE.sub(self._name, _APART.sub(self._join, sentence))
        return tuple([self.word(w) for w in _WORD.findall(s)])

    def units(self, text: str | None) -> Iterator[tuple[str, ...]]:
        """The words of every sentence; of a long one also of overlapping windows, in which a phrase stands out."""
        for s in sentences(text):
            ws = self.words(s)
            if ws:
                yield ws
            if len(ws) > LONG:
                for i in range(0, len(ws) - WINDOW // 2, WINDOW // 2):
                    yield ws[i : i + WINDOW]


def _raw_words(text: str) -> set[str]:
    return {_spelled(w) for s in sentences(text) for w in _WORD.findall(s)}


@lru_cache(maxsize=1)
def _example_suspects() -> tuple[str, ...]:
    bad, good = set(), set()
    for c, s in lexicon.examples():
        (bad if c else good).update(w for w in _raw_words(s) if "*" not in w)
    return tuple(sorted((w for w in bad if len(w) > (4 if w in good else 2)), key=lambda w: (w in good, -len(w), w)))


def find_suspects(texts: list[str], bad: np.ndarray) -> tuple[str, ...]:
    """Words that stand in offensive documents more often than elsewhere, the most telling first, and the examples'."""
    inside, every = Counter(), Counter()
    for t, b in zip(texts, bad, strict=True):
        ws = {w for w in _raw_words(t) if w.isalpha() and len(w) > 2}
        every.update(ws)
        if b:
            inside.update(ws)
    usual = (inside.total() + 1) / (every.total() + 2)
    lift = {w: (n + 1) / (every[w] + 1 / usual) for w, n in inside.items()}
    told = sorted((w for w, x in lift.items() if x > 2 * usual), key=lambda w: (-lift[w], w))
    return tuple(dict.fromkeys([*told, *_example_suspects()]))


@lru_cache(maxsize=1)
def _default_reader() -> Reader:
    return Reader(_example_suspects())


def words(sentence: str) -> tuple[str, ...]:
    return _default_reader().words(sentence)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Words:
    """Numbers words and keeps the places of their features: the word itself and its groups of three and four letters."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hashes: list[int] = []
        self.places: list[list[int]] = []
        self.of("^"), self.of("$")

    def of(self, w: str) -> int:
        i = self.number.get(w)
        if i is None:
            i = self.number[w] = len(self.places)
            padded = f"^{w}$"
            grams = {padded[k : k + n] for n in (3, 4) for k in range(len(padded) - n + 1)} if len(w) > 2 else set()
            self.hashes.append(_hash(w))
            self.places.append([_hash("w " + w) >> (32 - BITS), *sorted(_hash("c " + g) >> (32 - BITS) for g in grams)])
        return i

    def table(self, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(word, place) of every feature of the words from ``start`` on."""
        size = np.array([len(p) for p in self.places[start:]], np.int64)
        return np.repeat(np.arange(start, len(self.places)), size), np.concatenate([np.array(p, np.int64) for p in self.places[start:]]) if len(size) else np.empty(0, np.int64)


class Layout:
    """Sentences as numbers of words and places of word pairs; a pair begins at every word and at the beginning."""

    def __init__(self, units: list[tuple[str, ...]], vocabulary: Words):
        self.n = len(units)
        size = np.array([len(u) for u in units], np.int64)
        self.word = np.array([vocabulary.of(w) for u in units for w in u], np.int64)
        self.row, self.pair_row = np.repeat(np.arange(self.n), size), np.repeat(np.arange(self.n), size + 1)
        ends = np.cumsum(size)
        left, right = np.insert(self.word, ends - size, 0), np.insert(self.word, ends, 1)
        h = np.array(vocabulary.hashes, np.uint64)
        mixed = (h[left] * np.uint64(0x9E3779B97F4A7C15) + h[right] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
        self.pair = mixed.astype(np.int64)
        per_word = np.array([len(p) for p in vocabulary.places], np.int64)
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(self.row, per_word[self.word], self.n) + size + 1, 1))


class Places:
    """The places of features that a fit can learn from, numbered closely: those of words, and of pairs seen twice."""

    def __init__(self, units: list[tuple[str, ...]], vocabulary: Words):
        pairs = np.bincount(Layout(units, vocabulary).pair, minlength=1 << BITS)
        self.used = pairs >= 2
        self.used[vocabulary.table()[1]] = True
        self.number = np.cumsum(self.used) - 1
        self.n = int(self.used.sum())

    def spread(self, models: np.ndarray) -> np.ndarray:
        """Models over these places as models over all places."""
        out = np.zeros((len(models), (1 << BITS) + models.shape[1] - self.n))
        out[:, np.flatnonzero(self.used)] = models[:, : self.n]
        out[:, 1 << BITS :] = models[:, self.n :]
        return out


class Rows(Layout):
    """Sentences as sparse rows of length one: words, whose features are added up once a word, and word pairs."""

    def __init__(self, units: list[tuple[str, ...]], vocabulary: Words, places: Places):
        super().__init__(units, vocabulary)
        self.n_words, self.k = len(vocabulary.places), places.n
        of, place = vocabulary.table()
        self.table = of, places.number[place]
        known = places.used[self.pair]
        self.pair, self.pair_row = places.number[self.pair[known]], self.pair_row[known]

    def dot(self, w: np.ndarray) -> np.ndarray:
        of, place = self.table
        by_word = np.bincount(of, w[place], self.n_words)
        return self.scale * (np.bincount(self.row, by_word[self.word], self.n) + np.bincount(self.pair_row, w[self.pair], self.n))

    def back(self, g: np.ndarray) -> np.ndarray:
        of, place = self.table
        g = g * self.scale
        by_word = np.bincount(self.word, g[self.row], self.n_words)
        return np.bincount(place, by_word[of], self.k) + np.bincount(self.pair, g[self.pair_row], self.k)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _odds(x: Rows, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.dot(w[: x.k]) + extra @ w[x.k : -1] + w[-1]


def _fit(x: Rows, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps: int = 40, penalty: float = PENALTY, memory: int = 8) -> np.ndarray:
    """Weights (features, earlier categories, bias) of a penalised logistic model with soft labels, by L-BFGS."""
    w = np.zeros(x.k + extra.shape[1] + 1) if start is None else start.copy()
    if start is None:
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)
        w[-1] = np.log(share / (1 - share))

    def at(w):
        z = _odds(x, extra, w)
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w[:-1] @ w[:-1])
        g = weight * (_sigmoid(z) - y)
        grad = np.concatenate([x.back(g), extra.T @ g, [g.sum()]])
        grad[:-1] += penalty * w[:-1]
        return loss, grad

    loss, grad = at(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = grad.copy(), []
        for s, t, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d -= alphas[-1] * t
        if past:
            s, t, _r = past[-1]
            d *= (s @ t) / (t @ t)
        else:
            d /= max(np.linalg.norm(grad), 1e-12)
        for (s, t, rho), a in zip(past, reversed(alphas), strict=True):
            d += s * (a - rho * (t @ d))
        slope, rate = grad @ d, 1.0
        while True:
            new = w - rate * d
            new_loss, new_grad = at(new)
            if new_loss <= loss - 1e-4 * rate * slope or rate < 1e-4:
                break
            rate /= 3
        s, t = new - w, new_grad - grad
        done = loss - new_loss < 1e-5 * max(abs(loss), 1)
        if new_loss >= loss:
            break
        w, loss, grad = new, new_loss, new_grad
        if s @ t > 1e-12:
            past = [*past[-(memory - 1) :], (s, t, 1 / (s @ t))]
        if done:
            break
    return w


def _squash(z: np.ndarray) -> np.ndarray:
    return np.clip(z, -8, 8) / 8


def fit_categories(units: list[tuple[str, ...]], x: Rows, vocabulary: Words, places: Places, labels: np.ndarray, weight: np.ndarray, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray]:
    """(models [categories, weights], out-of-fold log-odds [rows, categories]) of all categories but the last.

    ``labels`` [rows, categories] are 0, 1, or NaN where a row says nothing about a category; a row that says
    nothing gets the log-odds of the model fitted on all.
    """
    n, width = labels.shape

    def some(at: np.ndarray) -> Rows:
        return Rows([units[i] for i in at], vocabulary, places)

    fold = np.random.default_rng(7).integers(0, folds, n)
    told = ~np.isnan(labels).all(1)
    parts = []
    for f in range(folds):
        at, rest = np.flatnonzero(told & (fold != f)), np.flatnonzero(told & (fold == f))
        if len(at) and len(rest):
            parts.append((some(at), at, some(rest), rest))
    everyone = np.flatnonzero(told)
    known_rows = some(everyone)
    models = np.zeros((width, x.k + width + 1))
    earlier = np.zeros((n, width))
    for c in range(width):
        y, w = np.nan_to_num(labels[:, c]), weight * ~np.isnan(labels[:, c])
        # the few examples weigh as much as a hundredth of all sentences at least
        bad = w[y > 0.5].sum()
        w = np.where(y > 0.5, w * max(1.0, 0.01 * w.sum() / max(bad, 1e-9)), w)
        models[c] = _fit(known_rows, earlier[everyone], y[everyone], w[everyone])
        z = _odds(x, earlier, models[c])
        for train_rows, at, test_rows, rest in parts:
            z[rest] = _odds(test_rows, earlier[rest], _fit(train_rows, earlier[at], y[at], w[at], start=models[c] * 0.5, steps=15))
        earlier[:, c] = _squash(z)
    return models, earlier


class Marked:
    """Marked documents as lists of the numbers of their distinct sentences."""

    def __init__(self, docs: list[np.ndarray], yes: np.ndarray, no: np.ndarray):
        self.size = np.array([len(d) for d in docs], np.int64)
        self.unit = np.concatenate(docs) if docs else np.empty(0, np.int64)
        self.doc = np.repeat(np.arange(len(docs)), self.size)
        self.yes, self.no, self.n = yes.astype(float), no.astype(float), len(docs)

    def expect(self, p: np.ndarray, noise: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """(chance that each document is offensive, chance that each of its sentences is), given its marks.

        ``p``: chance of every sentence of every document by itself.
        """
        clean = np.bincount(self.doc, np.log1p(-p), self.n)
        prior = np.clip(-np.expm1(clean), 1e-12, 1 - 1e-12)
        up, down = noise
        told = np.log1p(-down) * self.yes + np.log(down) * self.no - np.log(up) * self.yes - np.log1p(-up) * self.no
        post = _sigmoid(np.log(prior) - np.log1p(-prior) + told)
        return post, np.minimum(p / prior[self.doc], 1) * post[self.doc]

    def rates(self, post: np.ndarray) -> tuple[float, float]:
        """How often a mark says yes of a harmless document and no of an offensive one, starting from ``NOISE`` of 100 marks."""
        up = (((1 - post) * self.yes).sum() + 100 * NOISE[0]) / (((1 - post) * (self.yes + self.no)).sum() + 100)
        down = ((post * self.no).sum() + 100 * NOISE[1]) / ((post * (self.yes + self.no)).sum() + 100)
        return float(np.clip(up, 0.01, 0.3)), float(np.clip(down, 0.01, 0.3))


def fit_verdict(x: Rows, earlier: np.ndarray, marked: Marked, fixed: np.ndarray, rounds: int = ROUNDS, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """(weights, chance of every sentence, chance and held-out score of every document, noise of the marks).

    ``fixed``: label of the examples, NaN elsewhere.  What is expected of a document comes from a model that was
    fitted without it, so that no model can confirm a mistaken mark by heart.
    """
    # the examples of both sides weigh the same
    label, bad, good = np.nan_to_num(fixed), fixed == 1, fixed == 0
    known = bad + good * max(1.0, bad.sum() / max(good.sum(), 1))
    fold = np.random.default_rng(11).integers(0, folds, marked.n)
    at = fold[marked.doc]
    # to begin with, a sentence is as bad as the documents it stands in
    share = (marked.yes + 0.05) / (marked.yes + marked.no + 0.1)
    resp, noise = np.zeros(len(marked.unit)), NOISE
    for f in range(folds):
        some = at != f
        seen = np.bincount(marked.unit[some], minlength=x.n)
        told = np.bincount(marked.unit[some], share[marked.doc[some]], x.n) / np.maximum(seen, 1)
        resp[at == f] = 0.3 * told[marked.unit[at == f]] ** 2

    def fit(some: np.ndarray, start: np.ndarray | None, steps: int) -> tuple[np.ndarray, np.ndarray]:
        weight = known + np.bincount(marked.unit[some], minlength=x.n)
        y = (known * label + np.bincount(marked.unit[some], resp[some], x.n)) / np.maximum(weight, 1e-9)
        return _fit(x, earlier, y, weight, start, steps), y

    models: list = [None] * folds
    post = np.zeros(marked.n)
    p = np.zeros(len(marked.unit))
    for r in range(rounds):
        for f in range(folds):
            models[f], _ = fit(at != f, models[f], 8 if r else 25)
            p[at == f] = _sigmoid(_odds(x, earlier, models[f]))[marked.unit[at == f]]
        post, resp = marked.expect(np.clip(p, 1e-9, 1 - 1e-6), noise)
        noise = marked.rates(post)
    w, y = fit(np.ones(len(at), bool), models[0], 40)
    score = np.maximum.reduceat(p, np.cumsum(marked.size) - marked.size) if marked.n else np.zeros(0)
    return w, y, post, score, noise


def _threshold(score: np.ndarray, post: np.ndarray) -> tuple[float, float, float]:
    """(threshold, precision, recall) with the highest F1 against the chance that each document is offensive.

    Harmless documents count ``RARER`` times, as the marked documents hold more offensive ones than the corpus.
    """
    if not len(score) or post.sum() < 5:
        return 0.5, float("nan"), float("nan")
    order = np.argsort(-score, kind="stable")
    s, hit, miss = score[order], np.cumsum(post[order]), RARER * np.cumsum(1 - post[order])
    f1 = np.where(np.append(s[1:] != s[:-1], True), 2 * hit / (hit + miss + post.sum()), -1)
    # of thresholds that are as good but for about one document, the one nearest to one half
    good = np.flatnonzero(f1 >= f1.max() - max(0.002, 1 / (1 + post.sum())))
    high, low = s[good], np.append(s, 0.0)[good + 1]
    between = np.where((low < 0.5) & (high >= 0.5), 0.5, (high + low) / 2)
    best = np.abs(between - 0.5).argmin()
    at = good[best]
    return float(np.clip(between[best], 0.02, 0.98)), float(hit[at] / (hit[at] + miss[at])), float(hit[at] / post.sum())


def train(marked: pd.DataFrame) -> dict:
    """The model from ``text`` and either ``yes`` and ``no`` (marks of each kind) or ``offensive`` (share of the marks).

    Documents on whose marks reviewers are evenly divided say nothing.  Without any marked document the examples
    alone are used.  ``held_out`` has precision and recall of every marked document by a model fitted without it,
    against its marks and the estimated rates of mistakes.
    """
    names = lexicon.CATEGORIES
    if "yes" in marked:
        yes, no = marked["yes"].to_numpy(float), marked["no"].to_numpy(float)
    else:
        share = marked["offensive"].to_numpy(float)
        yes, no = share, 1 - share
    texts = [t or "" for t in marked["text"]]
    suspects = find_suspects(texts, yes > no)
    reader = Reader(suspects)
    examples = lexicon.examples()
    number: dict[tuple[str, ...], int] = {}
    example_of = np.array([number.setdefault(reader.words(s), len(number)) for _, s in examples])
    docs, keep = [], []
    for i, t in enumerate(texts):
        own = {number.setdefault(w, len(number)) for w in reader.units(t)}
        if own and yes[i] != no[i]:
            docs.append(np.array(sorted(own)))
            keep.append(i)
    sample = Marked(docs, yes[keep], no[keep])
    units, vocabulary = list(number), Words()
    places = Places(units, vocabulary)
    x = Rows(units, vocabulary, places)
    fixed = np.full(x.n, np.nan)
    fixed[example_of] = [float(bool(c)) for c, _ in examples]
    labels = np.full((x.n, len(names) - 1), np.nan)
    seen = np.bincount(sample.unit, minlength=x.n).astype(float)
    harmless = np.bincount(sample.unit, (sample.yes > sample.no)[sample.doc].astype(float), x.n) == 0
    labels[(seen > 0) & harmless] = 0.0
    labels[example_of] = [[float(c == k) for k in names[:-1]] for c, _ in examples]
    weight = np.where(np.isnan(fixed), seen, 1.0)
    for _ in range(PASSES):
        models, earlier = fit_categories(units, x, vocabulary, places, labels, weight)
        w, y, post, score, noise = fit_verdict(x, earlier, sample, fixed)
        # what was found to be offensive is an example of its most likely category
        found = np.flatnonzero((y > 0.9) & np.isnan(fixed))
        labels[found] = np.nan
        labels[found, earlier[found].argmax(1)] = 1.0
        labels[(y < 0.05) & np.isnan(fixed) & (seen > 0)] = 0.0
    threshold, precision, recall = _threshold(score, post)
    return {"models": places.spread(np.vstack([models, w])).astype(np.float32), "threshold": threshold, "suspects": suspects, "noise": noise, "held_out": {"precision": precision, "recall": recall, "documents": sample.n}}


class Scorer:
    """Scores texts with a model; a word's features are added up once for all models."""

    def __init__(self, model: dict):
        self.models = model["models"].astype(np.float64)
        self.reader = Reader(model["suspects"])
        self.clear()

    def clear(self) -> None:
        self.vocabulary = Words()
        self.sums = np.zeros((0, len(self.models)))
        self.known: dict[tuple[str, ...], np.ndarray] = {}

    def predict(self, units: list[tuple[str, ...]]) -> np.ndarray:
        """[rows, categories] probabilities along the chain."""
        k, start = 1 << BITS, len(self.sums)
        x = Layout(units, self.vocabulary)
        if len(self.vocabulary.places) > start:
            of, place = self.vocabulary.table(start)
            self.sums = np.concatenate([self.sums, np.stack([np.bincount(of - start, m[place]) for m in self.models], 1)])
        odds = np.zeros((x.n, len(self.models)))
        earlier = np.zeros((x.n, len(self.models) - 1))
        for c, m in enumerate(self.models):
            z = x.scale * (np.bincount(x.row, self.sums[x.word, c], x.n) + np.bincount(x.pair_row, m[x.pair], x.n))
            odds[:, c] = z + earlier @ m[k:-1] + m[-1]
            if c < earlier.shape[1]:
                earlier[:, c] = _squash(odds[:, c])
        return _sigmoid(odds)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """[texts, categories]: of every text the highest of its sentences, 0 where it has none."""
        todo: dict[tuple[str, ...], None] = {}
        lists = [list(self.reader.units(t)) for t in texts]
        if len(self.known) > 200_000 or len(self.vocabulary.places) > 300_000:
            self.clear()
        for us in lists:
            todo.update((u, None) for u in us if u not in self.known)
        fresh = list(todo)
        for i in range(0, len(fresh), 5_000):
            part = fresh[i : i + 5_000]
            self.known.update(zip(part, self.predict(part), strict=True))
        return np.array([np.max([self.known[u] for u in us], axis=0) if us else np.zeros(len(self.models)) for us in lists]).reshape(-1, len(self.models))


def marked_documents(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, yes, no (marks of each kind) of at most ``limit`` marked documents."""
    marks = labels.filter("offensive is not null and doc_id is not null").groupBy("doc_id").agg(F.count(F.when(F.col("offensive") > 0, 1)).alias("yes"), F.count(F.when(F.col("offensive") <= 0, 1)).alias("no"))
    few = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").filter("text is not null").select("doc_id", "text", "yes", "no")  # at most ``limit`` rows of three numbers


def _scored(documents: DataFrame, model: dict, kept: list[str]) -> DataFrame:
    """The ``kept`` columns with score, flagged and one column a category, of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = lexicon.CATEGORIES

    def run(frames):
        scorer, threshold = Scorer(shared.value), shared.value["threshold"]
        for f in frames:
            out = scorer.scores(f["_text"])
            yield pd.DataFrame({c: f[c] for c in kept} | {"score": out[:, -1], "flagged": out[:, -1] >= threshold} | {n: out[:, i] for i, n in enumerate(names[:-1])})

    t = documents.select(*kept, F.col("text").alias("_text"))
    types = dict(t.dtypes)
    return t.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", score double, flagged boolean, " + ", ".join(f"{n} double" for n in names[:-1]))


def scores(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, flagged and one column a category, of every row; 0 for empty and null texts.

    Whole texts are scored, whatever their length.  Null and repeated ids give a row each.  Other columns are
    ignored.
    """
    return _scored(documents, model, ["doc_id"])


def fit(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> dict:
    """A model from reviewers' marks; evenly divided marks, null marks and marks of unknown documents do not count."""
    return train(marked_documents(documents, labels, limit).orderBy("doc_id").toPandas())


def source_rates(documents: DataFrame, model: dict) -> DataFrame:
    """source, n_docs, n_flagged, rate, mean_score over every row; documents without a source are counted under null."""
    return _scored(documents, model, ["source"]).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("flagged"), 1)).alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
