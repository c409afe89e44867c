"""Interpolated Kneser-Ney character models, one per language, in shared sorted arrays of n-gram hashes.

A lookup finds the discounted probability of an n-gram, or the back-off weight of its context, for all languages at once.
``fit`` also calibrates on held-out folds what a word is worth as evidence, by how well any model knows it, and how far
the cross-entropy of clean text lies from its language's mean.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, replace

import numpy as np

ORDER = 5
#: Bounds between ranges of a word's cost a character in its best language, in nats.
KNOWN = np.array([0.8, 1.1, 1.4, 1.7, 2.0, 2.4, 2.8])
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0)
#: How far a document's cross-entropy may vary by its subject, as a share of the mean.
SUBJECT = 0.12
PRIME = np.uint64(0x9E3779B97F4A7C15)
START, END = 2, 3
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Models:
    """Per order: sorted hashes of n-grams with their discounted probabilities, and of contexts with their back-off weights."""

    languages: tuple[str, ...]
    grams: tuple[tuple[np.ndarray, np.ndarray], ...]
    contexts: tuple[tuple[np.ndarray, np.ndarray], ...]
    uniform: float
    temperature: float = 1.0
    reject: float = 0.4
    known: tuple[float, ...] = (1.0,) * (len(KNOWN) + 1)  # temperature of a word by its range of KNOWN
    mean: tuple[float, ...] = ()  # cross-entropy a character of clean text, by language
    spread: tuple[float, ...] = ()  # its standard deviation for one character
    limit: float = np.inf  # standard deviations above the mean that clean text keeps to


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each with ORDER - 1 starts before and an end behind; positions to predict; word of each."""
    pre, post = chr(START) * (ORDER - 1), chr(END)
    joined = "".join([pre + w + post for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), "uint32").astype("uint64")
    size = np.array([len(w) + 1 for w in words], "int64")
    owner = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + (owner + 1) * (ORDER - 1)
    del first
    return codes, at, owner


def _hashes(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hash of the n characters that end at each position, n = 1..ORDER."""
    with np.errstate(over="ignore"):
        out, h, scale = [], np.zeros(len(at), "uint64"), np.uint64(1)
        for n in range(ORDER):
            h = h + (codes[at - n] + np.uint64(7)) * scale
            scale = scale * PRIME
            out.append(h ^ (h >> np.uint64(29)) ^ np.uint64(n + 1))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.searchsorted(keys, wanted)
    where[where == len(keys)] = 0
    return where, keys[where] == wanted


def train(rows: list[tuple[str, str]]) -> Models:
    """Fit on (language, text) rows. Words count as often as they occur."""
    words: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        if lang and text:
            words[lang].update(LETTERS.findall(text.lower()))
    languages = tuple(sorted(words))
    grams: list[dict[str, Counter]] = [{} for _ in range(ORDER)]
    for lang in languages:
        counts = [Counter() for _ in range(ORDER)]
        for w, c in words[lang].items():
            s = chr(START) * (ORDER - 1) + w + chr(END)
            for i in range(ORDER - 1, len(s)):
                counts[ORDER - 1][s[i - ORDER + 1 : i + 1]] += c
        for n in range(ORDER - 2, -1, -1):  # lower orders count the distinct characters that an n-gram follows
            for g in counts[n + 1]:
                counts[n][g[1:]] += 1
        for n in range(ORDER):
            grams[n][lang] = counts[n]
    alphabet = {g for lang in languages for g in grams[0][lang]}
    out_g, out_c = [], []
    for n in range(ORDER):
        every = sorted({g for lang in languages for g in grams[n][lang]})
        heads = sorted({g[:-1] for g in every})
        gi, hi = {g: k for k, g in enumerate(every)}, {h: k for k, h in enumerate(heads)}
        prob = np.zeros((len(every), len(languages)))
        back = np.ones((len(heads), len(languages)))
        for k, lang in enumerate(languages):
            c = grams[n][lang]
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            discount = once / (once + 2 * twice) if once else 0.5
            total, kinds = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            for g, v in c.items():
                prob[gi[g], k] = (v - discount) / total[g[:-1]]
            for h, v in kinds.items():
                back[hi[h], k] = discount * v / total[h]
        out_g.append((every, prob))
        out_c.append((heads, back))

    def table(names: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not names or not names[0]:
            return np.zeros(1, "uint64"), values
        codes = np.array([[ord(x) for x in s] for s in names], "uint64")
        h = _hashes(codes.ravel(), np.arange(len(names)) * codes.shape[1] + codes.shape[1] - 1)[codes.shape[1] - 1]
        order = np.argsort(h)
        return h[order], values[order].astype("float64")

    return Models(languages, tuple(table(*x) for x in out_g), tuple(table(*x) for x in out_c), 1 / (len(alphabet) + 1))


def score_words(words: list[str], m: Models) -> np.ndarray:
    """Negative log-likelihood of each word in every language."""
    codes, at, owner = _padded(words)
    h = _hashes(codes, at)
    before = _hashes(codes, at - 1)
    p = np.full((len(at), len(m.languages)), m.uniform)
    live = np.arange(len(at))
    for n in range(ORDER):
        if n:  # only positions whose context was seen have more to learn from longer n-grams
            where, hit = _find(m.contexts[n][0], before[n - 1][live])
            live = live[hit]
            if not len(live):
                break
            back = m.contexts[n][1][where[hit]]
        else:
            back = m.contexts[0][1][np.zeros(len(live), "int64")]
        where, hit = _find(m.grams[n][0], h[n][live])
        q = back * p[live]
        q[hit] += m.grams[n][1][where[hit]]
        p[live] = q
    cost = -np.log(p)
    size = np.bincount(owner, minlength=len(words))
    return np.add.reduceat(cost, np.cumsum(size) - size, axis=0)


def word_sizes(words: list[str]) -> np.ndarray:
    return np.array([len(w) + 1 for w in words], "int64")  # the end of a word counts


def evidence(cost: np.ndarray, size: np.ndarray, m: Models) -> np.ndarray:
    """Costs of words above their best language, at the temperature of how well that language knows them."""
    low = cost.min(1, keepdims=True)
    return (cost - low) / np.array(m.known)[np.digitize(low[:, 0] / size, KNOWN)][:, None]


class Scorer:
    """Scores words once; the memory holds at most ``room`` words and is emptied when full."""

    def __init__(self, m: Models, room: int = 200_000) -> None:
        self.m, self.room, self.seen = m, room, {}
        self.rows = np.zeros((4096, 2 * len(m.languages) + 1))

    def lines(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(evidence, cost, characters) of each list of words, the first two by language; no list is empty."""
        flat = [w for ws in words for w in ws]
        new = list(set(flat).difference(self.seen))
        if len(self.seen) + len(new) > self.room:
            self.seen.clear()
            new = list(set(flat))
        if new:
            first, last = len(self.seen), len(self.seen) + len(new)
            if last > len(self.rows):
                self.rows = np.concatenate([self.rows[:first], np.zeros((last * 2 - first, self.rows.shape[1]))])
            cost, size = score_words(new, self.m), word_sizes(new)
            self.rows[first:last] = np.concatenate([evidence(cost, size, self.m), cost, size[:, None]], 1)
            self.seen.update(zip(new, range(first, last), strict=True))
        size = np.array([len(ws) for ws in words], "int64")
        idx = np.fromiter(map(self.seen.__getitem__, flat), "int64", len(flat))
        got = np.add.reduceat(self.rows[idx], np.cumsum(size) - size, axis=0)
        n = len(self.m.languages)
        return got[:, :n], got[:, n : 2 * n], got[:, 2 * n]


def posterior(cost: np.ndarray, temperature: float) -> np.ndarray:
    z = -(cost - cost.min(1, keepdims=True)) / temperature
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def _likeliest(cost: np.ndarray, truth: np.ndarray, least: float = 0.0) -> float:
    """Temperature, ``least`` or more, under which the true languages are most likely."""
    loss = {t: -np.log(np.maximum(posterior(cost, t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in TEMPERATURES if t >= least}
    return min(loss, key=loss.get)


def fit(rows: list[tuple[str, str]], more: list[tuple[str, str]] = (), folds: int = 2, reject: float = 0.4) -> Models:
    """Train on all rows and ``more``, and calibrate on held-out folds of the rows, each text once.

    Temperatures of words never fall with their cost: what is known less says less. The limit of the cross-entropy is half
    again what held-out texts reach, as texts of other kinds than the sample cost more.
    """
    rows = sorted({(lang, text) for lang, text in rows if lang and text})
    more = list(more)
    fold = [zlib.crc32(t.encode()) % folds for _, t in rows]
    whole = train([*rows, *more])
    names = whole.languages
    cost, size, owner, truth = [], [], [], []
    for f in range(folds):
        m = train([*(r for r, k in zip(rows, fold, strict=True) if k != f), *more])
        if m.languages != names:
            continue
        for (lang, text), k in zip(rows, fold, strict=True):
            words = LETTERS.findall(text.lower()) if k == f else []
            if words:
                cost.append(score_words(words, m))
                size.append(word_sizes(words))
                owner += [len(truth)] * len(words)
                truth.append(names.index(lang))
    if not truth:
        return replace(whole, reject=reject)
    c, n, of, t = np.concatenate(cost), np.concatenate(size), np.array(owner), np.array(truth)
    kind, known, least = np.digitize(c.min(1) / n, KNOWN), [], 0.0
    for k in range(len(KNOWN) + 1):
        own = kind == k
        if own.sum() >= 30:
            least = _likeliest(c[own], t[of[own]], least)
        known.append(max(least, TEMPERATURES[0]))
    whole = replace(whole, known=tuple(known), reject=reject)
    total = lambda x: np.stack([np.bincount(of, x[:, j], len(t)) for j in range(len(names))], 1)
    temperature = _likeliest(total(evidence(c, n, whole)), t)
    chars = np.bincount(of, n, len(t))
    rate = total(c)[np.arange(len(t)), t] / chars
    mean = [float(rate[t == k].mean()) if (t == k).any() else float(rate.mean()) for k in range(len(names))]
    off = (rate - np.array(mean)[t]) * np.sqrt(chars)
    spread = [float(off[t == k].std()) if (t == k).sum() > 1 else float(off.std()) for k in range(len(names))]
    whole = replace(whole, temperature=temperature, mean=tuple(mean), spread=tuple(max(x, 1e-6) for x in spread))
    return replace(whole, limit=1.5 * max(1.0, float(surprise(rate, chars, t, whole).max())))


def surprise(rate: np.ndarray, chars: np.ndarray, lang: np.ndarray, m: Models) -> np.ndarray:
    """Standard deviations by which a cross-entropy a character lies above what clean text of that length has."""
    if not m.mean:
        return np.zeros(len(rate))
    mean, spread = np.array(m.mean)[lang], np.array(m.spread)[lang]
    return (rate - mean) / np.sqrt(spread**2 / np.maximum(chars, 1) + (SUBJECT * mean) ** 2)


def strange(words: list[str], m: Models, beyond: float = 1.3) -> bool:
    """Whether words fit none of the languages: each one's calibrated limit is passed by a factor, as lists cost more than prose."""
    if not words or not m.mean:
        return False
    kinds = Counter(words)
    names = list(kinds)
    times = np.array([kinds[w] for w in names], float)
    chars = float((word_sizes(names) * times).sum())
    rate = (score_words(names, m) * times[:, None]).sum(0) / chars
    every = np.arange(len(m.languages))
    return bool((surprise(rate, np.full(len(every), chars), every, m) > beyond * m.limit).all())
