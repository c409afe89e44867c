"""Pages of repeated keywords, link lists and product tags instead of sentences.

Sentences need function words; keyword lists do without. A text is cut into units (lines, short neighbouring lines
pooled), and a unit counts as list-like when its share of function words stays below what every language needs. A page is
stuffed when most of its words stand in list-like units and those units show what stuffing looks like: a top word or word
pair that takes a large share, repeated lines, many links, or separators in place of grammar. Program code is neither and
is left out of both counts.

The needed shares and the limits of the signals are calibrated per language on the labelled samples. Languages without a
fixed list of function words get theirs from the samples, by document frequency. A text that the character models of all
languages find strange is in a language nobody has described: its function words are unknown, so that it looks list-like
whatever it is, and only the signals that need no language decide, at stricter limits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.models import LETTERS, Models, strange
from corvane.llm.models import fit as fit_models
from corvane.llm.words import FUNCTION_WORDS, URL, WORD, code_lines
from corvane.session import bounded_rows

#: Documented bound of the calibration sample: labelled rows fitted on the driver.
MAX_SAMPLES = 20_000
#: Fixed value: marks that belong to sentences; every other mark separates entries.
SENTENCE_MARKS = frozenset(".?!:'\"’‘“”«»()-_–—。，、！？：；「」『』（）《》।؟،")
#: Times a word or word pair must occur before its share says anything.
REPEATS = 3
#: Share of a language's sample texts that a function word stands in, where there is no fixed list.
FREQUENT = 0.15
SIGNALS = ("top_word", "top_pair", "repeated_lines", "links", "separators")


@dataclass(frozen=True)
class Calibration:
    """Function-word share below which a unit is list-like and limits of the signals, both by language, with their words.

    ``languages`` names them in order; ``function_of`` gives the positions of the languages that a word belongs to.
    """

    languages: tuple[str, ...]
    function_of: dict[str, tuple[int, ...]]
    need: tuple[float, ...]
    limits: tuple[dict[str, float], ...] = ()
    models: Models | None = None
    most: float = 0.5
    least_words: int = 12
    pool: int = 16
    short: int = 8
    prose: float = 1.5
    strict: float = 2.5
    least: dict[str, float] = field(default_factory=lambda: {"top_word": 0.08, "top_pair": 0.05, "repeated_lines": 0.3, "links": 0.15, "separators": 0.12})

    def limit(self, lang: int | None) -> dict[str, float]:
        return self.limits[lang] if lang is not None and self.limits else self.least


def calibrate(rows: list[tuple[str, str]], models: Models | None = None, fraction: float = 0.5, margin: float = 1.5, **given: float) -> Calibration:
    """Fit on (language, text) rows: the needed function-word share is a fraction of the mean share in clean text; a
    signal's limit is ``margin`` times what it reaches in stretches of clean text of 200 words or more, at least the usual one."""
    texts: dict[str, list[list[str]]] = defaultdict(list)
    raw: dict[str, list[str]] = defaultdict(list)
    for lang, text in sorted({(lang, text) for lang, text in rows if lang and text}):
        if WORD.search(text):
            texts[lang].append(WORD.findall(text.lower()))
            raw[lang].append(text)
    languages = tuple(sorted(set(FUNCTION_WORDS) | set(texts)))
    function_of: dict[str, tuple[int, ...]] = {}
    for k, lang in enumerate(languages):
        often = Counter(w for words in texts[lang] for w in set(words)) if lang not in FUNCTION_WORDS else {}
        for w in FUNCTION_WORDS[lang].split() if lang in FUNCTION_WORDS else sorted(w for w, n in often.items() if n >= FREQUENT * len(texts[lang])):
            function_of[w] = (*function_of.get(w, ()), k)
    share = {}
    for k, lang in enumerate(languages):
        words = [w for x in texts[lang] for w in x]
        if words:
            share[k] = sum(k in function_of.get(w, ()) for w in words) / len(words)
    usual = sum(share.values()) / len(share) if share else 0.36
    c = Calibration(languages, function_of, tuple(fraction * share.get(k, usual) for k in range(len(languages))), models=models or (fit_models(rows) if texts else None), **given)
    limits = []
    for lang in languages:
        most, stretch, n = dict(c.least), [], 0
        for text, words in zip(raw[lang], texts[lang], strict=True):
            stretch.append(text)
            n += len(words)
            if n >= 200:
                got = Assessment()
                _signals(got, WORD.findall(" ".join(stretch).lower()), stretch, 0, n, c)
                most = {s: max(v, margin * getattr(got, s)) if s in ("top_word", "top_pair", "separators") else v for s, v in most.items()}  # samples repeat whole texts
                stretch, n = [], 0
        limits.append(most)
    return Calibration(**{**c.__dict__, "limits": tuple(limits)})


@dataclass
class Assessment:
    words: int = 0
    listed: float = 0.0
    top_word: float = 0.0
    top_pair: float = 0.0
    repeated_lines: float = 0.0
    links: float = 0.0
    separators: float = 0.0
    stuffed: bool = False


def _language(words: list[str], c: Calibration) -> tuple[int | None, bool]:
    """(language whose function words stand out most, whether they are so many that the text can't be stuffed)."""
    hits, known = [0] * len(c.languages), c.function_of
    for w in words:
        if w in known:
            for k in known[w]:
                hits[k] += 1
    ratio = [h / (need * len(words)) if need and words else 0.0 for h, need in zip(hits, c.need, strict=True)]
    top = max(ratio, default=0.0)
    return (ratio.index(top) if top else None), top >= c.prose


def _signals(out: Assessment, words: list[str], lines: list[str], linked: int, n: int, c: Calibration) -> None:
    size = max(1, len(words))
    topic = Counter(w for w in words if w not in c.function_of)
    pairs = Counter(p for p in zip(words, words[1:], strict=False) if p[0] not in c.function_of and p[1] not in c.function_of)
    ends = [x.strip().lower() for x in lines]
    out.top_word = max((v for v in topic.values() if v >= REPEATS), default=0) / size
    out.top_pair = max((v for v in pairs.values() if v >= REPEATS), default=0) * 2 / size
    out.repeated_lines = 1 - len(set(ends)) / len(ends)
    out.links = linked / n
    out.separators = sum(not (ch.isalnum() or ch.isspace() or ch in SENTENCE_MARKS) for x in ends for ch in x) / n


def assess(text: str | None, c: Calibration, quick: bool = False) -> Assessment:
    """Shares of a text and the verdict. Null, empty and very short texts are not stuffed.

    ``quick`` gives only the verdict right where the whole text reads like prose, and leaves the shares at 0 there.
    """
    out = Assessment()
    if not text:
        return out
    lang, prose = _language(WORD.findall(text.lower()), c)
    if prose and quick:
        return out
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    code = code_lines(lines)
    units: list[tuple[int, list[int], list[str], list[str], int]] = []  # words, hits by language, words without links, lines, words in links
    pool: list | None = None
    n_lang = len(c.languages)
    for line, is_code in zip(lines, code, strict=True):
        if is_code:
            continue
        linked = 0
        body = line
        if "://" in line or "www." in line.lower():
            found = URL.findall(line)
            linked = sum(len(WORD.findall(u)) for u in found)
            body = URL.sub(" ", line)
        words = WORD.findall(body.lower())
        n = len(words) + linked
        if not n:
            continue
        hits = [0] * n_lang
        for w in words:
            for k in c.function_of.get(w, ()):
                hits[k] += 1
        unit = (n, hits, words, [line], linked)
        if n >= c.short:
            if pool:
                units.append(pool)
                pool = None
            units.append(unit)
        else:
            pool = unit if not pool else (pool[0] + n, [a + b for a, b in zip(pool[1], hits, strict=True)], pool[2] + words, pool[3] + [line], pool[4] + linked)
            if pool[0] >= c.pool:
                units.append(pool)
                pool = None
    if pool:
        units.append(pool)
    out.words = sum(u[0] for u in units)
    if out.words < c.least_words:
        return out
    listed = [u for u in units if all(h < need * u[0] for h, need in zip(u[1], c.need, strict=True))]
    n = sum(u[0] for u in listed)
    out.listed = n / out.words
    if not n:
        return out
    words = [w for u in listed for w in u[2]]
    _signals(out, words, [x for u in listed for x in u[3]], sum(u[4] for u in listed), n, c)
    limit = c.limit(lang)
    out.stuffed = out.listed > c.most and not prose and any(getattr(out, s) >= limit[s] for s in SIGNALS)
    if out.stuffed and c.models is not None and strange(LETTERS.findall(" ".join(words)), c.models):
        out.stuffed = any(getattr(out, s) >= min(c.strict * c.least[s], 0.9) for s in SIGNALS)
    return out


def fit(samples: DataFrame, **limits: float) -> Calibration:
    """Calibration on a table of ``lang, text`` rows with at most MAX_SAMPLES rows."""
    return calibrate([(r["lang"], r["text"]) for r in bounded_rows(samples.select("lang", "text"), MAX_SAMPLES, "language samples")], **limits)


def stuffed_pages(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", shares: bool = True, **limits: float) -> DataFrame:
    """``(key, words, listed, top_word, top_pair, repeated_lines, links, separators, stuffed)`` for every row, one pass, no shuffle.

    ``shares=False`` spends no time on the shares of pages that read like prose as a whole; the verdict is the same.
    Null, empty and too short texts come out with stuffed = false; a null key stays null; repeated rows each give a row;
    an empty table gives none. Only key and text are read, so columns of any other name do no harm.
    """
    c = fit(samples, **limits)
    kind = df.schema[key].dataType.simpleString()
    names = ["words", "listed", "top_word", "top_pair", "repeated_lines", "links", "separators", "stuffed"]
    schema = f"`{key}` {kind}, words bigint, listed double, top_word double, top_pair double, repeated_lines double, links double, separators double, stuffed boolean"
    types = [pa.int64(), *[pa.float64()] * 6, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [assess(t, c, quick=not shares) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([getattr(a, x) for a in got], t) for x, t in zip(names, types, strict=True)]], names=[key, *names])

    return df.select(key, text).mapInArrow(run, schema)
