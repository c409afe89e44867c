"""Language of documents and of their lines, with a confidence.

One interpolated Kneser-Ney character model per language is fitted on a bounded labelled sample. The models share sorted
arrays of n-gram hashes: a lookup finds the discounted probability of an n-gram, or the back-off weight of its context,
for all languages at once. Words are scored with their boundaries, each distinct word of a batch once.

What a word says about the language depends on how well any model knows it: a name that costs two nats a character in its
best language is evidence of nothing. Held-out folds of the sample therefore give a temperature for each range of costs a
character, and a line's cross-entropy is the mean over its characters of the words' costs at those temperatures. The
language with the least wins; the odds, at a temperature for whole lines from the same folds, are the confidence. Two
rejections are calibrated there too: odds below ``reject``, and a plain cross-entropy a character that lies further above
the language's own held-out mean than clean text of that length does, as text of a language without a model has it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.models import LETTERS, Models, Scorer, fit, posterior, surprise
from corvane.llm.stuffing import Calibration, assess, calibrate
from corvane.llm.words import URL, code_lines
from corvane.session import bounded_rows

#: Documented bounds: labelled rows to train on; documents of the table to learn from besides, and their lines per language.
MAX_SAMPLES = 20_000
OWN_DOCUMENTS = 1_500
OWN_LINES = 600
#: Spellings of language labels, by two-letter code.
LABELS = {
    "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish español espanol castellano", "fr": "fr fra fre french français francais",
    "nl": "nl nld dut dutch nederlands flemish", "pt": "pt por portuguese português portugues", "it": "it ita italian italiano",
    "da": "da dan danish", "sv": "sv swe swedish", "pl": "pl pol polish", "ru": "ru rus russian", "zh": "zh zho chi chinese", "ja": "ja jpn japanese",
}
_LABEL = {w: code for code, words in LABELS.items() for w in words.split()}


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label such as 'EN', 'en-US', 'eng' or 'English'; None where it names no known language."""
    base = re.split(r"[-_\s,;(]", (label or "").strip().lower())[0]
    return _LABEL.get(base)


# --- documents -------------------------------------------------------------------------------------------------------
def judge(texts: list[str | None], scorer: Scorer, least: int = 25, usual: float = 0.9) -> list[tuple[str | None, float, int, list[tuple[int, str, float]]]]:
    """(main language, confidence, letters, foreign lines as (line_no, language, confidence)) of each text.

    The main language has the most letters in decided lines. A line is in another one if that is likelier, given that a
    share of ``usual`` of all lines is in the main language, and its own cross-entropy is that of the other language's text.
    """
    m = scorer.m
    words, lines_of, letters_of = [], [], []
    for text in texts:
        start = len(words)
        numbers, total = [], 0
        if text:
            lines = text.split("\n")
            for no, (line, is_code) in enumerate(zip(lines, code_lines(lines), strict=True), 1):
                found = LETTERS.findall(line.lower())
                total += sum(map(len, found))
                if not found or is_code:
                    continue
                if "://" in line or "www." in line:
                    found = LETTERS.findall(URL.sub(" ", line).lower())
                if found:
                    numbers.append((no, sum(map(len, found))))
                    words.append(found)
        lines_of.append((start, numbers))
        letters_of.append(total)
    if not words:
        return [(None, 0.0, n, []) for n in letters_of]
    cost, plain, chars = scorer.lines(words)
    odds = posterior(cost, m.temperature)
    best, sure = odds.argmax(1), odds.max(1)
    rate = plain[np.arange(len(best)), best] / chars
    fits = surprise(rate, chars, best, m) <= m.limit
    others = max(1, len(m.languages) - 1)
    lift = np.log(usual * others / (1 - usual)) if usual < 1 else np.inf
    out = []
    for (start, numbers), total in zip(lines_of, letters_of, strict=True):
        if not numbers:
            out.append((None, 0.0, total, []))
            continue
        of = slice(start, start + len(numbers))
        size = np.array([n for _, n in numbers], float)
        firm = (sure[of] >= m.reject) & fits[of]
        votes = np.bincount(best[of][firm], size[firm], len(m.languages))
        whole = posterior(cost[of].sum(0, keepdims=True), m.temperature)[0]
        main = int(votes.argmax()) if votes.sum() else int(whole.argmax())
        confidence = float(votes[main] / votes.sum()) if votes.sum() else float(whole[main])
        n = chars[of].sum()
        strange = surprise(plain[of, main].sum(keepdims=True) / n, np.array([n]), np.array([main]), m)[0] > m.limit
        if strange or not votes.sum() and whole[main] < m.reject:
            out.append((None, float(whole[main]), total, []))
            continue
        foreign = []
        for k, ((no, letters), b, good) in enumerate(zip(numbers, best[of], firm, strict=True)):
            if good and b != main and letters >= least:
                z = (cost[start + k, main] - cost[start + k]) / m.temperature - lift
                z[main] = 0.0
                p = np.exp(z - z.max())
                p /= p.sum()
                if p[b] > p[main] and p[b] >= m.reject:
                    foreign.append((no, m.languages[b], float(p[b])))
        out.append((m.languages[main], confidence, total, foreign))
    return out


def own_lines(texts: list[tuple[str, str | None]], m: Models, most: int = OWN_LINES) -> list[tuple[str, str]]:
    """(language, line) from (text, label) rows whose main language the models and the label agree on.

    A line counts for its document's language if the models, asked without regard to the document, also find that one
    likeliest, however unsure they are: notices, bylines and headings become better known by that, and a site's lines in
    another language aren't learned as the document's. For the same reason a word counts only if it stands in at least
    half as large a share of that language's texts as of any other's. Each line counts once; those in most texts come
    first, then short ones, as they have the least to be told by; every language gives equally many at most. The order of
    the rows doesn't matter.
    """
    scorer, lines_of, texts_of, share = Scorer(m), defaultdict(Counter), Counter(), defaultdict(Counter)
    for (text, label), (main, _, letters, _) in zip(texts, judge([t for t, _ in texts], scorer), strict=True):
        if main is None or label_code(label) != main or letters < 200:
            continue
        lines = text.split("\n")
        own = sorted({x.strip() for x, code in zip(lines, code_lines(lines), strict=True) if not code and len(x.strip()) >= 20 and "://" not in x and "www." not in x and LETTERS.search(x)})
        if own:
            cost, _, _ = scorer.lines([LETTERS.findall(x.lower()) for x in own])
            own = [x for x, k in zip(own, cost.argmin(1), strict=True) if m.languages[k] == main]
        lines_of[main].update(own)
        texts_of[main] += 1
        for w in {w for x in own for w in LETTERS.findall(x.lower())}:
            share[w][main] += 1
    out = []
    for lang in sorted(lines_of):
        for x, _ in sorted(lines_of[lang].items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:most]:
            words = LETTERS.findall(x.lower())
            kept = [w for w in words if 2 * share[w][lang] / texts_of[lang] >= max(n / texts_of[k] for k, n in share[w].items())]
            out.append((lang, " ".join(kept)))
    return out


def _least_hashed(df: DataFrame, text: str, label: str, most: int = OWN_DOCUMENTS) -> list:
    """(text, label) of the different texts among the ``most`` rows with the least hash.

    Tasks first send hashes alone; the texts below the cut are then few, and copies of one are combined where they lie.
    """
    rows = df.select(F.xxhash64(text).alias("h"), F.col(text).alias("t"), F.col(label).alias("l"))
    low = rows.select("h").orderBy("h").limit(most).collect()
    if not low:
        return []
    return rows.where(F.col("h") <= low[-1]["h"]).groupBy("h").agg(F.min(F.struct("t", "l")).alias("x")).select("x.t", "x.l").limit(most).collect()


def languages_of(
    df: DataFrame,
    samples: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    least_document: int = 60,
    least_line: int = 25,
    skip_stuffed: bool = True,
    reject: float = 0.4,
) -> DataFrame:
    """``(key, line_no, lang, confidence, label_code, wrong)``: line 0 is the document, other lines are in another language.

    Every document with a decided main language has a row with line_no 0; ``wrong`` says whether its label is absent,
    names no language or names another. Each line of at least ``least_line`` letters in another language than the
    document's main one has a row of its own. Documents with fewer than ``least_document`` letters have no row 0.
    ``skip_stuffed`` leaves out keyword and link-list pages. Null and empty texts, code and undecided texts give no rows;
    a null key stays null; repeated rows repeat theirs; only the named columns are read. One pass without a shuffle, after
    a look at the OWN_DOCUMENTS texts with the least hash, whose unmistakable lines the models learn besides the sample.
    """
    rows = [(r["lang"], r["text"]) for r in bounded_rows(samples.select("lang", "text"), MAX_SAMPLES, "language samples")]
    first = fit(rows, reject=reject)
    limits: Calibration = calibrate(rows, first)
    some = _least_hashed(df.where(F.length(text).between(200, 20_000)), text, label)
    models = fit(rows, own_lines([(r[0], r[1]) for r in some if not assess(r[0], limits, quick=True).stuffed], first), reject=reject)
    shared = df.sparkSession.sparkContext.broadcast((models, limits))  # bounded by MAX_SAMPLES
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, line_no int, lang string, confidence double, label_code string, wrong boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = shared.value
        scorer = Scorer(m)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
                if skip_stuffed:
                    texts = [None if assess(t, c, quick=True).stuffed else t for t in texts]
                out: list[tuple] = []
                for i, (got, lab) in enumerate(zip(judge(texts, scorer, least_line), labels, strict=True)):
                    main, sure, letters, foreign = got
                    if main is None:
                        continue
                    code = label_code(lab)
                    if letters >= least_document:
                        out.append((i, 0, main, sure, code, code != main))
                    out += [(i, no, lang, s, code, None) for no, lang, s in foreign]
                cols = list(zip(*out, strict=True)) if out else [()] * 6
                types = [pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(x, t) for x, t in zip(cols[1:], types, strict=True)]], names=[key, "line_no", "lang", "confidence", "label_code", "wrong"])

    return df.select(key, text, label).mapInArrow(run, schema)
