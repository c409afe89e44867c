"""Language and quality filters. Thresholds are those of the published papers, in one place."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import words

#: Words of which an English text holds at least two.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
#: Duplicate-line and n-gram limits of Rae et al. 2021, table A1.
TOP_NGRAM = ((2, 0.20), (3, 0.18), (4, 0.16))
REPEATED_NGRAM = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))


@dataclass(frozen=True)
class Quality:
    least_words: int = 50
    most_words: int = 100_000
    least_mean: float = 3.0
    most_mean: float = 10.0
    most_symbols: float = 0.1
    most_bullets: float = 0.9
    most_ellipses: float = 0.3
    least_alpha: float = 0.8
    least_stop_words: int = 2


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def language_of_label(label: Column) -> Column:
    """Base language of a label: before the first hyphen, in lower case."""
    return F.split_part(F.lower(label), F.lit("-"), F.lit(1))


def language_allowed(label: Column, allowed: tuple[str, ...], unknown: str = "en") -> Column:
    """Whether a document stays; an undecided one counts as ``unknown``."""
    base = F.when(F.coalesce(F.trim(label), F.lit("")) == "", F.lit(unknown)).otherwise(language_of_label(F.trim(label)))
    return base.isin(*allowed)


def long_enough(text: Column, least: int = 200) -> Column:
    return F.length(F.coalesce(F.trim(text), F.lit(""))) >= least


def quality_reason(text: Column, q: Quality | None = None) -> Column:
    """'' where the text passes the document rules of Rae et al. 2021, else the first rule that it breaks."""
    q = q or Quality()
    t, lines = tokens(text), lines_of(text)
    n = F.size(t)
    mean = F.length(F.array_join(t, "")) / F.greatest(n, F.lit(1))
    symbols = (F.size(F.split(text, "#", -1)) - 1 + F.size(F.split(text, r"\.\.\.|…", -1)) - 1) / F.greatest(n, F.lit(1))
    bullets = F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-•*]"))) / F.greatest(F.size(lines), F.lit(1))
    ellipses = F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))) / F.greatest(F.size(lines), F.lit(1))
    alpha = F.size(F.filter(t, lambda x: x.rlike(r"\p{L}"))) / F.greatest(n, F.lit(1))
    stop = F.size(F.array_intersect(F.transform(t, F.lower), F.array(*map(F.lit, STOP_WORDS))))
    return (
        F.when(F.coalesce(n, F.lit(0)) < q.least_words, "few words").when(n > q.most_words, "many words")
        .when((mean < q.least_mean) | (mean > q.most_mean), "word length").when(symbols > q.most_symbols, "symbols")
        .when(bullets > q.most_bullets, "bullets").when(ellipses > q.most_ellipses, "ellipses").when(alpha < q.least_alpha, "not words")
        .when(stop < q.least_stop_words, "stop words").otherwise("")
    )


def repetition(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, duplicate_lines, duplicate_line_chars, top_2..4, repeated_5..10, repetitive)``: shares of repeated parts; one Arrow pass.

    ``top_n`` is the share of characters in the most frequent n-gram that occurs at least twice, ``repeated_n`` the share
    of words that stand in some n-gram that occurred before.
    """
    names = ["duplicate_lines", "duplicate_line_chars", *[f"top_{n}" for n, _ in TOP_NGRAM], *[f"repeated_{n}" for n, _ in REPEATED_NGRAM]]
    limits = [0.30, 0.20, *[x for _, x in TOP_NGRAM], *[x for _, x in REPEATED_NGRAM]]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names) + ", repetitive boolean"

    def shares(t: str | None) -> list[float]:
        lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
        seen, count, chars = set(), 0, 0
        for x in lines:
            if x in seen:
                count, chars = count + 1, chars + len(x)
            seen.add(x)
        w = (t or "").split()
        size = sum(map(len, w))
        out = [count / max(1, len(lines)), chars / max(1, len(t or ""))]
        for n, _ in TOP_NGRAM:
            c = Counter(zip(*(w[i:] for i in range(n)), strict=False))
            top = max(((v, sum(map(len, g))) for g, v in c.items()), default=(0, 0))
            out.append(top[0] * top[1] / size if top[0] > 1 else 0.0)
        for n, _ in REPEATED_NGRAM:
            before, covered = set(), 0
            at, reach = 0, 0
            for at in range(len(w) - n + 1):
                g = tuple(w[at : at + n])
                if g in before:
                    covered += sum(map(len, w[max(at, reach) : at + n]))
                    reach = at + n
                before.add(g)
            out.append(covered / size if size else 0.0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shares(t) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(names))]
            flags = pa.array([any(x > m for x, m in zip(r, limits, strict=True)) for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, flags], names=[key, *names, "repetitive"])

    return df.select(key, text).mapInArrow(run, schema)


def c4_lines(text: Column, least_words: int = 3) -> Column:
    """Text without lines of fewer than ``least_words`` words or with javascript; the terminal mark isn't required."""
    kept = F.filter(F.split(text, "\n"), lambda x: (F.size(tokens(x)) >= least_words) & ~F.lower(x).contains("javascript"))
    return F.array_join(kept, "\n")


def c4_reason(text: Column, least_sentences: int = 5) -> Column:
    """'' where the text passes the page rules of Raffel et al. 2020, else the first that it breaks."""
    low = F.lower(text)
    sentences = F.size(F.split(text, r"[.!?](?:\s|$)", -1)) - 1
    return F.when(low.contains("lorem ipsum"), "filler").when(text.contains("{"), "braces").when(sentences < least_sentences, "few sentences").otherwise("")


def fineweb_reason(text: Column) -> Column:
    """'' where the text passes the line rules of Penedo et al. 2024, else the first that it breaks."""
    lines = lines_of(text)
    n = F.greatest(F.size(lines), F.lit(1))
    ended = F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"[.?!\"'”]$"))) / n
    short = F.size(F.filter(lines, lambda x: F.length(x) <= 30)) / n
    unique = F.array_distinct(lines)
    repeated = 1 - F.length(F.array_join(unique, "")) / F.greatest(F.length(F.array_join(lines, "")), F.lit(1))
    return F.when(ended <= 0.12, "line ends").when(repeated >= 0.1, "repeated lines").when(short >= 0.67, "short lines").otherwise("")


def document_words(text: Column) -> Column:
    return F.size(words(text))
