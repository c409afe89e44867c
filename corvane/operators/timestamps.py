"""Mixed timestamp formats and zones to one UTC instant.

A string is reduced to its shape: every digit becomes ``9``, every run of letters ``A``. A collection has few shapes
however many rows it has, so each distinct shape of a batch is read once by a small grammar (``plan_for``), which says
which run of the shape is the year, the hour, the offset and so on. All strings of that shape are then converted
together by array arithmetic; local times go through zone transition tables that are built once on the driver from one
version of the zone database and shipped with the job, so that every executor uses the same rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import bounded_rows

SECOND = 1_000_000
#: Names of months (first letters as far as they tell months apart, without accents), by language.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene janeiro januari",
    2: "feb february februar feber février fevrier févr fevr febrero fevereiro fev februari",
    3: "mar march märz maerz mrz mars marzo março marco maart mrt",
    4: "apr april avril avr abril abr",
    5: "may mai mayo maio mei",
    6: "jun june juni juin junio junho",
    7: "jul july juli juillet juil julio julho",
    8: "aug august août aout agosto ago augustus",
    9: "sep sept september septembre septiembre setembro set",
    10: "oct october okt oktober octobre octubre outubro out",
    11: "nov november novembre noviembre novembro",
    12: "dec december dez dezember décembre decembre déc diciembre dic dezembro",
}
#: Words that may stand between a date and a time, and words around a time that carry no zone.
JOINERS = {"t", "à", "a", "às", "as", "om", "um", "at", "kl", "las"}
HOUR_WORDS = {"h", "uhr", "uur", "u", "hrs"}
OF_WORDS = {"de", "do", "del", "of"}
ORDINALS = {"st", "nd", "rd", "th", "er", "º", "ª"}
#: Offsets in minutes of zone abbreviations; those that several regions use are listed by region.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "nst": -210, "ndt": -150,
    "brt": -180, "brst": -120, "art": -180, "bst": 60, "ist": 330, "npt": 345, "pkt": 300, "ict": 420, "sgt": 480,
    "hkt": 480, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
BY_REGION = {
    "Australia": {"est": 600, "edt": 660, "cst": 570, "cdt": 630, "wst": 480},
    "Asia": {"cst": 480, "bst": 360, "ast": 180},
    "Asia/Jerusalem": {"ist": 120, "idt": 180},
    "Europe/Dublin": {"ist": 60},
}
_MONTH = {w: m for m, words in MONTHS.items() for w in words.split()}

# --- the grammar of shapes -------------------------------------------------------------------------------------------
_DATES = (
    r"(?P<y>9999)(?P<s>[-/.])(?P<m>99?)(?P=s)(?P<d>99?)",
    r"(?P<p>99?)/(?P<q>99?)/(?P<y>9999|99)",
    r"(?P<d>99?)\. ?(?P<m>99?)\. ?(?P<y>9999|99)",
    r"(?:A\.?,? )?(?P<d>99?)(?:\.|(?P<ord>A))?(?: (?P<of1>A))? (?P<mon>A)\.?,?(?: (?P<of2>A))? (?P<y>9999)",
    r"(?:A\.?,? )?(?P<d>99?)[ -](?P<mon>A)\.?[ -](?P<y>9999)",
    r"(?:A\.?,? )?(?P<mon>A)\.? (?P<d>99?)(?P<ord>A)?,? (?P<y>9999)",
    r"(?P<ymd>99999999)",
)
_CLOCKS = (
    r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?",
    r"(?P<H>99?) ?(?P<h>A) ?(?P<M>99)",
    r"(?P<hms>999999|9999)(?:[.,](?P<f>9+))?",
)
_ZONES = r"(?: ?(?P<w1>A)(?: (?P<w2>A))?)?(?: ?(?P<sign>[+-])(?:(?P<ohm>9999)|(?P<oh>99?)(?::(?P<om>99))?))?"
_JOIN = r"(?:,? (?P<j1>A) |(?P<j2>A)|,? )"
_SHAPES = [re.compile(d + "(?:" + _JOIN + c + _ZONES + ")?") for d in _DATES for c in _CLOCKS]
_NUMBER = re.compile(r"(?P<n>9{9,16})(?:[.,](?P<f>9+))?|(?P<stamp>9{14}|9{12})")


@dataclass(frozen=True)
class Plan:
    pattern: str  # captures every digit run and letter run of the shape
    at: dict  # role -> number of the run
    number: bool
    sign: int
    slash: bool


@lru_cache(maxsize=4096)
def plan_for(mask: str) -> Plan | None:
    """The parser of a shape, or None where no full date has it."""
    runs = list(re.finditer(r"9+|A", mask))
    start = {m.start(): k for k, m in enumerate(runs)}
    pattern = "^" + "".join(f"(?P<g{start[m.start()]}>" + (r"\p{L}+" if m.group() == "A" else rf"\d{{{len(m.group())}}}") + ")" if m.start() in start else re.escape(m.group()) for m in re.finditer(r"9+|A|[^9A]", mask)) + "$"
    m = _NUMBER.fullmatch(mask)
    number = bool(m)
    for shape in () if m else _SHAPES:
        m = shape.fullmatch(mask)
        if m:
            break
    if not m:
        return None
    at = {k: start.get(m.start(k), -1) for k, v in m.groupdict().items() if v is not None and k not in ("s", "sign")}
    if min(at.values()) < 0:
        return None
    sign = {"+": 1, "-": -1}.get(m.groupdict().get("sign") or "", 0)
    return Plan(pattern, at, number, sign, "p" in at)


# --- zone transition tables ------------------------------------------------------------------------------------------
def zone_version() -> str:
    """Version of the zone database behind the tables."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=1024)
def transitions(name: str | None, first_year: int = 1985, last_year: int = 2040) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(local switch times, offsets, abbreviations) of a zone, times and offsets in microseconds.

    ``offsets[k]`` holds for local times before ``switch[k]``. The switch time is the transition plus the larger of both
    offsets: a repeated hour then keeps the earlier offset (first passage) and a skipped one the offset in force before.
    Unknown names count as UTC.
    """
    try:
        zone = ZoneInfo(name) if name else timezone.utc
    except (KeyError, ValueError, OSError):
        zone = timezone.utc
    off = lambda t: int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())
    t0 = int(datetime(first_year, 1, 1, tzinfo=timezone.utc).timestamp())
    t1 = int(datetime(last_year, 1, 1, tzinfo=timezone.utc).timestamp())
    switch, offsets, names = [], [off(t0)], {}
    step = 5 * 86400
    for t in range(t0, t1, step):
        label = datetime.fromtimestamp(t, zone).tzname() or ""
        if label.isalpha():
            names[label.lower()] = off(t) // 60
        a, b = t, t + step
        if off(a) == off(b):
            continue
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if off(mid) == off(a) else (a, mid)
        switch.append((b + max(off(a), off(b))) * SECOND)
        offsets.append(off(b))
    return np.array(switch, "int64"), np.array(offsets, "int64") * SECOND, names


_SHIPPED: dict = {}


def _table(name: str | None) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    return _SHIPPED.get(name or "") or transitions(name or None)


def abbreviation_offset(word: str, tz: str | None) -> int | None:
    """Minutes of a zone abbreviation as it is used in the region of a zone, or None."""
    word = word.lower()
    if word in ("z", "utc", "gmt", "ut"):
        return 0
    for key in (tz, (tz or "").split("/")[0]):
        if key in BY_REGION and word in BY_REGION[key]:
            return BY_REGION[key][word]
    own = _table(tz)[2]
    return own.get(word, ABBREVIATIONS.get(word))


# --- conversion ------------------------------------------------------------------------------------------------------
def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of civil dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _month_days(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    n = np.array([31, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)]
    return n + ((m == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))


def _micros(f: pa.Array | None, n: int) -> np.ndarray:
    if f is None:
        return np.zeros(n, "int64")
    return pc.cast(pc.utf8_slice_codeunits(pc.utf8_rpad(f, 6, "0"), 0, 6), pa.int64()).to_numpy(zero_copy_only=False)


def _words(a: pa.Array, to: dict, default) -> np.ndarray:
    d = pc.utf8_lower(a).dictionary_encode()
    return np.array([to.get(w, default) for w in d.dictionary.to_pylist()])[d.indices.to_numpy(zero_copy_only=False)]


def _convert(values: pa.Array, plan: Plan, tz: np.ndarray, mdy: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, usable) of strings that share one shape."""
    n = len(values)
    got = pc.extract_regex(values, plan.pattern)
    run = lambda role: got.field(plan.at[role])
    num = lambda role: pc.cast(run(role), pa.int64()).to_numpy(zero_copy_only=False)
    ok = np.ones(n, bool)
    if plan.number:
        text = run("stamp" if "stamp" in plan.at else "n")
        frac = run("f") if "f" in plan.at else None
        count = pc.cast(text, pa.int64()).to_numpy(zero_copy_only=False)
        out, ok = np.zeros(n, "int64"), np.zeros(n, bool)
        size = len(text[0].as_py())
        for unit in (SECOND, 1000, 1):
            digits = {SECOND: 10, 1000: 13, 1: 16}[unit]
            if size > digits:
                continue
            part = _micros(frac, n) // (SECOND // unit) if frac is not None else 0
            us = count * unit + part
            hit = (us >= low) & (us <= high) & ~ok
            out, ok = np.where(hit, us, out), ok | hit
        if size not in (12, 14) or frac is not None:
            return out, ok
        s = text
        cut = lambda a, b: pc.cast(pc.utf8_slice_codeunits(s, a, b), pa.int64()).to_numpy(zero_copy_only=False)
        y, mo, d, h, mi = cut(0, 4), cut(4, 6), cut(6, 8), cut(8, 10), cut(10, 12)
        se = cut(12, 14) if size == 14 else np.zeros(n, "int64")
        good = (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= _month_days(y, mo)) & (h < 24) & (mi < 60) & (se < 60)
        local = _days(y, mo, d) * 86400 * SECOND + (h * 3600 + mi * 60 + se) * SECOND
        us = local - _local_offset(local, tz)
        good &= (us >= low) & (us <= high) & ~ok
        return np.where(good, us, out), ok | good

    def fixed(role: str, allowed: set) -> None:
        nonlocal ok
        if role in plan.at:
            ok &= _words(run(role), dict.fromkeys(allowed, True), False).astype(bool)

    if "ymd" in plan.at:
        s = run("ymd")
        cut = lambda a, b: pc.cast(pc.utf8_slice_codeunits(s, a, b), pa.int64()).to_numpy(zero_copy_only=False)
        y, mo, d = cut(0, 4), cut(4, 6), cut(6, 8)
    else:
        y = num("y")
        y = np.where(y < 100, 2000 + y, y)
        if plan.slash:
            p, q = num("p"), num("q")
            mo, d = np.where(mdy, p, q), np.where(mdy, q, p)
        else:
            mo, d = _words(run("mon"), _MONTH, 0).astype("int64") if "mon" in plan.at else num("m"), num("d")
    fixed("ord", ORDINALS)
    fixed("of1", OF_WORDS)
    fixed("of2", OF_WORDS)
    ok &= (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= _month_days(y, mo))
    us = _days(y, np.clip(mo, 1, 12), d) * 86400 * SECOND
    clock = "H" in plan.at or "hms" in plan.at
    offset, zoned = np.zeros(n, "int64"), np.zeros(n, bool)
    if clock:
        fixed("j1", JOINERS)
        fixed("j2", {"t"})
        fixed("h", HOUR_WORDS)
        if "hms" in plan.at:
            s = run("hms")
            cut = lambda a, b: pc.cast(pc.utf8_slice_codeunits(s, a, b), pa.int64()).to_numpy(zero_copy_only=False)
            h, mi = cut(0, 2), cut(2, 4)
            se = cut(4, 6) if len(s[0].as_py()) == 6 else np.zeros(n, "int64")
        else:
            h, mi = num("H"), num("M")
            se = num("S") if "S" in plan.at else np.zeros(n, "int64")
        for role in ("w1", "w2"):
            if role not in plan.at:
                continue
            words = pc.utf8_lower(run(role)).dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
            for k, w in enumerate(names):
                of = code == k
                if w in ("am", "pm"):
                    ok &= ~of | ((h >= 1) & (h <= 12))
                    h = np.where(of, h % 12 + (12 if w == "pm" else 0), h)
                elif w in HOUR_WORDS:
                    continue
                else:
                    for name in pd.unique(tz[of]):
                        minutes = abbreviation_offset(w, name)
                        those = of & (tz == name)
                        if minutes is None:
                            ok &= ~those
                        else:
                            offset, zoned = np.where(those, minutes * 60 * SECOND, offset), zoned | those
        ok &= (h < 24) & (mi < 60) & (se < 60)
        us = us + (h * 3600 + mi * 60 + se) * SECOND + _micros(run("f") if "f" in plan.at else None, n)
        if plan.sign:
            if "ohm" in plan.at:
                oh, om = np.divmod(num("ohm"), 100)
            else:
                oh, om = num("oh"), num("om") if "om" in plan.at else np.zeros(n, "int64")
            ok &= (oh <= 18) & (om < 60)
            offset, zoned = plan.sign * (oh * 60 + om) * 60 * SECOND, np.ones(n, bool)
    us = us - np.where(zoned, offset, _local_offset(us, tz))
    return us, ok & (us >= low) & (us <= high)


def _local_offset(local: np.ndarray, tz: np.ndarray) -> np.ndarray:
    out = np.zeros(len(local), "int64")
    for name in pd.unique(tz):
        of = tz == name
        switch, offsets, _ = _table(name)
        out[of] = offsets[np.searchsorted(switch, local[of], side="right")]
    return out


def normalise_strings(values: pa.Array, tz: np.ndarray, mdy: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970 in UTC, usable) of date strings; ``tz`` holds '' for UTC."""
    n = len(values)
    out, ok = np.zeros(n, "int64"), np.zeros(n, bool)
    text = pc.replace_substring_regex(pc.fill_null(pc.cast(values, pa.string()), ""), r"[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{feff}]+", " ")
    text = pc.utf8_trim(pc.utf8_trim(text, " "), "\"' ")
    mask = pc.replace_substring_regex(pc.replace_substring_regex(text, r"\p{L}+", "A"), r"[0-9]", "9").dictionary_encode()
    code = mask.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(mask.dictionary) + 1))
    for k, shape in enumerate(mask.dictionary.to_pylist()):
        plan = plan_for(shape)
        if plan is not None:
            rows = order[bounds[k] : bounds[k + 1]]
            out[rows], ok[rows] = _convert(text.take(pa.array(rows)), plan, tz[rows], mdy[rows], low, high)
    return out, ok


def normalise_timestamps(
    df: DataFrame,
    sources: DataFrame,
    fields: tuple[str, ...] = ("published_at", "created_at"),
    key: str = "item_id",
    low: str = "1990-01-01T00:00:00+00:00",
    high: str = "2025-07-03T00:00:00+00:00",
    max_sources: int = 100_000,
    version: bool = False,
) -> DataFrame:
    """``(key, field, utc_us)``: one row for each record and field whose string gives a usable instant.

    ``version`` adds ``zones``, the version of the zone database behind the transition tables; they are made on the driver
    for the years from ``low`` to ``high`` and travel together.

    ``sources`` gives ``source, tz, date_order``; it is a dimension table, so its rows are bounded by ``max_sources`` and
    shipped with the transition tables of their zones. Sources that are missing there, and null zones, count as UTC and
    day-first. Null, empty and unusable strings give no row, however long; fractions of a second may have any number of digits. Repeated
    rows give one row; a record delivered with different strings gives a row for each instant. A null key is kept as
    null. Other columns are ignored, whatever their names.
    """
    known = {r["source"]: (r["tz"] or "", r["date_order"] == "MDY") for r in bounded_rows(sources.select("source", "tz", "date_order"), max_sources, "sources")}
    years = [datetime.fromisoformat(x).year for x in (low, high)]
    tables = {tz: transitions(tz or None, min(1985, years[0] - 2), max(2040, years[1] + 2)) for tz in {"", *(tz for tz, _ in known.values())}}
    zones = zone_version()
    lo, hi = (int(datetime.fromisoformat(x).timestamp()) * SECOND for x in (low, high))
    kind = df.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, field string, utc_us bigint"
    names = list(fields)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corvane.operators import timestamps

        timestamps._SHIPPED.clear()
        timestamps._SHIPPED.update(tables)  # the driver's, whatever zone database this machine has
        for b in batches:
            src = b.column(1).dictionary_encode()
            code = src.indices.fill_null(len(src.dictionary)).to_numpy(zero_copy_only=False)
            of = [known.get(s, ("", False)) for s in src.dictionary.to_pylist()] + [("", False)]
            tz = np.array([x[0] for x in of], object)[code]
            mdy = np.array([x[1] for x in of], bool)[code]
            for k, name in enumerate(names):
                us, ok = normalise_strings(b.column(2 + k), tz, mdy, lo, hi)
                rows = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([name] * len(rows), pa.string()), pa.array(us[ok])], names=[key, "field", "utc_us"])

    return df.select(key, "source", *[F.col(c).cast("string") for c in names]).mapInArrow(convert, schema).distinct().select("*", *([F.lit(zones).alias("zones")] if version else []))
