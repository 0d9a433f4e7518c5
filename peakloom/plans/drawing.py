"""What a query asks for, as shapes over m/z and relative intensity: to be drawn, or to be met with the peaks of many scans."""

from __future__ import annotations

from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .describe import value_at
from .language import Condition, Query, parse

COLOURS = {"MS2PROD": "green", "MS2PREC": "blue", "MS2NL": "red", "MS1MZ": "green", "X": "pink", "match": "purple", "least": "red"}
LEVELS = {"MS2PROD": 2, "MS2NL": 2, "MS2PREC": 2, "MS1MZ": 1, "X": 1}


@dataclass(frozen=True)
class Shape:
    """A box, or a line where low is high or bottom is top; `value` counts a condition's alternatives from 0, `excluded` ones must be empty."""

    level: int
    field: str
    what: str  # band, limit, match or least
    condition: int
    value: int
    low: float
    high: float
    bottom: float
    top: float
    excluded: bool


def reach(c: Condition, at: float) -> float:
    if "TOLERANCEPPM" in c.numbers:
        return abs(at) * c.numbers["TOLERANCEPPM"] / 1e6
    return c.numbers.get("TOLERANCEMZ", 0.1)


def shapes(query: Query | str, x: float = 500.0, y: float = 1.0, precursor: float = 800.0) -> list[Shape]:
    """The shapes of all conditions with X and Y set: bands around m/z, losses as the fragments that leave them, the limits of X, and the
    relative intensities a peak must have or reach. Conditions on any m/z, and sub-queries, have none."""
    q = parse(query) if isinstance(query, str) else query
    names, out = {"X": x, "Y": y}, []
    for n, c in enumerate(q.where):
        if c.field == "X" and "range" in c.ranges:
            out += [Shape(1, "X", "limit", n, k, at, at, 0.0, 1.0, False) for k, at in enumerate(c.ranges["range"])]
        if c.field not in LEVELS or c.field == "X" or c.subquery is not None:
            continue
        height = value_at(c.match, names) if c.match is not None else 1.0
        for k, e in enumerate(c.values):
            at = value_at(e, names)
            if c.field == "MS2NL":
                at_low, at_high = precursor - at - reach(c, at), precursor - at + reach(c, at)
            else:
                at_low, at_high = at - reach(c, at), at + reach(c, at)
            shape = lambda what, bottom, top: Shape(LEVELS[c.field], c.field, what, n, k, at_low, at_high, bottom, top, c.excluded)  # noqa: B023, E731
            out.append(shape("band", 0.0, height))
            if "INTENSITYMATCHPERCENT" in c.numbers and c.match is not None:
                share = c.numbers["INTENSITYMATCHPERCENT"] / 100
                out += [shape("match", at, at) for at in (height * (1 - share), height * (1 + share))]
            if "INTENSITYPERCENT" in c.numbers:
                out.append(shape("least", c.numbers["INTENSITYPERCENT"] / 100, c.numbers["INTENSITYPERCENT"] / 100))
    return out


def drawn_peaks(query: Query | str, peaks: DataFrame, x: float = 500.0, y: float = 1.0) -> DataFrame:
    """(scan, condition, value, field, n, best): for each scan and each band of MS2 m/z how many of its peaks lie in it and the largest relative intensity.

    peaks (scan, frag_mz, frag_intens, precmz); losses are taken from a scan's own precursor. A query has a handful of bands, so each
    peak is held against all of them where it is.
    """
    bands = [s for s in shapes(query, x, y, 0.0) if s.what == "band" and s.level == 2 and s.field != "MS2PREC"]
    if not bands:
        return peaks.select("scan").limit(0).selectExpr("scan", "0 as condition", "0 as value", "'' as field", "0L as n", "0D as best")
    place = lambda s: F.col("frag_mz") - F.col("precmz") if s.field == "MS2NL" else F.col("frag_mz")
    inside = [F.when((place(s) > s.low) & (place(s) < s.high), F.struct(F.lit(s.condition).alias("condition"), F.lit(s.value).alias("value"), F.lit(s.field).alias("field"))) for s in bands]
    top = peaks.groupBy("scan").agg(F.max("frag_intens").alias("top"))
    met = peaks.select("scan", "frag_intens", F.inline(F.filter(F.array(*inside), lambda s: s.isNotNull())))
    counts = met.groupBy("scan", "condition", "value", "field").agg(F.count("*").alias("n"), F.max("frag_intens").alias("best"))
    return counts.join(top, "scan").select("scan", "condition", "value", "field", "n", (F.col("best") / F.col("top")).alias("best"))


WIDTH, HEIGHT, MARGIN = 800, 240, 30


def svg(drawn: list[Shape], peaks: dict[int, list[tuple[float, float]]] | None = None, title: str = "") -> str:
    """Two panels, MS1 above MS2, with peaks (m/z, intensity) by level, relative to their largest, as an SVG document."""
    peaks = peaks or {}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{2 * HEIGHT}" font-size="11">', f"<title>{escape(title)}</title>"]
    for level in (1, 2):
        own, shown = [s for s in drawn if s.level == level], peaks.get(level, [])
        wide = max([1000.0, *(s.high for s in own), *(m for m, _ in shown)])
        floor = HEIGHT * level - MARGIN
        across = lambda mz: MARGIN + mz / wide * (WIDTH - 2 * MARGIN)  # noqa: B023, E731
        up = lambda share: floor - share / 1.5 * (HEIGHT - 2 * MARGIN)  # noqa: B023, E731
        out.append(f'<g><text x="{MARGIN}" y="{floor + 20}">MS{level}, m/z 0 to {wide:.0f}</text><path d="M{MARGIN} {floor}H{WIDTH - MARGIN}" stroke="black"/>')
        most = max((i for _, i in shown), default=0.0)
        out += [f'<path d="M{across(m):.2f} {floor}V{up(i / most):.2f}" stroke="gray"/>' for m, i in shown if most > 0]
        for s in own:
            colour = COLOURS[s.what if s.what in ("match", "least") else s.field]
            if s.what == "band":
                out.append(f'<rect x="{across(s.low):.2f}" y="{up(s.top):.2f}" width="{max(across(s.high) - across(s.low), 1):.2f}" height="{floor - up(s.top):.2f}" fill="none" stroke="{colour}" stroke-width="2"{" stroke-dasharray=\"6\"" if s.excluded else ""}/>')
            else:
                out.append(f'<path d="M{across(s.low):.2f} {up(s.bottom):.2f}L{across(s.high):.2f} {up(s.top):.2f}" stroke="{colour}" stroke-width="2" stroke-dasharray="2"/>')
        out.append("</g>")
    return "\n".join([*out, "</svg>"])


def visualise(query: Query | str, x: float = 500.0, y: float = 1.0, precursor: float = 800.0, peaks: dict[int, list[tuple[float, float]]] | None = None) -> str:
    return svg(shapes(query, x, y, precursor), peaks, query if isinstance(query, str) else "")


def curve(values: list[float], title: str = "") -> str:
    """A series, such as a likelihood by epoch, as an SVG document."""
    low, high = min(values, default=0.0), max(values, default=1.0)
    span, n = (high - low) or 1.0, max(len(values) - 1, 1)
    points = " ".join(f"{MARGIN + k / n * (WIDTH - 2 * MARGIN):.2f},{HEIGHT - MARGIN - (v - low) / span * (HEIGHT - 2 * MARGIN):.2f}" for k, v in enumerate(values))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-size="11"><title>{escape(title)}</title><text x="{MARGIN}" y="16">{escape(title)}: {low:.6g} to {high:.6g}</text><polyline points="{points}" fill="none" stroke="blue"/></svg>'


