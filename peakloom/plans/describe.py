"""Queries in words, as bands to draw, and as text again."""

from __future__ import annotations

from .language import Binary, Condition, Expression, Number, Query, Variable, parse, uses

RESULTS = {
    None: "Return the peaks of", "scannum": "Return the scan numbers of", "scansum": "Return the summed intensity of each of the", "scanrangesum": "Return the intensity summed by m/z bin of",
    "scanmz": "Return the precursor m/z of", "scaninfo": "Return information on", "scanmaxint": "Return the largest intensity of each of the",
}
NAMES = {
    "MS2PROD": "an MS2 product ion", "MS2PREC": "a precursor", "MS2NL": "a neutral loss", "MS1MZ": "an MS1 peak", "RTMIN": "a retention time above", "RTMAX": "a retention time below",
    "SCANMIN": "a scan number of at least", "SCANMAX": "a scan number of at most", "CHARGE": "a charge of", "POLARITY": "polarity", "MOBILITY": "an ion mobility", "X": "a variable X",
}
QUALIFIERS = {
    "TOLERANCEMZ": "a tolerance of {} m/z", "TOLERANCEPPM": "a tolerance of {} ppm", "INTENSITYPERCENT": "at least {}% of the base peak", "INTENSITYTICPERCENT": "at least {}% of the total intensity",
    "INTENSITYVALUE": "an intensity above {}", "INTENSITYMATCHPERCENT": "an intensity match within {}%",
}


def formula(e: Expression) -> str:
    if isinstance(e, Number):
        return f"{e.value:.10g}"
    if isinstance(e, Variable):
        return e.name
    inner = [f"({formula(x)})" if isinstance(x, Binary) and e.op in "*/-" else formula(x) for x in (e.left, e.right)]
    return inner[0] + e.op + inner[1]


def sentence(c: Condition) -> str:
    if c.field == "POLARITY":
        return "positive polarity" if c.values == (Number(1.0),) else "negative polarity"
    if c.field in ("X", "MOBILITY"):
        kind, (low, high) = next(iter(c.ranges.items()))
        return f"{NAMES[c.field]} with {'mass defect' if kind == 'massdefect' else 'a value'} from {low:g} to {high:g}"
    if c.field not in ("MS2PROD", "MS2PREC", "MS2NL", "MS1MZ"):
        return f"{NAMES[c.field]} {formula(c.values[0])}"
    if c.subquery is not None:
        at = f"at any value found thus: {describe(c.subquery)}"
    else:
        at = "at m/z " + " or ".join(map(formula, c.values)) if c.values else "at any m/z"
    parts = [QUALIFIERS[k].format(f"{v:g}") for k, v in c.numbers.items()]
    parts += [f"{k.lower()} from {low:g} to {high:g}" for k, (low, high) in c.ranges.items()]
    if c.match is not None:
        parts.append(f"an intensity of {formula(c.match)}" + (", which sets the reference" if c.reference else ""))
    return ("not " if c.excluded else "") + f"{NAMES[c.field]} {at}" + (" with " + " and ".join(parts) if parts else "")


def describe(query: Query | str) -> str:
    """An English description of a query."""
    q = parse(query) if isinstance(query, str) else query
    out = f"{RESULTS[q.function]} MS{q.level} scans"
    if q.where:
        out += " where there is " + "; and ".join(map(sentence, q.where))
    if q.filters:
        out += "; keep only peaks of " + "; and ".join(map(sentence, q.filters))
    return out + "".join(f"; only where {k} is {v}" for k, v in q.metadata) + "."


def value_at(e: Expression, names: dict[str, float]) -> float:
    if isinstance(e, Number):
        return e.value
    if isinstance(e, Variable):
        return names[e.name]
    a, b = value_at(e.left, names), value_at(e.right, names)
    return {"+": a + b, "-": a - b, "*": a * b}[e.op] if e.op != "/" else a / b


def bands(query: Query | str, x: float = 500.0, y: float = 1.0) -> list[tuple[str, float, float, float, bool]]:
    """(field, low, high, least intensity share, excluded) of every numeric peak condition, with X and Y set."""
    q = parse(query) if isinstance(query, str) else query
    out = []
    for c in q.where:
        if c.field not in ("MS2PROD", "MS2PREC", "MS2NL", "MS1MZ"):
            continue
        least = c.numbers.get("INTENSITYPERCENT", 0.0) / 100
        if c.match is not None and not c.reference and uses(c.match, "Y"):
            least = value_at(c.match, {"X": x, "Y": y})
        for e in c.values:
            at = value_at(e, {"X": x, "Y": y})
            reach = at * c.numbers["TOLERANCEPPM"] / 1e6 if "TOLERANCEPPM" in c.numbers else c.numbers.get("TOLERANCEMZ", 0.1)
            out.append((c.field, at - reach, at + reach, least, c.excluded))
    return out
