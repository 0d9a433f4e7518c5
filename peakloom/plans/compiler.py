"""From a parsed query to one DataFrame plan.

Peak frames have one row for each peak: ms1 (scan, mz, i, i_norm, i_tic_norm, rt, polarity), ms2 (scan, ms1scan,
frag_mz, frag_intens, loss_mz, loss_intens, precmz, rt, polarity, charge, and any metadata). All conditions of a level
become flags over one window by scan, whose partitioning the final grouping reuses: one shuffle, however many
conditions. Conditions with the free variable X meet its candidates in a banded equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import defect, half_bin, tolerance, within
from ..operators.ordered import cover
from .language import Condition, Expression, Number, Query, QueryError, Variable, parse, parse_many

COLUMNS = {"MS2PROD": ("frag_mz", "frag_intens"), "MS2NL": ("loss_mz", "loss_intens"), "MS2PREC": ("precmz", None), "MS1MZ": ("mz", "i")}


def column(e: Expression, names: dict[str, Column]) -> Column:
    if isinstance(e, Number):
        return F.lit(e.value)
    if isinstance(e, Variable):
        return names[e.name]
    a, b = column(e.left, names), column(e.right, names)
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[e.op]


def floor_of(c: Condition, strict_ms2: bool) -> Column:
    """The intensity limits of a condition."""
    mz, intensity = COLUMNS[c.field]
    if intensity is None:
        return F.lit(True)
    out = F.col(intensity) > F.lit(c.numbers.get("INTENSITYVALUE", 0.0))
    percent, tic = min(c.numbers.get("INTENSITYPERCENT", 0.0) / 100, 0.99), c.numbers.get("INTENSITYTICPERCENT", 0.0) / 100
    if c.field == "MS1MZ":
        out = out & (F.col("i_norm") > percent) & (F.col("i_tic_norm") > tic)
    elif strict_ms2:
        scan = Window.partitionBy("scan")
        out = out & (F.col(intensity) > percent * F.max(intensity).over(scan)) & (F.col(intensity) > tic * F.sum(intensity).over(scan))
    return out


def hits(c: Condition, x: Column | None = None, strict_ms2: bool = False) -> list[Column]:
    """For each alternative, whether a peak row matches."""
    mz = F.col(COLUMNS[c.field][0])
    base = floor_of(c, strict_ms2)
    low, high = c.ranges.get("MASSDEFECT", (0.0, 1.0))
    fractional = (defect(mz) > low) & (defect(mz) < high)
    if not c.values:
        return [fractional & base]
    if c.field == "MS1MZ" and (low > 0 or high < 1):
        base = base & fractional
    names = {} if x is None else {"X": x}
    targets = [column(v, names) for v in c.values]
    return [within(mz, t, tolerance(t, c.numbers.get("TOLERANCEPPM"), c.numbers.get("TOLERANCEMZ"))) & base for t in targets]


def row_filter(df: DataFrame, conditions: tuple[Condition, ...], is_ms2: bool) -> DataFrame:
    for c in conditions:
        if c.field == "MOBILITY":
            if "mobility" in df.columns:
                df = df.filter(F.col("mobility").between(*c.ranges["range"]))
            continue
        if c.field in COLUMNS or c.field == "X":
            continue
        v = column(c.values[0], {})
        if c.field == "CHARGE" and not is_ms2:
            continue
        scan = F.col("scan").cast("bigint")
        test = {"RTMIN": F.col("rt") > v, "RTMAX": F.col("rt") < v, "SCANMIN": scan >= v.cast("bigint"), "SCANMAX": scan <= v.cast("bigint"), "POLARITY": F.col("polarity") == v}
        df = df.filter(test[c.field] if c.field in test else F.col("charge") == v)
    return df


def keep_scans(df: DataFrame, conditions: list[Condition], x: Column | None, keys: list[str], strict_ms2: bool) -> DataFrame:
    """df's rows of the scans that meet every condition.

    The peaks that match any condition, a filter that reaches the scan of the table, are summed up by scan with partial aggregates
    of the few columns they need; rows then meet the scans that are left in a semi join, or, where all conditions exclude, an
    anti join with those that fail.
    """
    if not conditions:
        return df
    alternatives, values, tests = [], {}, {}
    register: dict[str, Column] = {}
    for k, c in enumerate(sorted(conditions, key=lambda c: not c.reference)):
        found = [F.coalesce(h, F.lit(False)) for h in hits(c, x, strict_ms2)]
        if strict_ms2:  # these look at a scan's whole peaks, so they are columns before anything is left out
            df = df.withColumns({f"_hit{k}_{j}": h for j, h in enumerate(found)})
            found = [F.col(f"_hit{k}_{j}") for j in range(len(found))]
        any_hit = found[0]
        for h in found[1:]:
            any_hit = any_hit | h
        alternatives.append(any_hit)
        values[f"_any{k}"] = F.max(any_hit)
        keep = F.col(f"_any{k}")
        intensity = COLUMNS[c.field][1]
        if "CARDINALITY" in c.ranges and len(found) > 1:
            values |= {f"_one{k}_{j}": F.max(h.cast("int")) for j, h in enumerate(found)}
            keep = keep & sum((F.col(f"_one{k}_{j}") for j in range(len(found))), F.lit(0)).between(*c.ranges["CARDINALITY"])
        if c.match is not None and intensity is not None:
            values[f"_sum{k}"] = F.sum(F.when(any_hit, F.col(intensity)))
            total = F.col(f"_sum{k}")
            if c.reference:
                if not isinstance(c.match, Variable):
                    raise QueryError("INTENSITYMATCHREFERENCE needs INTENSITYMATCH=Y")
                register[c.match.name] = total
            else:
                wanted, p = column(c.match, register), c.numbers.get("INTENSITYMATCHPERCENT", 0.0) / 100
                keep = keep & F.coalesce((total > wanted * (1 - p)) & (total < wanted * (1 + p)), F.lit(False))
        tests[k] = ~keep if c.excluded else keep
    matching, all_met = alternatives[0], tests[0]
    for k in range(1, len(alternatives)):
        matching, all_met = matching | alternatives[k], all_met & tests[k]
    seen = df.filter(matching).groupBy(*keys).agg(*(v.alias(name) for name, v in values.items()))
    df = df.drop(*(c for c in df.columns if c.startswith("_hit")))
    if all(c.excluded for c in conditions):
        return df.join(seen.filter(~all_met).select(*keys), keys, "left_anti")
    return df.join(seen.filter(all_met).select(*keys), keys, "left_semi")


def other_scan(ms1: DataFrame, original: DataFrame, c: Condition) -> DataFrame:
    """ms1's scans near whose time any scan has the peak: a range join on time, in bins as wide as the range."""
    left, right = c.ranges["OTHERSCAN"]
    width = max(left + right, 1e-6)
    any_hit = None
    for h in hits(c):
        any_hit = h if any_hit is None else any_hit | h
    times = original.filter(any_hit).select(F.col("rt").alias("_t")).distinct().withColumn("_bin", F.floor(F.col("_t") / width))
    scans = ms1.select("scan", "rt").distinct()
    near = scans.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("rt") - left) / width), F.floor((F.col("rt") + right) / width))))
    found = near.join(times, "_bin").filter((F.col("_t") > F.col("rt") - left) & (F.col("_t") < F.col("rt") + right)).select("scan").distinct()
    return ms1.join(found, "scan", "left_anti" if c.excluded else "left_semi")


def sub_values(c: Condition, ms1: DataFrame | None, ms2: DataFrame) -> DataFrame:
    inner = run(c.subquery, ms1, ms2)
    if "precmz" not in inner.columns:
        raise QueryError("a sub-query needs scanmz")
    return inner.select(F.col("precmz").alias("_target")).filter("_target is not null").distinct()


def band_join(peaks: DataFrame, mz: str, targets: DataFrame, c: Condition, target: Column) -> DataFrame:
    """peaks joined with the targets in whose band their mz lies: an equi-join on bins as wide as the tolerance.

    For tolerances in ppm the bins are equal on a logarithmic scale. `target` is a column of targets.
    """
    ppm, da = c.numbers.get("TOLERANCEPPM"), c.numbers.get("TOLERANCEMZ")
    if ppm is not None:
        width = math.log1p(2 * ppm / 1e6)
        bin_of = lambda v: F.floor(F.log(F.greatest(v, F.lit(1e-9))) / width)
    else:
        width = 0.1 if da is None else max(da, 1e-9)
        bin_of = lambda v: F.floor(v / width)
    wide = targets.withColumn("_at", target).withColumn("_margin", tolerance(F.col("_at"), ppm, da))
    wide = wide.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_at") - F.col("_margin")), bin_of(F.col("_at") + F.col("_margin")))))
    return peaks.withColumn("_bin", bin_of(F.col(mz))).join(wide, "_bin").filter(within(F.col(mz), F.col("_at"), F.col("_margin"))).drop("_bin", "_at", "_margin")


def link(ms1: DataFrame | None, ms2: DataFrame, by_ms1: bool, by_ms2: bool) -> tuple[DataFrame | None, DataFrame]:
    if ms1 is not None and by_ms1:
        ms2 = ms2.join(ms1.select(F.col("scan").alias("ms1scan")).distinct(), "ms1scan", "left_semi")
    if ms1 is not None and by_ms2:
        ms1 = ms1.join(ms2.select(F.col("ms1scan").alias("scan")).distinct(), "scan", "left_semi")
    return ms1, ms2


def restrict(q: Query, ms1: DataFrame | None, ms2: DataFrame, conditions: tuple[Condition, ...], strict_ms2: bool) -> tuple[DataFrame | None, DataFrame]:
    """The rows of both levels after the conditions without X."""
    original = ms1
    if ms1 is not None:
        ms1 = row_filter(ms1, conditions, False)
    ms2 = row_filter(ms2, conditions, True)
    on1 = [c for c in conditions if c.field == "MS1MZ" and c.subquery is None and "OTHERSCAN" not in c.ranges]
    on2 = [c for c in conditions if c.field in COLUMNS and c.field != "MS1MZ" and c.subquery is None]
    others = [c for c in conditions if "OTHERSCAN" in c.ranges]
    if ms1 is not None:
        ms1 = keep_scans(ms1, on1, None, ["scan"], strict_ms2)
        for c in others:
            ms1 = other_scan(ms1, original, c)
    ms2 = keep_scans(ms2, on2, None, ["scan"], strict_ms2)
    for c in conditions:
        if c.subquery is not None:
            mz = COLUMNS[c.field][0]
            side = ms1 if c.field == "MS1MZ" else ms2
            found = band_join(side.withColumn("_floor", floor_of(c, strict_ms2)).filter("_floor"), mz, sub_values(c, original, ms2), c, F.col("_target")).select("scan").distinct()
            side = side.join(found, "scan", "left_anti" if c.excluded else "left_semi")
            ms1, ms2 = (side, ms2) if c.field == "MS1MZ" else (ms1, side)
    charged = any(c.field == "CHARGE" for c in conditions)
    subs = {c.field == "MS1MZ" for c in conditions if c.subquery is not None}
    return link(ms1, ms2, bool(on1 or others or True in subs), bool(on2 or charged or False in subs))


def trim(df: DataFrame, filters: tuple[Condition, ...], level: int) -> DataFrame:
    """FILTER: the peaks of df that match."""
    for c in filters:
        if c.field not in ("MS1MZ", "MS2PROD") or c.subquery is not None:
            raise QueryError(f"FILTER {c.field} is not supported")
        if (c.field == "MS1MZ") == (level == 1) and not c.has_x:
            test = None
            for h in hits(c):
                test = h if test is None else test | h
            df = df.filter(test)
    return df


def candidates(q: Query, ms1: DataFrame | None, ms2: DataFrame) -> DataFrame:
    """(x): the m/z values that the free variable takes: of all that occur, those that a greedy pass by their tolerance keeps."""
    parts, ppm, da = [], None, None
    for c in q.where:
        if not c.has_x:
            continue
        own_ppm, own_da = c.numbers.get("TOLERANCEPPM"), c.numbers.get("TOLERANCEMZ")
        ppm = own_ppm if ppm is None else min(ppm, own_ppm) if own_ppm is not None else ppm
        da = own_da if da is None else min(da, own_da) if own_da is not None else da
        if Variable("X") in c.values:
            source, name = {"MS1MZ": (ms1, "mz"), "MS2PREC": (ms2, "precmz")}.get(c.field, (ms2, "frag_mz"))
            if c.field == "MS1MZ":
                source = source.filter(floor_of(c, False))
            parts.append(source.select(F.col(name).alias("x")))
    if not parts:
        raise QueryError("X stands alone in no condition")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    x = F.col("x")
    out = out.filter(x.isNotNull())
    for c in q.where + q.filters:
        if c.field == "X":
            for kind, (low, high) in c.ranges.items():
                out = out.filter((x if kind == "range" else defect(x)).between(low, high))
    return cover(out.withColumn("reach", half_bin(x, ppm, da)))


def met(side: DataFrame, conditions: list[Condition], xs: DataFrame, strict_ms2: bool) -> DataFrame:
    """(x, scan) where all conditions have a peak: conditions of one column and tolerance share one join, and one aggregation takes all."""
    groups: dict[tuple, list[tuple[int, Condition]]] = {}
    for k, c in enumerate(conditions):
        groups.setdefault((COLUMNS[c.field][0], c.numbers.get("TOLERANCEPPM"), c.numbers.get("TOLERANCEMZ")), []).append((k, c))
    found = None
    side = side.withColumns({f"_floor{k}": floor_of(c, strict_ms2) for k, c in enumerate(conditions)})
    for (mz, *_), members in groups.items():
        x = F.col("x")
        wanted = F.array(*(F.struct(F.lit(k).alias("_k"), column(v, {"X": x}).cast("double").alias("_target")) for k, c in members for v in c.values))
        base = F.lit(False)
        for k, c in members:
            base = F.when(F.col("_k") == k, F.col(f"_floor{k}")).otherwise(base)
        part = band_join(side, mz, xs.select("x", F.inline(wanted)), members[0][1], F.col("_target")).filter(base).select("x", "scan", "_k")
        found = part if found is None else found.unionByName(part)
    every = (1 << len(conditions)) - 1
    return found.groupBy("x", "scan").agg(F.bit_or(F.expr("shiftleft(1, _k)")).alias("_met")).filter(F.col("_met") == every).select("x", "scan")


def with_variable(q: Query, ms1: DataFrame | None, ms2: DataFrame, strict_ms2: bool) -> tuple[DataFrame | None, DataFrame]:
    """Both levels' rows for each candidate and scan that meets the conditions with X, tagged `comment` = x."""
    xs = candidates(q, ms1, ms2)
    with_x = [c for c in q.where if c.has_x]
    on1, on2 = [c for c in with_x if c.field == "MS1MZ"], [c for c in with_x if c.field != "MS1MZ"]

    def narrowed(side: DataFrame, conditions: list[Condition], scans: DataFrame | None, key: str) -> DataFrame | None:
        """(x, scan) pairs that meet the conditions."""
        pairs = scans
        plain = [c for c in conditions if not c.excluded and c.match is None and "CARDINALITY" not in c.ranges]
        if plain:
            pairs = met(side, plain, xs, strict_ms2)
        rest = [c for c in conditions if c not in plain]
        if rest:
            if pairs is None:
                raise QueryError("X needs a condition without EXCLUDED, INTENSITYMATCH or CARDINALITY")
            rows = keep_scans(side.join(pairs, "scan"), rest, F.col("x"), ["x", "scan"], strict_ms2)
            pairs = rows.select("x", "scan").distinct()
        return pairs

    pairs1 = narrowed(ms1, on1, None, "scan") if on1 else None
    pairs2 = narrowed(ms2, on2, None, "scan") if on2 else None
    if pairs2 is None:
        pairs2 = ms2.select("scan", "ms1scan").distinct().join(pairs1.withColumnsRenamed({"scan": "ms1scan"}), "ms1scan").select("x", "scan")
    elif pairs1 is not None:
        both = ms2.select("scan", "ms1scan").distinct().join(pairs2, "scan")
        pairs2 = both.join(pairs1.withColumnsRenamed({"scan": "ms1scan"}), ["x", "ms1scan"], "left_semi").select("x", "scan").distinct()
    first = Window.partitionBy("scan", F.floor("x")).orderBy("x")
    pairs2 = pairs2.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn").withColumnsRenamed({"x": "comment"})
    out2 = ms2.join(pairs2, "scan")
    if ms1 is None:
        return None, out2
    if pairs1 is None or on2:
        pairs1 = out2.select(F.col("comment").alias("x"), F.col("ms1scan").alias("scan")).distinct()
    pairs1 = pairs1.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn").withColumnsRenamed({"x": "comment"})
    return ms1.join(pairs1, "scan"), out2


METADATA = ("ms1scan", "precmz", "rt", "polarity", "charge")


def result(q: Query, ms1: DataFrame | None, ms2: DataFrame) -> DataFrame:
    df = ms1 if q.level == 1 else ms2
    if df is None:
        raise QueryError("there is no MS1 table")
    tag = ["comment"] if "comment" in df.columns else []
    mz, intensity = ("mz", "i") if q.level == 1 else ("frag_mz", "frag_intens")
    keys = ["scan", *tag]
    if q.function is None:
        return df
    if q.function == "scannum":
        return df.select(*keys).distinct()
    if q.function == "scanmz":
        return ms2.select("precmz", *tag).distinct()
    if q.function == "scanrangesum" and q.level == 1:
        return df.groupBy(F.floor(F.col(mz) / 0.1).alias("bin"), *keys).agg(F.sum(intensity).alias("i_sum"))
    total = F.max(intensity) if q.function == "scanmaxint" else F.sum(intensity)
    fixed = [c for c in df.columns if c not in (*keys, "mz", "i", "i_norm", "i_tic_norm", "frag_mz", "frag_intens", "loss_mz", "loss_intens", "peak_idx", "mobility")]
    own = [F.first(c, True).alias(c) for c in fixed]  # metadata is constant within a scan
    if q.function in ("scansum", "scanmaxint", "scanrangesum"):
        return df.groupBy(*keys).agg(*own, total.alias(intensity))
    out = df.groupBy(*keys).agg(*own, total.alias("i"), *([F.max("i_norm").alias("i_norm")] if q.level == 1 else [])).withColumn("mslevel", F.lit(q.level))
    if q.level == 2 and ms1 is not None:
        norms = ms1.groupBy(F.col("scan").alias("ms1scan")).agg(F.max("i_norm").alias("i_norm_ms1"))
        out = out.join(norms, "ms1scan", "left")
    return out


def run(query: Query | str, ms1: DataFrame | None, ms2: DataFrame, strict_ms2: bool = False) -> DataFrame:
    """The result of one query over peak tables; ms1 may be None."""
    q = parse(query) if isinstance(query, str) else query
    for key, value in q.metadata:
        if key in ms2.columns:
            ms2 = ms2.filter(F.trim(F.col(key).cast("string")) == F.lit(value))
            ms1, ms2 = link(ms1, ms2, False, True)
    variable = any(c.has_x for c in q.where)
    ms1, ms2 = restrict(q, ms1, ms2, tuple(c for c in q.where if not c.has_x), strict_ms2)
    if ms1 is not None:
        ms1 = trim(ms1, q.filters, 1)
    ms2 = trim(ms2, q.filters, 2)
    if variable:
        ms1, ms2 = with_variable(q, ms1, ms2, strict_ms2)
    return result(q, ms1, ms2)


def run_many(text: str, ms1: DataFrame | None, ms2: DataFrame) -> DataFrame:
    """Queries separated by three pipe characters, with query_index."""
    out = None
    for k, q in enumerate(parse_many(text)):
        part = run(q, ms1, ms2).withColumn("query_index", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
