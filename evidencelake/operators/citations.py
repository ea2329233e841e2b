"""Is every number quoted in an answer backed by its results?

The figures of an answer are kept in sorted blocks of bounded size, and so are its open numbers. What is shuffled are
blocks, never a row per number and figure; an answer with very many figures or quoted numbers is many blocks and is
spread over tasks. Blocks whose bounds rule out a difference or ratio are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from evidencelake.functions.text import normalised, numbers_in, to_number
from evidencelake.session import materialise

# Fixed values.
ABSOLUTE_TOLERANCE = 0.06
RELATIVE_TOLERANCE = 0.015
SMALL_INTEGER = 12
YEARS = (2020, 2030)
BLOCK = 1024
MIN_WHY = 60
MIN_ACTION = 25
DATE_IN_TEXT = r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?"
DATE_VALUE = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?"

# a hyphen after a word character, percent sign or closing bracket separates two figures
_SEPARATOR = "\u0001"
_LINEAR_LIMIT = ABSOLUTE_TOLERANCE / RELATIVE_TOLERANCE


def near(n: Column, figure: Column) -> Column:
    return F.abs(n - figure) <= F.greatest(F.lit(ABSOLUTE_TOLERANCE), F.abs(figure) * RELATIVE_TOLERANCE)


def band(x: Column) -> Column:
    """A number that never decreases with x and steps about once per tolerance."""
    steps = _LINEAR_LIMIT / ABSOLUTE_TOLERANCE
    outer = F.floor(F.log(F.greatest(F.abs(x) / _LINEAR_LIMIT, F.lit(1.0))) / F.log1p(F.lit(RELATIVE_TOLERANCE))) + steps
    return F.when(F.abs(x) <= _LINEAR_LIMIT, F.floor(x / ABSOLUTE_TOLERANCE)).otherwise(F.signum(x) * outer).cast("long")


def near_bands(n: Column) -> Column:
    """Every band a figure near the number can fall in, for joins by equality; one more on either side absorbs rounding at the edges."""
    r = _near_range(n)
    return F.sequence(band(r["lo"]) - 1, band(r["hi"]) + 1)


def _near_range(n: Column) -> Column:
    """The figures a number is near to, as ``struct<lo, hi>``: both tolerances describe intervals around it."""
    inward, outward = n / (1 + RELATIVE_TOLERANCE), n / (1 - RELATIVE_TOLERANCE)
    return F.struct(
        F.least(n - ABSOLUTE_TOLERANCE, inward, outward).alias("lo"),
        F.greatest(n + ABSOLUTE_TOLERANCE, inward, outward).alias("hi"),
    )


def numeric_pool(cells: DataFrame, tasks: DataFrame, profile: DataFrame | None = None, rows_shown: int | None = None) -> DataFrame:
    """The figures an answer may cite, as ``(answer_id, position, value)`` with each value once.

    ``cells(answer_id, task_position, row_id, position, value)`` hold the results' numbers with 0-based row and
    column positions, ``tasks(answer_id, task_position, fetched_rows, total_rows)`` their sizes, ``profile`` -
    shaped like ``cells`` - the digest and extreme rows. Row counts and shown rows of every task come before any
    profile figure; a fraction is also citable as a percentage. ``rows_shown`` keeps only the first rows of each task.
    """
    where = ["answer_id", "task_position"]
    shown_n = F.least(F.col("fetched_rows"), F.lit(rows_shown)) if rows_shown else F.col("fetched_rows")
    sizes = tasks.select(
        *where,
        F.posexplode(
            F.array(*[c.cast("double") for c in (F.col("fetched_rows"), F.col("total_rows"), shown_n)])
        ).alias("i", "value"),
    ).select("answer_id", F.array(F.lit(0), F.col("task_position"), F.lit(0), F.lit(0), F.col("i"), F.lit(0)).alias("position"), "value")

    def figures(df: DataFrame, phase: int) -> DataFrame:
        v = F.col("v")
        return (
            df.filter(F.col("value").isNotNull())
            .select(*where, F.col("row_id"), F.col("position").alias("p"), F.col("value").cast("double").alias("v"))
            .select("*", F.posexplode(F.array_compact(F.array(v, F.when((v >= -1) & (v <= 1), v * 100)))).alias("s", "value"))
            .select(
                "answer_id",
                F.array(F.lit(phase), F.col("task_position"), F.lit(1), F.col("row_id").cast("int"), F.col("p"), F.col("s")).alias("position"),
                "value",
            )
        )

    pool = sizes.unionByName(figures(cells.filter(F.col("row_id") < rows_shown) if rows_shown else cells, 0))
    if profile is not None:
        pool = pool.unionByName(figures(profile, 1))
    return pool.groupBy("answer_id", "value").agg(F.min("position").alias("position"))


def date_literals(cells: DataFrame) -> DataFrame:
    """Dates the rows contain: ``(answer_id, literal)``; ``cells`` carry ``text`` values."""
    return (
        cells.filter(F.col("text").rlike(DATE_VALUE))
        .select("answer_id", F.col("text").alias("literal"))
        .distinct()
    )


def without_known_dates(texts: DataFrame, dates: DataFrame) -> DataFrame:
    """``texts(answer_id, section, text)`` with the dates its results contain blanked out.

    A date is known when it is a prefix of a literal or the other way round; an invented one stays.
    """
    found = F.regexp_extract_all(F.col("text"), F.lit(f"({DATE_IN_TEXT})"), 1)
    written = texts.select("answer_id", "section", F.explode_outer(F.array_distinct(found)).alias("found"))
    literals = dates.select("answer_id", "literal", F.left("literal", F.lit(10)).alias("day"))
    known = (
        written.withColumn("day", F.left("found", F.lit(10)))
        .join(literals, ["answer_id", "day"])
        .filter(F.startswith("literal", F.col("found")) | F.startswith("found", F.col("literal")))
        # no more dates than the one text holds
        .groupBy("answer_id", "section")
        .agg(F.collect_set("found").alias("known"))
    )
    joined = texts.join(known, ["answer_id", "section"], "left").withColumn("found", found)

    def stitch(part: Column, i: Column) -> Column:
        date = F.get(F.col("found"), i)
        blank = F.coalesce(F.array_contains("known", date), F.lit(False))
        return F.concat(part, F.coalesce(F.when(blank, F.lit(" ")).otherwise(date), F.lit("")))

    parts = F.transform(F.split("text", DATE_IN_TEXT), stitch)
    return joined.select("answer_id", "section", F.array_join(parts, "").alias("text"))


def quoted_numbers(texts: DataFrame) -> DataFrame:
    """Distinct ``(answer_id, raw, n)`` worth checking: small integers and years are not claims about the data."""
    marked = F.regexp_replace("text", r"-(?<=[A-Za-z0-9_%)\]]-)(?=\d)", _SEPARATOR)
    tokens = F.regexp_extract_all(marked, F.lit(rf"([-{_SEPARATOR}]?\d[\d,]*(?:\.\d+)?)"), 1)
    n, whole = F.col("n"), F.col("n") == F.floor("n")
    return (
        # the outer form: an inferred emptiness filter would scan every text twice
        texts.select("answer_id", F.explode_outer(tokens).alias("token"))
        .select(
            "answer_id",
            F.regexp_replace("token", _SEPARATOR, "-").alias("raw"),
            to_number(F.regexp_replace("token", _SEPARATOR, "")).alias("n"),
        )
        .filter(n.isNotNull())
        .filter(~(whole & (F.abs(n) <= SMALL_INTEGER)))
        .filter(~(whole & F.abs(n).between(*YEARS)))
        .distinct()
    )


def sorted_blocks(df: DataFrame, column: str) -> DataFrame:
    """``(answer_id, block, first, last, members)``: the different numbers of every answer, sorted and cut into blocks of at most ``BLOCK``.

    Answers are dealt by ranges of their numbers, so none passes through one task. A block's id tells it from others of
    this run only: write the blocks before they are read twice.
    """
    numbers = df.select("answer_id", F.col(column).alias("v")).dropna().distinct()
    placed = numbers.repartitionByRange("answer_id", "v").sortWithinPartitions("answer_id", "v").withColumn("i", F.monotonically_increasing_id())
    members = placed.groupBy("answer_id", F.shiftright("i", BLOCK.bit_length() - 1).alias("block")).agg(F.array_sort(F.collect_list("v")).alias("members"))
    return members.select("answer_id", "block", F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"), "members")


def figure_blocks(pool: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The blocks of all citable figures, written once; ``derives`` says whether they are usable in arithmetic, which asked numbers are not.

    ``first_count`` and ``last_count`` are the least and the greatest whole number of a block, null without one.
    """
    blocks = sorted_blocks(pool, "value").withColumn("derives", F.lit(True))
    if asked is not None:
        blocks = blocks.unionByName(sorted_blocks(asked.withColumn("value", F.col("value").cast("double")), "value").withColumn("derives", F.lit(False)))
    counts = F.filter("members", lambda v: (F.rint(v) == v) & ~F.isnan(v))
    return materialise(blocks.withColumns({"first_count": F.array_min(counts), "last_count": F.array_max(counts)}), "figures")


def meeting_blocks(open_: DataFrame, figures: DataFrame) -> DataFrame:
    """``(answer_id, ns, bs, xs)``: open numbers with every two blocks of figures that a difference, ratio or percentage among them can come from.

    Numbers that come from first and last figures of blocks alone are found already: their ``bs`` and ``xs`` are null. For any other
    number no such figure lies in the interval that another leaves, so of an answer's blocks each meets few others, not all.
    An answer's index, one row of bounds for ``BLOCK`` figures, is passed to the task that deals its pairs of blocks.
    """
    figures = figures.filter("derives")
    index = figures.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "first_count", "last_count", "block"))).alias("blocks"))
    members = lambda x: figures.select("answer_id", F.col("block").alias(f"{x}_block"), F.col("members").alias(f"{x}s"))
    numbers = sorted_blocks(open_, "n").select("answer_id", F.col("members").alias("ns"))
    ids = [StructField(c, LongType()) for c in ("b_block", "x_block")]
    pairs = numbers.join(index, "answer_id").mapInArrow(_pairs_in, StructType([numbers.schema["answer_id"], numbers.schema["ns"], *ids]))
    return (
        pairs.join(members("b"), ["answer_id", "b_block"], "left").join(members("x"), ["answer_id", "x_block"], "left")
        .select("answer_id", "ns", "bs", "xs")
    )


def _intervals(ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_near_range` of many numbers."""
    inward, outward = ns / (1 + RELATIVE_TOLERANCE), ns / (1 - RELATIVE_TOLERANCE)
    return np.minimum(np.minimum(ns - ABSOLUTE_TOLERANCE, inward), outward), np.maximum(np.maximum(ns + ABSOLUTE_TOLERANCE, inward), outward)


def _found_at_ends(ns: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``ns`` are derived from two of the sorted ``ends``, as many of them at a time as fill one pair of whole blocks."""
    found = np.zeros(len(ns), bool)
    step = max(1, BLOCK**2 // len(ns))
    for k in range(0, len(ends), step):
        rest, bs = np.nonzero(~found)[0], ends[k : k + step]
        found[rest[_derived(ns[rest], np.array([0, len(rest)]), bs, np.array([0, len(bs)]), ends, np.array([0, len(ends)]))]] = True
    return found


def _stretches(lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Per number (row) and block (column) the blocks ``start..end`` that hold the other figures of a derivation of this kind."""
    lo, hi = lo[:, None], hi[:, None]
    if kind == "difference":
        low, high = lo + first, hi + last
    else:
        corners = np.stack([x * y for x in (lo, hi) for y in (first, last)])
        low, high = corners.min(axis=0), corners.max(axis=0)
        if kind == "percentage":
            most = np.maximum(np.abs(first), np.abs(last))
            low, high = np.maximum(low / 100, -most), np.minimum(high / 100, most)
    # a little wider than the test of the figures, which decides
    slack = (np.abs(lo) + np.abs(hi) + np.abs(first) + np.abs(last) + np.abs(low) + np.abs(high)) * 1e-9 + 1e-300
    low, high = low - slack, high + slack
    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
    return np.searchsorted(last, low, "left"), np.searchsorted(first, high, "right")


def _block_pairs(ns: np.ndarray, first: np.ndarray, last: np.ndarray, first_count: np.ndarray, last_count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(number, b, x)`` positions: the blocks of one answer that some of its open numbers can come from."""
    lo, hi = _intervals(ns)
    counts = np.nonzero(~np.isnan(first_count))[0]
    # NaN is the greatest figure
    bounds = first, np.where(np.isnan(last), np.inf, last), np.arange(len(first))
    kinds = [("difference", *bounds), ("ratio", *bounds), ("percentage", first_count[counts], last_count[counts], counts)]
    step = max(1, BLOCK**2 // 8 // len(first))
    for k in range(0, len(ns), step):
        keys = []
        for kind, low, high, block in kinds:
            start, end = (c.ravel() for c in _stretches(lo[k : k + step], hi[k : k + step], low, high, kind))
            width = np.maximum(end - start, 0)
            cell = np.repeat(np.arange(len(width)), width)
            x = block[start[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(width) - width, width)]
            n, b = k + cell // max(1, len(block)), block[cell % max(1, len(block))]
            keys.append((b * len(first) + x) * len(ns) + n)
        pair, n = np.divmod(np.unique(np.concatenate(keys)), len(ns))
        yield n, *np.divmod(pair, len(first))


def _pairs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["answer_id", "ns", "b_block", "x_block"]
    for batch in batches:
        answers, numbers, blocks = (batch.column(c) for c in ("answer_id", "ns", "blocks"))
        at, n_at = blocks.offsets.to_numpy().astype(np.int64), numbers.offsets.to_numpy().astype(np.int64)
        bounds = [blocks.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "first_count", "last_count", "block")]
        all_ns = numbers.values.to_numpy(zero_copy_only=False)
        one = np.nonzero(np.diff(at) == 1)[0]
        block = pa.array(bounds[4][at[one]], pa.int64())
        yield pa.RecordBatch.from_arrays([answers.take(pa.array(one)), numbers.take(pa.array(one)), block, block], names)
        # no more answers than there are whole blocks have several
        for row in np.nonzero(np.diff(at) > 1)[0]:
            ns, (*ends, block) = all_ns[n_at[row] : n_at[row + 1]], (c[at[row] : at[row + 1]] for c in bounds)

            def rows(members, offsets, b, x):
                same = pa.array(np.full(len(offsets) - 1, row))
                return pa.RecordBatch.from_arrays([answers.take(same), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(members), type=numbers.type), pa.array(b, pa.int64()), pa.array(x, pa.int64())], names)

            with np.errstate(all="ignore"):
                figures = np.unique(np.concatenate(ends))
                found = _found_at_ends(ns, figures[~np.isnan(figures)])
                if found.any():
                    yield rows(ns[found], [0, found.sum()], [None], [None])
                ns = ns[~found]
                for n, b, x in _block_pairs(ns, *ends) if len(ns) else ():
                    new = np.nonzero(np.diff(b, prepend=-1) | np.diff(x, prepend=-1))[0]
                    yield rows(ns[n], [*new, len(n)], block[b[new]], block[x[new]])


def _lower_bounds(xs: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Per interval the first index in ``start..end`` of a figure of at least ``low``; every such stretch of ``xs`` is sorted."""
    start, end = start.copy(), end.copy()
    while (open_ := start < end).any():
        middle = (start + end) // 2
        less = open_ & (xs[np.where(open_, middle, 0)] < low)
        start, end = np.where(less, middle + 1, start), np.where(open_ & ~less, middle, end)
    return start


def _any_between(xs: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, test) -> np.ndarray:
    """Per interval whether ``test(figures, intervals)`` holds of a figure in it, looked up in ``start..end`` of ``xs``."""
    found = np.zeros(len(low), bool)
    k = np.nonzero(start < end)[0]
    # NaN is the greatest figure and in no interval
    k = k[~(xs[start[k]] > high[k]) & ~(xs[end[k] - 1] < low[k])]
    at = _lower_bounds(xs, start[k], end[k], low[k])
    while len(k):
        inside = at < end[k]
        inside[inside] = xs[at[inside]] <= high[k[inside]]
        k, at = k[inside], at[inside]
        passed = test(xs[at], k)
        found[k[passed]] = True
        k, at = k[~passed], at[~passed] + 1
    return found


def _derived(ns: np.ndarray, n_at: np.ndarray, bs: np.ndarray, b_at: np.ndarray, xs: np.ndarray, x_at: np.ndarray) -> np.ndarray:
    """Which of ``ns`` are a difference or ratio of a figure of ``xs`` and another of ``bs``, or a percentage of two counts.

    Unit u has the numbers ``ns[n_at[u]:n_at[u + 1]]``, and so on; its ``xs`` are sorted.
    """
    found = np.zeros(len(ns), bool)
    los, his = _intervals(ns)
    # every number of a unit with every one of its bs
    width = np.diff(b_at)
    cells = np.diff(n_at) * width
    unit = np.repeat(np.arange(len(cells)), cells)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(cells) - cells, cells)
    i, j = n_at[unit] + nth // width[unit], b_at[unit] + nth % width[unit]
    lo, hi, b = los[i], his[i], bs[j]

    def difference(x, k):
        return (x != b[k]) & (x - b[k] >= lo[k]) & (x - b[k] <= hi[k])

    # the bounds are a little wider than the test, which decides
    slack = (np.abs(lo) + np.abs(hi) + np.abs(b)) * 1e-9
    found[i[_any_between(xs, x_at[unit], x_at[unit + 1], lo + b - slack, hi + b + slack, difference)]] = True

    whole = xs == np.floor(xs)
    before = np.concatenate([[0], np.cumsum(whole)])
    for scale, figures, at, usable in ((1.0, xs, x_at, b != 0), (100.0, xs[whole], before[x_at], (b != 0) & (b == np.floor(b)))):
        c = np.nonzero(usable & ~found[i])[0]
        u, ci, cb = unit[c], i[c], b[c]
        low, high = los[ci] / scale, his[ci] / scale

        def share(x, k):
            s = x / cb[k]
            return (x != cb[k]) & (s >= low[k]) & (s <= high[k]) & ((scale == 1.0) | (np.abs(s) <= 1))

        one, other = low * cb, high * cb
        slack = (np.abs(one) + np.abs(other)) * 1e-9 + 1e-300
        least, most = np.minimum(one, other), np.maximum(one, other)
        if scale != 1.0:
            least, most = np.maximum(least, -np.abs(cb)), np.minimum(most, np.abs(cb))
        found[ci[_any_between(figures, at[u], at[u + 1], least - slack, most + slack, share)]] = True
    return found


def _derived_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (ns, n_at), (bs, b_at), (xs, x_at) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy().astype(np.int64)) for c in (batch.column(n) for n in ("ns", "bs", "xs")))
        known = batch.column("bs").is_null().to_numpy(zero_copy_only=False)
        cells = np.cumsum(np.diff(n_at) * np.diff(b_at))
        # as many units at a time as fill one pair of whole blocks
        for rows in np.split(np.arange(len(cells)), np.unique(np.searchsorted(cells, np.arange(BLOCK**2, cells[-1] if len(cells) else 0, BLOCK**2), "right"))):
            if len(rows):
                of = slice(rows[0], rows[-1] + 2)
                first, last = n_at[rows[0]], n_at[rows[-1] + 1]
                with np.errstate(all="ignore"):
                    hits = _derived(ns[first:last], n_at[of] - first, bs, b_at[of], xs, x_at[of])
                # without figures: numbers found before
                hits |= np.repeat(known[rows], np.diff(n_at[of]))
                row = np.repeat(rows, np.diff(n_at[of]))[hits]
                yield pa.RecordBatch.from_arrays([batch.column("answer_id").take(pa.array(row)), pa.array(ns[first:last][hits])], ["answer_id", "n"])


def derivable(open_: DataFrame, figures: DataFrame) -> DataFrame:
    """``(answer_id, n)`` of the open numbers that are a difference or ratio of two different figures, or a percentage of two counts.

    ``figures`` are :func:`figure_blocks`. An open number and one figure leave an interval for the other, which is looked
    up in the sorted blocks - so figures are never paired with one another.
    """
    units = meeting_blocks(open_, figures)
    return units.mapInArrow(_derived_in, StructType([units.schema["answer_id"], StructField("n", DoubleType())])).distinct()


def uncited_numbers(
    texts: DataFrame, pool: DataFrame, dates: DataFrame | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """``(answer_id, raw)`` of every quoted number the results do not back.

    ``texts(answer_id, section, text)``, ``pool(answer_id, position, value)``, ``dates(answer_id, literal)``,
    ``asked(answer_id, value)``: numbers of the question itself, citable but not usable in arithmetic.
    """
    if dates is not None:
        texts = without_known_dates(texts, dates)
    figures = figure_blocks(pool, asked)
    n, r = F.col("n"), _near_range(F.col("n"))
    slack = F.abs(n) * 1e-6 + 1e-6
    met = (
        (F.col("answer_id") == F.col("_a")) & (F.col("last") >= r["lo"] - slack) & (F.col("first") <= r["hi"] + slack)
        & F.exists("members", lambda v: near(n, v))
    )
    # read twice
    open_ = materialise(quoted_numbers(texts).join(figures.withColumnRenamed("answer_id", "_a"), met, "left_anti"), "open")
    return open_.join(derivable(open_, figures), ["answer_id", "n"], "left_anti").select("answer_id", "raw").distinct()


def asked_numbers(questions: DataFrame) -> DataFrame:
    """``(answer_id, value)`` for the numbers a question contains."""
    return questions.select("answer_id", F.explode(numbers_in(F.col("question"))).alias("value")).distinct()


def citation_audit(answers: DataFrame, uncited: DataFrame) -> DataFrame:
    """Every answer with how many uncited numbers it quotes."""
    counts = uncited.groupBy("answer_id").agg(F.count(F.lit(1)).alias("uncited_n"))
    return (
        answers.select("answer_id").distinct().join(counts, "answer_id", "left").fillna({"uncited_n": 0})
        .withColumn("passes", F.col("uncited_n") == 0)
    )


def sections_substantive(headline: Column, happening: Column, why: Column, action: Column) -> Column:
    """Does the cause say more than the measurement, and the action something to do?"""
    head, what, cause, act = (normalised(c) for c in (headline, happening, why, action))
    return (
        (what != "") & (cause != "") & (act != "")
        & (F.length(cause) >= MIN_WHY)
        & ~F.contains(head, cause) & ~F.contains(what, cause) & ~F.contains(cause, what)
        & (F.length(act) >= MIN_ACTION)
    )
