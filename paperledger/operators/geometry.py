"""Word boxes on pages: rows, layout text, column bands, deskewing. words: doc_id, page_no, seq, text,
x0, y0, x1, y1. A page has some hundred words, so work by page is small groups after one shuffle by
(doc_id, page_no); windows of the same key reuse it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship_package, spread
from ..functions.text import let

PAGE = ("doc_id", "page_no")


def upper_median(values: Column) -> Column:
    """Element n/2 of the sorted values, counted from 0."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def page_metrics(words: DataFrame) -> DataFrame:
    """A18. Upper medians of the words' heights and of the width of a character."""
    boxes = words.where("length(text) > 0 and x1 > x0")
    return boxes.groupBy(*PAGE).agg(upper_median(F.collect_list(F.col("y1") - F.col("y0"))).alias("height"), upper_median(F.collect_list((F.col("x1") - F.col("x0")) / F.length("text"))).alias("char_width"))


def stack_pages(words: DataFrame) -> DataFrame:
    """W5. Pages under each other: each begins 1000 below the bottom of those before."""
    bottoms = words.groupBy(*PAGE).agg(F.max("y1").alias("bottom"))
    order = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bottoms.withColumn("offset", F.coalesce(F.sum(F.col("bottom") + 1000).over(order), F.lit(0.0))).select(*PAGE, "offset")
    return words.join(offsets, list(PAGE)).withColumn("y0", F.col("y0") + F.col("offset")).withColumn("y1", F.col("y1") + F.col("offset")).drop("offset")


ROWS = "doc_id bigint, page_no int, seq bigint, text string, x0 double, y0 double, x1 double, y1 double, row_no int"


def _typed(words: DataFrame) -> DataFrame:
    return words.select(F.col("doc_id").cast("bigint"), F.col("page_no").cast("int"), F.col("seq").cast("bigint"), "text", *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))


def _by_top(y0: list[float], y1: list[float]) -> list[int]:
    limit = 0.6 * sorted(b - a for a, b in zip(y0, y1, strict=True))[len(y0) // 2]
    rows, top, n = [], None, -1
    for y in y0:
        if top is None or abs(y - top) >= limit:
            n, top = n + 1, y
        rows.append(n)
    return rows


def _by_overlap(y0: list[float], y1: list[float]) -> list[int]:
    """Words come from top to bottom, so a row that ends above one can't take it or a later one, and rows
    open from top to bottom."""
    numbers, n = [], 0
    near: list[list[float]] = []  # number, top, bottom
    for a, b in zip(y0, y1, strict=True):
        near = [r for r in near if r[2] > a]
        row = next((r for r in near if min(r[2], b) - a > 0.35 * max(r[2] - r[1], 1)), None)
        if row is None:
            row, n = [n, a, b], n + 1
            near.append(row)
        row[2] = max(row[2], b)
        numbers.append(int(row[0]))
    return numbers


def by_page(words: DataFrame, number, shape: str, columns: tuple[str, ...], name: str, beside: str | None = None) -> DataFrame:
    """``words`` with an int column ``name``, which ``number`` gives for a page's lists of ``columns``; with
    ``beside`` it gives two lists, the second for a column of doubles of that name.

    Pages are dealt out once at most and sorted; a task takes them from batch to batch, many to a batch.
    """
    ship_package(words.sparkSession)
    at = words.columns.index("page_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            out: list[int] = []
            more: list[float | None] = []
            rows = rows.drop_columns(["_place"])
            doc, page = rows.column("doc_id").to_numpy(), rows.column(at).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (page[1:] != page[:-1]))))
            values = [rows.column(c).to_pylist() for c in columns]
            for a, b in zip(starts, np.append(starts[1:], len(doc)), strict=True):
                got = number(*(v[a:b] for v in values))
                out += got[0] if beside else got
                more += got[1] if beside else ()
            rows = rows.append_column(name, pa.array(out, pa.int32()))
            return (rows.append_column(beside, pa.array(more, pa.float64())) if beside else rows).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            doc, page = batch.column("doc_id").to_numpy(), batch.column(at).to_numpy()
            same = np.flatnonzero((doc != doc[-1]) | (page != page[-1]))
            last = int(same[-1]) + 1 if len(same) else 0  # where the batch's last page begins
            if held and (doc[0], page[0]) != (held[0].column("doc_id")[0].as_py(), held[0].column(at)[0].as_py()):
                yield done(pa.Table.from_batches(held))
                held = []
            if last:
                yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(pa.Table.from_batches(held))

    # a window asks for whole pages only, so words that lie by document already aren't dealt out again
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "seq")
    return words.withColumn("_place", F.row_number().over(order)).mapInArrow(run, shape)


def rows_by_top(words: DataFrame) -> DataFrame:
    """W3. Adds row_no: a new row where a word's top is 0.6 median heights or more from the row's first."""
    return by_page(_typed(words), _by_top, ROWS, ("y0", "y1"), "row_no")


def group_words_into_rows(words: DataFrame) -> DataFrame:
    """W2. Adds row_no, from top to bottom. A word, from top to bottom, joins the first row that it overlaps by
    more than 0.35 of the row's present height (1 at least); the row grows to its bottom."""
    return by_page(_typed(words), _by_overlap, ROWS, ("y0", "y1"), "row_no")


def rows_density(rows: DataFrame) -> DataFrame:
    """A19. doc_id, page_no, density: words of a row in the mean, of rows with two words or more; 0 without such rows."""
    sizes = rows.groupBy(*PAGE, "row_no").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*PAGE).agg(F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("n"))), F.lit(0.0)).alias("density"))


#: Rows are denser by more than this share, or no less dense with tops off their rows' by this share at most.
DENSER, FLATTER = 1.02, 0.5


#: Height of a band in which one slope holds; words half as far above or below count for it too.
SLOPE_BAND = 160
#: Pairs of words of a page looked at together, and slopes that a band must have.
PAIRS_AT_ONCE, LEAST_SLOPES = 1 << 20, 12


def _band_slopes(y0: list[float], y1: list[float], x0: list[float], seq: list[int]) -> list[float | None]:
    """The slope that W12 uses for each word of a page (None: none), from its pairs of words (J17)."""
    top, left, order = np.array(y0), np.array(x0), np.array(seq)
    high, down = np.array(y1) - top, (top - top.min()) / SLOPE_BAND
    own = np.flatnonzero(high > 0)
    if len(own) < 2:
        return [None] * len(y0)
    t, x, s, h, d = top[own], left[own], order[own], high[own], down[own]
    i, j, slope = _slope_pairs(t, x, s, 1.2 * h)
    if len(slope) < LEAST_SLOPES:
        return [None] * len(y0)
    first, last = np.maximum(np.ceil(d - 1.5), 0), np.minimum(np.floor(d + 0.5), np.floor(d.max()))
    begin, end = np.maximum(first[i], first[j]), np.minimum(last[i], last[j])
    band, used = np.floor(down).tolist(), {}
    for b in set(band):
        k = np.sort(slope[(begin <= b) & (b <= end)])
        if len(k) >= LEAST_SLOPES and 0.020 <= abs(k[len(k) // 2]) <= 0.05:
            used[b] = float(k[len(k) // 2])
    return [used.get(b) for b in band] if used else [None] * len(y0)


def _slope_pairs(t: np.ndarray, x: np.ndarray, s: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, second word and slope of J17's pairs of a page, whichever bands they lie in."""
    found = []
    step = max(PAIRS_AT_ONCE // len(t), 1)
    for a in range(0, len(t), step):
        some = slice(a, a + step)
        dx = x - x[some, None]
        i, j = ((dx >= 150) & (dx <= 2000) & (s > s[some, None])).nonzero()
        dy = t[j] - t[i + a]
        near = np.abs(dy) <= limit[i + a]
        i, j, dy = i[near], j[near], dy[near]
        found.append((i + a, j, dy / dx[i, j]))
    return found[0] if len(found) == 1 else tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _straighter(y0: list[float], y1: list[float], x0: list[float], seq: list[int]) -> tuple[list[int], list[float | None]]:
    """W2's numbers for the words as they are; where the straightened ones make the better rows, -1 less their
    numbers. Beside them each word's slope."""
    plain, slopes = _by_overlap(y0, y1), _band_slopes(y0, y1, x0, seq)
    shift = [0.0 if k is None else k * x for k, x in zip(slopes, x0, strict=True)]
    if not any(shift):
        return plain, slopes
    f0, f1 = [y - s for y, s in zip(y0, shift, strict=True)], [y - s for y, s in zip(y1, shift, strict=True)]
    order = sorted(range(len(f0)), key=lambda k: (f0[k], x0[k], seq[k]))
    fixed = [0] * len(order)
    for k, n in zip(order, _by_overlap([f0[k] for k in order], [f1[k] for k in order]), strict=True):
        fixed[k] = n
    d, e = _density(plain), _density(fixed)
    if e > d * DENSER or (e >= d and _unevenness(f0, fixed) <= _unevenness(y0, plain) * FLATTER):
        return [-1 - n for n in fixed], slopes
    return plain, slopes


def _density(numbers: list[int]) -> float:
    """A19 of one page's rows."""
    several = [n for n in Counter(numbers).values() if n > 1]
    return sum(several) / len(several) if several else 0.0


def _unevenness(tops: list[float], numbers: list[int]) -> float:
    """How far the words' tops lie below their rows', added up."""
    first: dict[int, float] = {}
    for y, n in zip(tops, numbers, strict=True):
        first[n] = min(y, first.get(n, y))
    return sum(y - first[n] for y, n in zip(tops, numbers, strict=True))


def straight_rows(words: DataFrame) -> DataFrame:
    """W2 on the words as they are, or straightened where rows are denser by two percent then (A19), or no
    less dense and half as uneven: a slope can shift words between rows and leave as many. A page's slopes (W12)
    come with its rows, from one pass: as joins of its words they would be dealt out eight times. The rows lie by page."""
    rows = by_page(_typed(words), _straighter, ROWS.replace("row_no int", "code int, k double"), ("y0", "y1", "x0", "seq"), "code", "k")
    fixed = F.col("code") < 0
    shift = F.when(fixed, F.coalesce(F.col("k") * F.col("x0"), F.lit(0.0))).otherwise(0.0)
    rows = rows.select(*PAGE, "seq", "text", "x0", (F.col("y0") - shift).alias("y0"), "x1", (F.col("y1") - shift).alias("y1"), F.when(fixed, -1 - F.col("code")).otherwise(F.col("code")).alias("row_no"))
    return spread(rows, *PAGE)


def layout_text(rows: DataFrame, gap_factor: float = 2.5) -> DataFrame:
    """W4. doc_id, page_no, flat, layout: rows as lines; in the layout a bar where the gap between two
    words is over gap_factor characters. A page's rows and widths come from the same aggregates, so words move once."""
    word = F.struct("x0", "seq", "x1", "text")
    line = rows.groupBy(*PAGE, "row_no").agg(F.array_sort(F.collect_list(word)).alias("w"), F.collect_list(_char_width()).alias("widths"))
    page = line.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row_no", "w"))).alias("lines"), upper_median(F.flatten(F.collect_list("widths"))).alias("char_width")).where("char_width is not null")

    def spaced(w: Column) -> Column:
        gap = lambda x, i: x["x0"] - F.get(w, i - 1)["x1"]
        sep = lambda g: F.when(g.isNull(), "").when(g > F.col("char_width") * gap_factor, " | ").otherwise(" ")
        return F.array_join(F.transform(w, lambda x, i: F.concat(let(gap(x, i), sep), x["text"])), "")

    flat = lambda w: F.array_join(F.transform(w, lambda x: x["text"]), " ")
    whole = lambda f: F.array_join(F.transform("lines", lambda x: f(x["w"])), "\n")
    return page.select(*PAGE, whole(flat).alias("flat"), whole(spaced).alias("layout"))


def _char_width() -> Column:
    """Width of a character of a word's box; null without text or width."""
    return F.when((F.length("text") > 0) & (F.col("x1") > F.col("x0")), (F.col("x1") - F.col("x0")) / F.length("text"))


def column_bands(words: DataFrame) -> DataFrame:
    """W6. doc_id, page_no, band, lo, hi: x-intervals of the words merged over gaps up to 1.5 characters
    (4 at least); borders in the middle of gaps, one character beyond at the ends. Pages of fewer than
    four boxes have none. A page's boxes are one array, merged from left to right."""
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "seq"))).alias("w"), upper_median(F.collect_list(_char_width())).alias("char_width"))
    pages = pages.where("size(w) >= 4 and char_width is not null")
    limit = F.greatest(F.col("char_width") * 1.5, F.lit(4.0))
    edge = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))
    none = F.lit(None).cast("double")
    start = F.struct(F.array().cast("array<struct<a:double,b:double>>").alias("done"), none.alias("a"), none.alias("b"), none.alias("right"))

    def step(s: Column, x: Column) -> Column:
        right = F.greatest(s["right"], x["x1"]).alias("right")
        new = F.struct(F.concat(s["done"], F.array(edge(s))).alias("done"), x["x0"].alias("a"), x["x1"].alias("b"), right)
        wider = F.struct(s["done"].alias("done"), F.least(s["a"], x["x0"]).alias("a"), F.greatest(s["b"], x["x1"]).alias("b"), right)
        return F.when(x["x0"] - s["right"] > limit, new).otherwise(wider)

    merged = F.aggregate("w", start, step, lambda s: F.concat(s["done"], F.array(edge(s))))
    bands = pages.select(*PAGE, "char_width", F.inline(F.array(F.struct(merged.alias("bands")))))
    lo = lambda e, i: F.coalesce((F.get("bands", i - 1)["b"] + e["a"]) / 2, e["a"] - F.col("char_width"))
    hi = lambda e, i: F.coalesce((F.get("bands", i + 1)["a"] + e["b"]) / 2, e["b"] + F.col("char_width"))
    ends = F.transform("bands", lambda e, i: F.struct(lo(e, i).alias("lo"), hi(e, i).alias("hi")))
    return bands.select(*PAGE, F.posexplode(ends).alias("band", "e")).select(*PAGE, "band", "e.lo", "e.hi")


def words_to_bands(words: DataFrame, bands: DataFrame) -> DataFrame:
    """J13. Adds band: lo <= centre < hi; left of all bands the first, right of all the last. The bands
    of a page come as one array, so a page's words aren't multiplied."""
    listed = bands.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("band", "lo", "hi"))).alias("bands"))
    centre = (F.col("x0") + F.col("x1")) / 2
    rows = words.join(listed, list(PAGE)).withColumn("centre", centre)
    hit = F.get(F.filter("bands", lambda b: (b["lo"] <= F.col("centre")) & (F.col("centre") < b["hi"])), F.lit(0))["band"]
    ends = F.when(F.col("centre") < F.get("bands", F.lit(0))["lo"], F.get("bands", F.lit(0))["band"]).otherwise(F.element_at("bands", -1)["band"])
    return rows.withColumn("band", F.coalesce(hit, ends)).drop("bands", "centre")


def words_in_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """J12. doc_id, page_no, box, text: words whose centre lies in the box, borders included, by (y0, x0)."""
    b = boxes.select(*PAGE, "box", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hits = words.join(b, list(PAGE)).where(cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1")))
    return hits.groupBy(*PAGE, "box").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", "text"))), lambda x: x["text"]), " ").alias("text"))


def _from_top(words: DataFrame) -> DataFrame:
    """Adds down: how far a word's top lies below the page's."""
    return words.withColumn("down", F.col("y0") - F.min("y0").over(Window.partitionBy(*PAGE)))


def word_slope_pairs(words: DataFrame, band: int = SLOPE_BAND) -> DataFrame:
    """J17. doc_id, page_no, band_no, slope of pairs of words, the second later in the engine's order, whose
    upper left corners are 150 to 2000 apart across and 1.2 heights of the first at most down. A page's
    bands are counted from its top; both words lie in the band or half a band beside it, so a pair can
    count in several."""
    w = _from_top(words).where("y1 > y0").select(*PAGE, "seq", "x0", "y0", (F.col("y1") - F.col("y0")).alias("h"), "down")
    w = w.withColumn("last", F.floor(F.max("down").over(Window.partitionBy(*PAGE)) / band))
    first_in, last_in = F.greatest(F.ceil(F.col("down") / band - 1.5), F.lit(0)), F.least(F.floor(F.col("down") / band + 0.5), F.col("last"))
    w = w.withColumn("band_no", F.explode(F.sequence(first_in.cast("int"), last_in.cast("int"))))
    other = w.select(*PAGE, "band_no", F.col("seq").alias("later"), F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    dx, dy = F.col("ox") - F.col("x0"), F.col("oy") - F.col("y0")
    return w.join(other, [*PAGE, "band_no"]).where((F.col("later") > F.col("seq")) & dx.between(150, 2000) & (F.abs(dy) <= 1.2 * F.col("h"))).select(*PAGE, "band_no", (dy / dx).alias("slope"))


def deskew(words: DataFrame, names: tuple[str, str] = ("y0", "y1")) -> DataFrame:
    """W12. Straightened words: per band (J17) the upper median of 12 slopes or more, used from 0.020 to 0.05,
    for the words whose top lies in the band itself. ``names``: the columns of the new tops and bottoms."""
    slopes = word_slope_pairs(words).groupBy(*PAGE, "band_no").agg(F.count(F.lit(1)).alias("n"), upper_median(F.collect_list("slope")).alias("k"))
    used = slopes.where(f"n >= {LEAST_SLOPES} and abs(k) between 0.020 and 0.05").select(*PAGE, "band_no", "k")
    rows = _from_top(words).withColumn("band_no", F.floor(F.col("down") / SLOPE_BAND).cast("int")).join(used, [*PAGE, "band_no"], "left")
    shift = F.coalesce(F.col("k") * F.col("x0"), F.lit(0.0))
    return rows.withColumns({names[0]: F.col("y0") - shift, names[1]: F.col("y1") - shift}).drop("band_no", "k", "down")


def duplicate_rows(cells: DataFrame) -> DataFrame:
    """A16. doc_id, source, row_no of rows that repeat an earlier row of their table word for word."""
    row = cells.groupBy("doc_id", "source", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.trim("value").alias("v")))).alias("r"))
    first = Window.partitionBy("doc_id", "source", F.xxhash64("r"), "r").orderBy("row_no")
    return row.withColumn("n", F.row_number().over(first)).where("n > 1").select("doc_id", "source", "row_no")


def max_money_in_totals(cells: DataFrame) -> DataFrame:
    """A17. Largest sum (cents) of a table's totals row."""
    from ..functions.money import cents

    return cells.where("is_total").groupBy("doc_id", "source").agg(F.max(cents(F.col("value"))).alias("total"))


def pick_grid(grid_cells: DataFrame) -> DataFrame:
    """A20. doc_id, grid_no of the grid with most distinct known captions (100 each), numbers (5) and
    filled cells (1), among those of three columns and four filled cells; the first of equal ones."""
    from ..functions.money import cents
    from .lines import classify_header_word

    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    g = grid_cells.groupBy("doc_id", "grid_no").agg(
        F.count_distinct("col").alias("cols"), F.count(F.when(filled, 1)).alias("filled"), F.count(cents(F.col("text"))).alias("numbers"), F.count_distinct(F.when(F.col("row") == 0, classify_header_word(F.substring_index(F.trim("text"), " ", 1)))).alias("roles"),
    )
    score = F.col("roles") * 100 + F.col("numbers") * 5 + F.col("filled")
    return g.where("cols >= 3 and filled >= 4").groupBy("doc_id").agg(F.max_by("grid_no", F.struct(score.alias("s"), (-F.col("grid_no")).alias("first"))).alias("grid_no"))
