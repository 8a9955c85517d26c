"""Operators over flat rows of runs, segments, cells and images: windows, range joins and ordered aggregates.

All work within (path, page), so partitioning by path serves every step of a page; side inputs are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("path", "page_no")


def ordered_text(parts: Column, by: Column) -> Column:
    """Aggregate: the strings in the order of `by`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), parts.alias("t")))), lambda x: x["t"]), "")


def line_text(runs: DataFrame) -> DataFrame:
    """(path, page_no, text) of runs (path, page_no, seq, text, font_size, x, y, width): a line ends where the baseline
    moves by more than 0.55 of the larger size, a space stands where the gap exceeds 0.2 of it. Empty runs don't count."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    some = runs.where("text IS NOT NULL AND text <> ''")
    size = F.greatest(F.col("font_size"), F.lag("font_size").over(w))
    dy, gap = F.abs(F.col("y") - F.lag("y").over(w)), F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    lead = F.when(F.lag("seq").over(w).isNull(), "").when(dy > 0.55 * size, "\n").when(gap > 0.2 * size, " ").otherwise("")
    return some.withColumn("_t", F.concat(lead, F.col("text"))).groupBy(*PAGE).agg(ordered_text(F.col("_t"), F.col("seq")).alias("text"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """Adjacent runs of one style that touch on one line, joined: (path, page_no, seq, text, font, font_size, color, x,
    y, width, height), seq being the first one's."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    same = F.lit(True)
    for c in ("font", "font_size", "color"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    touch = same & (F.abs(F.col("y") - F.lag("y").over(w)) < 0.01) & (F.abs(F.lag(F.col("x") + F.col("width")).over(w) - F.col("x")) < 0.01)
    islands = runs.where("text IS NOT NULL AND text <> ''").withColumn("_new", F.when(F.coalesce(touch, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    first = lambda c: F.min_by(c, "seq").alias(c)
    return islands.groupBy(*PAGE, "_g").agg(F.min("seq").alias("seq"), ordered_text(F.col("text"), F.col("seq")).alias("text"), *map(first, ("font", "font_size", "color", "x", "y")), F.sum("width").alias("width"), F.max("height").alias("height")).drop("_g")


def bounds(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest rectangle around each group; rectangles without extent don't count."""
    r = rects.where("width <> 0 OR height <> 0")
    g = r.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_r"), F.max(F.col("y") + F.col("height")).alias("_b"))
    return g.select(*keys, "x", "y", (F.col("_r") - F.col("x")).alias("width"), (F.col("_b") - F.col("y")).alias("height"))


def classified(segments: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Adds orientation (h, v or null), coordinate, start and stop of segments (x1, y1, x2, y2)."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    o = F.when((dy <= tolerance) & (dx >= 4), "h").when((dx <= tolerance) & (dy >= 4), "v")
    pick = lambda h, v: F.when(F.col("orientation") == "h", h).when(F.col("orientation") == "v", v)
    s = segments.withColumn("orientation", o)
    return s.withColumns({"coordinate": pick((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2), "start": pick(F.least("x1", "x2"), F.least("y1", "y2")), "stop": pick(F.greatest("x1", "x2"), F.greatest("y1", "y2"))})


def merged_rules(rules: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Joins overlapping or touching rules with equal coordinates: gaps and islands over the running end."""
    keys = [*PAGE, "orientation", "coordinate"]
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = rules.withColumn("_new", F.when(F.col("start") <= reach + tolerance, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return x.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def grid_cells(rules: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(path, page_no, left, low, right, high) of the cells that merged rules close on four sides without a rule
    between; coordinates must be equal for one line. Range joins within a page; pages have few rules."""
    h, v = rules.where("orientation = 'h'"), rules.where("orientation = 'v'")
    ys = h.select(*PAGE, F.col("coordinate").alias("low")).distinct()
    pairs = ys.join(ys.withColumnRenamed("low", "high"), list(PAGE)).where("high > low")
    bars = v.select(*PAGE, F.col("coordinate").alias("left"), "start", "stop")
    cover = pairs.join(bars, list(PAGE)).where((F.col("start") <= F.col("low") + tolerance) & (F.col("stop") >= F.col("high") - tolerance)).select(*PAGE, "low", "high", "left").distinct()
    w = Window.partitionBy(*PAGE, "low", "high").orderBy("left")
    cells = cover.withColumn("right", F.lead("left").over(w)).where("right IS NOT NULL")
    spans = h.select(*PAGE, F.col("coordinate").alias("_y"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    key = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in PAGE]
    over = (F.col("s._a") <= F.col("c.left") + tolerance) & (F.col("s._b") >= F.col("c.right") - tolerance)
    for edge in ("low", "high"):
        cells = cells.alias("c").join(spans.alias("s"), [*key, over, F.col("s._y") == F.col(f"c.{edge}")], "left_semi")
    cells = cells.alias("c").join(spans.alias("s"), [*key, over, F.col("s._y") > F.col("c.low"), F.col("s._y") < F.col("c.high")], "left_anti")
    return cells.select(*PAGE, "left", "low", "right", "high")


def runs_to_cells(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """The best cell of each run: (path, page_no, seq, left, low, score), score being the covered share of the run plus
    one if its centre lies inside; of equals the lowest, leftmost. Runs outside all cells are absent."""
    right, top = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    w = F.greatest(F.lit(0.0), F.least(right, F.col("right")) - F.greatest(F.col("x"), F.col("left")))
    h = F.greatest(F.lit(0.0), F.least(top, F.col("high")) - F.greatest(F.col("y"), F.col("low")))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = (cx >= F.col("left")) & (cx <= F.col("right")) & (cy >= F.col("low")) & (cy <= F.col("high"))
    near = (F.col("x") <= F.col("right")) & (right >= F.col("left")) & (F.col("y") <= F.col("high")) & (top >= F.col("low"))
    scored = runs.join(cells, list(PAGE)).where(near).withColumn("score", w * h / F.greatest(F.lit(1e-9), F.col("width") * F.col("height")) + inside.cast("double"))
    best = scored.where("score > 0").groupBy(*PAGE, "seq").agg(F.max_by(F.struct("left", "low", "score"), F.struct("score", -F.col("low"), -F.col("left"))).alias("b"))
    return best.select(*PAGE, "seq", "b.left", "b.low", "b.score")


def outer_rects(rects: DataFrame, key: str, ratio: float = 1.5) -> DataFrame:
    """Rectangles of a page without those that contain a smaller one (more than `ratio` times its area)."""
    a, b = rects.alias("a"), rects.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE]
    holds = (F.col("a.x") <= F.col("b.x")) & (F.col("a.y") <= F.col("b.y")) & (F.col("a.x") + F.col("a.width") >= F.col("b.x") + F.col("b.width")) & (F.col("a.y") + F.col("a.height") >= F.col("b.y") + F.col("b.height"))
    larger = F.col("a.width") * F.col("a.height") > ratio * F.col("b.width") * F.col("b.height")
    return a.join(b, [*same, holds, larger, F.col(f"a.{key}") != F.col(f"b.{key}")], "left_anti")


def nearest_line(values: DataFrame, lines: DataFrame, value: str, line: str, index: str) -> DataFrame:
    """Adds the index of the closest line of the page; of equals the lower."""
    d = F.struct(F.abs(F.col(value) - F.col(line)), F.col(index))
    keys = values.columns
    return values.join(lines, list(PAGE)).groupBy(*keys).agg(F.min_by(index, d).alias(index))


def sheet_text(cells: DataFrame) -> DataFrame:
    """(path, sheet, text) of cells (path, sheet, row, col, value): values at their columns, trailing tabs and blank
    rows dropped. The columns of a row are filled by position, so gaps cost nothing but tabs."""
    w = Window.partitionBy("path", "sheet", "row").orderBy("col")
    gap = F.col("col") - F.coalesce(F.lag("col").over(w), F.lit(0))
    rows = cells.withColumn("_t", F.concat(F.repeat(F.lit("\t"), gap.cast("int")), F.coalesce("value", F.lit("")))).groupBy("path", "sheet", "row").agg(F.regexp_replace(ordered_text(F.col("_t"), F.col("col")), r"\t+$", "").alias("line"))
    return rows.where("line <> ''").groupBy("path", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def with_shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Adds value: the shared string (path, idx, value) that raw points to, raw itself where there is none."""
    s = strings.select("path", F.col("idx").cast("string").alias("raw"), F.col("value").alias("_s"))
    return cells.join(s, ["path", "raw"], "left").withColumn("value", F.coalesce("_s", "raw")).drop("_s")


def with_fonts(cells: DataFrame, formats: DataFrame, fonts: DataFrame) -> DataFrame:
    """Adds font_name, through style index and font index; any miss gives the file's first font, then an empty name."""
    x = cells.join(formats.select("path", F.col("idx").alias("style"), "font_idx"), ["path", "style"], "left")
    x = x.join(fonts.select("path", F.col("idx").alias("font_idx"), F.col("name").alias("_n")), ["path", "font_idx"], "left")
    return x.join(fonts.where("idx = 0").select("path", F.col("name").alias("_d")), "path", "left").withColumn("font_name", F.coalesce("_n", "_d", F.lit(""))).drop("_n", "_d")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def recognition_images(images: DataFrame) -> DataFrame:
    """Images worth recognition: at least 64 x 32 with data; where the largest of a page is at least 512 x 512 only it."""
    w = Window.partitionBy(*PAGE)
    ok = images.where("width >= 64 AND height >= 32 AND size > 0").withColumn("_area", F.col("width") * F.col("height"))
    top = ok.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_area"), "seq")))
    big = F.max(F.when((F.col("_rank") == 1) & (F.col("width") >= 512) & (F.col("height") >= 512), 1).otherwise(0)).over(w)
    return top.withColumn("_big", big).where("_big = 0 OR _rank = 1").drop("_area", "_rank", "_big")


def offsets(sizes: DataFrame, keys: list[str], order: str, size: str, whole: str) -> DataFrame:
    """Adds offset: the sum of the sizes before, scaled so that all sizes make up `whole`."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(size).over(w)
    return sizes.withColumn("offset", before * F.when((total > 0) & (F.col(whole) > 0), F.col(whole) / total).otherwise(1.0))


def collapsed(steps: DataFrame, keys: list[str], order: str, index: str, blank: int = 0) -> DataFrame:
    """Steps that start a new symbol: neither blank nor the same as the step before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return steps.withColumn("_p", F.lag(index).over(w)).where((F.col(index) != blank) & (F.col("_p").isNull() | (F.col("_p") != F.col(index)))).drop("_p")


def with_declared_fonts(runs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Adds what the file declares for the font of each run; null where it declares nothing."""
    return runs.join(fonts, ["path", "font"], "left")


def style_at(chars: DataFrame, styles: DataFrame, block: int = 1 << 14) -> DataFrame:
    """Interval join as an as-of lookup: the style whose [start, stop) holds each position, null where none does.
    Sorted union and the last seen start, so that no pair is formed. Places are dealt into blocks, so that one large
    file fills many windows; a block begins with the last start of the blocks before it."""
    a = chars.select("path", F.col("fc").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("stop"), F.lit(None).cast("string").alias("style"))
    b = styles.select("path", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("stop").cast("bigint"), F.col("style").cast("string"))
    cut = F.floor(F.col("at") / block).alias("_b")
    # one row per block that holds anything; what each block hands on is found over blocks, not places
    blocks = a.unionByName(b).groupBy("path", cut).agg(F.max(F.when(F.col("kind") == 0, F.struct("at", "stop", "style"))).alias("_end"))
    handed = F.last("_end", ignorenulls=True).over(Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "_b", handed.alias("_in"))
    w = Window.partitionBy("path", "_b").orderBy("at", "kind", "stop", "style").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("stop", "style")), ignorenulls=True).over(w)
    found = a.unionByName(b).withColumn("_b", F.floor(F.col("at") / block)).withColumn("_s", last).where("kind = 1").join(blocks, ["path", "_b"], "left")
    s = F.coalesce("_s", F.when(F.col("_in").isNotNull(), F.struct("_in.stop", "_in.style")))
    return found.select("path", F.col("at").alias("fc"), F.when(F.col("at") < s["stop"], s["style"]).alias("style"))


def equal_pages(lines: DataFrame, per_page: int) -> DataFrame:
    """Page of each line (path, n) where all lines are equally high."""
    return lines.withColumn("page_no", (F.floor((F.col("n") - 1) / per_page) + 1).cast("int"))
