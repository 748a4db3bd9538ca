"""Marks on pages: bands of labels, grid axes, owners of callouts, lines that go on, cells of tables.

Positions are numbers in the page's units, y downwards. Whatever is compared lies on one page; pairs are found over cells, or
between a mark and its page's bands, columns or rows of labels. A null page, id or position takes no part; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import cells
from .rounds import one_to_one

# Texts of grid labels, and a line that holds a spacing alone.
LETTER, NUMBER = r"^[A-Z]{1,2}(\.\d)?'?$", r"^\d{1,2}(\.\d)?'?$"
SPACING = r"""(?i)^\s*(\d{1,3}\s?)?@\s?\d{1,4}(\s?("|''|”|″|mm))?(\s?(c\s?/\s?c|c\.\s?c\.?))?\s*$"""


def bands(labels: DataFrame, by: list[str], tolerance: Column, least: int = 3) -> DataFrame:
    """labels in a band: neighbours by `pos` at most `tolerance` apart, with at least so many different texts. Adds `band`.

    labels: by, id, text, pos. Equal positions go by id. One window a group of `by`.
    """
    order = Window.partitionBy(*by).orderBy("pos", "id")
    far = F.coalesce(F.col("pos") - F.lag("pos").over(order) > tolerance, F.lit(False))
    numbered = labels.withColumn("band", F.sum(far.cast("int")).over(order))
    whole = Window.partitionBy(*by, "band")
    return numbered.withColumn("_texts", F.size(F.collect_set("text").over(whole))).where(F.col("_texts") >= least).drop("_texts")


def grid_axes(lines: DataFrame) -> DataFrame:
    """page, axis, label, position: the lines that a page's bubbles name, one family by letters and one by numbers.

    lines: page, id, text, size, x, y. Of the labels those of at least 0.8 of the usual size count, the median of the largest
    third (six at least). The family that keeps rows better names vertical lines, and positions of one label may differ by at
    most two sizes. Pages with fewer than three letters or numbers have no grid.
    """
    text = F.trim("text")
    family = F.when(text.rlike(LETTER), "letter").when(text.rlike(NUMBER), "number")
    known = lines.select("page", "id", text.alias("text"), "size", "x", "y", family.alias("family")).dropna()
    page = Window.partitionBy("page")
    count = lambda f: F.count_if(F.col("family") == f).over(page)
    known = known.withColumn("_n", F.count(F.lit(1)).over(page)).withColumn("_few", F.least(count("letter"), count("number")))
    known = known.withColumn("_rank", F.row_number().over(page.orderBy(F.desc("size"), "id"))).where("_few >= 3")
    large = F.col("_rank") <= F.greatest(F.lit(6), F.floor(F.col("_n") / 3))
    known = known.withColumn("big", F.percentile(F.when(large, F.col("size")), 0.5).over(page)).where("size >= 0.8 * big")
    sides = F.explode(F.array(
        F.struct(F.lit("row").alias("side"), F.col("y").alias("pos"), F.col("x").alias("along")),
        F.struct(F.lit("column").alias("side"), F.col("x").alias("pos"), F.col("y").alias("along")),
    ))
    placed = known.select("page", "id", "text", "family", "big", sides.alias("_s")).select("page", "id", "text", "family", "big", "_s.*")
    found = bands(placed, ["page", "family", "side"], F.greatest(F.lit(4.0), 0.5 * F.col("big")))
    upright = ((F.col("family") == "letter") == (F.col("side") == "row")).cast("int")
    found = found.withColumn("_letters_upright", F.sum(2 * upright - 1).over(page) > 0)
    mine = F.col("_letters_upright") == (upright == 1)
    axis = F.when(F.col("side") == "row", "vertical").otherwise("horizontal")
    label = F.regexp_replace("text", "'+$", "")
    return found.where(mine).groupBy("page", axis.alias("axis"), label.alias("label")).agg(
        F.avg("along").alias("position"), (F.max("along") - F.min("along") <= 2 * F.max("big")).alias("_agree")
    ).where("_agree").drop("_agree")


def label_bands(labels: DataFrame) -> DataFrame:
    """page, side, band, pos, lo, hi, pitch, id, at: rows and columns of labels, one row a label in its band.

    labels: page, id, text, x, y, height. Rows take neighbours within 0.7 of the page's median height (3 at least), columns
    within 12; pitch is the median gap above 1, and a band without such a gap is none.
    """
    page = Window.partitionBy("page")
    tall = labels.dropna().withColumn("_h", F.percentile("height", 0.5).over(page))
    sides = F.explode(F.array(
        F.struct(F.lit("row").alias("side"), F.col("y").alias("pos"), F.col("x").alias("at"), F.greatest(F.lit(3.0), 0.7 * F.col("_h")).alias("tol")),
        F.struct(F.lit("column").alias("side"), F.col("x").alias("pos"), F.col("y").alias("at"), F.lit(12.0).alias("tol")),
    ))
    placed = tall.select("page", "id", "text", sides.alias("_s")).select("page", "id", "text", "_s.*")
    found = bands(placed, ["page", "side"], F.col("tol"))
    band = Window.partitionBy("page", "side", "band")
    gap = F.col("at") - F.lag("at").over(band.orderBy("at", "id"))
    found = found.withColumn("_gap", F.when(gap > 1, gap)).withColumn("pitch", F.percentile("_gap", 0.5).over(band))
    return found.where("pitch is not null").select(
        "page", "side", "band", F.avg("pos").over(band).alias("pos"), F.min("at").over(band).alias("lo"), F.max("at").over(band).alias("hi"), "pitch", "id", "at"
    )


def owners(bars: DataFrame, labels: DataFrame, radius: float, pull: float = 0.35) -> DataFrame:
    """page, id, label, cost: the label that owns each callout, if one costs at most 1.5 radii.

    bars: page, id, x, y; labels as in `label_bands`. A header of a band before the callout costs its offset plus `pull` of its
    distance (1.2 radii at most), if it is the band's nearest and within 0.6 pitches. A label near the callout costs its
    distance (1.3 of it from 90 on), where sideways counts 0.6 and upwards 2.5. Ties go to the smaller label id.
    """
    known, places = bars.select("page", "id", "x", "y").dropna(), labels.select("page", F.col("id").alias("label"), F.col("x").alias("lx"), F.col("y").alias("ly")).dropna()
    size, wide = 2 * radius, radius / 0.6
    # only bars with labels around them meet, in the label's cell
    near = known.withColumn("cx", cells(F.col("x") - wide, F.col("x") + wide, size))
    near = near.withColumn("cy", cells(F.col("y") - radius / 2.5, F.col("y") + radius, size))
    here = places.withColumn("cx", F.floor(F.col("lx") / size)).withColumn("cy", F.floor(F.col("ly") / size))
    dx, dy = 0.6 * (F.col("lx") - F.col("x")), F.col("ly") - F.col("y")
    dy = F.when(dy < 0, 2.5 * dy).otherwise(dy)
    near = near.join(here, ["page", "cx", "cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    near = near.select("page", "id", F.when(F.col("d") < 90, F.col("d")).otherwise(1.3 * F.col("d")).alias("cost"), "label")

    heads = label_bands(labels).withColumnRenamed("id", "label")
    row = F.col("side") == "row"
    along, away = F.when(row, F.col("x")).otherwise(F.col("y")), F.when(row, F.col("y")).otherwise(F.col("x")) - F.col("pos")
    reach, off = 0.6 * F.col("pitch"), F.abs(F.col("at") - along)
    under = known.join(heads, "page").where((away > 1) & along.between(F.col("lo") - reach, F.col("hi") + reach) & (off <= reach))
    price = off + F.least(pull * away, F.lit(1.2 * radius))
    first = F.min(F.struct(off.alias("off"), "label", price.alias("cost"))).alias("b")
    under = under.groupBy("page", "id", "side", "band").agg(first).select("page", "id", "b.cost", "b.label")
    best = near.unionByName(under).groupBy("page", "id").agg(F.min(F.struct("cost", "label")).alias("b"))
    return best.where(F.col("b.cost") <= 1.5 * radius).select("page", "id", "b.label", "b.cost")


def with_spacings(lines: DataFrame, callout: Column, gap: float = 1.0, size: float = 60.0) -> DataFrame:
    """lines, where a callout takes the spacing line right after it: text joined by a blank, the lower conf of both.

    lines: page, id (reading order), text, x0, y0, x1, y1, way (0 across, 1 upwards, -1 downwards), conf. A spacing goes on
    from a callout written alike (across or not) that overlaps it along the text and ends at most `gap` of its thickness
    before it (0.3 after). In reading order each takes the nearest that is still free, ties to the smaller id.
    """
    c = F.col
    turned = lambda way: {
        "a0": F.when(way == 0, c("x0")).otherwise(c("y0")), "a1": F.when(way == 0, c("x1")).otherwise(c("y1")),
        "b0": F.when(way == 0, c("y0")).when(way == 1, c("x0")).otherwise(-c("x1")),
        "b1": F.when(way == 0, c("y1")).when(way == 1, c("x1")).otherwise(-c("x0")),
    }
    later = lines.where(c("text").rlike(SPACING)).withColumns(turned(c("way"))).withColumn("thick", c("b1") - c("b0"))
    later = later.withColumn("ca", cells(c("a0"), c("a1"), size)).withColumn("cb", cells(c("b0") - gap * c("thick"), c("b0") + 0.3 * c("thick"), size))
    ways = F.explode(F.when(c("way") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(-1))))
    former = lines.where(callout).withColumn("way", ways).withColumns(turned(c("way")))
    former = former.select("page", "way", c("id").alias("f_id"), c("a0").alias("f_a0"), c("a1").alias("f_a1"), c("b1").alias("f_b1"))
    former = former.withColumn("ca", cells(c("f_a0"), c("f_a1"), size)).withColumn("cb", F.floor(c("f_b1") / size))
    start, between = F.greatest("a0", "f_a0"), c("b0") - c("f_b1")
    fits = (F.least("a1", "f_a1") > start) & between.between(-0.3 * c("thick"), gap * c("thick")) & (F.floor(start / size) == c("ca"))
    pairs = later.join(former, ["page", "way", "ca", "cb"]).where(fits & (c("id") != c("f_id")))
    pairs = pairs.select("page", c("id").alias("a"), c("f_id").alias("b"), F.struct("id", between.alias("between"), "f_id").alias("cost"))
    taken = one_to_one(pairs).select("page", c("a").alias("_a"), c("b").alias("id"))
    tail = lines.select("page", c("id").alias("_a"), F.trim("text").alias("_tail"), c("conf").alias("_conf"))
    grown = lines.join(taken.join(tail, ["page", "_a"]), ["page", "id"], "left")
    out = {"text": F.when(c("_tail").isNull(), c("text")).otherwise(F.concat_ws(" ", "text", "_tail")), "conf": F.least("conf", "_conf")}
    return grown.withColumns(out).select(*lines.columns)


def table_cells(runs: DataFrame, rows: DataFrame, heads: DataFrame, near: float = 14.0) -> DataFrame:
    """page, id, row, head: the cell of each text run: the nearest row label, the last column that starts before it.

    runs: page, id, x, y (left end, middle); rows: page, row, y; heads: page, head, x. Ties of rows go to the upper, then to the
    smaller name. A run may start 14 before its column's head; runs left of the first column or farther than `near` from
    every row are in no cell. A page's heads are one array: the columns of a table.
    """
    columns = heads.dropna().groupBy("page").agg(F.array_sort(F.collect_set(F.struct("x", "head"))).alias("_heads"))
    before = F.filter("_heads", lambda h: h["x"] - 14 <= F.col("x"))
    placed = runs.dropna(subset=["page", "id", "x", "y"]).join(columns, "page").withColumn("head", F.element_at(F.transform(before, lambda h: h["head"]), -1))
    inside = F.get("_heads", F.lit(0))["x"] - 12 <= F.col("x")
    placed = placed.where(inside).select("page", "id", "y", "head").withColumn("_cell", cells(F.col("y") - near, F.col("y") + near, 2 * near))
    labels = rows.dropna().select("page", "row", F.col("y").alias("_row_y")).withColumn("_cell", F.floor(F.col("_row_y") / (2 * near)))
    off = F.abs(F.col("_row_y") - F.col("y"))
    best = F.min(F.struct(off.alias("off"), "_row_y", "row")).alias("b")
    pairs = placed.join(labels, ["page", "_cell"]).where(off <= near)
    return pairs.groupBy("page", "id", "head").agg(best).select("page", "id", "b.row", "head")
