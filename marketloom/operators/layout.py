"""Boxes on rendered pages: sections of images, nested and overlapping blocks, contrast of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded


def inside(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["left"], box["left"] + box["width"]) & y.between(box["top"], box["top"] + box["height"])


def in_sections(images: DataFrame, sections: DataFrame) -> DataFrame:
    """images(page_id, image_id, section_id, bbox) with section: the first of sections(page_id, id, place, bbox) that holds their middle, else their own, else ungrouped."""
    x, y = F.col("bbox.left") + F.col("bbox.width") / 2, F.col("bbox.top") + F.col("bbox.height") / 2
    boxes = sections.select(F.col("page_id").alias("of"), F.col("id").alias("found"), "place", F.col("bbox").alias("box"))
    both = images.join(boxes, (F.col("of") == F.col("page_id")) & inside(x, y, F.col("box")), "left")
    first = F.row_number().over(Window.partitionBy("page_id", "image_id").orderBy(F.col("place").asc_nulls_last(), "found"))
    return both.withColumn("n", first).where("n = 1").select(*images.columns, F.coalesce("found", "section_id", F.lit("ungrouped")).alias("section"))


def leaf_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(page_id, block_id, characters, bbox) that no other block with as many characters holds; equal boxes remove each other."""
    a, b = F.col("a.bbox"), F.col("b.bbox")
    held = (a["left"] >= b["left"]) & (a["top"] >= b["top"]) & (a["left"] + a["width"] <= b["left"] + b["width"]) & (a["top"] + a["height"] <= b["top"] + b["height"])
    more = F.coalesce("b.characters", F.lit(0)) >= F.coalesce("a.characters", F.lit(0))
    return blocks.alias("a").join(blocks.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.block_id") != F.col("b.block_id")) & held & more, "left_anti")


def overlapping(blocks: DataFrame) -> DataFrame:
    """page_id, overlaps: blocks that overlap a later one of their page."""
    a, b = F.col("a.bbox"), F.col("b.bbox")
    apart = (a["left"] + a["width"] <= b["left"]) | (b["left"] + b["width"] <= a["left"]) | (a["top"] + a["height"] <= b["top"]) | (b["top"] + b["height"] <= a["top"])
    met = blocks.alias("a").join(blocks.alias("b"), (F.col("a.page_id") == F.col("b.page_id")) & (F.col("b.block_id") > F.col("a.block_id")) & ~apart, "left_semi")
    return met.groupBy("page_id").agg(F.count("*").alias("overlaps"))


def rgb(color: Column) -> Column:
    """Red, green and blue of `rgb(...)` or `rgba(...)`; null for other text."""
    part = lambda k: F.regexp_extract(color, r"(?i)rgba?\(([0-9]+),\s*([0-9]+),\s*([0-9]+)", k)
    return F.when(part(1) != "", F.array(*(part(k).cast("double") for k in (1, 2, 3))))


def luminance(channels: Column) -> Column:
    """Relative luminance of red, green and blue of 0 to 255."""
    s = F.transform(channels, lambda v: F.when(v / 255 <= 0.03928, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, 2.4)))
    return 0.2126 * s[0] + 0.7152 * s[1] + 0.0722 * s[2]


def contrast(color: Column, background: Column) -> Column:
    """Contrast ratio, 1 to 21; a background that can't be read counts as white."""
    a, b = luminance(rgb(color)), luminance(F.coalesce(rgb(background), F.array(*[F.lit(255.0)] * 3)))
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def contrast_statistics(samples: DataFrame) -> DataFrame:
    """By page of samples(page_id, color, background): mean, least and upper median of the ratios from 1.8 on."""
    rows = samples.select("page_id", contrast(F.col("color"), F.col("background")).alias("ratio")).where("ratio >= 1.8")
    n = rows.groupBy("page_id").agg(F.avg("ratio").alias("mean"), F.min("ratio").alias("least"), F.count("*").alias("samples"), F.array_sort(F.collect_list("ratio")).alias("all"))
    median = F.element_at("all", (F.floor(F.col("samples") / 2) + 1).cast("int"))
    return n.select("page_id", rounded(F.col("mean"), 2).alias("average_ratio"), rounded(F.col("least"), 2).alias("min_ratio"), rounded(median, 2).alias("median_ratio"), "samples", (median >= 4.5).alias("aa_likely"))


# Pixels and shares from which a row of images is uneven, images that a row needs, and bands of confidence.
ROW_TOLERANCE, TOP_DELTA, SIZE_SHARE, LEAST_IMAGES = 20, 24, 0.18, 3
HIGH, MEDIUM = 0.75, 0.6


def image_rows(images: DataFrame) -> DataFrame:
    """images(page_id, section, image_id, bbox) with line: images of a section from top to bottom, gathered into rows.

    An image joins the first row whose mean top is within 20 pixels of its own, and moves that mean; so the order decides, and the fold runs over
    the sorted images of one section of one page.
    """
    box = F.struct(F.col("bbox.top").cast("double").alias("top"), F.col("bbox.left").cast("double").alias("left"), "image_id")
    rows = "array<struct<top:double,n:int,members:array<struct<top:double,left:double,image_id:" + images.schema["image_id"].dataType.simpleString() + ">>>>"

    def joined(lines: Column, x: Column) -> Column:
        place = F.array_position(F.transform(lines, lambda r: F.abs(r["top"] - x["top"]) <= ROW_TOLERANCE), True)

        def moved(r: Column, k: Column) -> Column:
            more = F.struct(((r["top"] * r["n"] + x["top"]) / (r["n"] + 1)).alias("top"), (r["n"] + 1).alias("n"), F.concat(r["members"], F.array(x)).alias("members"))
            return F.when(k + 1 == place, more).otherwise(r)

        fresh = F.array(F.struct(x["top"].alias("top"), F.lit(1).alias("n"), F.array(x).alias("members")))
        return F.when(place == 0, F.concat(lines, fresh)).otherwise(F.transform(lines, moved)).cast(rows)

    lines = images.groupBy("page_id", "section").agg(F.array_sort(F.collect_list(box)).alias("boxes")).withColumn("lines", F.aggregate("boxes", F.array().cast(rows), joined))
    return lines.select("page_id", "section", F.posexplode("lines").alias("line", "r")).select("page_id", "section", "line", F.explode("r.members").alias("m")).select("page_id", "section", "line", "m.image_id")


def alignment_issues(images: DataFrame, sections: DataFrame) -> DataFrame:
    """page_id, section, line, images, top_delta, width_share, height_share, confidence, severity: uneven rows of grid images.

    images(page_id, image_id, section_id, visible, decorative, in_grid, in_product_grid, bbox): visible grid images of 40 pixels or more
    count, where their section has three.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    shown = in_sections(images.where(F.coalesce("visible", F.lit(True))), sections)
    grid = shown.where(~yes("decorative") & (yes("in_grid") | yes("in_product_grid")) & (F.col("bbox.width") >= 40) & (F.col("bbox.height") >= 40))
    lines = image_rows(grid).join(grid.select("page_id", "section", "image_id", "bbox"), ["page_id", "section", "image_id"])
    own = Window.partitionBy("page_id", "section", "line")
    size = {side: F.col(f"bbox.{side}") for side in ("width", "height")}
    lines = lines.withColumns({f"mean_{side}": F.avg(c).over(own) for side, c in size.items()})
    share = lambda side: F.when(F.max(f"mean_{side}") > 0, F.max(F.abs(size[side] - F.col(f"mean_{side}"))) / F.max(f"mean_{side}")).otherwise(0.0)
    rows = lines.groupBy("page_id", "section", "line").agg(F.count("*").alias("images"), (F.max("bbox.top") - F.min("bbox.top")).cast("double").alias("top_delta"), share("width").alias("width_share"), share("height").alias("height_share"))
    top, wide = F.col("top_delta") > TOP_DELTA, F.greatest("width_share", "height_share")
    sure = 0.42 + F.least(F.lit(1.0), F.col("images") / 6) * 0.15
    sure = sure + F.when(top, F.least(F.lit(1.0), F.col("top_delta") / (TOP_DELTA * 2)) * 0.25).otherwise(0.0) + F.when(wide > SIZE_SHARE, F.least(F.lit(1.0), wide / (SIZE_SHARE * 2)) * 0.3).otherwise(0.0)
    rows = rows.where((F.col("images") >= LEAST_IMAGES) & (top | (wide > SIZE_SHARE))).withColumn("confidence", rounded(F.least(F.lit(0.98), sure), 2)).where(F.col("confidence") >= MEDIUM)
    return rows.withColumn("severity", F.when(F.col("confidence") >= HIGH, "high").otherwise("medium"))


def alignment_summary(issues: DataFrame) -> DataFrame:
    """page_id, misaligned_images, confidence: of pages with an uneven row."""
    return issues.groupBy("page_id").agg(F.sum("images").alias("misaligned_images"), F.max("confidence").alias("confidence"))


# What makes the text above the fold dense.
FOLD = {"area": 0.42, "large": 480, "wall": 620, "wall without headings": 520, "separated": 360, "crowd": 14, "crowd block": 380, "crowd area": 0.5, "tight": 5, "tight block": 420, "tight area": 0.45, "artifact area": 1.2, "artifact overlap": 0.45, "crowd overlap": 0.35}


def text_density(blocks: DataFrame, screens: DataFrame) -> DataFrame:
    """One row a screen(page_id, width, height, headings): how dense the text above its fold is, and how sure that is.

    blocks(page_id, block_id, characters, visible, line_height_tight, bbox with bottom): leaf blocks above the fold count; a screen without blocks has
    none. Figures are as in alignment_issues: shares, confidence of two places, a score of 0 to 100.
    """
    fold = blocks.join(screens.select("page_id", "width", "height"), "page_id").where(F.coalesce("visible", F.lit(True)) & (F.col("bbox.top") < F.col("height")) & (F.col("bbox.bottom") > 0)).drop("width", "height")
    leaves = leaf_blocks(fold)
    area = F.greatest(F.lit(0), F.col("bbox.width")) * F.greatest(F.lit(0), F.col("bbox.height"))
    rows = leaves.groupBy("page_id").agg(
        F.sum("characters").alias("characters"), F.max("characters").alias("largest"), F.sum(area).alias("text_area"), F.count("*").alias("blocks"), F.count_if("line_height_tight").alias("tight"),
    )
    rows = screens.select("page_id", F.col("width") * F.col("height"), "headings").toDF("page_id", "area", "headings").join(rows, "page_id", "left").join(overlapping(leaves), "page_id", "left").na.fill(0)
    raw = F.when(F.col("area") > 0, F.col("text_area") / F.col("area")).otherwise(0.0)
    rows = rows.withColumns({"raw_share": raw, "overlap_share": F.when(F.col("blocks") > 0, F.col("overlaps") / F.col("blocks")).otherwise(0.0)})
    rows = rows.withColumns({"share": F.least(F.lit(1.0), "raw_share"), "artifact": (F.col("raw_share") > FOLD["artifact area"]) | (F.col("overlap_share") > FOLD["artifact overlap"])})
    largest, share, real = F.col("largest"), F.col("share"), ~F.col("artifact")
    weak = (F.col("headings") < 2) & (largest >= FOLD["separated"])
    high_area, big = (share >= FOLD["area"]) & real, largest >= FOLD["large"]
    wall = (largest >= FOLD["wall"]) | ((largest >= FOLD["wall without headings"]) & (F.col("headings") < 2))
    crowd = (F.col("blocks") >= FOLD["crowd"]) & (largest >= FOLD["crowd block"]) & (share >= FOLD["crowd area"]) & (F.col("overlap_share") < FOLD["crowd overlap"]) & real
    dense = wall | (high_area & big & weak) | crowd | ((F.col("tight") >= FOLD["tight"]) & (largest >= FOLD["tight block"]) & (share >= FOLD["tight area"]) & real)
    add = lambda test, points: F.when(test, points).otherwise(0.0)
    sure = F.when(dense, F.least(F.lit(0.95), 0.58 + add(wall, 0.2) + add(big, 0.1) + add(high_area, 0.08) + add(weak, 0.08) + add(crowd, 0.06))).when(~real, 0.4).when(F.col("blocks") > 0, 0.78).otherwise(0.35)
    score = F.when(dense, F.greatest(F.lit(25.0), 100 - rounded(share * 120) - rounded(largest / 10))).otherwise(F.least(F.lit(94.0), 72 + rounded((1 - share) * 18)))
    return rows.select(
        "page_id", score.alias("density_score"), rounded(sure, 2).alias("confidence"), (dense & (sure >= MEDIUM)).alias("high_density"), F.when(F.col("area") > 0, rounded(F.col("characters") / F.col("area"), 2)).otherwise(0.0).alias("density"),
        "largest", "blocks", "artifact", F.col("overlaps").alias("overlapping"), rounded(share, 2).alias("share"),
    )


def devices_merged(alignment: DataFrame, density: DataFrame) -> DataFrame:
    """One row a page of alignment(page_id, device, misaligned_images, confidence) and density(page_id, device, ...), device desktop or mobile.

    Misaligned images count where the surer device is sure; dense text counts on mobile screens only, where a real block is large.
    """
    a = alignment.groupBy("page_id").agg(F.max("misaligned_images").alias("most"), F.max("confidence").alias("alignment_confidence"))
    mobile = F.col("device") == "mobile"
    on = lambda c: F.max(F.when(mobile, F.col(c)))
    d = density.groupBy("page_id").agg(F.coalesce(F.nullif(on("confidence"), F.lit(0.0)), F.max(F.when(~mobile, F.col("confidence"))), F.lit(0.0)).alias("density_confidence"), on("largest").alias("largest"), F.bool_or(mobile & F.col("high_density")).alias("high"), F.bool_or(mobile & F.col("artifact")).alias("artifact"))
    rows = a.join(d, "page_id", "full")
    sure = F.coalesce("alignment_confidence", F.lit(0.0))
    dense = F.coalesce(F.col("high") & (F.col("density_confidence") >= MEDIUM) & (F.col("largest") >= 360) & ~F.col("artifact"), F.lit(False))
    issues = (sure >= MEDIUM) | dense
    return rows.select(
        "page_id", F.when(sure >= HIGH, F.col("most")).otherwise(0).alias("misaligned_images"), sure.alias("misalignment_confidence"), dense.alias("high_mobile_density"),
        rounded(F.greatest(sure, F.coalesce("density_confidence", F.lit(0.0)), F.when(issues, MEDIUM).otherwise(0.4)), 2).alias("evidence_confidence"),
    )
