"""Rows of images, uneven grids and dense text, against plain loops."""

import random

from marketloom.operators import layout

BOX = "bbox struct<left:double,top:double,width:double,height:double,bottom:double>"
IMAGE = f"page_id long, image_id string, section_id string, visible boolean, decorative boolean, in_grid boolean, in_product_grid boolean, {BOX}"


def box(left, top, width, height):
    return (float(left), float(top), float(width), float(height), float(top + height))


def plain_rows(images):
    rows = []
    for top, left, i in sorted(images):
        row = next((r for r in rows if abs(r[0] - top) <= 20), None)
        if row:
            row[1].append(i)
            row[0] = (row[0] * (len(row[1]) - 1) + top) / len(row[1])
        else:
            rows.append([top, [i]])
    return {i: k for k, (_, members) in enumerate(rows) for i in members}


def test_rows_equal_a_plain_loop(spark):
    rng = random.Random(3)
    pages = {p: [(float(rng.choice([0, 10, 15, 21, 25, 40, 44, 61, rng.randint(0, 90)])), float(rng.randint(0, 3)), f"i{k}") for k in range(rng.randint(1, 12))] for p in range(1000)}
    rows = [(p, "s", i, box(left, top, 50, 50)) for p, images in pages.items() for top, left, i in images]
    got = layout.image_rows(spark.createDataFrame(rows, f"page_id long, section string, image_id string, {BOX}")).collect()
    assert len(got) == len(rows)
    want = {p: plain_rows(images) for p, images in pages.items()}
    assert all(want[r.page_id][r.image_id] == r.line for r in got)


def grid(page, boxes, **more):
    return [(page, f"m{k}", None, True, more.get("decorative"), more.get("in_grid", True), None, box(*b)) for k, b in enumerate(boxes)]


def test_uneven_grids(spark):
    even, uneven = [(0, 100, 200, 200), (220, 102, 198, 198), (440, 101, 199, 199)], [(0, 100, 200, 200), (220, 102, 200, 200), (440, 101, 110, 200)]
    rows = [*grid(1, even), *grid(2, uneven), *grid(3, uneven, decorative=True), *grid(4, uneven, in_grid=False), *grid(5, uneven[:2]), *grid(6, [(0, 0, 30, 30), *uneven[:2]])]
    sections = spark.createDataFrame([(p, "section-1", 0, box(0, 0, 700, 500)) for p in range(1, 7)], f"page_id long, id string, place int, {BOX}")
    issues = layout.alignment_issues(spark.createDataFrame(rows, IMAGE), sections)
    (r,) = issues.collect()
    mean = (200 + 200 + 110) / 3
    share = (mean - 110) / mean
    assert (r.page_id, r.section, r.images, r.severity, r.top_delta) == (2, "section-1", 3, "high", 2.0)
    assert r.width_share == share and r.confidence == round(0.42 + 0.5 * 0.15 + min(1, share / 0.36) * 0.3, 2)
    assert [tuple(x) for x in layout.alignment_summary(issues).collect()] == [(2, 3, r.confidence)]


def test_dense_text(spark):
    block = f"page_id long, block_id int, characters int, visible boolean, line_height_tight boolean, {BOX}"
    rows = [(1, 1, 180, True, False, box(20, 120, 350, 80)), (1, 2, 140, True, False, box(20, 260, 350, 70)), (2, 1, 755, True, True, box(10, 40, 360, 420))]
    rows += [(2, 2 + k, 180, True, True, box(10, 480 + k * 50, 360, 45)) for k in range(6)] + [(2, 9, 9999, False, True, box(0, 0, 9, 9)), (2, 10, 9999, True, True, box(0, 900, 9, 9))]
    screens = spark.createDataFrame([(1, 390, 844, 2), (2, 390, 844, 0), (3, 390, 844, 1)], "page_id long, width int, height int, headings int")
    got = {r.page_id: r for r in layout.text_density(spark.createDataFrame(rows, block), screens).collect()}
    assert (got[1].high_density, got[1].confidence, got[1].largest) == (False, 0.78, 180)
    share = (360 * 420 + 6 * 360 * 45) / (390 * 844)
    assert (got[2].high_density, got[2].confidence, got[2].largest, got[2].blocks) == (True, 0.95, 755, 7)
    assert got[2].density_score == max(25, 100 - int(share * 120 + 0.5) - int(75.5 + 0.5))
    assert (got[3].blocks, got[3].confidence, got[3].density_score) == (0, 0.35, 90.0)


def test_devices(spark):
    a = spark.createDataFrame([(1, "desktop", 12, 0.4), (1, "mobile", 8, 0.2), (2, "mobile", 5, 0.8)], "page_id long, device string, misaligned_images long, confidence double")
    d = spark.createDataFrame([(1, "mobile", 0.9, True, 400, False), (2, "mobile", 0.9, True, 400, True), (3, "desktop", 0.7, True, 900, False)], "page_id long, device string, confidence double, high_density boolean, largest int, artifact boolean")
    got = {r.page_id: tuple(r)[1:] for r in layout.devices_merged(a, d).collect()}
    assert got == {1: (0, 0.4, True, 0.9), 2: (5, 0.8, False, 0.9), 3: (0, 0.0, False, 0.7)}
