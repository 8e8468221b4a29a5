"""Geometry, raster, detection, deformation, recognition and whole pages."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolens.functions import geometry as E
from foliolens.operators import deformation as W
from foliolens.operators import detection as D
from foliolens.operators import planes as N
from foliolens.operators import raster as P
from foliolens.operators import recognition as R
from foliolens.operators import scan as S
from foliolens.plans.graph import plan
from foliolens.queries import pages as Q
from foliolens.sources import onnx as O
from foliolens.sources import pages as G

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)


def column(spark, build, polygon):
    df = spark.createDataFrame([([tuple(map(float, p)) for p in polygon],)], "p array<struct<x: double, y: double>>")
    return df.select(build(F.col("p")).alias("v")).first()["v"]


def test_polygon_expressions(spark):
    shapes = [SQUARE, SQUARE[::-1], np.array([[0, 0], [4, 0], [0, 3]], float), SQUARE[:2], SQUARE[:1]]
    for p in shapes:
        assert column(spark, E.area, p) == pytest.approx(D.area(p)) and column(spark, E.perimeter, p) == pytest.approx(D.perimeter(p))
        assert list(column(spark, E.centroid, p)) == pytest.approx(D.centroid(p).tolist())
    assert list(column(spark, E.bounds, SQUARE)) == [0, 0, 10, 10] and list(column(spark, E.bounds, [])) == [0, 0, 0, 0]
    inside = [[column(spark, lambda q, x=x, y=y: E.contains(q, F.lit(x), F.lit(y)), SQUARE) for x in (0.0, 5.0, 10.0)] for y in (0.0, 10.0)]
    assert inside == [[True, True, False], [False, False, False]]
    h = P.homography(SQUARE, np.array([[1, 1], [12, 2], [11, 13], [0, 9]], float))
    row = spark.createDataFrame([(h.reshape(-1).tolist(),)], "h array<double>").select(E.apply_homography(F.col("h"), F.lit(3.0), F.lit(4.0)).alias("p"), E.invert_homography(F.col("h")).alias("i")).first()
    assert list(row["p"]) == pytest.approx(list(P.project(h, 3, 4))) and list(P.project(np.array(row["i"]).reshape(3, 3), *row["p"])) == pytest.approx([3, 4])
    v = spark.range(1).select(E.evaluate(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(2.0)).alias("v"), E.derivative(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("d")).first()
    assert v["v"] == 17 and v["d"] == [2, 6]


def test_line_shapes(spark):
    x = np.arange(8.0)
    curves = {1: 2 + 0.5 * x, 2: 1 + x * x / 10, 3: np.where(x % 2 == 0, 0.0, 3.0)}
    rows = [(k, float(a), float(b)) for k, y in curves.items() for a, b in zip(x, y, strict=True)]
    got = {r["k"]: r for r in E.line_shapes(spark.createDataFrame(rows, "k int, x double, y double"), "k").collect()}
    for k, y in curves.items():
        shape = W.measure(np.stack([x, y], axis=1))
        assert (got[k]["angle"], got[k]["linear_bow"], got[k]["curve_bow"]) == pytest.approx(shape, abs=1e-6)
    assert W.classify((0, 0, 2)) == 3 and W.classify((0, 2, 0)) == 2 and W.classify((0.1, 0, 0)) == 1 and W.page_level([]) == 0


def test_raster():
    r = np.random.default_rng(3)
    for w, h in ((1, 1), (5, 1), (1, 5), (8, 8), (13, 9)):
        plane = r.random((h, w)).astype("f4")
        for radius in (0, 1, 3, 20):
            want = np.array([[plane[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].mean() for x in range(w)] for y in range(h)])
            np.testing.assert_allclose(P.box_blur(plane, radius), want, atol=1e-5)
        np.testing.assert_allclose(P.resize(plane, w, h), plane, atol=1e-6)
    ramp = np.tile(np.arange(10, dtype="f4"), (4, 1))
    assert P.sample(ramp, np.array([2.25]), np.array([1.5]))[0] == pytest.approx(2.25)
    np.testing.assert_allclose(P.rectify_quad(ramp, np.array([[2, 0], [6, 0], [6, 3], [2, 3]]), 5, 4), ramp[:, 2:7], atol=1e-4)
    flat = P.rectify_curve(ramp, np.array([2.0, 0.0]), 0, 9, 9, 2, 1, 1)
    np.testing.assert_allclose(flat[0], np.arange(9) + 0.5, atol=1e-4)
    np.testing.assert_allclose(P.fit_polynomial(np.stack([np.arange(5.0), 1 + 2 * np.arange(5.0) + 3 * np.arange(5.0) ** 2], axis=1), 2), [1, 2, 3], atol=1e-8)
    with pytest.raises(P.GeometryError):
        P.fit_polynomial(np.array([[1.0, 1], [1, 2]]), 1)
    assert P.to_bytes(np.array([-1, 0.5, 2], "f4")).tolist() == [0, 128, 255]


def test_detection():
    def bitmap(*rows):
        return np.array([[c == "#" for c in r] for r in rows])

    assert D.contours(bitmap("....", ".###", ".###", ".###"))[0].tolist() == [[1, 1], [2, 1], [3, 1], [3, 2], [3, 3], [2, 3], [1, 3], [1, 2]]
    assert [c.tolist() for c in D.contours(bitmap("...", ".#."))] == [[[1, 1]]]
    assert D.contours(bitmap("####"))[0].tolist() == [[0, 0], [1, 0], [2, 0], [3, 0], [2, 0], [1, 0]]
    assert D.components(bitmap("#.#", ".#.", "#.#"))[1] == 1 and D.components(bitmap("#.#", "#.#"))[1] == 2
    r = np.random.default_rng(0)
    for _ in range(20):
        b = r.random((9, 11)) < 0.4
        labels, n = D.components(b)
        want, count = np.zeros(b.shape, int), 0
        for y, x in zip(*np.nonzero(b), strict=True):
            if not want[y, x]:
                count += 1
                stack = [(y, x)]
                while stack:
                    i, j = stack.pop()
                    if 0 <= i < 9 and 0 <= j < 11 and b[i, j] and not want[i, j]:
                        want[i, j] = count
                        stack += [(i + a, j + c) for a in (-1, 0, 1) for c in (-1, 0, 1)]
        assert n == count and (labels == want).all()
    assert sorted(D.unclip(SQUARE, 1.6).tolist()) == sorted([[-4, -4], [14, -4], [14, 14], [-4, 14]])
    assert D.region_score(np.pad(np.ones((3, 3)), 1), np.array([[1, 1], [3, 1], [3, 3], [1, 3]], float)) == 1
    assert [D.resized(*s) for s in ((1920, 1080), (500, 300), (10, 10), (896, 528))] == [(960, 544), (512, 288), (32, 32), (896, 512)]
    assert W.baseline(np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)).tolist() == [[0, 1], [1, 1]]


def test_ctc(spark):
    classes = R.charset(["a", "b", "c"])
    cases = {"ab": [1, 1, 0, 2], "aa": [1, 0, 1, 0], "a": [1, 1, 1, 1], "": [0, 0, 0, 0]}
    rows = []
    for n, (text, path) in enumerate(cases.items()):
        p = np.full((1, 4, 4), 0.1, "f4")
        p[0, np.arange(4), path] = 0.7
        (got, confidence), = R.decode(p, classes)
        assert got == text and confidence == pytest.approx(0.7 if text else 0)
        rows += [(n, t, c, float(p[0, t, c])) for t in range(4) for c in range(4)]
    frame = R.decode_frame(spark.createDataFrame(rows, "n int, t int, c int, p float"), spark.createDataFrame(list(enumerate(classes)), "c int, text string"))
    assert [r["text"] for r in frame.orderBy("n").collect()] == list(cases)
    assert R.preprocess(np.zeros((48, 48, 3), np.uint8)).shape == (1, 3, 48, 320) and R.preprocess(np.zeros((48, 960, 3), np.uint8)).shape == (1, 3, 48, 960)


def png(a):
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[y, :, ::-1].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def toy_engine(folder):
    """A detector that finds bright pixels, and a recogniser that reads white lines as X and dark ones as Y."""
    w = np.zeros((1, 3, 1, 1), "f4")
    w[0, :, 0, 0] = 8
    det = O.model_bytes([O.Node("Conv", ["x", "w", "b"], ["t"], "", "", {}), O.Node("Sigmoid", ["t"], ["y"])], {"x": [1, 3, "h", "w"]}, ["y"], {"w": w, "b": np.array([8.0], "f4")})
    v = np.array([[0, 0, 0], [8, 0, 0], [-8, 0, 0]], "f4").reshape(3, 3, 1, 1)
    nodes = [O.Node("GlobalAveragePool", ["x"], ["p"]), O.Node("Conv", ["p", "v", "c"], ["q"]), O.Node("Reshape", ["q", "s"], ["r"]), O.Node("Softmax", ["r"], ["y"], "", "", {"axis": 2})]
    rec = O.model_bytes(nodes, {"x": [1, 3, 48, "w"]}, ["y"], {"v": v, "c": np.array([-5, 2.2, -2.2], "f4"), "s": np.array([1, 1, 3], np.int64)})
    for name, data in (("det.onnx", det), ("rec.onnx", rec), ("dict.txt", b"X\nY\n")):
        (folder / name).write_bytes(data)
    return S.Engine.open(*(str(folder / n) for n in ("det.onnx", "rec.onnx", "dict.txt")))


def test_whole_page(spark, tmp_path):
    page = np.zeros((80, 900, 3), np.uint8)
    page[30:50, 40:340], page[30:50, 500:800] = 255, 150
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "page.png").write_bytes(png(page))
    engine = toy_engine(tmp_path)
    pages = G.read_pages(spark, str(tmp_path / "in"))
    regions = engine.regions(pages).cache()
    rows = regions.orderBy("region_no").collect()
    assert len(rows) == 2 and all(r["measured"] and r["level"] == 0 and r["score"] > 0.9 for r in rows)
    assert rows[0]["x0"] < 45 and rows[0]["x1"] > 330 and [r["text"] for r in rows] == ["X", "Y"]
    lines = S.lines_of_pages(regions).collect()
    assert len(lines) == 1 and len(lines[0]["words"]) == 2
    assert engine.page_levels(regions).first()["page_level"] == 0
    assert engine.identity.det_hash.startswith("sha256:") and regions.withColumns(engine.identity.columns()).first()["overlap"] == 0.5


def test_filters_and_dictionary(tmp_path):
    parsed = G.parse_filter('{"versao": "1", "detect": {"Threshold": 0.4}}')
    options = G.apply_filter(G.ScanOptions(), parsed)
    assert options.detector == D.DetectOptions(0.4, 0, 0, 0) and options.thresholds == W.Thresholds(0, 0, 0)
    with pytest.warns(UserWarning):
        G.parse_filter('{"detect": {"min_area": 1}}')
    (tmp_path / "d").write_bytes("a\r\n \n\nb".encode())
    assert G.read_dictionary(str(tmp_path / "d")) == ["a", " ", "b"]
    assert W.Thresholds().relaxed(30, 0.3).straight_px == 9 and W.Thresholds().relaxed(1, 0.3) == W.Thresholds() and math.isclose(W.Thresholds().angle, math.pi / 180)
    assert plan(O.parse(O.model_bytes([O.Node("Relu", ["x"], ["y"])], {"x": [1]}, ["y"]))).run(x=np.array([-1.0]))["y"][0] == 0


def test_tables_of_planes(spark):
    plane = np.zeros((8, 10), "f4")
    plane[2:5, 3:8] = 0.9
    rows = [(7, [8, 10], plane.reshape(-1).tolist()), (8, [8, 10], [0.0] * 80)]
    tensors = spark.createDataFrame(rows, "k long, shape array<int>, data array<float>")
    got = N.contours_of(tensors, 0.5, "k").collect()
    assert [(r["k"], r["region_no"], [(p["x"], p["y"]) for p in r["polygon"]]) for r in got] == [(7, 0, [tuple(p) for p in D.contours(plane > 0.5)[0].tolist()])]
    found, = N.regions_of(tensors, D.DetectOptions(min_area=1), "k").collect()
    assert found["score"] == pytest.approx(0.9) and len(found["line"]) == 16 and found["angle"] is not None
    assert N.regions_of(tensors, D.DetectOptions(min_area=9), "k").count() == 0 and N.regions_of(tensors.limit(0), key="k").count() == 0
    flipped = {r["k"]: np.array(r["data"], "f4").reshape(r["shape"]) for r in N.map_planes(tensors, lambda a: a.T, "k").collect()}
    assert (flipped[7] == plane.T).all() and flipped[8].shape == (10, 8)
    path = spark.createDataFrame([(1, [2, 3], [0.1, 0.8, 0.1, 0.7, 0.2, 0.1])], "k long, shape array<int>, data array<float>")
    assert N.texts_of(path, R.charset(["a", "b"]), "k").first()["text"] == "a"


def test_pages_are_dealt_over_tasks(spark, tmp_path):
    """Pages come from one small file, but no task scans more than a few of them."""
    spark.range(150).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    regions = Q._regions(spark, str(tmp_path))
    shares = [r["count"] for r in regions.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(shares) == 300 and max(shares) <= 2 * Q.PAGES_A_TASK


def test_planes_are_sampled_together():
    """Stacks of byte planes give what single float planes give, and pixels in boxes what they give one by one."""
    r = np.random.default_rng(5)
    page = r.integers(0, 256, (12, 17, 3)).astype(np.uint8)
    x, y = r.random((4, 6)) * 19 - 1, r.random((4, 6)) * 14 - 1
    single = [P.channel(page, c) for c in range(3)]
    assert (P.sample(P.planes_of(page), x, y) == np.stack([P.sample(p, x, y) for p in single])).all()
    assert (P.resize(P.planes_of(page), 9, 30) == np.stack([P.resize(p, 9, 30) for p in single])).all()
    with pytest.raises(P.GeometryError):
        P.sample(single[0], np.array([np.nan]), np.array([1.0]))
    for n in range(3, 30):
        p = np.round(r.random((n, 2)) * 20 - 4, n % 3)
        low, high = np.array([0, 1]), np.array([12, 9])
        assert (D.inside_box(p, low, high) == D.inside(p, *np.meshgrid(np.arange(13), np.arange(1, 10)))).all()


def test_places_and_levels_need_no_texts(spark, tmp_path):
    """What is wanted without texts is found without a recogniser, and is what a whole scan finds."""
    spark.range(9).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    whole, unread = (Q._regions(spark, str(tmp_path), read).drop("text", "ctc_confidence") for read in (True, False))
    assert unread.orderBy("page_id", "region_no").collect() == whole.orderBy("page_id", "region_no").collect()
    assert unread.count() == 18
    engine = Q._engine()
    assert S.process_regions(np.zeros((40, 60, 3), np.uint8), [(SQUARE, 0.9)], 1, 1, None, engine.classes, engine.options)[0]["measured"]


def test_many_pages_share_tasks_in_small_batches(spark):
    """Tasks and batches follow the pages: few pages fill the cores, many pages do not make thousands of tasks, and no batch holds a task's pages at once."""
    cores = spark.sparkContext.defaultParallelism
    assert [Q._dealt(spark.range(n)).rdd.getNumPartitions() for n in (0, 1, 150, 100_000)] == [1, 1, 3, max(391, Q.TASKS_A_CORE * cores)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.num_rows]})

    own = S._in_small_batches(spark.range(100).coalesce(1))
    assert sorted(r["n"] for r in own.mapInArrow(sizes, "n long").collect()) == [100 % S.PAGES_A_BATCH, *[S.PAGES_A_BATCH] * (100 // S.PAGES_A_BATCH)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_upright_grids_are_sampled_as_any_points():
    r = np.random.default_rng(8)
    page = P.planes_of(r.integers(0, 256, (20, 31, 3)).astype(np.uint8))
    for plane in (page, P.channel(np.moveaxis(page, 0, -1), 1), page[2].astype(float)):
        for wide, high in ((1, 1), (7, 3), (40, 26)):
            x, y = np.meshgrid(np.sort(r.random(wide)) * 36 - 3, np.sort(r.random(high)) * 25 - 3)
            assert (P.sample(plane, x, y).reshape(*plane.shape[:-2], -1) == P.sample(plane, x.ravel(), y.ravel())).all()
    given = P.channel(np.moveaxis(page, 0, -1), 0)
    kept = given.copy()
    P.resize(given, 31, 20)[:] = 5  # a new array, also where the size stays
    assert (given == kept).all()


def test_contours_follow_rows_as_single_steps():
    """Long rows are passed at once and only the box of set pixels is read; every vertex stays."""

    def stepped(bitmap, x, y):
        h, w = bitmap.shape
        on = lambda x, y: 0 <= x < w and 0 <= y < h and bitmap[y, x]
        here, came, path = (x, y), 0, [(x, y)]
        while True:
            ways = [(d, (here[0] + D.STEPS[d][0], here[1] + D.STEPS[d][1])) for d in ((came + k) % 8 for k in range(1, 9))]
            turn, there = next(((d, p) for d, p in ways if on(*p)), (8, here))
            if turn == 8:
                return path
            here, came = there, turn ^ 4
            if here == (x, y):
                return path
            path.append(here)

    r = np.random.default_rng(4)
    for k in range(120):
        bitmap = np.zeros((14, 40), bool) if k % 2 else r.random((14, 40)) < 0.4
        for x, y, w, h in zip(r.integers(0, 36, 4), r.integers(0, 13, 4), r.integers(1, 30, 4), r.integers(1, 5, 4), strict=True):
            bitmap[y : y + h, x : x + w] = True
        labels, count = D.components(bitmap)
        found = D.contours(bitmap)
        assert len(found) == count
        for n, c in enumerate(found, 1):
            y, x = np.argwhere(labels == n)[0]
            assert c.tolist() == [list(map(float, p)) for p in stepped(bitmap, x, y)]
    assert D.contours(np.zeros((3, 4), bool)) == [] and D.components(np.zeros((3, 4), bool))[1] == 0
