"""Lines, cells and table columns."""

import random

from foliolens.operators import layout as Y

SCHEMA = "page_id int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"


def words(spark, *pages):
    return spark.createDataFrame([(p, i, *map(float, w[1:]), w[0]) for p, page in enumerate(pages) for i, w in enumerate(page)], SCHEMA)


def line_texts(df):
    out = {}
    for r in df.orderBy("page_id", "line_no").collect():
        out.setdefault(r["page_id"], []).append(" ".join(w["text"] for w in r["words"]))
    return out


def test_group_lines(spark):
    shuffled = [("123", 120, 10, 150, 20), ("500,00", 110, 50, 160, 60), ("Nota", 0, 10, 40, 20), ("R$", 70, 50, 90, 60), ("Fiscal", 50, 10, 100, 20), ("Total", 0, 50, 50, 60)]
    jitter = [("a", 0, 10, 10, 20), ("b", 20, 12, 30, 22)]
    apart = [("a", 0, 10, 10, 20), ("b", 20, 19, 30, 29)]
    chain = [("descricao", 0, 447, 100, 477), ("UN", 110, 461, 130, 494), ("VValorTotal", 140, 467, 200, 498)]
    drift = [(f"w{i}", 20 * i, 4 * i, 20 * i + 10, 4 * i + 10) for i in range(12)]
    stacked = [("first", 0, 10, 100, 30), ("second", 0, 18, 100, 38), ("2", 120, 10, 130, 30)]
    flat = [("a", 0, 10, 10, 10), ("b", 20, 10, 30, 10)]
    got = line_texts(Y.read_lines(words(spark, shuffled, jitter, apart, chain, drift, stacked, flat)))
    assert got[0] == ["Nota Fiscal 123", "Total R$ 500,00"]
    assert got[1] == ["a b"] and got[2] == ["a", "b"] and got[3] == ["descricao UN VValorTotal"]
    assert len(got[4]) >= 2 and got[4][0].count("w") < 12
    assert len(got[5]) == 2 and len(got[6]) == 2


def test_cells_and_columns(spark):
    near, far = [("a", 0, 0, 20, 20), ("b", 28, 0, 50, 20)], [("a", 0, 0, 20, 20), ("b", 320, 0, 350, 20)]
    dense = [(str(x), x, 0, x + 30, 20) for x in (0, 50, 100, 150)]
    lines = Y.read_lines(words(spark, near, far, dense))
    cells = {}
    for r in Y.split_cells(lines).collect():
        cells.setdefault(r["page_id"], []).append(r["text"])
    assert cells[0] == ["a b"] and sorted(cells[1]) == ["a", "b"] and cells[2] == ["0 50 100 150"]
    counts = {r["page_id"]: r["n_columns"] for r in Y.column_counts(Y.table_of_words(lines)).collect()}
    assert counts[2] == 4
    grid = [(f"{r}{c}", x, 30 * r, x + 100, 30 * r + 20) for r in range(3) for c, x in enumerate((0, 500, 700)) if (r, c) != (1, 2)]
    rows = Y.table_rows(Y.table_of_cells(Y.read_lines(words(spark, grid)))).orderBy("row").collect()
    assert [r["cells"] for r in rows] == [["00", "01", "02"], ["10", "11", ""], ["20", "21", "22"]]


def test_columns_match_a_fold(spark):
    r = random.Random(4)
    pages = [[(str(i), x := r.randint(0, 400), 30 * r.randint(0, 4), x + r.randint(1, 60), 0) for i in range(12)] for _ in range(20)]
    pages = [[(t, x0, y, x1, y + 20) for t, x0, y, x1, _ in page] for page in pages]
    lines = Y.read_lines(words(spark, *pages))
    got = {(x["page_id"], x["row"], x["col"]): x["text"] for x in Y.table_of_words(lines).collect()}
    want = {}
    for page in lines.groupBy("page_id").agg({"line_no": "max"}).select("page_id").collect():
        cells = sorted((w["x0"], x["line_no"], i, w["x1"], w["text"]) for x in lines.where(f"page_id = {page[0]}").collect() for i, w in enumerate(x["words"]))
        col, reach = -1, float("-inf")
        for x0, row, _, x1, text in cells:
            if x0 > reach:
                col += 1
            reach = max(reach, x1)
            want[page[0], row, col] = text
    assert got == want
