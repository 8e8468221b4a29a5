"""Lines, cells and columns of the item grid and of document words."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators import layout as Y
from foliolens.queries.derived import GRID, derive


def _placed(spark, d):
    """Grid words with the line and position they were printed at."""
    return derive(spark, d, GRID).select("page_id", F.col("row").alias("line_no"), F.col("col").alias("pos"), "text", "x0", "y0", "x1", "y1")


def _lines(spark, d):
    return Y.lines_of(_placed(spark, d))


def _cells_sql() -> str:
    return f"""
WITH g AS ({GRID}), h AS (SELECT *, max(y1) OVER r - min(y0) OVER r AS height, x0 - lag(x1) OVER (PARTITION BY page_id, row ORDER BY x0) AS gap FROM g WINDOW r AS (PARTITION BY page_id, row)),
n AS (SELECT *, CAST(sum(CASE WHEN gap > 3 * height THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, row ORDER BY x0) AS INTEGER) AS cell_no FROM h)
SELECT page_id, row AS line_no, cell_no, string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n GROUP BY page_id, row, cell_no"""


def _islands_sql(cells: str) -> str:
    return f"""
WITH c AS ({cells}), m AS (SELECT *, max(x1) OVER (PARTITION BY page_id ORDER BY x0, line_no, cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
k AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR x0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x0, line_no, cell_no) - 1 AS INTEGER) AS col FROM m)
SELECT page_id, line_no AS row, col, arg_max(text, cell_no) AS text FROM k GROUP BY page_id, line_no, col"""


_WORD_CELLS = f"SELECT page_id, row AS line_no, CAST(row_number() OVER (PARTITION BY page_id, row ORDER BY x0) - 1 AS INTEGER) AS cell_no, text, x0, x1 FROM ({GRID})"


def _row_texts(spark, d):
    return Y.table_rows(Y.table_of_words(_lines(spark, d))).select("page_id", "row", F.array_join("cells", "|").alias("cells"))


QUERIES = {
    "words_line_text": (lambda s, d: _lines(s, d).select("page_id", "line_no", Y.line_text(F.col("words")).alias("text")), f"SELECT page_id, row AS line_no, string_agg(text, ' ' ORDER BY col) AS text FROM ({GRID}) GROUP BY page_id, row"),
    "line_bounds": (
        lambda s, d: _lines(s, d).select("page_id", "line_no", Y.line_bounds(F.col("words")).alias("b")).select("page_id", "line_no", "b.*"),
        f"SELECT page_id, row AS line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({GRID}) GROUP BY page_id, row",
    ),
    "group_lines": (
        lambda s, d: Y.group_lines(derive(s, d, GRID)),
        f"SELECT page_id, CAST(row AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY page_id, row ORDER BY x0) - 1 AS INTEGER) AS pos, word_no FROM ({GRID})",
    ),
    "read_lines": (lambda s, d: Y.read_lines(derive(s, d, GRID)).select("page_id", "line_no", Y.line_text(F.col("words")).alias("text")), f"SELECT page_id, CAST(row AS INTEGER) AS line_no, string_agg(text, ' ' ORDER BY x0) AS text FROM ({GRID}) GROUP BY page_id, row"),
    "split_cells": (lambda s, d: Y.split_cells(_lines(s, d)), _cells_sql()),
    "table_columns_words": (lambda s, d: Y.table_of_words(_lines(s, d)), _islands_sql(_WORD_CELLS)),
    "table_columns_cells": (lambda s, d: Y.table_of_cells(_lines(s, d)), _islands_sql(_cells_sql())),
    "table_column_count": (lambda s, d: Y.column_counts(Y.table_of_words(_lines(s, d))), f"SELECT page_id, CAST(max(col) + 1 AS INTEGER) AS n_columns FROM ({_islands_sql(_WORD_CELLS)}) GROUP BY page_id"),
    "table_rows": (
        _row_texts,
        f"WITH t AS ({_islands_sql(_WORD_CELLS)}), w AS (SELECT page_id, max(col) AS last FROM t GROUP BY page_id), r AS (SELECT DISTINCT page_id, row FROM t), g AS (SELECT page_id, row, unnest(range(0, last + 1)) AS col FROM r JOIN w USING (page_id)) "
        "SELECT page_id, row, string_agg(coalesce(text, ''), '|' ORDER BY g.col) AS cells FROM g LEFT JOIN t USING (page_id, row, col) GROUP BY page_id, row",
    ),
    "interval_overlap": (
        lambda s, d: derive(s, d, GRID).select("page_id", "row", "col", Y.interval_overlap(F.col("x0"), F.col("x1"), F.lit(310.0), F.lit(420.0)).alias("n")),
        f"SELECT page_id, row, col, greatest(least(x1, 420.0) - greatest(x0, 310.0), 0.0) AS n FROM ({GRID})",
    ),
}
