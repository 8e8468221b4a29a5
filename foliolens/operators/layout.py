"""Words to lines, lines to cells, cells to table columns.

``words`` has page_id, word_no, x0, y0, x1, y1, text. ``lines`` has page_id, line_no and words, an array of
struct(text, x0, y0, x1, y1) from left to right. Everything is keyed by page_id, so one exchange serves the chain.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Overlap above which a word can join a line, growth of a line against its first word, and the
#: gap between cells, both in heights.
OVERLAP, DRIFT, GAP = 0.5, 2.0, 3.0
WORD = "struct<text:string,x0:double,y0:double,x1:double,y1:double>"


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the intersection, 0 if disjoint."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


# ---- line expressions

def line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _edge(words: Column, field: str, pick) -> Column:
    return F.coalesce(pick(F.transform(words, lambda w: w[field])), F.lit(0.0))


def line_bounds(words: Column) -> Column:
    """struct(x0, y0, x1, y1) around the words; zeros without words."""
    return F.struct(
        _edge(words, "x0", F.array_min).alias("x0"), _edge(words, "y0", F.array_min).alias("y0"),
        _edge(words, "x1", F.array_max).alias("x1"), _edge(words, "y1", F.array_max).alias("y1"),
    )


def line_height(words: Column) -> Column:
    return _edge(words, "y1", F.array_max) - _edge(words, "y0", F.array_min)


# ---- grouping

def assign_lines(x0: list[float], y0: list[float], x1: list[float], y1: list[float], overlap: float = OVERLAP, drift: float = DRIFT) -> list[int]:
    """Number of the line that each word joins, in the order in which lines are opened.

    Words come from top to bottom. Each goes to the open line with the largest share of vertical overlap (of the smaller
    height) above ``overlap`` in which nothing stands above or below it; the first such line on ties, else a new one.
    A line's range grows to take a word in unless it would exceed ``drift`` heights of its first word.
    """
    line = [-1] * len(x0)
    top: list[float] = []
    bottom: list[float] = []
    limit: list[float] = []
    members: list[list[int]] = []
    for w in sorted(range(len(y0)), key=y0.__getitem__):
        high, low, left, right = y0[w], y1[w], x0[w], x1[w]
        height, best, most = low - high, -1, overlap
        for i, t in enumerate(top):
            b = bottom[i]
            common = (low if low < b else b) - (high if high > t else t)
            smaller = min(height, b - t)
            if common > 0 and smaller > 0 and common / smaller > most and not any(min(x1[m], right) > max(x0[m], left) for m in members[i]):
                best, most = i, common / smaller
        if best < 0:
            best = len(top)
            top.append(high)
            bottom.append(low)
            limit.append(drift * height)
            members.append([])
        else:
            t, b = min(top[best], high), max(bottom[best], low)
            if b - t <= limit[best]:
                top[best], bottom[best] = t, b
        members[best].append(w)
        line[w] = best
    return line


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by page as tables of whole pages, with the places where pages begin and the end."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        starts = (np.nonzero(np.diff(b.column("page_id").dictionary_encode(null_encoding="encode").indices.to_numpy()))[0] + 1).tolist()
        if held and held[-1].column("page_id")[-1].as_py() == b.column("page_id")[0].as_py() and not starts:
            held.append(b)
            continue
        if held and held[-1].column("page_id")[-1].as_py() == b.column("page_id")[0].as_py():
            yield pa.Table.from_batches([*held, b.slice(0, starts[0])]), [0, sum(h.num_rows for h in held) + starts[0]]
            b, starts = b.slice(starts[0]), [s - starts[0] for s in starts[1:]]
        elif held:
            yield pa.Table.from_batches(held), [0, sum(h.num_rows for h in held)]
        if starts:
            yield pa.Table.from_batches([b.slice(0, starts[-1])]), [0, *starts]
        held = [b.slice(starts[-1] if starts else 0)]
    if held:
        yield pa.Table.from_batches(held), [0, sum(h.num_rows for h in held)]


def _reading_order(table: pa.Table, bounds: list[int], overlap: float, drift: float) -> tuple[list[int], list[int], list[int]]:
    """Rows page by page, line by line and from left to right; the number of each line in its page, and where lines begin and the end."""
    x0, y0, x1, y1 = (table.column(c).cast(pa.float64()).to_pylist() for c in ("x0", "y0", "x1", "y1"))
    rows: list[int] = []
    numbers: list[int] = []
    begins: list[int] = []
    for a, b in itertools.pairwise(bounds):
        own = x0[a:b]
        lines: dict[int, list[int]] = {}
        for w, opened in enumerate(assign_lines(own, y0[a:b], x1[a:b], y1[a:b], overlap, drift)):
            lines.setdefault(opened, []).append(w)
        in_order = sorted(lines.items(), key=lambda line: (min(y0[a + w] for w in line[1]), line[0]))
        for number, (_, words) in enumerate(in_order):
            numbers.append(number)
            begins.append(len(rows))
            rows += [a + w for w in sorted(words, key=own.__getitem__)]
    return rows, numbers, [*begins, len(rows)]


def _by_page(words: DataFrame, *columns: str) -> DataFrame:
    return words.select("page_id", "word_no", *columns).repartition("page_id").sortWithinPartitions("page_id", "word_no")


def group_lines(words: DataFrame, overlap: float = OVERLAP, drift: float = DRIFT) -> DataFrame:
    """page_id, line_no, pos, word_no: the place of every word. Lines go by their top, words by their left edge. A word
    without a place (a null coordinate) is left out."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_pages(batches):
            rows, numbers, begins = _reading_order(table, bounds, overlap, drift)
            sizes = np.diff(begins)
            pos = np.arange(len(rows)) - np.repeat(begins[:-1], sizes)
            ids, numbered = (table.column(c).combine_chunks().take(pa.array(rows, pa.int64())) for c in ("page_id", "word_no"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(numbers, sizes), pa.int32()), pa.array(pos, pa.int32()), numbered], names=["page_id", "line_no", "pos", "word_no"])

    page, word = (words.schema[c].dataType.simpleString() for c in ("page_id", "word_no"))
    placed = words.dropna(subset=["x0", "y0", "x1", "y1"])
    return _by_page(placed, "x0", "y0", "x1", "y1").mapInArrow(place, f"page_id {page}, line_no int, pos int, word_no {word}")


def lines_of(placed_words: DataFrame) -> DataFrame:
    """lines from words with line_no and pos."""
    word = F.struct("pos", F.struct("text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("w"))
    in_order = F.transform(F.array_sort(F.collect_list(word)), lambda p: p["w"])
    return placed_words.groupBy("page_id", "line_no").agg(in_order.alias("words"))


def read_lines(words: DataFrame, overlap: float = OVERLAP, drift: float = DRIFT) -> DataFrame:
    """lines from words, by ``group_lines``: one exchange by page, from which whole lines come back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_pages(batches):
            rows, numbers, begins = _reading_order(table, bounds, overlap, drift)
            own = table.take(pa.array(rows, pa.int64())).combine_chunks()
            fields = [own.column(c).combine_chunks() for c in ("text", "x0", "y0", "x1", "y1")]
            listed = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays(fields, names=["text", "x0", "y0", "x1", "y1"]))
            ids = table.column("page_id").combine_chunks().take(pa.array([rows[i] for i in begins[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int32()), listed], names=["page_id", "line_no", "words"])

    page = words.schema["page_id"].dataType.simpleString()
    placed = words.dropna(subset=["x0", "y0", "x1", "y1"])
    return _by_page(placed, "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).mapInArrow(read, f"page_id {page}, line_no int, words array<{WORD}>")


# ---- cells and columns

def split_cells(lines: DataFrame, gap: float = GAP) -> DataFrame:
    """page_id, line_no, cell_no, text, x0, y0, x1, y1: a new cell begins after a gap of more than ``gap`` line heights."""
    rows = lines.select("page_id", "line_no", line_height(F.col("words")).alias("height"), F.posexplode("words").alias("pos", "w"))
    in_line = Window.partitionBy("page_id", "line_no").orderBy("pos")
    opens = F.col("w.x0") - F.lag("w.x1").over(in_line) > gap * F.col("height")
    rows = rows.withColumn("cell_no", F.sum(F.when(opens, 1).otherwise(0)).over(in_line).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w.text"))), lambda p: p["text"]), " ")
    return rows.groupBy("page_id", "line_no", "cell_no").agg(text.alias("text"), F.min("w.x0").alias("x0"), F.min("w.y0").alias("y0"), F.max("w.x1").alias("x1"), F.max("w.y1").alias("y1"))


def word_cells(lines: DataFrame) -> DataFrame:
    """As ``split_cells``, with every word a cell of its own."""
    return lines.select("page_id", "line_no", F.posexplode("words").alias("cell_no", "w")).select("page_id", "line_no", "cell_no", "w.text", "w.x0", "w.y0", "w.x1", "w.y1")


def align_columns(cells: DataFrame, keep_all: bool = False) -> DataFrame:
    """page_id, row, col, text: cells of a page whose x ranges touch or overlap, directly or through others, share a column.

    Of two cells of a line in one column the right-hand one stays; with ``keep_all`` both do, joined by a space.
    """
    in_page = Window.partitionBy("page_id").orderBy("x0", "line_no", "cell_no")
    reach = F.max("x1").over(in_page.rowsBetween(Window.unboundedPreceding, -1))
    rows = cells.withColumn("opens", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0))
    rows = rows.withColumn("col", (F.sum("opens").over(in_page) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda p: p["text"]), " ") if keep_all else F.max_by("text", "cell_no")
    return rows.groupBy("page_id", F.col("line_no").alias("row"), "col").agg(text.alias("text"))


def table_of_cells(lines: DataFrame, gap: float = GAP) -> DataFrame:
    return align_columns(split_cells(lines, gap))


def table_of_words(lines: DataFrame) -> DataFrame:
    return align_columns(word_cells(lines))


def table_rows(table: DataFrame) -> DataFrame:
    """page_id, row, cells: for each row an array over all columns of its page, empty where there is no cell."""
    width = table.groupBy("page_id").agg((F.max("col") + 1).alias("width"))
    rows = table.groupBy("page_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.col("m")[c], F.lit("")))
    return rows.join(width, "page_id").select("page_id", "row", cells.alias("cells"))


def column_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("page_id").agg((F.max("col") + 1).alias("n_columns"))
