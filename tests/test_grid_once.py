"""Words of lines are read twice for a grid: for the starts of cells and for their texts."""

import random

import __spark_entry__ as entry
from sheetloom import schemas
from sheetloom.operators import layout
from sheetloom.plans.inputs import Inputs


def test_lines_are_cut_twice(spark):
    text = entry.queries()["grid_assign"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("posexplode(split(text") == 2


def test_grid_equals_a_plain_search(spark):
    rnd = random.Random(7)
    rows = sorted({(1 + i % 3, 1, rnd.randrange(4 if i % 3 else 1), float(rnd.randrange(0, 90))) for i in range(120)}) + [(4, 1, 0, 5.0), (4, 1, 1, 5.0)]
    cells = spark.createDataFrame([(*r, f"t{i}") for i, r in enumerate(rows)], "doc_id BIGINT, page_no INT, line_no INT, cell_x0 DOUBLE, text STRING")
    expected = []
    for tol in (1.0, 2.0, 6.0):
        for doc in (1, 2, 3, 4):
            mine = [(r[2], r[3], f"t{i}") for i, r in enumerate(rows) if r[0] == doc]
            clusters = []
            for x in sorted(m[1] for m in mine):
                if clusters and x - clusters[-1][-1] <= 2 * tol:
                    clusters[-1].append(x)
                else:
                    clusters.append([x])
            edges = [c[len(c) // 2] for c in clusters]
            grid = {}
            for line, x, text in sorted(mine):
                col = min(range(len(edges)), key=lambda j: (abs(edges[j] - x), j)) + 1
                grid.setdefault((line, col), []).append(text)
            lines = [line for line, _ in grid]
            if len(edges) >= 2 and len(set(lines)) >= 2 and sum(lines.count(line) >= 2 for line in set(lines)) >= 2:
                expected += [(tol, doc, 1, line, col, " ".join(texts)) for (line, col), texts in grid.items()]
    got = [(tol, *r) for tol in (1.0, 2.0, 6.0) for r in layout.grid_assign(cells, layout.column_edges(cells, tol)).collect()]
    assert sorted(got) == sorted(expected) and len({r[1] for r in got}) == 2


def test_grid_of_words_equals_that_of_their_cells(spark):
    words = Inputs(spark, "/root/testdata/sf0.001").words
    cells = layout.line_cells(words, 5.0)
    a, b = layout.grid_of_words(words, 5.0, 2.0), layout.grid_assign(cells, layout.column_edges(cells, 2.0))
    assert a.dtypes == b.dtypes and a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    rows = [(1, 1, ln, k, f"{t}{ln}", x, 20.0 * ln, x + 6.0, 20.0 * ln + 10, 12.0, "Arial") for ln in (0, 1) for k, (t, x) in enumerate([("a", 0.0), ("b", 12.0), ("c", 60.0)])]
    got = layout.grid_of_words(spark.createDataFrame(rows, schemas.WORDS)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, 1, "a0 b0"), (1, 1, 0, 2, "c0"), (1, 1, 1, 1, "a1 b1"), (1, 1, 1, 2, "c1")]
