"""Tables of cells: read once, dealt out by table in parts that follow the size of the rows."""

import random
import re

from pyspark.sql import functions as F

from paperloom.operators import tables as TB
from paperloom.session import dealt

SCHEMA = "t long, row int, col int, row_span int, col_span int, text string"


def some_cells():
    r = random.Random(3)
    return [(t, row, col, r.randint(1, 2), r.choice([1, 1, 2]), f"{t}.{row}.{col}") for t in range(60) for row in range(6) for col in range(3) if r.random() < 0.7]


def scans(df):
    return len(re.findall("Scan parquet", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))


def test_checks_and_heads_read_the_cells_once(spark, tmp_path):
    rows = some_cells() + [(0, 9, 0, 1, 1, "x"), (0, 9, 0, 1, 1, "y"), (1, None, 9, 1, 1, "z"), (99, 0, 0, 9, 9, "no limits")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "c"))
    cells = dealt(spark.read.parquet(str(tmp_path / "c")), ["t"])
    limits = spark.createDataFrame([(t, 6, 3) for t in range(98)] + [(99, None, None)], "t long, n_rows int, n_cols int")
    checked, heads = TB.check(cells, ["t"], limits), TB.header_rows(cells, ["t"])
    assert scans(checked) == 1 and scans(heads) == 1

    want, slots, tables = [], {}, {}
    for t, row, col, rs, cs, _ in rows:
        tables.setdefault(t, []).append((row, col, rs, cs))
        if t == 99:
            continue
        if col + cs > 3 or (row is not None and row + rs > 6):
            want.append((t, "outside", row, col, 1))
        elif row is not None:
            for r in range(row, row + rs):
                for c in range(col, col + cs):
                    slots[t, r, c] = slots.get((t, r, c), 0) + 1
    want += [(t, "overlap", r, c, n - 1) for (t, r, c), n in slots.items() if n > 1]
    key = lambda x: tuple((v is not None, v) if not isinstance(v, str) else v for v in x)
    assert sorted(map(tuple, checked.collect()), key=key) == sorted(want, key=key)

    expected = {}
    for t, cs in tables.items():
        n = max(row + rs for row, _, rs, _ in cs if row is not None)
        wide = {row for row, _, _, c in cs if c > 1}
        leaf = next((r for r in range(max(n, 1)) if r not in wide), n)
        expected[t] = min(min(leaf, max(n - 1, 0)) + 1, max(n - 1, 1))
    assert {x.t: x.header_rows for x in heads.collect()} == expected


def test_parts_follow_the_size_of_the_rows(spark, tmp_path):
    spark.range(100_000).select((F.col("id") % 997).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1).write.parquet(str(tmp_path / "d"))
    d, least = spark.read.parquet(str(tmp_path / "d")), int(spark.conf.get("spark.sql.shuffle.partitions"))
    few, many = dealt(d, ["k"]), dealt(d, ["k"], part=1 << 17)
    assert few.rdd.getNumPartitions() >= least and many.rdd.getNumPartitions() > 2 * least
    assert many.groupBy("k", "v").count().groupBy("k").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
