import random

import pytest
from pyspark.sql import functions as F

from tracekit.operators import ordering as D
from tracekit.operators import sampling as S
from tracekit.sources import jsonl as J
from tracekit.sources import lines as L


@pytest.fixture
def many_splits(spark):
    """Files are read in blocks of about a kilobyte."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def files(tmp_path, sizes, seed=1):
    """Text files of lines of uneven length; all lines in the order of the paths."""
    rng, every = random.Random(seed), []
    for f, n in enumerate(sizes):
        lines = [f"{f}.{i} " + "x" * rng.choice((0, 3, 40, 900)) for i in range(n)]
        if lines and f % 2:
            lines[len(lines) // 2] = ""
        (tmp_path / f"part-{f}.txt").write_text("".join(x + "\n" for x in lines) if f % 3 else "\n".join(lines), encoding="utf-8")
        every += lines
    return every


def test_lines_have_the_files_order(spark, tmp_path, many_splits):
    every = files(tmp_path, (120, 0, 1, 300, 57))
    lines = L.read_lines(spark, str(tmp_path / "*.txt"))
    assert lines.select("_file", "_block").distinct().count() > 20
    got = L.with_line_numbers(lines).collect()
    assert {r["line"]: r["value"] for r in got} == dict(enumerate(every))
    in_order = [r["value"] for r in lines.orderBy(*L.ORDER).collect()]
    assert in_order == every


def test_no_lines(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    assert L.with_line_numbers(L.read_lines(spark, str(tmp_path / "none.txt"))).collect() == []


@pytest.mark.parametrize("n", [0, 1, 37, 100, 5000, None])
def test_cap_takes_the_files_first_records(spark, tmp_path, many_splits, n):
    every = files(tmp_path, (90, 130))
    lines = L.read_lines(spark, str(tmp_path / "*.txt"))
    kept, report = S.first_n(lines, F.col("value").contains("x"), L.ORDER, n)
    want = [x for x in every if "x" in x][:n]
    assert sorted(r["value"] for r in kept.collect()) == sorted(want)
    report = report.first()
    assert report["saved"] == len(want)
    if n and n < len([x for x in every if "x" in x]):
        assert report["processed"] == every.index(want[-1]) + 1


def test_rows_align_by_position(spark, tmp_path, many_splits):
    for side in ("a", "b"):
        (tmp_path / side).mkdir()
    a, b = files(tmp_path / "a", (80, 45), 2), files(tmp_path / "b", (10, 100, 9), 3)
    left, right = (L.with_line_numbers(L.read_lines(spark, str(tmp_path / side))).select("line", F.col("value").alias(side)) for side in "ab")
    both = L.align(left, right)
    rows = {r["line"]: (r["a"], r["b"], r["_only"]) for r in both.collect()}
    assert len(rows) == max(len(a), len(b)) == 125
    assert all(rows[i] == (a[i], b[i] if i < len(b) else None, None if i < len(b) else "left") for i in range(125))
    assert tuple(L.alignment_report(both).first()) == (len(b), len(a) - len(b), 0)


def test_ordered_traces_keep_their_fields(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"index": 3, "problem": "p"}\nnot json\n\n{"index": 1}\n')
    got = J.read_traces(spark, str(tmp_path / "t.jsonl"), ordered=True).orderBy(*L.ORDER).collect()
    assert [(r["index"], r["_corrupt_record"], r["_blank"]) for r in got] == [(3, None, False), (None, "not json", False), (None, "", True), (1, None, False)]


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 10, 97, 100, 1000, 4097])
def test_places_are_a_bijection(spark, rows):
    a, b = D.grid(rows)
    assert rows <= a * b < rows + max(a, b)
    found = {}
    for seed in (1, 2):
        got = spark.range(rows, numPartitions=3).select("id", D.place_of(F.col("id"), rows, seed).alias("place")).collect()
        assert sorted(r["place"] for r in got) == list(range(rows))
        found[seed] = [r["place"] for r in got]
    if rows > 20:
        assert found[1] != found[2] and found[1] != list(range(rows))


def test_order_looks_random(spark):
    rows = 4000
    got = spark.range(rows).select("id", D.place_of(F.col("id"), rows, 5).alias("place")).toPandas()
    assert abs(got["id"].corr(got["place"])) < 0.06
    first = got[got["place"] < rows // 10]["id"]
    assert 0.35 < (first < rows / 2).mean() < 0.65


def test_sample_is_the_same_for_any_partitioning(spark):
    data = [(i * 7 % 1009, f"t{i}") for i in range(1009)]
    found = []
    for parts in (1, 6):
        df = spark.createDataFrame(data, "key long, text string").repartition(parts)
        got = D.ordered_sample(df, "key", 40, 3).collect()
        found.append(sorted((r["place"], r["key"], r["text"]) for r in got))
    assert found[0] == found[1] and [p for p, *_ in found[0]] == list(range(40))
    assert found[0] == sorted((r["place"], r["key"], r["text"]) for r in D.ordered_sample(df, "key", None, 3).collect())[:40]
    assert D.ordered_sample(df.limit(0), "key", 5, 3).collect() == []
