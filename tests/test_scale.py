"""Work that must not grow faster than the rows: once for each line and cell, pieces of bounded size, packed copies."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from calzada.functions import numbers, text
from calzada.operators.cleaning import clean
from calzada.registry import operators
from calzada.session import INITIAL_PARTITIONS, METHOD_LIMIT, compile_in_parts, shuffles_of
from calzada.sources import lines, readers, workspace, writers
from calzada.sources.schemas import RAW_COLUMNS


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def landed(spark, tmp_path):
    (tmp_path / "2020").mkdir()
    (tmp_path / "2020/a.csv").write_text(",".join(RAW_COLUMNS) + "\n" + ",".join(["1"] * 25) + "\n" + "," * 24 + "\n")
    return lines.read_rows(spark.read, str(tmp_path), 25, 1_000)


def test_each_line_is_parsed_once(spark, tmp_path):
    rows = landed(spark, tmp_path)
    taken = clean(rows.where(F.col("registro").isNotNull() | ~F.forall(F.array(*RAW_COLUMNS), lambda c: c.isNull())))
    assert plan(taken).count("from_csv(") == 1
    assert taken.count() == 1


def test_whole_numbers_take_one_look_at_a_plain_cell(spark):
    cells = ["7", " -3.9 ", "\t2.\n", "1e3", ".5", "1e999", "9" * 310, "3000000000", "1d", "0x1p3", "nan", "1 2", "5 ", "", None]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(numbers.to_number(F.col("c")).alias("n"), numbers.to_int(F.col("c"), None).alias("i")).collect()
    assert [r.n for r in got] == [7, -3.9, 2, 1000, 0.5, None, None, 3e9, *[None] * 7]
    assert [r.i for r in got] == [7, -3, 2, 1000, 0, *[None] * 10]
    text = plan(spark.range(1).select(F.uuid().alias("c")).select(numbers.to_int(F.col("c")).alias("i")))
    assert text.lower().count("rlike") <= 1


def test_pieces_do_not_grow_with_the_source(spark, tmp_path):
    spark.range(400_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    size = readers.stored_bytes(source)
    pieces = readers.spread(source, "id", piece=size // 40).rdd.getNumPartitions()
    assert 40 <= pieces <= 41
    assert readers.spread(source, "id", piece=size).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_packed_landings_hold_the_same_rows(spark, tmp_path):
    rows = landed(spark, tmp_path).select(*RAW_COLUMNS, "anio_carpeta")
    writers.write_csv_by_year(rows, str(tmp_path / "out"), year="anio_carpeta", compression="gzip")
    files = [p.name for p in (tmp_path / "out").rglob("part-*")]
    assert files and all(n.endswith(".csv.gz") for n in files)
    assert sorted(map(tuple, readers.read_positional(spark, str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_long_methods_are_cut_in_any_session(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, kept in (("65535", METHOD_LIMIT), ("4000", 4_000)):
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", given)
            compile_in_parts(spark)
            assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == kept
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_text_that_is_no_number_is_not_cast(spark):
    # The cast throws and catches an exception for each; cells of other blanks and long ones keep their numbers.
    assert plan(spark.range(1).select(F.uuid().alias("c")).select(numbers.to_number(F.col("c")).alias("n"))).count("regexp_extract") == 0
    cells = ["  7.5 ", "\x0b-2\x0c", "+.5e1", "7\u0085", "7 7", "1e", ".", "n/a", "-1e999", "-" + "0" * 400 + "4"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(numbers.to_number(F.col("c")).alias("n"), numbers.to_int(F.col("c")).alias("i")).collect()
    assert [r.n for r in got] == [7.5, -2, 5, *[None] * 6, -4]
    assert [r.i for r in got] == [7, -2, 5, *[0] * 6, -4]


def test_titles_are_broken_up_only_where_a_word_starts_inside(spark):
    cells = ["LUNES", "carril 3", "80-regional", "10a", "a\u0001 b", "ÑANDÚ o'higgins", "", None]
    got = [r.t for r in spark.createDataFrame([(c,) for c in cells], "c string").select(text.title_case(F.col("c")).alias("t")).collect()]
    assert got == ["Lunes", "Carril 3", "80-Regional", "10A", "AB", "Ñandú O'Higgins", "", None]
    assert "RLIKE" in plan(spark.range(1).select(F.uuid().alias("c")).select(text.title_case(F.col("c")).alias("t")))


def test_joins_start_with_the_pieces_of_the_source(spark):
    before = spark.conf.get(INITIAL_PARTITIONS, None)
    try:
        for given, kept in ((None, "5000"), ("40", "5000"), ("6000", "6000")):
            spark.conf.unset(INITIAL_PARTITIONS) if given is None else spark.conf.set(INITIAL_PARTITIONS, given)
            shuffles_of(spark, 5_000)
            assert spark.conf.get(INITIAL_PARTITIONS) == kept
    finally:
        spark.conf.unset(INITIAL_PARTITIONS) if before is None else spark.conf.set(INITIAL_PARTITIONS, before)


def test_a_file_a_year_takes_no_shuffle_and_no_sort(spark, tmp_path):
    rows = spark.range(0, 9_000, 1, 6).selectExpr("concat('x', id) AS a", "CASE WHEN id % 4 < 3 THEN cast(2000 + id % 4 AS int) END AS anio")
    kept, folder = workspace.stored(rows, "por_anio", "zstd", by=["anio"])
    assert kept.columns == rows.columns
    tasks, group = spark.sparkContext.statusTracker(), "un_fichero_por_anio"
    spark.sparkContext.setJobGroup(group, "")
    try:
        writers.write_csv_file_by_year(kept, str(tmp_path / "out"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [tasks.getJobInfo(j) for j in tasks.getJobIdsForGroup(group)]
    # Each year by a task of its own; what finds the years is the only shuffle.
    assert [tasks.getStageInfo(s).numTasks for s in jobs[0 if jobs[0].jobId > jobs[-1].jobId else -1].stageIds] == [4]
    files = [str(p.parent.name) for p in (tmp_path / "out").rglob("part-*")]
    assert sorted(files) == ["anio=2000", "anio=2001", "anio=2002", "anio=__HIVE_DEFAULT_PARTITION__"]
    back = spark.read.option("header", "true").schema("a string, anio int").csv(str(tmp_path / "out"))
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    workspace.drop_folder(spark, folder)
    empty, folder = workspace.stored(rows.where("a = ''"), "por_anio", "zstd", by=["anio"])
    writers.write_csv_file_by_year(empty, str(tmp_path / "nada"))
    assert (tmp_path / "nada/_SUCCESS").exists()
    workspace.drop_folder(spark, folder)


def test_text_writes_keep_a_file_open_for_each_year(spark, tmp_path):
    # Rows of the years take turns: sorted or not, a task makes one file for each; past the number of open files the rest is sorted.
    rows = spark.range(0, 300, 1, 2).selectExpr("cast(id AS string) AS a", "cast(id % 100 AS int) AS anio")
    writers.write_csv_by_year(rows, str(tmp_path / "out"), compression="gzip")
    assert len(list((tmp_path / "out").rglob("part-*"))) == 200
    first = spark.read.option("header", "true").csv(str(tmp_path / "out/anio=7")).collect()
    assert sorted(r.a for r in first) == ["107", "207", "7"]


def test_text_writes_by_year_are_not_sorted(spark, tmp_path, monkeypatch):
    inside, before = [], spark.conf.get(workspace.OPEN_FILES, None)
    monkeypatch.setattr(writers, "by_year", lambda df, *_: inside.append(spark.conf.get(workspace.OPEN_FILES)) or df)
    writers.write_csv_by_year(spark.range(3).selectExpr("cast(id AS string) AS a", "cast(id AS int) AS anio"), str(tmp_path / "out"))
    assert int(inside[0]) >= 64
    assert spark.conf.get(workspace.OPEN_FILES, None) == before


def test_rows_are_counted_in_one_packed_column(spark):
    marks = [("a", None, 1), ("a", None, 1), ("a", "", 1), (None, "a", 1), (None, None, None), ("", "", 1), ("a\x1fb", "c", 1), ("a", "b\x1fc", 1),
             ("\x1e", "x", 1), (None, "x", 1), ("\x1e", "x", 1), ("ñ,\"", "\n", 2)]
    df = spark.createDataFrame(marks, "t string, u string, n2 int")
    got = sorted(map(tuple, operators._counted_rows(df, "t", "u", "n2").collect()), key=str)
    assert got == sorted(((*k, n) for k, n in Counter(marks).items()), key=str)
    text = operators._counted_rows(df, "t", "u", "n2")._jdf.queryExecution().optimizedPlan().toString()
    dealt = next(x for x in text.splitlines() if "RepartitionByExpression" in x)
    below = text[text.index(dealt):]
    assert "_fila" in below and "_celdas" in below
    one = operators._counted_rows(df.select("t"), "t")
    assert sorted(map(tuple, one.collect()), key=str) == sorted(((k, n) for k, n in Counter(m[0] for m in marks).items()), key=str)
