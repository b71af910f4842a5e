"""CSV order under any cut of the files, and writes that replace nothing else."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from parley.sources import commit, io
from parley.sources.csv_scan import ends_open, read_csv


def nasty_files(rnd, n_files=3, n=60):
    """(folder of CSV files, the rows in them): quotes, line breaks and commas
    everywhere, both kinds of line ends, blank lines."""
    parts = ["a", ",", '"', "\n", "\r\n", "é", " ", "x,y", "\n\n", "b" * 30, '","', ",\n"]
    folder, rows = tempfile.mkdtemp(prefix="parley-csv-"), []
    for i in range(n_files):
        with open(f"{folder}/f{i}.csv", "w", newline="") as f:
            end = rnd.choice(["\n", "\r\n"])
            f.write("author_id,content,note" + end)
            for j in range(n):
                cells, values = [], []
                for _ in range(2):
                    body = "".join(rnd.choice(parts) for _ in range(rnd.randrange(5)))
                    if rnd.random() < .5 and not any(c in body for c in '",\n\r'):
                        cells.append(body)
                        values.append(body or None)
                    else:
                        cells.append('"' + body.replace('"', '""') + '"')
                        values.append(body or None)             # an empty field is null, quoted or not
                if rnd.random() < .1:
                    cells[1] = values[1] = 'say "hi" 5" x'          # quotes in an unquoted field
                f.write(f"{i}-{j}," + ",".join(cells) + rnd.choice([end, end + end]))
                rows.append((f"{i}-{j}", *values))
    return folder, rows


def test_any_cut_gives_the_one_task_rows(spark):
    key = "spark.sql.files.maxPartitionBytes"
    for seed in range(3):
        folder, want = nasty_files(random.Random(seed))
        for size in ("37", "300", "134217728"):
            old = spark.conf.get(key)
            spark.conf.set(key, size)
            try:
                rows = read_csv(spark, folder).collect()
            finally:
                spark.conf.set(key, old)
            got = sorted(tuple(r) for r in rows)
            assert [r[0] for r in got] == list(range(len(want)))
            assert [r[1:] for r in got] == want, (seed, size)


def test_numbering_does_not_depend_on_the_cut_between_passes(spark):
    folder, want = nasty_files(random.Random(9))
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, "50")
        df = io.read_messages(spark, folder, extra=())
        spark.conf.set(key, "5000")                                 # as if executors came or went
        rows = df.collect()
    finally:
        spark.conf.set(key, old)
    assert sorted((-r.seq, r.author_id, r.content) for r in rows) == [(i, *r[:2]) for i, r in enumerate(want)]


def test_line_states(spark):
    cases = [("a,b", False, True), ('a,"b', True, False), ('"a ""b"" c",d', False, False), ('x "y" z', False, False),
             ('""', False, False), ('"', True, False), ("", False, True), ('a""b', False, True), ('b",c', False, False),
             ('"",', False, False), ('","', False, True)]
    df = spark.createDataFrame([(c[0],) for c in cases], "value string")
    got = {r[0]: (r[1], r[2]) for r in df.select("value", ends_open(F.col("value"), False), ends_open(F.col("value"), True)).collect()}
    assert {k: got[k][0] for k, _, _ in cases} == {k: a for k, a, _ in cases}
    for k in ("a,b", 'a,"b', "", 'b",c', 'a""b'):
        assert got[k][1] == {c[0]: c[2] for c in cases}[k], k


def test_na_values_and_header_only(spark):
    d = tempfile.mkdtemp(prefix="parley-csv-")
    with open(f"{d}/a.csv", "w") as f:
        f.write("author_id,content\n1,NA\n2,x\n")
    with open(f"{d}/b.csv", "w") as f:
        f.write("author_id,content\n")
    plain = io.read_messages(spark, d)
    assert sorted((r.seq, r.content) for r in plain.collect()) == [(-1, "x"), (0, "NA")]
    assert sorted((r.seq, r.content) for r in io.read_messages(spark, d, na_values=["NA"]).collect()) == [(-1, "x"), (0, None)]


def sessions(spark, root):
    df = spark.read.parquet(root)
    return sorted((r.session, r.n) for r in df.groupBy("session").agg(F.count(F.lit(1)).alias("n")).collect())


def test_sessions_written_in_turn_stay(spark):
    root = tempfile.mkdtemp(prefix="parley-runs-") + "/runs"
    rows = lambda s, n: spark.range(n).select(F.lit("g").alias("guild"), F.lit(s).alias("session"), "id")
    for s, n in (("s1", 5), ("s2", 7), ("s1", 3)):
        io.write_dataset(rows(s, n), root, partition_by=("guild", "session"))
    assert sessions(spark, root) == [("s1", 3), ("s2", 7)]
    io.write_session(spark.range(4), root, "g", "s2")
    assert sessions(spark, root) == [("s1", 3), ("s2", 4)]
    io.write_session(spark.range(0), root, "g", "s1")               # a run without rows replaces the old one too
    assert io.read_session(spark, root, "g", "s2").count() == 4 and sessions(spark, root) == [("s2", 4)]


def test_a_failed_write_leaves_the_old_rows(spark):
    root = tempfile.mkdtemp(prefix="parley-runs-") + "/runs"
    io.write_dataset(spark.range(5).select(F.lit("s1").alias("session"), "id"), root, partition_by=("session",))
    bad = spark.range(5).select(F.lit("s1").alias("session"), F.when(F.col("id") == 4, F.raise_error(F.lit("no")))
                                .otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        io.write_dataset(bad, root, partition_by=("session",))
    assert sessions(spark, root) == [("s1", 5)]
    path = tempfile.mkdtemp(prefix="parley-table-") + "/t"
    io.write_dataset(spark.range(6), path)
    with pytest.raises(Exception, match="no"):
        io.write_dataset(bad, path)
    assert spark.read.parquet(path).count() == 6
    io.write_dataset(spark.read.parquet(path).where("id > 2"), path)          # a job may read what it replaces
    assert spark.read.parquet(path).count() == 3
    assert [n for n in os.listdir(os.path.dirname(path)) if n.startswith(".") and not n.endswith(".crc")] == []


def test_a_swap_cut_short_is_taken_back(spark):
    root = tempfile.mkdtemp(prefix="parley-runs-") + "/runs"
    io.write_session(spark.range(5), root, "g", "s")
    at = io.session_layout(root, "g", "s")
    os.rename(at, f"{os.path.dirname(at)}/.replaced-session=s")               # the driver died between the renames
    assert io.read_session(spark, root, "g", "s").count() == 5
    commit.settle(spark, at)
    assert io.read_session(spark, root, "g", "s").count() == 5
