from parley.llm import mixing as M


def test_remix_when_the_split_of_the_files_changes(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(20 + i % 50)), "abc"[i % 3]) for i in range(400)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12).write.parquet(path)
    df = spark.read.parquet(path)
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    targets = M.source_targets

    def one_file_a_task(*args):                  # as if executors had joined since the sizes were written
        for n in names:
            spark.conf.set(n, "100000")
        return targets(*args)

    monkeypatch.setattr(M, "source_targets", one_file_a_task)
    try:
        spark.conf.set(names[0], "100000000")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set(names[1], "0")
        _, plan, _ = M.mix(df)
        want = plan.agg({"n": "sum"}).first()[0]
        spark.conf.set(names[0], "100000000")
        spark.conf.set(names[1], "0")
        got = M.remix(df, n_chars=None).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert sum(len(r["text"].split()) for r in got) == want
    assert all(w.startswith(f"d{r['doc_id']}w") for r in got for w in r["text"].split())
