from codequarry.streaming.arrivals import analyse_arrivals, arriving_files


def test_files_are_analysed_once(spark, make_files, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for name in ("a.py", "b.py"):
        make_files((name, "import os\n")).write.mode("append").parquet(folder)
        query = analyse_arrivals(arriving_files(spark, folder), out, checkpoint)
        query.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.path, r.elements[0].name) for r in rows) == [("a.py", "os"), ("b.py", "os")]
