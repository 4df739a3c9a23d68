from pyspark.sql import functions as F

from flowtriage.operators import evaluation
from flowtriage.sources import files
from flowtriage.streaming.logs import triage_stream


def write_logs(folder):
    folder.mkdir()
    (folder / "a.log").write_bytes("ok\r\nNo space left on device é".encode())
    (folder / "b.txt").write_bytes(b"bad \xff byte")
    (folder / "c.csv").write_bytes(b"not a log")


def test_read_logs_replaces_bad_bytes(spark, tmp_path):
    write_logs(tmp_path / "logs")
    got = {r.filename: r.text for r in files.read_logs(spark, str(tmp_path / "logs")).collect()}
    assert got == {"a.log": "ok\r\nNo space left on device é", "b.txt": "bad � byte"}


def test_labelled_scan_drops_absent_files(spark, tmp_path):
    write_logs(tmp_path / "logs")
    index = tmp_path / "labels.csv"
    index.write_text("filename,label,pipeline,executor\na.log,disk_space,p,local\ngone.log,clean,p,local\nb.txt,clean,,local\n")
    found = files.labelled_logs(files.read_label_index(spark, str(index)), files.read_logs(spark, str(tmp_path / "logs")))
    assert {(r.filename, r.label, r.pipeline, r.source) for r in found.collect()} == {
        ("a.log", "disk_space", "p", "real"), ("b.txt", "clean", "", "real"),
    }


def test_malformed_index_lines_are_kept_apart(spark, tmp_path):
    index = tmp_path / "labels.csv"
    index.write_text("filename,label,pipeline,executor\na.log,clean,p,local\nshort.log,clean\nlong.log,clean,p,local,extra\n,clean,p,local\nb.log,clean,,\n")
    assert sorted(r.filename for r in files.read_label_index(spark, str(index)).collect()) == ["a.log", "b.log"]
    bad = sorted(r.line for r in files.malformed_index_lines(spark, str(index)).collect())
    assert bad == [",clean,p,local", "long.log,clean,p,local,extra", "short.log,clean"]


def test_repeated_index_names_each_get_the_text(spark):
    index = spark.range(500).select(F.when(F.col("id") < 400, "hot.log").otherwise("gone.log").alias("filename"), F.lit("clean").alias("label"), F.lit(None).cast("string").alias("pipeline"))
    logs = spark.createDataFrame([("hot.log", "x"), ("other.log", "y")], "filename string, text string")
    got = files.labelled_logs(index, logs).collect()
    assert len(got) == 400 and {(r.filename, r.text, r.pipeline) for r in got} == {("hot.log", "x", "")}


def test_corpus_write_and_read_back(spark, tmp_path):
    items = spark.range(25).select(
        F.col("id").alias("run_id"), F.concat(F.lit("text\n"), F.col("id")).alias("text"),
        F.when(F.col("id") % 2 == 0, "clean").otherwise("disk_space").alias("label"),
        F.lit("p").alias("pipeline"), F.lit(None).cast("string").alias("executor"),
    )
    files.save_corpus(items, str(tmp_path / "corpus"))
    back = files.read_corpus(spark, str(tmp_path / "corpus"))
    assert sorted(r.text for r in back.collect()) == sorted(f"text\n{i}" for i in range(25))
    names = [r.filename for r in files.corpus_index(items).collect()]
    assert sorted(n[-8:-4] for n in names) == [f"{i:04d}" for i in range(25)]
    assert evaluation.with_real_runs(items.drop("executor"), items.drop("executor")).count() == 25 * 5


def test_stream_equals_batch(spark, tmp_path):
    write_logs(tmp_path / "logs")
    query = triage_stream(spark, str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(60)
    got = {r.run_id: r.run_health for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.log": "failed", "b.txt": "healthy"}
