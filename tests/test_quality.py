"""Release audits of tables and of folders of files, on small cases with known findings."""

import pytest
from pyspark.errors import PySparkException

from longpanel.operators import quality


@pytest.fixture()
def release(tmp_path):
    """A folder as it might be released, with one case for each rule."""
    files = {
        "README.md": "plain text, no finding: /homework and a/b\nsee C:\\Users\\someone\\x and d:/users/other/y twice C:\\Users\\someone\\x",
        "code.PY": "open('/home/someone/data.csv')\n",
        "results/clean.csv": "Group,mean score\n1,2\ndate,pid\n",
        "results/bad one+two.csv": "\ufeffScore, Participant_ID ,\"DATE\",\"a,date\",my_uid,date\n\"/home/a/b\",1\n",
        "results/empty.csv": "",
        "results/table.Parquet": "x",
        "archive.tar.zip": "x",
        "notes.parquet.txt": "fine",
        "picture.png": "/home/never/read",
        "build.log": "/home/left/out",
        ".git/config.txt": "/home/left/out",
        "sub/__pycache__/old.py": "/home/left/out",
        "sub/my.git/kept.txt": "C:\\data",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


FOUND = {
    ("README.md", "private path", "C:\\Users\\someone\\x"),
    ("README.md", "private path", "d:/users/other/y"),
    ("code.PY", "private path", "/home/someone/data.csv"),
    ("results/bad one+two.csv", "private column", "Participant_ID"),
    ("results/bad one+two.csv", "private column", "DATE"),
    ("results/bad one+two.csv", "private column", "my_uid"),
    ("results/bad one+two.csv", "private column", "date"),
    ("results/bad one+two.csv", "private path", "/home/a/b"),
    ("results/table.Parquet", "file type", ".parquet"),
    ("archive.tar.zip", "file type", ".zip"),
    ("sub/my.git/kept.txt", "private path", "C:\\data"),
}


def test_audit_files(spark, release):
    rows = [tuple(r) for r in quality.audit_files(spark, release).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == FOUND
    assert {tuple(r) for r in quality.audit_files(spark, f"file://{release}/").collect()} == FOUND


def test_headers_of_files_in_many_splits(spark, release):
    """Only the very first line of a file is its header, however many tasks read it."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        with open(f"{release}/results/long.csv", "w") as f:
            f.write("ok,fine\n" + "date,pid\n" * 500 + "x,/home/end/x\n")
        found = {tuple(r) for r in quality.audit_files(spark, release).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == FOUND | {("results/long.csv", "private path", "/home/end/x")}


def test_require_clean(spark, release, tmp_path):
    with pytest.raises(PySparkException, match="private path in code.PY|in README.md|file type in|in results/|in sub/"):
        quality.require_clean(quality.audit_files(spark, release)).collect()
    clean = tmp_path / "clean"
    clean.mkdir()
    (clean / "a.md").write_text("nothing")
    assert quality.require_clean(quality.audit_files(spark, str(clean))).collect() == []


def test_audit_table(spark):
    df = spark.createDataFrame([(1, "x", "/home/a/b", None), (None, None, "see C:\\\\z", None), (3, "y", "plain", None)], "PID int, date string, note string, `a.b` string")
    found = {tuple(r) for r in quality.audit_table(df, "t").collect()}
    assert found == {("t", "PID", "private column", 2), ("t", "date", "private column", 2), ("t", "note", "private path", 2)}
    assert quality.audit_table(df.select(quality.F.lit(1).alias("n")), "t").count() == 0
    assert {tuple(r) for r in quality.audit_table(df.where("false"), "t").collect()} == {("t", "PID", "private column", 0), ("t", "date", "private column", 0)}
