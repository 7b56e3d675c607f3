import sqlite3

import pytest

from usagemill.sources.sqlite import read_table

SCHEMA = "id bigint, name string, src_file string"


def base(path, n=2000):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id, name)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, "x" * 200) for i in range(n)])
    con.commit()
    con.close()


def test_a_path_that_is_not_there_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError|missing"):
        read_table(spark, f"file://{tmp_path}/missing", "t", SCHEMA).count()
    with pytest.raises(Exception, match="mount"):
        read_table(spark, "s3a://bucket/x", "t", SCHEMA).count()


def test_a_torn_database_is_an_error_and_another_file_is_none(spark, tmp_path):
    base(tmp_path / "a.db")
    (tmp_path / "b.db").write_text("no database, but long enough to be looked at " * 50)
    assert read_table(spark, f"file://{tmp_path}", "t", SCHEMA).count() == 2000
    whole = (tmp_path / "a.db").read_bytes()
    (tmp_path / "a.db").write_bytes(whole[: len(whole) // 2] + b"\xff" * (len(whole) - len(whole) // 2))
    with pytest.raises(Exception, match="broke off"):
        read_table(spark, f"file://{tmp_path}", "t", SCHEMA).count()
