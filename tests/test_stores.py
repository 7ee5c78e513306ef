import os
from pathlib import Path

from hushframe.sources import stores


def connector(folder):
    class Client:
        def __init__(self):
            self.todo = []

        def pipeline(self, transaction=True):
            return self

        def set(self, key, value, ex=None):
            self.todo.append((key, f"{value}/{ex}"))

        def execute(self):
            for key, value in self.todo:
                with open(os.path.join(folder, key), "a") as out:
                    out.write(value)
            self.todo = []

        def close(self):
            assert not self.todo

    return Client


def test_keys_get_their_last_values(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 1500, f"v{i}") for i in range(3000)], "at long, k long, v string")
    stores.write_keys(rows, connector(str(tmp_path)), "k", "v", ["at"], 60)
    got = {p.name: p.read_text() for p in Path(tmp_path).iterdir()}
    assert got == {str(k): f"v{k + 1500}/60" for k in range(1500)}


def test_keys_of_a_stream(spark, tmp_path):
    for name in ("in", "out"):
        (tmp_path / name).mkdir()
    spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "at long, k long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("at long, k long, v string").parquet(str(tmp_path / "in"))
    query = stores.stream_keys(rows, connector(str(tmp_path / "out")), "k", "v", ["at"], str(tmp_path / "at"))
    query.processAllAvailable()
    query.stop()
    assert (tmp_path / "out" / "7").read_text() == "b/None"


def shared(folder):
    class Shared:
        """A store in a folder, as far as it is asked here."""

        def __init__(self, folder):
            self.folder, self.todo = folder, []

        def mget(self, keys):
            return [p.read_bytes() if (p := Path(self.folder) / k).exists() else None for k in keys]

        def pipeline(self, transaction=True):
            return self

        def set(self, key, value, ex=None):
            self.todo.append((key, value))

        def delete(self, key):
            self.todo.append((key, None))

        def execute(self):
            for key, value in self.todo:
                path = Path(self.folder) / key
                path.unlink() if value is None else path.write_text(value)
            self.todo = []

        def close(self):
            assert not self.todo

    return lambda: Shared(folder)


def test_reading_through(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "1").write_text("one")
    rows = spark.createDataFrame([(1,), (2,), (3,), (2,), (None,)], "k long").coalesce(1)
    connect = shared(folder)
    assert sorted(map(str, stores.read_keys(rows, connect, "k").collect())) == sorted(f"Row(k={k!r}, value={v!r})" for k, v in [("1", "one"), ("2", None), ("3", None), ("2", None), (None, None)])
    load = lambda keys: [{"2": "two"}.get(k) for k in keys]
    got = {r.k: r.value for r in stores.read_keys(rows, connect, "k", load, 60).collect()}
    assert got == {"1": "one", "2": "two", "3": None, None: None} and (tmp_path / "2").read_text() == "two" and not (tmp_path / "3").exists()
    stores.each_key(rows.where("k = 1"), connect, "delete", "k")
    assert not (tmp_path / "1").exists()


def test_upserts(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (k integer primary key, v text, n integer)")
    connect = lambda: sqlite3.connect(path)
    rows = spark.createDataFrame([(i, f"v{i}", 1) for i in range(2500)], "k long, v string, n int")
    for _ in range(2):
        stores.upsert(rows, connect, "t", ["k"], most=1, mark="?")
    stores.upsert(rows.where("k < 2").selectExpr("k", "'new' as v", "2 as n"), connect, "t", ["k"], most=1, mark="?")
    with sqlite3.connect(path) as db:
        assert db.execute("select count(*), sum(n) from t").fetchone() == (2500, 2502) and db.execute("select v from t where k = 1").fetchone() == ("new",)


def test_trying_again():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    stores.retried(call, sleep=waits.append)
    assert len(calls) == 3 and 0 <= waits[0] <= 0.1 and 0 <= waits[1] <= 0.2
