"""Publication of several tables: conflicts, failures, and readers in between."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from eventloom.sources import sinks, snapshots
from tests.conftest import rows


def tables(spark, n):
    return {"a": spark.range(n), "b": spark.createDataFrame([(n, "x")], "n int, t string")}


def test_versions(spark, tmp_path):
    root = f"{tmp_path}/p"
    assert snapshots.newest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, root)
    one = snapshots.publish(spark, tables(spark, 1), root, base=0)
    two = snapshots.publish(spark, tables(spark, 2), root)
    assert (one.number, two.number) == (1, 2) and one.folder != two.folder
    version, found = snapshots.load(spark, root)
    assert version == two and rows(found["b"]) == [(2, "x")]
    assert rows(snapshots.load(spark, root, 1)[1]["b"]) == [(1, "x")]
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, tables(spark, 3), root, base=1)
    assert [v.number for v in snapshots.versions(spark, root)] == [2, 1]
    assert len(list((tmp_path / "p" / "snapshots").iterdir())) == 2
    assert snapshots.expire(spark, root, 1) == [1] and [v.number for v in snapshots.versions(spark, root)] == [2]
    assert rows(snapshots.load(spark, root, verify=False)[1]["a"]) == [(0,), (1,)]


def test_failures_leave_what_was_there(spark, tmp_path):
    root = f"{tmp_path}/p"
    snapshots.publish(spark, tables(spark, 1), root)

    def refuse(_):
        raise ValueError("not these")

    broken = {"a": spark.range(1), "b": spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))}
    for made, validate in ((broken, None), (tables(spark, 5), refuse)):
        with pytest.raises(Exception, match="no"):
            snapshots.publish(spark, made, root, validate=validate)
    assert [v.number for v in snapshots.versions(spark, root)] == [1]
    assert len(list((tmp_path / "p" / "snapshots").iterdir())) == 1
    spark.range(9).write.mode("overwrite").parquet(f"{snapshots.newest(spark, root).folder}/a")
    with pytest.raises(ValueError, match="published"):
        snapshots.load(spark, root)


def test_of_two_publishers_one_wins(spark, tmp_path, monkeypatch):
    """Both have written their tables before either points to them."""
    root = f"{tmp_path}/p"
    snapshots.publish(spark, tables(spark, 1), root)
    both = threading.Barrier(2)
    real = sinks.publish

    def together(*args, **more):
        made = real(*args, **more)
        both.wait(60)
        return made

    monkeypatch.setattr(sinks, "publish", together)
    won, lost, seen, stop = [], [], [], threading.Event()

    def run(n):
        try:
            won.append((n, snapshots.publish(spark, tables(spark, n), root, base=1).number))
        except snapshots.Conflict:
            lost.append(n)

    def read():
        while not stop.is_set():
            _, found = snapshots.load(spark, root, verify=False)
            seen.append((found["a"].count(), found["b"].first().n))

    threads = [threading.Thread(target=run, args=(n,)) for n in (2, 3)]
    reader = threading.Thread(target=read)
    for t in [*threads, reader]:
        t.start()
    for t in threads:
        t.join(120)
    stop.set()
    reader.join(60)
    assert len(won) == len(lost) == 1 and won[0][1] == 2
    assert rows(snapshots.load(spark, root)[1]["b"]) == [(won[0][0], "x")]
    assert seen and all(a == b for a, b in seen) and {a for a, _ in seen} <= {1, won[0][0]}
    assert len(list((tmp_path / "p" / "snapshots").iterdir())) == 2


def test_pointers_under_way_and_dead_ones(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/p"
    snapshots.publish(spark, tables(spark, 1), root)
    (tmp_path / "p" / "versions" / "000000000002.json").write_text('{"folder": "snap')
    assert snapshots.newest(spark, root).number == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, tables(spark, 2), root)
    monkeypatch.setattr(snapshots, "GRACE", 0)
    time.sleep(0.1)
    assert snapshots.publish(spark, tables(spark, 2), root).number == 3
    assert rows(snapshots.load(spark, root)[1]["b"]) == [(2, "x")]


def test_create_once(spark, tmp_path):
    path = f"{tmp_path}/deep/x.json"
    assert snapshots.create_once(spark, path, json.dumps({"a": "ä"})) and not snapshots.create_once(spark, path, "other")
    assert (tmp_path / "deep" / "x.json").read_text() == '{"a": "\\u00e4"}' and len(list((tmp_path / "deep").iterdir())) == 1
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(snapshots.create_once(spark, f"{tmp_path}/one", str(k)))) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert sum(won) == 1


def test_texts_are_replaced_in_one_step(spark, tmp_path, monkeypatch):
    """A reader always finds the old text or the new one."""
    path = tmp_path / "t.txt"
    sinks.write_text(spark, str(path), "0" * 1000)
    missing, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                missing.append(len(set(path.read_text())) != 1)
            except FileNotFoundError:
                missing.append(True)

    t = threading.Thread(target=read)
    t.start()
    for k in range(1, 10):
        sinks.write_text(spark, str(path), str(k) * 1000, force=True)
    stop.set()
    t.join(10)
    assert missing and not any(missing) and path.read_text() == "9" * 1000
