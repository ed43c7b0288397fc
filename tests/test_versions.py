import threading

import pytest

from tidemark.sources import versions


def test_readers_find_a_whole_table_through_all_publications(spark, tmp_path):
    table = versions.Versions(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.current()
    table.publish(spark.range(1))
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(table.read().count())
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 16):
        table.publish(spark.range(n))
    stop.set()
    reader.join()
    assert not failed and seen == sorted(seen) and set(seen) <= set(range(1, 16)) and table.read().count() == 15


def test_a_crash_at_any_step_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = versions.Versions(spark, str(tmp_path / "t"))
    first = table.publish(spark.range(3))
    with pytest.raises(Exception):
        table.publish(spark.range(9).selectExpr("raise_error('half written') AS x", "id"))
    assert table.current() == first
    real = versions._fs

    def broken(spark, path):
        if "/current/" in path:
            raise OSError("the pointer cannot be made")
        return real(spark, path)

    monkeypatch.setattr(versions, "_fs", broken)
    with pytest.raises(OSError):
        table.publish(spark.range(9))
    monkeypatch.undo()
    assert table.current() == first and table.read().count() == 3
    held = table.read()
    second = table.publish(spark.range(4).selectExpr("id", "id % 2 AS part"), by=["part"])
    assert held.count() == 3 and table.read().count() == 4
    # what was broken off has numbers before or at the second's; only what is before the kept ones goes
    third = table.publish(spark.range(5))
    gone = table.expire(keep=1)
    assert len(gone) >= 3 and table.current() == third and [p.name for p in (tmp_path / "t" / "versions").iterdir()] == [third.rsplit("/", 1)[1]]
    assert second not in third
    with pytest.raises(ValueError):
        table.expire(0)
