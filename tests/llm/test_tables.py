"""Tables of a block are its own, whatever other threads of the driver do meanwhile."""

from __future__ import annotations

import threading

from terrane.llm import tables


def test_blocks_of_two_threads_leave_each_other_alone(spark):
    begun, ended, rows = threading.Event(), threading.Event(), []

    def one():
        with tables.scratch(spark):
            frame, _ = tables.written(spark.range(5))
            begun.set()
            assert ended.wait(60)
            rows.append(frame.count())

    thread = threading.Thread(target=one)
    thread.start()
    assert begun.wait(60)
    with tables.scratch(spark):  # begins and ends while the other's table is in use
        tables.written(spark.range(3))
    ended.set()
    thread.join(120)
    assert rows == [5]


def test_nested_blocks_hand_on_what_is_kept(spark):
    with tables.scratch(spark):
        with tables.scratch(spark) as kept:
            held, path = tables.written(spark.range(4))
            _, other = tables.written(spark.range(2))
            kept.append(path)
        assert held.count() == 4 and path in tables._there and other not in tables._there
    assert path not in tables._there
