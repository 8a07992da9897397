"""Scratch folders of threads are their own."""

import threading

from spanloom.llm import common


def test_threads_do_not_share_scratch_folders(spark):
    inside, go = {}, threading.Barrier(2, timeout=60)

    def run(name):
        with common.scratch(spark, name):
            go.wait()
            inside[name] = common.new_folder(spark, "x")
            go.wait()

    both = [threading.Thread(target=run, args=(n,)) for n in ("one", "two")]
    [t.start() for t in both]
    [t.join(60) for t in both]
    assert "spanloom-one-" in inside["one"] and "spanloom-two-" in inside["two"]
    assert "spanloom-one-" not in common.new_folder(spark, "x")
