import os
import threading

import pytest

from loamwork.llm import shared


def test_tables_of_this_thread_go_but_for_kept_ones(spark):
    place = shared.mark()
    kept = shared.written(spark.range(5), "kept")
    gone = shared.written(spark.range(3), "gone")
    other = []
    thread = threading.Thread(target=lambda: other.append(shared.written(spark.range(2), "other")))
    thread.start()
    thread.join()
    files = [f.removeprefix("file://") for f in gone.inputFiles()]
    shared.drop_since(spark, place, kept)
    assert kept.count() == 5 and other[0].count() == 2 and not any(map(os.path.exists, files))
    shared.drop_since(spark, place)
    assert shared.mark() == place


def test_what_a_worker_keeps_goes_when_something_else_begins():
    from loamwork.llm import encoder

    encoder.encoder.cache_clear()
    dropped = []
    shared.keep_for("encoder", lambda: dropped.append(1))
    assert list(shared.tidy(lambda batches: iter(batches), "encoder")([1, 2])) == [1, 2] and not dropped
    assert list(shared.tidy(lambda batches: iter(batches))([3])) == [3] and dropped == [1]
    assert list(shared.tidy(lambda batches: iter(batches), "pieces")([])) == [] and dropped == [1]


def test_local_folders_are_refused_on_clusters():
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.scratch(Session(), "x")
    Session.conf = {"spark.checkpoint.dir": "hdfs://name/folder/"}
    place = shared.mark()
    assert shared.scratch(Session(), "x").startswith("hdfs://name/folder/x-")
    shared._paths.all[place:] = []
