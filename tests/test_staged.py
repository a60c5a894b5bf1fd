"""Staged runs: rows by stage, a cancelled run among others, errors."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from quillstream.operators import analyses as A
from quillstream.operators import staged as S
from quillstream.operators.frames import Frames


def test_rows_by_stage(spark):
    docs = spark.createDataFrame([(k, f"He left quickly. She stayed, number {k}.") for k in range(20)], "doc_id long, text string")
    stages = {
        "sentences": lambda _: Frames.plain(docs).sentences,
        "adverbs": lambda _: A.adverbs(Frames.plain(docs).words),
        "by_rule": lambda made: made["adverbs"].groupBy("rule").count(),
        "none": lambda made: made["sentences"].limit(0),
    }
    seen = []
    run = S.Run(spark, stages, seen.append)
    frames = run.run()
    assert [(p.stage, p.number, p.of, p.rows) for p in seen] == [("sentences", 1, 4, 40), ("adverbs", 2, 4, 20), ("by_rule", 3, 4, 1), ("none", 4, 4, 0)]
    assert frames["by_rule"].first()["count"] == 20 and run.table().count() == 4
    run.cancel()  # after its end: nothing happens
    assert frames["adverbs"].count() == 20


def test_one_run_is_cancelled_and_another_goes_on(spark):
    def slow(_):
        return spark.range(0, 64, 1, 64).mapInPandas(lambda pages: (page for page in pages if not time.sleep(0.5)), "id long")

    began, caught = threading.Event(), []
    run = S.Run(spark, {"first": lambda _: spark.range(3).toDF("id"), "slow": slow, "never": lambda _: pytest.fail("began")}, lambda p: began.set())

    def go():
        try:
            run.run()
        except S.Cancelled as e:
            caught.append(e)

    thread = threading.Thread(target=go)
    thread.start()
    assert began.wait(60)
    time.sleep(1)
    run.cancel()
    other = S.Run(spark, {"count": lambda _: spark.range(100).agg(F.sum("id"))})
    assert other.run()["count"].first()[0] == 4950
    thread.join(60)
    assert not thread.is_alive() and len(caught) == 1 and [p.stage for p in run.done] == ["first"]


def test_an_error_is_no_cancellation(spark):
    with pytest.raises(ValueError, match="bad"):
        S.Run(spark, {"bad": lambda _: (_ for _ in ()).throw(ValueError("bad"))}).run()
