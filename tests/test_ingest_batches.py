"""A batch of arriving files keeps every core busy."""

import importlib

import pytest

import __spark_entry__ as entry
from sheetloom.plans.inputs import Inputs


class Seen(Exception):
    pass


def test_a_batch_has_files_for_every_core(spark, monkeypatch):
    entry.queries()
    plan = importlib.import_module("sheetloom.plans.flows")

    def look(*args):
        raise Seen(args[-1])

    monkeypatch.setattr(plan.flows, "ingest_stream", look)
    with pytest.raises(Seen) as seen:
        plan.ingest(Inputs(spark, "/root/testdata/sf0.001"))
    assert seen.value.args[0] >= 2 * spark.sparkContext.defaultParallelism
