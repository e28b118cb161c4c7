"""Registry, scratch tables, shipping, and independence from the text subpackage."""

import os
import subprocess
import sys

import pytest

from seqloom.plans import scratch
from seqloom.plans.registry import Registry
from seqloom.plans.ship import ship


def test_a_name_is_registered_once():
    r = Registry()
    r.add("q", "select 1")(lambda spark, d: None)
    with pytest.raises(ValueError):
        r.add("q")(lambda spark, d: None)


def test_scratch_tables_are_kept_and_cleared(spark):
    kept = scratch.Scratch(spark, "t").keep(spark.range(5).selectExpr("id", "id * 2 as d"))
    assert kept.agg({"d": "sum"}).head()[0] == 20
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert os.path.isdir(folder)
    assert scratch.clear(spark) >= 1 and not os.path.isdir(folder)


def test_ship_is_done_once(spark):
    ship(spark)
    ship(spark)
    assert sum("seqloom.zip" in f for f in spark.sparkContext.listFiles) == 1
    assert spark.range(3).mapInPandas(lambda parts: parts, "id bigint").count() == 3


def test_nothing_outside_imports_the_text_package():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for at, _, names in os.walk(os.path.join(here, "seqloom")):
        if os.path.basename(at) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "seqloom.llm" not in open(os.path.join(at, n)).read(), n
    code = "import sys; sys.modules['seqloom.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p7_ids' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=here).returncode == 0
