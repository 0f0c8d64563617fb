"""The driver contract without the optional part."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = f"""
import __spark_entry__ as entry
from loam.session import build_session
spark = build_session("entry", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"}})
queries, sql = entry.queries(), entry.oracle_sql()
assert set(sql) <= set(queries)
assert queries["jn1_first_role"](spark, "{SMALL}").count() > 0
assert entry.entry(spark).count() > 0
print("optional:", *sorted(q for q in queries if q.startswith("op") or q == "pipeline"))
"""


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    leave = shutil.ignore_patterns("__pycache__", *gone)
    for name in ("loam", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=leave)
    for name in {"__spark_entry__.py", "corpus_pipeline.py"}.difference(gone):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    run = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)},
                         capture_output=True, text=True, timeout=280)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "pipeline" not in run.stdout and ("op1_" not in run.stdout or "llm" not in gone)


ELSEWHERE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from loam.bindings import Tables
from loam.operators import account_history
from loam.session import build_session
from loam.streaming import counters, runs
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"}})
tables = Tables(spark, "{SMALL}")
assert account_history.account_states(tables.account_events).count() == 25
assert runs.append_now(counters.first_crossings(tables.streamed("readings"), tables.sensors), "crossings").count() > 0
"""


def test_workers_need_not_have_the_package(tmp_path):
    """The repository is on the driver's path only."""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", ELSEWHERE], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=280)
    assert run.returncode == 0, run.stderr[-2000:]
