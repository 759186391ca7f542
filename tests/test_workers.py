"""Executors need not have this library: a driver started elsewhere runs every kind of Python function."""

import os
import subprocess
import sys
from pathlib import Path

import oracle
import pytest

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from millrace.plans import registry
from millrace.session import build_session
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
for name in sys.argv[3:]:
    assert registry.queries()[name](spark, sys.argv[2]).count() > 0, name
"""


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="driver tables are absent")
def test_queries_run_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    names = ["edit_scores", "syntax_ok", "rolling_500", "quota_exact_greedy", "stream_rolling", "stream_early_stop", "stream_quotas"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, repo, oracle.FOLDER, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
