"""Functions sent to executors carry what they need, wherever the library lies."""

import os
import pickle
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from millrace.llm import html, licenses, minhash, substrings

SCRIPT = """
import pickle, sys
pickle.load(sys.stdin.buffer)
assert not any(m.split(".")[0] == "millrace" for m in sys.modules)
"""


@pytest.mark.parametrize("function", [html._hash_pages, html._own_hashes, html._extract_pages(None), licenses._scan_batches, minhash._sign, minhash._contract, substrings._remove(35)], ids=lambda f: f.__qualname__)
def test_functions_load_without_the_library(function, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, input=cloudpickle.dumps(function, pickle.HIGHEST_PROTOCOL), capture_output=True, timeout=60, check=False)
    assert done.returncode == 0, done.stderr[-1000:]


def test_names_of_a_corpus_are_not_kept():
    assert not hasattr(html.surrounds, "cache_info")
    assert html.surrounds("site-footer") and html.surrounds("share-box") and html.surrounds("social-links")
    assert not html.surrounds("has-sidebar") and not html.surrounds("social-history") and not html.surrounds("")
