"""Workers find the package when the driver runs from another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pairwell.session import local_session, needs_shipping
assert needs_shipping({root!r})
spark = local_session("2", 2)
assert entry.queries()["fisher_p"](spark, "/root/testdata/sf0.001").collect()
print("rows came back")
"""


def test_a_query_with_python_functions_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows came back" in done.stdout, done.stderr[-2000:]
