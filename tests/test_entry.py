"""The driver's entry imports without a session, and every oracle has its query."""

import subprocess
import sys
from pathlib import Path


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys() and len(q) > 100"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
