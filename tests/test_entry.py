"""The entry point with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__
from weftline.plans import registry


def test_queries_have_their_sql():
    known = __spark_entry__.queries()
    assert set(registry.queries()) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)


def test_other_queries_stay_where_a_library_is_missing():
    code = "import sys; sys.modules['zstandard'] = sys.modules['pyarrow.fs'] = sys.modules['tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]
    assert "left out" in done.stderr
