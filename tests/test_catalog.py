"""Every registered query against its SQL on the smallest driver tables."""

import os
import subprocess
import sys

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def names():
    import catalog
    return sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    from verify import connect
    return connect(FOLDER)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    import catalog
    from verify import compare
    ok, note = compare(spark, con, FOLDER, catalog.QUERIES[name], catalog.SQL.get(name))
    assert ok is not False, note


def test_entry_has_rows_and_names_are_plain(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_optional_packages():
    """A missing package of the optional part costs its queries only."""
    script = ("import sys; sys.modules['tiktoken'] = None; sys.modules['public_tokenizers'] = None\n"
              "import __spark_entry__ as e, catalog\n"
              "assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.SQL)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
