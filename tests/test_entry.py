"""The driver contract with and without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
{block}
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(found) and "ranked_vessels" in found
print(sorted(k for k in found if k.startswith("op") and "_" in k and k[2:k.index("_")].isdigit() or k == "pipeline"))
"""


def names(block=""):
    out = subprocess.run([sys.executable, "-c", CODE.format(block=block)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.strip()


def test_entry_without_the_subpackage():
    assert names("sys.modules['corpus_pipeline'] = sys.modules['slickwatch.llm'] = None") == "[]"


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "slickwatch")):
        if not folder.endswith("llm"):
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "slickwatch.llm" not in f.read()
