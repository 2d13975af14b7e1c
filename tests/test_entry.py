"""The entry module without the training-data operators, and the shape of the registry."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_the_subpackage():
    code = (
        "import sys; sys.modules['linkveil.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e, re\n"
        "names = e.queries()\n"
        "assert names and not [n for n in names if re.match(r'op\\d+_|pipeline', n)]\n"
        "assert set(e.oracle_sql()) <= set(names)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "linkveil").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"linkveil\.llm|from \.+llm", f.read_text()), f


def test_registry():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
