"""The driver's entry: without a dependency of the text operators their queries go, all others stay."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import sys; sys.modules['{0}'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k.startswith('op') and k[2].isdigit() or k == 'pipeline'))"


def test_queries_load_without_a_dependency():
    for missing in ("ahocorasick", "meshwright.llm"):
        out = subprocess.run([sys.executable, "-c", CODE.format(missing)], cwd=ROOT, capture_output=True, text=True, check=True).stdout
        n, sql, optional = out.strip().split(" ", 2)
        assert int(n) > 150 and int(sql) > 150 and optional == "[]"
