import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["node", "bc"] and out.count() == 160


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "betwixt"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "betwixt" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_bc' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)


def test_only_the_optional_part_imports_itself():
    for p in (ROOT / "betwixt").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
