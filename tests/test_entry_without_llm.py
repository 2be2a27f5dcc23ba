import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_optional_parts(tmp_path):
    for name in ("canlake", "__spark_entry__.py"):
        source, to = f"{REPO}/{name}", f"{tmp_path}/{name}"
        shutil.copytree(source, to, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, to)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'id_summary' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
