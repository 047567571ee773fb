import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_corpus_subpackage(tmp_path):
    """With the subpackage and the pipeline away, the entry imports and keeps the other queries."""
    for name in ("__spark_entry__.py", "chronotext"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "chronotext"
    package.mkdir()
    for p in (ROOT / "chronotext").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gap_check' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    (tmp_path / "run.py").write_text(code)
    entry = tmp_path / "__spark_entry__.py"
    entry.unlink()
    entry.write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-B", "run.py"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "chronotext").rglob("*.py"):
        if "llm" not in p.parts:
            assert "chronotext.llm" not in p.read_text(), p
