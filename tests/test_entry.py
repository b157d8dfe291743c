import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera import plans

ROOT = Path(entry.__file__).parent


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.registry()) <= set(entry.queries())


@pytest.mark.parametrize(("gone", "left"), [(("tessera/llm", "corpus_pipeline.py"), "plans"), (("corpus_pipeline.py",), "llm"), (("tessera/llm",), "plans")])
@pytest.mark.parametrize("empty", [False, True])
def test_imports_after_deletion(tmp_path, gone, left, empty):
    """With the folders deleted, or only emptied, the rest imports; an import error inside of a part that is there shows."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        path = tmp_path / "r" / name
        if path.exists():
            shutil.rmtree(path) if path.is_dir() else path.unlink()
        if empty and "." not in name:
            path.mkdir()
    code = "import __spark_entry__ as e; from tessera import plans; n = len(e.queries()) - len(plans.registry()); assert n == {'plans': 0, 'llm': 10}['" + left + "'], n"
    if left == "llm" and not (ROOT / "tessera/llm/queries.py").exists():
        return
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "r")


def test_an_import_error_shows(tmp_path):
    (tmp_path / "tessera/llm").mkdir(parents=True)
    for name in ("__spark_entry__.py", "tessera/__init__.py", "tessera/session.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "tessera/plans", tmp_path / "tessera/plans")
    (tmp_path / "tessera/llm/queries.py").write_text("import not_there_at_all")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "not_there_at_all" in done.stderr


def test_imports_without_optional_parts():
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; from tessera import plans; assert set(e.queries()) == set(plans.registry())"
    subprocess.run([sys.executable, "-c", code], check=True)
