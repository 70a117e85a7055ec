import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "matching_results" in names


def test_the_rest_works_without_the_training_data_part():
    """Nothing outside the part imports it, but for the guard in the entry module."""
    import re
    from pathlib import Path

    root = Path(entry.__file__).parent
    for path in root.glob("tessera/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from .*\bllm\b", path.read_text()), path


def test_only_the_absence_of_the_part_is_passed_over(tmp_path):
    root = Path(__file__).parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    done = run()
    assert done.returncode == 0 and int(done.stdout.split()[0]) >= 55, done.stderr
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr
