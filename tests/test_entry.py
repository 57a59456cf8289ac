"""The entry module without the optional part, and with one that lacks a package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print('N', len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def loaded(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-800:]
    return [int(x) for x in run.stdout.split("N ")[1].split()], run.stderr


def test_entry_without_the_corpus_operators_and_with_a_missing_package(tmp_path):
    for name in ("pairwell", "suite"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (plain, extra), err = loaded(tmp_path)
    assert plain > 100 and extra == 0 and "left out" not in err
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_there\n")
    (again, extra), err = loaded(tmp_path)
    assert again == plain and extra == 0 and "a_package_that_is_not_there" in err
