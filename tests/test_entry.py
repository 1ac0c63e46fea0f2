"""The engine stands without its optional part, and a broken optional part isn't hidden."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def loaded(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)


def copied(to):
    for name in ("lexmill", "__spark_entry__.py", "corpus_pipeline.py"):
        source = f"{ROOT}/{name}"
        if os.path.isdir(source):
            shutil.copytree(source, to / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif os.path.exists(source):
            shutil.copy(source, to / name)
    return to


def test_queries_without_the_optional_part(tmp_path):
    folder = copied(tmp_path)
    for gone in ("llm folder", "pipeline too"):
        if gone == "pipeline too" and (folder / "corpus_pipeline.py").exists():
            (folder / "corpus_pipeline.py").unlink()
        ran = loaded(folder)
        assert ran.returncode == 0, ran.stderr
        assert "lexicon_build" in ran.stdout and "op1_" not in ran.stdout and "'pipeline'" not in ran.stdout


def test_a_broken_optional_part_is_told(tmp_path):
    folder = copied(tmp_path)
    (folder / "corpus_pipeline.py").write_text("import a_library_that_is_missing\n")
    ran = loaded(folder)
    assert ran.returncode and "a_library_that_is_missing" in ran.stderr
