"""The catalogue stands without the training-data subpackage and the pipeline."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("pixelloom.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in e.queries())
"""


def test_without_subpackage():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "pixelloom")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                text = open(os.path.join(folder, n)).read()
                assert "import llm" not in text and ".llm" not in text, n
