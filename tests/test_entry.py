"""The entry with and without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(before: str) -> list[str]:
    code = f"import sys\n{before}\nimport __spark_entry__ as e\nprint('NAMES', *e.queries())\nassert e.oracle_sql().keys() <= e.queries().keys()"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout.rpartition("NAMES")[2].split()


def test_other_queries_stand_without_the_training_data_operators():
    without = names("sys.modules['voxelkeel.llm'] = None")
    assert len(without) > 150 and not any(n.startswith("op") or n == "pipeline" for n in without)
    assert set(without) <= set(names(""))
