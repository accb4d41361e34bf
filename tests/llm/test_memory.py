import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
HELD = """
import re
import numpy as np
from gradeloom.llm.common import lean

def memory():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def run(parts):
    for _ in parts:
        small = [np.ones(200) for _ in range(100_000)]
        kept.append(small[-1])  # what lies below it is free afterwards, but not at the heap's end
        yield len(small)

kept, before = [], memory()
assert list(lean(run)([1])) == [100_000] and not list(lean(run)([]))
print(memory() - before)
"""


def test_a_worker_gives_back_what_a_stage_took():
    said = subprocess.run([sys.executable, "-c", HELD], cwd=REPO, env=os.environ | {"PYTHONPATH": REPO}, capture_output=True, text=True, check=True)
    assert float(said.stdout) < 60  # of some 170 MB
