"""What workers keep between tasks."""

import subprocess
import sys

import pytest

#: Frees 100 MB below a block that stays, which the C library alone would keep.
KEPT = """
import re
import pyarrow as pa
from kinloom.llm import workers

def used():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def rows(n):
    return pa.record_batch([pa.array(["x"] * n)], names=["text"])

def task():
    for part in workers.sliced(iter([rows(10), rows(10)]), 0):
        made = [bytes(2000) for _ in range(50_000)]
        stays.append(bytes(2000))
        del made

stays = []
list(workers.sliced(iter([rows(10)]), 0))
before = used()
if {held}:
    workers.held("many", lambda: [bytes(2000) for _ in range(50_000)])
    stays.append(bytes(2000))
    workers.release()
else:
    task()
print(used() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
@pytest.mark.parametrize("held", [True, False])
def test_freed_memory_goes_back(held):
    """After what was held for another operator goes, and after a task's last slice."""
    ran = subprocess.run([sys.executable, "-c", KEPT.replace("{held}", str(held))], capture_output=True, text=True, check=True)
    assert float(ran.stdout) < 30
