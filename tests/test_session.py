"""Workers that do not have the package on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import functions as F
from siftworks.operators import blocks
from siftworks.session import local_session

spark = local_session("shipped", "2", 2)
local_session("shipped again", "2", 2)

def where(batches):
    from siftworks.operators import blocks as found
    for b in batches:
        yield b.assign(id=[len(found.__name__)] * len(b))

print("rows", spark.range(3).mapInPandas(where, "id long").distinct().collect()[0][0] == len(blocks.__name__))
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows True" in done.stdout, done.stderr[-2000:]
