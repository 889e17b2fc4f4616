"""Functions sent to executors work where the package is not installed."""

import os
import subprocess
import sys

import pytest
from filetrail.operators import claims, images, segments
from pyspark import cloudpickle


@pytest.mark.parametrize("function, call", [
    (segments.any_records, "(b'text')"), (claims._cbor_item, "(bytes([1]), 0)"), (images.flat_std, ".__name__"),
])
def test_functions_travel_by_value(tmp_path, function, call):
    path = tmp_path / "function"
    path.write_bytes(cloudpickle.dumps(function))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", f"import pickle; f = pickle.load(open({str(path)!r}, 'rb')); print(f{call})"],
        cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
