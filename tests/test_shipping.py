"""Workers that have the package only as the shipped zip can import all of it."""

import subprocess
import sys

from noisesift.session import zip_package


def test_every_subpackage_imports_from_the_zip(tmp_path):
    path = tmp_path / "noisesift.zip"
    zip_package(str(path))
    code = f"""
import sys
sys.path.insert(0, {str(path)!r})
import noisesift.functions.text, noisesift.operators.gate, noisesift.operators.weights, noisesift.sources.splits, noisesift.streaming.bank, noisesift.llm.packing, noisesift.plans.registry
assert noisesift.streaming.bank.__file__.startswith({str(path)!r})
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": ""}, timeout=120)
    assert done.returncode == 0, done.stderr
