"""The shared folder in a session whose settings name none."""

import os
import subprocess
import sys

import pytest

from sherdline.session import shared_folder

PROGRAM = """
from sherdline.session import cut, local_session, shared_folder
spark = local_session(1, "no-folder")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
assert cut(spark.range(5)).count() == 5
print("cut", shared_folder(spark))
"""


def test_local_session_without_a_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "SHERDLINE_DRIVER_MEMORY": "1g"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "cut " in done.stdout, done.stderr[-2000:]


def test_cluster_without_a_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
