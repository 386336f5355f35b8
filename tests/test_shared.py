"""Where intermediate tables go."""

import pytest

from assayer.sources.shared import shared_folder


class Session:
    def __init__(self, **conf):
        self.values, self.conf = {k.replace("_", "."): v for k, v in conf.items()}, self

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_only_local_mode_falls_back_to_a_local_folder():
    assert shared_folder(Session(spark_checkpoint_dir="hdfs://x/", spark_master="yarn"), "a").startswith("hdfs://x/a-")
    assert "/a-" in shared_folder(Session(spark_master="local[4]"), "a")
    for master in ("yarn", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session(spark_master=master), "a")
