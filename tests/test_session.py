from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from tessitura.session import discard, saved, shared_dir


def test_saved_frames_can_be_discarded(spark):
    df = saved(spark.range(3))
    assert df.count() == 3 and os.path.isdir(df.written_at) and df.written_at.startswith(shared_dir(spark))
    discard(df)
    assert not os.path.exists(df.written_at)


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
