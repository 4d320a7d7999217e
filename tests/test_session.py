import glob
import os
from types import SimpleNamespace

import pytest

from cadastre import session


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(fake)


def test_scratch_folders_go_and_others_stay(spark):
    folder = os.path.join(session.checkpoint_dir(spark), "cadastre").removeprefix("file:")
    stays = session.materialize(spark.range(3), "stays")
    with session.scratch(spark):
        assert session.materialize(spark.range(5), "goes").count() == 5
        assert glob.glob(f"{folder}/goes-*")
    assert not glob.glob(f"{folder}/goes-*")
    assert stays.count() == 3
