import os

import pytest

from tablewright.functions.lineage import local_folder


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError):
        local_folder(master, "x-")


@pytest.mark.parametrize("master", ["local", "local[8]"])
def test_a_local_session_may_use_one(master):
    assert os.path.isdir(local_folder(master, "tablewright-test-"))
