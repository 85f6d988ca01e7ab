from pathlib import Path

import pytest


@pytest.fixture(scope="session")
def small():
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    return folder
