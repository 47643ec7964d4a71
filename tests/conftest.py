import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("BENCH_MEM", "4g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from partloom.session import get_session

    base = tmp_path_factory.mktemp("shared")
    s = get_session("tests", master=f"local[{os.environ.get('TEST_CPUS', '4')}]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(base), spark__sql__warehouse__dir=str(base / "warehouse"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
