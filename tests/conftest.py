import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from worklens.session import session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    return session("tests", cores=4, **{"spark.sql.warehouse.dir": warehouse})
