import pytest

from marlspring.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", 4, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    s.stop()
