import pytest

from foliograph.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    # Small rows through large plans: compiling them is most of the time, so they are interpreted here.
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield s
    s.stop()
