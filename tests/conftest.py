import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
