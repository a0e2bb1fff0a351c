import pytest

from turnloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Blocks of two positions, so that most conversations count as long."""
    monkeypatch.setattr("turnloom.operators.turns.BLOCK_BITS", 1)
