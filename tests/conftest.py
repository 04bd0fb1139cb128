import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import local_session

    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_pins(monkeypatch):
    """Every per-group summary counts as too large to broadcast."""
    from cohortlens import session

    monkeypatch.setattr(session, "PIN_ROWS", 1)


@pytest.fixture(autouse=True)
def order_path(request):
    """Unit tests cut small tables again and again, as large ones are; the registered queries do not."""
    from cohortlens.operators.ordering import small_buckets

    if request.module.__name__.endswith("test_queries") or ".llm." in request.module.__name__:
        yield
    else:
        with small_buckets(5, 500):
            yield
