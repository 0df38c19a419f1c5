import pytest

from cloakwork.llm.shared import let_workers_import

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    """The session, whose Python workers find the package."""
    let_workers_import(spark)
    return spark
