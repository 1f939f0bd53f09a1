import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from probeline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8, app="probeline-tests", **{"spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def rows(df, *by):
    """Collected rows as tuples, in order of ``by`` or of the whole row."""
    found = [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]
    return found if by else sorted(found, key=repr)
