import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from eventlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "eventlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    from eventlens.session import materialize
    from eventlens.sources.canonical import load_events

    return materialize(load_events(spark, SF), "events")


@pytest.fixture(scope="session")
def skewed(events):
    """A third of all rows under one user, and rows without a user."""
    from pyspark.sql import functions as F

    user = (
        F.when(F.col("event_id") % 3 == 0, "hot").when(F.col("event_id") % 17 == 1, F.lit(None))
        .otherwise(F.col("user_id"))
    )
    return events.withColumn("user_id", user)


def rows(df, *order):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=lambda t: tuple(map(repr, t)))
