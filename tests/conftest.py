import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfspark.session import local_session  # noqa: E402

CATALOG = (
    "listing_id long, parent_asin string, title string, features array<string>, description array<string>, price string, categories array<string>, "
    "details map<string,string>, average_rating double, rating_number long, store string, listed_at timestamp, loaded_at timestamp"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def catalog(spark):
    """Makes a catalog table from dicts; extra columns with clashing names can be added."""
    import datetime as dt

    from pyspark.sql import functions as F

    names = [c.strip().split(" ")[0] for c in CATALOG.replace("map<string,string>", "map").split(", ")]

    def make(rows, clash=True):
        at = dt.datetime(2026, 1, 1)
        data = [tuple(r.get(n, at if n == "loaded_at" else None) for n in names) for r in rows]
        df = spark.createDataFrame(data, CATALOG)
        if clash:
            for name in ("n", "term", "text", "class", "field", "value", "__x", "records", "score", "name", "a", "b"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
