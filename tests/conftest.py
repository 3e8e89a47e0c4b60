import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratiform import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def write(tmp_path):
    """Write a text file under the test's folder and return its folder."""

    def writer(name, text, folder="staged", encoding="utf-8"):
        target = tmp_path / folder
        target.mkdir(exist_ok=True)
        (target / name).write_bytes(text.encode(encoding))
        return str(target)

    return writer


@pytest.fixture
def envelope():
    def build(*records):
        return json.dumps({"data": list(records)}, ensure_ascii=False) + "\n"

    return build


@pytest.fixture
def flight():
    """An invented flight record; nested parts are replaced by keyword."""

    def build(icao="XXX1", **changed):
        record = {
            "flight_date": "2023-12-01",
            "flight_status": "active",
            "departure": {
                "airport": "Chopin", "iata": "WAW", "icao": "EPWA", "delay": 7, "actual": "dep-actual",
                "actual_runway": "dep-runway", "baggage": "D1", "scheduled": "2023-12-01T12:05:00+00:00",
            },
            "arrival": {
                "airport": "Balice", "iata": "KRK", "icao": "EPKK", "delay": 3, "actual": "arr-actual",
                "actual_runway": "arr-runway", "baggage": "A1", "scheduled": "2023-12-01T13:00:00+00:00",
            },
            "flight": {"iata": "XX1", "icao": icao, "number": "1", "codeshared": None},
            "aircraft": None,
            "airline": {"iata": "XX", "icao": "XXX", "name": "Example"},
            "live": {
                "altitude": 1066.80, "direction": 135, "is_ground": False, "latitude": 52.1, "longitude": 20.9,
                "speed_horizontal": 400.0, "speed_vertical": 0, "updated": "2023-12-01T12:30:00+00:00",
            },
        }
        record.update(changed)
        return record

    return build
