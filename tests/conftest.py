import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from clickloom.session import get_spark

    s = get_spark("local[4]", 8, app="clickloom-tests")
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="clickloom-test-")


EVENT_DEFAULTS = dict(
    event_id=None, event_name="page_view", visitor_id="v1", session_id="s1", client_timestamp=None,
    received_at=None, page_url="https://shop.example.com/", page_path="/", page_title=None, referrer=None,
    utm_source=None, utm_medium=None, utm_campaign=None, utm_content=None, utm_term=None, fbclid=None,
    device_type=None, screen_width=None, language=None, properties="{}",
)


def make_events(spark, rows):
    """Build an event table (bronze shape) from partial dicts."""
    from clickloom.sources.events import EVENTS_SCHEMA

    full = []
    for i, r in enumerate(rows):
        d = dict(EVENT_DEFAULTS)
        d.update(r)
        if d["event_id"] is None:
            d["event_id"] = f"e{i:04d}"
        if d["received_at"] is None:
            d["received_at"] = d["client_timestamp"]
        full.append(tuple(d[f.name] for f in EVENTS_SCHEMA.fields))
    return spark.createDataFrame(full, EVENTS_SCHEMA)
