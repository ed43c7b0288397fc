import copy

import pytest
import yaml

from tidemark.plans import catalog as c

RAW = yaml.safe_load(c.DEFAULT_PATH.read_text(encoding="utf-8"))


def test_shipped_catalog():
    shipped = c.load_catalog()
    assert shipped.names == ["sum_amt_24h", "count_txn_24h", "sum_amt_7d", "time_since_last_txn_sec"]
    assert [f.window_hours for f in shipped.features] == [24, 24, 168, 720]
    assert shipped.max_lookback_hours == 720 and shipped.fingerprint == "a56eaf7727288928"
    assert c.describe(shipped).count("\n") == 3


@pytest.mark.parametrize("key, value", [("aggregation", "mean"), ("window_hours", 0), ("window_hours", -1), ("window_hours", 1.5), ("window_hours", True), ("name", "Sum"), ("name", "1a"), ("name", "số"), ("name", "a b"), ("source_column", "event_ts"), ("default_value", 1), ("default_value", None), ("version", ""), ("version", "-1"), ("description", "  "), ("entity", "card"), ("event_time", "ts"), ("extra", 1)])
def test_bad_features_are_refused(key, value):
    raw = copy.deepcopy(RAW)
    raw["features"][0][key] = value
    with pytest.raises(ValueError):
        c.from_mapping(raw)


def test_bad_catalogs_are_refused(tmp_path):
    twice = copy.deepcopy(RAW)
    twice["features"].append(twice["features"][0])
    for raw in (twice, {"version": "1"}, {"version": "1", "features": []}, {**RAW, "x": 1}, [1], {"version": "1", "features": [{}]}):
        with pytest.raises(ValueError):
            c.from_mapping(raw)
    (tmp_path / "empty.yaml").write_text("")
    with pytest.raises(ValueError, match="empty"):
        c.load_catalog(tmp_path / "empty.yaml")


def test_zero_as_float_is_the_same_default():
    raw = copy.deepcopy(RAW)
    raw["features"][0]["default_value"] = 0.0
    assert c.from_mapping(raw).features[0].default_value == 0
