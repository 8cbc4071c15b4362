"""Raw logs, road files, settings, schemas."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftframe import config, schema
from driftframe.functions import geo
from driftframe.operators import roads as road_ops
from driftframe.sources import roads, synthetic, tables

PHONE_HEADER = (
    "LATITUDE (degrees),LONGITUDE (degrees),ALTITUDE (m),SPEED (Kmh),ACCURACY (m),ORIENTATION (degrees),SATELLITES IN RANGE,TIME SINCE START (ms),DATE(YYYY-MO-DD HH-MI-SS_SSS),"
    "ACCELEROMETER X (m/s\xb2),ACCELEROMETER Y (m/s\xb2),ACCELEROMETER Z (m/s\xb2),GRAVITY X (m/s\xb2),GRAVITY Y (m/s\xb2),GRAVITY Z (m/s\xb2),GYROSCOPE Yaw (rad/s),GYROSCOPE Pitch (rad/s),GYROSCOPE Roll (rad/s),"
    "MAGNETIC FIELD X (\xb5T),MAGNETIC FIELD Y (\xb5T),MAGNETIC FIELD Z (\xb5T),ORIENTATION Yaw (\xb0),ORIENTATION Pitch (\xb0),ORIENTATION Roll (\xb0)"
)


def clock(s: float) -> str:
    h, m, x = int(s // 3600), int(s % 3600 // 60), s % 60
    return f"2024-03-01 {h:02d}:{m:02d}:{int(x):02d}:{round((x - int(x)) * 1000):03d}"


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    """A drive of 300 s with a 30 s hole, a repeated and a backward phone row; the vehicle's clock is 2.0 s behind."""
    d = tmp_path_factory.mktemp("logs")
    t = np.arange(0, 300, 0.1)
    rng = np.random.default_rng(5)
    turn = np.convolve(rng.normal(size=len(t)), np.ones(40) / 40, "same")
    rows = [PHONE_HEADER]
    for i, x in enumerate(t):
        if 150 <= x < 180:
            continue
        line = ["51.0", "7.0", "80", "10.0", "1.0", "90", "9 / 12", str(int(x * 1000)), clock(36000 + x), "1.0", "0.0", "9.81", "0", "0", "9.81", "0.0", f"{turn[i]:.6f}", "0.0", "1", "2", "3", "90.0", "0", "0"]
        rows.append(",".join(line))
        if i in (100, 200):
            rows.append(",".join(line if i == 100 else [*line[:8], clock(36000 + x - 5), *line[9:]]))
    (d / "S.csv").write_bytes("\n".join(rows).encode("latin-1"))
    v = ["TIME (s),LATITUDE (degrees),LONGITUDE (degrees),VELOCITY (km/h),HEADING (degrees),YAW RATE (deg/s),INDICATED SPEED (km/h)"]
    v += [f"{36000 + x - 2.0:.1f},{51 + x * 1e-5:.7f},7.0,36.0,0.0,{math.degrees(turn[i]):.5f},36.0" for i, x in enumerate(t)]
    (d / "V.csv").write_text("\n".join(v))
    return d


def test_raw_logs_become_a_standard_table(spark, logs):
    cfg = config.with_changes(config.DEFAULTS, {"data.sync.segment_s": 60.0, "data.sync.max_lag_s": 5.0})
    phone = tables.raw(spark, str(logs / "S.csv"), tables.PHONE, "X1")
    vehicle = tables.raw(spark, str(logs / "V.csv"), tables.VEHICLE, "X1")
    df = tables.standardise(phone, vehicle, cfg)
    assert df.schema.fieldNames() == schema.DRIVE.fieldNames()
    got = df.orderBy("t").toPandas()
    assert len(got) == 2700 and got["session"].nunique() == 2 and (got["t"].diff()[1:] > 0).all()
    assert np.allclose(got["ax"], 0.0, atol=1e-9) and np.allclose(got["ay"], 1.0)
    ok = got[got["ref_valid"]]
    assert len(ok) > 2000 and np.allclose(ok["ref_speed"], 10.0) and np.allclose(ok["ref_yaw"], math.pi / 2)
    # the vehicle's row of the same moment: t - 2 on its own clock
    assert np.allclose(ok["ref_lat"], 51 + (ok["t"]) * 1e-5, atol=2e-6)
    own = tables.standardise(phone, vehicle, cfg, "phone").orderBy("t").toPandas()
    assert (own["gnss_std"] == 2.0).all() and (own["gnss_speed"] == 10.0).all()


def test_drives_round_trip_by_partition(spark, tmp_path):
    d = synthetic.drives(synthetic.specs(spark, 3, duration_s=20.0))
    tables.save_drives(d, str(tmp_path / "p"))
    back = tables.load_drives(spark, str(tmp_path / "p"), ["d1"])
    assert back.count() == 200 and back.select("drive_id").distinct().count() == 1
    assert "PartitionFilters: [isnotnull(drive_id" in back._jdf.queryExecution().toString()
    assert [f.metadata["role"] for f in back.schema][:4] == ["meta", "meta", "meta", "imu"]


def test_headers_match_across_encodings():
    assert tables.column_key("ACCELEROMETER X (m/s\xb2)") == tables.column_key("Accelerometer X (m/s2)") == "ACCELEROMETERX|ms"
    assert tables.column_key("ORIENTATION Yaw (\xb0)") != tables.column_key("GYROSCOPE Yaw (rad/s)")


def test_clock_strings(spark):
    df = spark.createDataFrame([("2024-03-01 10:00:01:250",), (" 2024-03-01 00:00:00:5",), ("2024-13-01 10:00:01:250",), ("nonsense",), (None,)], "w string")
    got = [r[0] for r in df.select(geo.time_of_day_s(F.col("w"))).collect()]
    assert got == [36001.25, 0.5, None, None, None]


def test_manifest_and_digests(spark, tmp_path):
    f = tmp_path / "S.csv"
    f.write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "m.csv").write_text(f"drive_id,driver,group,s_path,v_path,s_bytes,v_bytes,s_sha256,v_sha256\nX1,A,g,{f},{f},3,4,{good},{good}\n")
    m = tables.manifest(spark, str(tmp_path / "m.csv"))
    assert m.first()["s_bytes"] == 3
    files = m.selectExpr("s_path as path", "s_bytes as bytes", "s_sha256 as sha256")
    assert [r["ok"] for r in tables.verified(spark, files).collect()] == [True]


OVERPASS = {
    "elements": [
        {"type": "node", "id": 1, "lat": 51.0, "lon": 7.0}, {"type": "node", "id": 2, "lat": 51.001, "lon": 7.0}, {"type": "node", "id": 3, "lat": 51.001, "lon": 7.001}, {"type": "node", "id": 4, "lat": 51.002, "lon": 7.0},
        {"type": "way", "id": 10, "nodes": [1, 2, 99, 3], "tags": {"highway": "residential", "oneway": "yes"}}, {"type": "way", "id": 11, "nodes": [2, 4], "tags": {"highway": "footway"}}, {"type": "way", "id": 12, "nodes": [2, 4], "tags": {"highway": "primary"}},
    ]
}
XML = """<osm><node id="1" lat="51.0" lon="7.0"/><node id="2" lat="51.001" lon="7.0"/><node id="3" lat="51.001" lon="7.001"/><node id="4" lat="51.002" lon="7.0"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="99"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="oneway" v="yes"/></way>
<way id="11"><nd ref="2"/><nd ref="4"/><tag k="highway" v="footway"/></way><way id="12"><nd ref="2"/><nd ref="4"/><tag k="highway" v="primary"/></way></osm>"""
GEOJSON = {
    "features": [
        {"geometry": {"type": "MultiLineString", "coordinates": [[[7.0, 51.0], [7.0, 51.001], [7.001, 51.001]], [[7.0, 51.001], [7.0, 51.002]]]}, "properties": {"oneway": "no"}},
        {"geometry": {"type": "Point", "coordinates": [7.0, 51.0]}, "properties": {}},
    ]
}


def test_road_files_agree(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(OVERPASS))
    (tmp_path / "a.osm").write_text(XML)
    (tmp_path / "a.geojson").write_text(json.dumps(GEOJSON))
    found = {}
    for name in ("a.json", "a.osm", "a.geojson"):
        s = road_ops.geometry(roads.segments(roads.read(spark, str(tmp_path / name)), 51.0, 7.0))
        found[name] = sorted((round(r["x0"]), round(r["y0"]), round(r["x1"]), round(r["y1"])) for r in s.collect())
        adjacent = road_ops.adjacency_by_node(s)
        assert s.count() == 3 and adjacent.count() == 9
    assert found["a.json"] == found["a.osm"] == found["a.geojson"] == [(0, 0, 0, 111), (0, 111, 0, 223), (0, 111, 70, 111)]
    ways = roads.read(spark, str(tmp_path / "a.json"))
    assert {(r["way"], r["oneway"]) for r in ways.collect()} == {("10", True), ("12", False)}


def test_settings_inherit_and_override(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text("filter: {zupt: false, sigma_acc: 0.5}\n")
    (tmp_path / "own.yaml").write_text("inherit: base.yaml\nfilter: {sigma_acc: 0.7}\n")
    cfg = config.load(str(tmp_path / "own.yaml"), ["filter.nhc_sigma=0.4", "map.every=3"])
    f = cfg["filter"]
    assert (f["zupt"], f["sigma_acc"], f["nhc_sigma"], cfg["map"]["every"], f["zaru"]) == (False, 0.7, 0.4, 3, True)
    assert config.DEFAULTS["filter"]["sigma_acc"] == 0.16
    with pytest.raises(KeyError):
        config.with_changes(cfg, {"nosuch.key": 1})


def test_guards_work_on_schemas(spark):
    d = synthetic.drives(synthetic.specs(spark, 1, duration_s=10.0))
    with pytest.raises(schema.LeakageError):
        schema.estimator_input(d)
    seen = d.select(*schema.ESTIMATOR)
    assert schema.estimator_input(seen).columns == list(schema.ESTIMATOR)
    assert schema.role_report(spark).where("allowed = 'never'").count() == len(schema.REFERENCE)
    assert schema.tampered(seen, F.col("t") > 5).count() > 0


def test_synthetic_resampling(spark):
    d = synthetic.truth_native(spark, 1, 30.0, 10.0)
    r = synthetic.resampled(d, ["drive_id"], 50.0, ["x", "y", "speed"], 1.0, [(10.0, 15.0)])
    p = r.orderBy("t").toPandas()
    assert len(p) == round(29.9 * 50) and not p[(p.t >= 10) & (p.t < 15)].gnss_healthy.any() and 20 <= p.gnss_healthy.sum() <= 26


def test_python_data_source(spark):
    from driftframe.runtime import ship
    from driftframe.sources import datasource

    ship(spark)
    datasource.register(spark)
    df = spark.read.format("synthetic_drive").option("drives", 2).option("duration_s", 20).load()
    assert df.count() == 400 and df.where("ref_lat is not null").count() == 0 and df.select("drive_id").distinct().count() == 2


def test_sinks_and_command_line(spark, tmp_path, capsys):
    from driftframe.__main__ import main
    from driftframe.sources import sinks

    df = spark.createDataFrame([(1, 2.345)], "a int, b double")
    for kind in ("parquet", "csv", "json"):
        sinks.save(df, str(tmp_path / kind), kind)
    sinks.save(df, str(tmp_path / "r.md"), "md")
    assert "| 1 | 2.35 |" in (tmp_path / "r.md").read_text() or "| 1 | 2.34 |" in (tmp_path / "r.md").read_text()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["a"] == "1"
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "x"), "xml")
    main(["list"])
    main(["run", "session_summary", "/root/testdata/sf0.001", "--to", str(tmp_path / "s"), "--as", "json"])
    assert "nav_benchmark" in capsys.readouterr().out and spark.read.json(str(tmp_path / "s")).count() > 0
