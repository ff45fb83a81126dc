"""Readers on good and bad files."""

import json

import pytest

from slickwatch.sources import files


def test_positions_csv(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("MMSI,BaseDateTime,LAT,LON,SOG\n538001234.0,2020-08-10T00:00:00,-20.4,57.7,\nx,,1,2,3\n")
    good, bad = files.read_positions_csv(spark, str(tmp_path / "ok.csv"))
    r = good.collect()
    assert len(r) == 1 and bad.count() == 1
    assert (r[0].mmsi, r[0].sog, r[0].cog, r[0].vessel_name, r[0].vessel_type) == (538001234, 10.0, 0.0, "VESSEL_538001234", "Cargo")
    (tmp_path / "bad.csv").write_text("INVALID_HEADER1,INVALID_HEADER2\n1,2\n")
    with pytest.raises(files.SourceError):
        files.read_positions_csv(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl"])
def test_manifest(spark, tmp_path, kind):
    rows = [{"scene_id": f"S{i}", "vv_path": "a", "vh_path": "b", "mask_path": "c", "scene_category": "Oil"} for i in range(3)]

    def write(rows):
        p = tmp_path / f"m.{kind}"
        if kind == "csv":
            p.write_text("\n".join([",".join(rows[0])] + [",".join(r.values()) for r in rows]))
        elif kind == "json":
            p.write_text(json.dumps(rows))
        else:
            p.write_text("\n".join(map(json.dumps, rows)))
        return str(p)

    assert {r.scene_category for r in files.read_manifest(spark, write(rows)).collect()} == {"oil"}
    with pytest.raises(files.SourceError):
        files.read_manifest(spark, write([*rows, rows[0]]))
    with pytest.raises(files.SourceError):
        files.read_manifest(spark, write([{**rows[0], "scene_category": "ship"}]))


def test_geojson_document(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [{"type": "Feature", "properties": {"name": "isle"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}],
    }
    (tmp_path / "l.geojson").write_text(json.dumps(doc))
    square, hole, other = ([[[x + a, x + b] for a, b in ((0, 0), (s, 0), (s, s), (0, 0))] for x, s in ((0, 9), (2, 1), (20, 4))])
    several = {"type": "MultiPolygon", "coordinates": [[square, hole], [other]]}
    mixed = [{"type": "Feature", "properties": {"name": n}, "geometry": g} for n, g in (("m", several), ("p", {"type": "Point", "coordinates": [1, 2]}))]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, mixed)))
    parts = sorted(files.read_geojson(spark, str(tmp_path / "m.jsonl"), lines=True).collect(), key=lambda r: (r.properties["name"], r.part or 0))
    assert [(r.part, r.ring and len(r.ring), r.holes and len(r.holes[0])) for r in parts] == [(0, 4, 4), (1, 4, []), (None, None, None)]
    df = spark.createDataFrame([parts[0]], files.read_geojson(spark, str(tmp_path / "m.jsonl"), lines=True).schema)
    files.geojson_features(df.drop("part", "geometry_type"), holes="holes").write.text(str(tmp_path / "back"))
    back = files.read_geojson(spark, str(tmp_path / "back"), lines=True).first()
    assert (back.ring, back.holes) == (parts[0].ring, parts[0].holes)
    r = files.read_geojson(spark, str(tmp_path / "l.geojson")).first()
    assert r.properties["name"] == "isle" and len(r.ring) == 4 and r.holes == []
