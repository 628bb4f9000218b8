"""Keys that no schema lists survive from the transcript file over relabelling to the document."""

import json

from turnlake.operators.bank import apply_mapping
from turnlake.operators.transcript import to_document
from turnlake.sources.readers import read_cost_log, read_transcript


def test_unknown_keys_are_kept(spark, tmp_path):
    doc = {"file": "e1", "segments": [
        {"id": k + 1, "start": k, "end": k + 1, "speaker": "S0", "text": f"t{k}", "metadata": {"original_speaker": "old" if k else None, "mood": {"calm": k}, "tags": ["x", k]}} for k in range(3)
    ] + [{"id": 9, "start": 9, "end": 10, "speaker": "S1", "text": "no metadata"}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    rows = read_transcript(spark, str(tmp_path / "t.json"))
    assert [r.original_speaker for r in rows.orderBy("seg_id").collect()] == [None, "old", "old", None]
    named = apply_mapping(rows, spark.createDataFrame([("S0", "Ann"), ("old", "Ann")], "label string, name string"))
    made = json.loads(to_document(named.drop("words"), part_size=100).first().document)
    assert [s["speaker"] for s in made["segments"]] == ["Ann", "Ann", "Ann", "S1"]
    assert [s.get("metadata", {}).get("mood") for s in made["segments"]] == [{"calm": 0}, {"calm": 1}, {"calm": 2}, None]
    assert made["segments"][1]["metadata"]["tags"] == ["x", 1]


def test_cost_metadata_of_any_shape(spark, tmp_path):
    events = [{"event_id": 1, "cost_usd": 1.0, "metadata": {"a": [1, {"b": 2}]}}, {"event_id": 2, "cost_usd": 2.0, "metadata": "text"}, {"event_id": 3, "cost_usd": 3.0}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, events)))
    got = read_cost_log(spark, str(tmp_path / "c.json")).selectExpr("event_id", "to_json(metadata) as m").collect()
    assert {r.event_id: r.m and json.loads(r.m) for r in got} == {1: {"a": [1, {"b": 2}]}, 2: "text", 3: None}
