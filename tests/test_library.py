import json

import pytest

from corvane.operators import library as lib
from tests.conftest import rows

EXPORT = {"format": lib.FORMAT, "version": 1, "exportedAt": "2024-01-01T00:00:00Z", "items": [{"entityType": "person", "entityId": "a", "favorite": True, "tags": ["x", "x", "y"], "note": "n"}]}


def test_stored_documents():
    assert lib.read_stored(None) == lib.read_stored("{oops") == lib.read_stored('{"version": 2}') == lib.EMPTY
    old = lib.read_stored(json.dumps({"version": 1, "favorites": {"people": ["a", 3, "a"], "works": []}}))
    assert old == {"version": 1, "favorites": {"people": ["a"], "works": []}, "annotations": {}}
    odd = lib.normalize_stored({"version": 1, "favorites": {"people": None}, "annotations": {"person:a": {"tags": ["t", 1, "t"], "note": 5}, "x": 3}})
    assert odd["annotations"] == {"person:a": {"tags": ["t"], "note": ""}}


def test_parsing():
    assert lib.parse_export(json.dumps(EXPORT))["items"][0]["tags"] == ["x", "y"]
    assert lib.parse_export(json.dumps(EXPORT | {"exportedAt": 5}))["exportedAt"] == ""
    for bad in ("nothing", "[]", json.dumps(EXPORT | {"format": "other"}), json.dumps(EXPORT | {"items": {}})):
        with pytest.raises(ValueError):
            lib.parse_export(bad)
    assert lib.parse_export(json.dumps(EXPORT | {"format": "older"}), ("older", lib.FORMAT))["format"] == "older"
    broken = EXPORT | {"items": [*EXPORT["items"], {"entityType": "tag", "entityId": "a", "favorite": True, "tags": [], "note": ""}]}
    with pytest.raises(ValueError, match="item 2"):
        lib.parse_export(json.dumps(broken))


def test_merge(spark):
    current = lib.library_rows(spark, {"favorites": {"people": ["a", "b"], "works": ["w"]}, "annotations": {"person:b": {"tags": ["old"], "note": ""}, "work:w:1": {"tags": [], "note": "k"}, "other:z": {"tags": [], "note": ""}}})
    assert rows(current.select("entity_type", "entity_id", "favorite")) == [("person", "a", True), ("person", "b", True), ("work", "w", True), ("work", "w:1", False)]
    items = [{"entityType": "person", "entityId": i, "favorite": f, "tags": [t], "note": ""} for i, f, t in (("a", True, "1"), ("b", False, "2"), ("a", True, "3"), ("c", True, "4"))]
    merged = lib.merge(current, lib.export_rows(spark, {"items": items}))
    liked = [r["entity_id"] for r in merged.where("favorite and entity_type = 'person'").orderBy("place").collect()]
    assert liked == ["a", "c"]
    assert rows(merged.where("entity_type = 'person'").select("entity_id", "tags")) == [("a", ["3"]), ("b", ["2"]), ("c", ["4"])]
    assert merged.where("entity_type = 'work'").count() == 2
    again = lib.merge(merged, lib.export_rows(spark, {"items": items}))
    assert [r["entity_id"] for r in again.where("favorite and entity_type = 'person'").orderBy("place").collect()] == liked


def test_round_trip(spark, tmp_path):
    document = lib.export_document(lib.export_rows(spark, EXPORT), "now")
    assert lib.parse_export(document)["items"] == lib.parse_export(json.dumps(EXPORT))["items"]
    (tmp_path / "x.json").write_text(document)
    assert lib.read_exports(spark, str(tmp_path)).count() == 1


def test_exports_list_notes_first(spark, tmp_path):
    stored = {"version": 1, "favorites": {"people": ["b", "a"], "works": ["w"]}, "annotations": {"work:z": {"tags": ["t"], "note": "1"}, "person:a": {"tags": [], "note": "2"}}}
    library = lib.library_rows(spark, stored)
    path = str(tmp_path / "library.json")
    for _ in range(2):  # the second replaces the first
        lib.write_export(spark, library, "now", path)
    listed = [(i["entityType"], i["entityId"]) for i in lib.parse_export((tmp_path / "library.json").read_text())["items"]]
    assert listed == [("work", "z"), ("person", "a"), ("person", "b"), ("work", "w")]
    lib.write_stored(spark, library, path)
    assert lib.read_stored((tmp_path / "library.json").read_text()) == stored


def test_notes(spark):
    library = lib.library_rows(spark, {"favorites": {"people": ["a"], "works": []}, "annotations": {"person:a": {"tags": ["old"], "note": "o"}}})
    notes = spark.createDataFrame([("person", "a", ["n"], "1", 0), ("person", "c", ["m"], "2", 1), ("person", "c", ["k"], "3", 2)], "entity_type string, entity_id string, tags array<string>, note string, noted int")
    after = lib.annotate(library, notes)
    assert rows(after.select("entity_id", "favorite", "tags", "note", "noted")) == [("a", True, ["n"], "1", 0), ("c", False, ["k"], "3", 3)]
    people = spark.createDataFrame([("a",), ("x",)], "id string")
    assert rows(lib.with_notes(people, after, "person")) == [("a", ["n"], "1"), ("x", [], "")]
    documents = spark.createDataFrame([("o", '{"version": 1, "favorites": {"people": ["a"], "works": []}}'), ("p", "{oops"), ("q", None)], "owner string, text string")
    assert rows(lib.stored_rows(documents, "owner", "text")) == [("o", "person", "a", True, 0, [], "", None)]


def test_preview_and_toggle(spark):
    items = lib.export_rows(spark, {"items": [*EXPORT["items"], {"entityType": "work", "entityId": "q", "favorite": False, "tags": [], "note": ""}]})
    known = spark.createDataFrame([("person", "a"), ("person", "a")], "entity_type string, entity_id string")
    assert rows(lib.preview(items, known)) == [(1, 1)]
    favorites = spark.createDataFrame([("person", "a", 0), ("person", "b", 1)], "entity_type string, entity_id string, place int")
    toggled = spark.createDataFrame([("person", "a", 0), ("person", "c", 0)], "entity_type string, entity_id string, place int")
    assert rows(lib.toggle(favorites, toggled)) == [("person", "b", 1), ("person", "c", 2)]
    assert lib.entity_key("person", "a:b") == "person:a:b"


def test_empty_library(spark):
    empty = lib.library_rows(spark, lib.EMPTY)
    assert empty.count() == 0
    assert lib.merge(empty, lib.export_rows(spark, EXPORT)).count() == 1
