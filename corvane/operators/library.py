"""Personal libraries: favourites and notes as rows, and their JSON documents.

As rows a library is (`entity_type`, `entity_id`, `favorite`, `place`, `tags`, `note`, `noted`): one row for each entity that is a
favourite or has a note; `place` orders favourites and is NULL for others, `noted` orders notes by entry and is NULL for entities without one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format name that documents are written with; others may be accepted by name when parsing.
FORMAT, VERSION = "local-library", 1
TYPES = ("person", "work")
SCHEMA = "entity_type string, entity_id string, favorite boolean, place int, tags array<string>, note string, noted int"
EMPTY: dict[str, Any] = {"version": VERSION, "favorites": {"people": [], "works": []}, "annotations": {}}


def entity_key(kind: str, entity_id: str) -> str:
    return f"{kind}:{entity_id}"


def _strings(values: Any) -> list[str]:
    """The different strings of a list, in order of first appearance; other values are dropped."""
    return list(dict.fromkeys(v for v in values if isinstance(v, str))) if isinstance(values, list) else []


def normalize_stored(value: Any) -> dict[str, Any]:
    """A stored library with everything that doesn't belong there left out; an unusable one is empty."""
    if not isinstance(value, dict) or value.get("version") != VERSION or not isinstance(value.get("favorites"), dict):
        return json.loads(json.dumps(EMPTY))
    liked, notes = value["favorites"], value.get("annotations")
    kept = {k: {"tags": _strings(a.get("tags")), "note": a["note"] if isinstance(a.get("note"), str) else ""} for k, a in (notes.items() if isinstance(notes, dict) else ()) if isinstance(a, dict)}
    return {"version": VERSION, "favorites": {"people": _strings(liked.get("people")), "works": _strings(liked.get("works"))}, "annotations": kept}


def read_stored(text: str | None) -> dict[str, Any]:
    """A stored document; an absent or corrupt one is an empty library, without error."""
    try:
        return normalize_stored(json.loads(text)) if text else normalize_stored(None)
    except ValueError:
        return normalize_stored(None)


def parse_export(text: str, formats: Sequence[str] = (FORMAT,)) -> dict[str, Any]:
    """An exported document of one of the accepted formats, checked throughout. An error names the first bad item, counted from 1."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ValueError("not a JSON document") from e
    if not isinstance(doc, dict) or doc.get("format") not in formats or doc.get("version") != VERSION or not isinstance(doc.get("items"), list):
        raise ValueError("unsupported library format")
    items = []
    for n, item in enumerate(doc["items"], 1):
        good = isinstance(item, dict) and item.get("entityType") in TYPES and isinstance(item.get("entityId"), str) and item["entityId"] and isinstance(item.get("favorite"), bool)
        good = good and isinstance(item.get("tags"), list) and all(isinstance(t, str) for t in item["tags"]) and isinstance(item.get("note"), str)
        if not good:
            raise ValueError(f"item {n} is not valid")
        items.append({**{k: item[k] for k in ("entityType", "entityId", "favorite", "note")}, "tags": _strings(item["tags"])})
    return {"format": doc["format"], "version": VERSION, "exportedAt": doc["exportedAt"] if isinstance(doc.get("exportedAt"), str) else "", "items": items}


def library_rows(spark: SparkSession, library: dict[str, Any]) -> DataFrame:
    """A stored library as rows."""
    return spark.createDataFrame([tuple(r) for r in _document_rows(library)], SCHEMA)


def _document_rows(library: dict[str, Any]) -> list[list[Any]]:
    """A stored library as rows: people's and works' favourites as listed, then entities that only have a note."""
    rows: dict[tuple[str, str], list[Any]] = {}
    for kind, part in (("person", "people"), ("work", "works")):
        for place, i in enumerate(library["favorites"][part]):
            rows[kind, i] = [kind, i, True, place, [], "", None]
    for n, (key, a) in enumerate(library["annotations"].items()):
        kind, _, i = key.partition(":")
        if kind in TYPES and i:
            row = rows.setdefault((kind, i), [kind, i, False, None, [], "", None])
            row[4:] = a["tags"], a["note"], n
    return list(rows.values())


def stored_rows(documents: DataFrame, owner: str, text: str) -> DataFrame:
    """The rows of many stored libraries, each document read leniently, with the `owner` of each."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["owner", "entity_type", "entity_id", "favorite", "place", "tags", "note", "noted"]
        for b in batches:
            rows = [(o, *r) for o, t in zip(b["owner"], b["text"], strict=True) for r in _document_rows(read_stored(t))]
            yield pd.DataFrame(rows, columns=columns).astype({"place": "Int32", "noted": "Int32"})

    return documents.select(F.col(owner).cast("string").alias("owner"), F.col(text).alias("text")).mapInPandas(read, f"owner string, {SCHEMA}")


def export_rows(spark: SparkSession, export: dict[str, Any]) -> DataFrame:
    """The items of an exported document with their place in it."""
    return spark.createDataFrame([(i["entityType"], i["entityId"], i["favorite"], n, i["tags"], i["note"], n) for n, i in enumerate(export["items"])], SCHEMA)


def read_exports(spark: SparkSession, path: str, formats: Sequence[str] = (FORMAT,)) -> DataFrame:
    """The items of all exported documents under a path, with their `file`; every document is checked as a whole."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, i["entityType"], i["entityId"], i["favorite"], n, i["tags"], i["note"], n) for f, t in zip(b["file"], b["value"], strict=True) for n, i in enumerate(parse_export(t, formats)["items"])]
            yield pd.DataFrame(rows, columns=["file", "entity_type", "entity_id", "favorite", "place", "tags", "note", "noted"])

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return texts.mapInPandas(parse, f"file string, {SCHEMA}")


def join_favorites_and_notes(favorites: DataFrame, notes: DataFrame) -> DataFrame:
    """Library rows of favourites (`entity_type`, `entity_id`, `place`) and notes (`entity_type`, `entity_id`, `tags`, `note`, `noted`): one for each entity in either."""
    liked = favorites.withColumn("_liked", F.lit(True))
    both = liked.join(notes, ["entity_type", "entity_id"], "full_outer")
    return both.select("entity_type", "entity_id", F.col("_liked").isNotNull().alias("favorite"), "place", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("note", F.lit("")).alias("note"), "noted")


def last_of_each(items: DataFrame) -> DataFrame:
    """Of repeated items of one entity the last."""
    columns = [c for c in items.columns if c not in ("entity_type", "entity_id")]
    return items.groupBy("entity_type", "entity_id").agg(F.max_by(F.struct(*columns), "place").alias("_i")).select("entity_type", "entity_id", "_i.*")


def merge(current: DataFrame, imported: DataFrame) -> DataFrame:
    """`current` with the imported items: an item replaces the entity's row, entities not imported stay as they are.

    Imported favourites go after all current ones, in the order of their last item; an imported item that isn't a
    favourite removes the entity from them. Places are numbers in order, not without gaps.
    """
    new = last_of_each(imported)
    key = ["entity_type", "entity_id"]
    after = current.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_last"), F.coalesce(F.max("noted"), F.lit(-1)).alias("_noted"))
    before = current.select(*key, F.col("noted").alias("_old"))
    placed = new.join(before, key, "left").crossJoin(F.broadcast(after)).select(*key, "favorite", F.when(F.col("favorite"), F.col("place") + F.col("_last") + 1).cast("int").alias("place"), "tags", "note", F.coalesce("_old", F.col("noted") + F.col("_noted") + 1).cast("int").alias("noted"))
    return current.join(new.select(*key), key, "left_anti").unionByName(placed)


def annotate(current: DataFrame, notes: DataFrame) -> DataFrame:
    """`current` with the tags and note of each entity in `notes` (`entity_type`, `entity_id`, `tags`, `note`, `noted`) replaced as a whole, or added.

    A note that replaces one keeps its order of entry. Repeated entities: the note entered last holds.
    """
    key = ["entity_type", "entity_id"]
    new = notes.groupBy(*key).agg(F.max_by(F.struct("tags", "note", "noted"), "noted").alias("_n"))
    last = current.agg(F.coalesce(F.max("noted"), F.lit(-1)).alias("_noted"))
    both = current.join(new, key, "full_outer").crossJoin(F.broadcast(last))
    fresh = F.col("_n").isNotNull()
    return both.select(*key, F.coalesce("favorite", F.lit(False)).alias("favorite"), "place", F.when(fresh, F.col("_n.tags")).otherwise(F.col("tags")).alias("tags"), F.when(fresh, F.col("_n.note")).otherwise(F.col("note")).alias("note"), F.coalesce("noted", F.col("_n.noted") + F.col("_noted") + 1).cast("int").alias("noted"))


def with_notes(entities: DataFrame, library: DataFrame, kind: str) -> DataFrame:
    """Entities (`id`, ...) of one kind with their `tags_noted` and `note`: none and empty where the library has nothing on them."""
    mine = library.where(F.col("entity_type") == kind).select(F.col("entity_id").alias("id"), F.col("tags").alias("tags_noted"), "note")
    none = F.array().cast("array<string>")
    return entities.join(mine, "id", "left").withColumn("tags_noted", F.coalesce("tags_noted", none)).withColumn("note", F.coalesce("note", F.lit("")))


def preview(items: DataFrame, known: DataFrame) -> DataFrame:
    """One row: how many items the catalog knows and how many it lacks. known: (`entity_type`, `entity_id`)."""
    marked = items.join(known.distinct().withColumn("_known", F.lit(True)), ["entity_type", "entity_id"], "left")
    return marked.agg(F.count_if(F.col("_known").isNotNull()).alias("known"), F.count_if(F.col("_known").isNull()).alias("missing"))


def toggle(favorites: DataFrame, toggled: DataFrame) -> DataFrame:
    """Favourites (`entity_type`, `entity_id`, `place`) after each toggled entity was removed if present, else appended."""
    key = ["entity_type", "entity_id"]
    last = favorites.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_last"))
    added = toggled.join(favorites.select(*key), key, "left_anti").crossJoin(F.broadcast(last)).select(*key, (F.col("_last") + 1 + F.col("place")).cast("int").alias("place"))
    return favorites.join(toggled.select(*key), key, "left_anti").unionByName(added)


def export_order(rows: DataFrame) -> list[Column]:
    """The order of exported items: entities with a note as entered, then people's favourites, then works' favourites."""
    return [F.col("noted").isNull(), F.col("noted"), F.col("entity_type"), F.col("place"), F.col("entity_id")]


def export_document(rows: DataFrame, exported_at: str) -> str:
    """The exported document of one library, which is one person's and therefore small."""
    ordered = rows.orderBy(*export_order(rows)).collect()
    items = [{"entityType": r["entity_type"], "entityId": r["entity_id"], "favorite": r["favorite"], "tags": list(r["tags"]), "note": r["note"]} for r in ordered]
    return json.dumps({"format": FORMAT, "version": VERSION, "exportedAt": exported_at, "items": items}, ensure_ascii=False, indent=2)


def stored_document(rows: DataFrame) -> dict[str, Any]:
    """The stored form of one library's rows."""
    listed = rows.orderBy(*export_order(rows)).collect()
    liked = {kind: [r["entity_id"] for r in sorted((r for r in listed if r["favorite"] and r["entity_type"] == kind), key=lambda r: r["place"])] for kind in TYPES}
    notes = {entity_key(r["entity_type"], r["entity_id"]): {"tags": list(r["tags"]), "note": r["note"]} for r in listed if r["noted"] is not None}
    return {"version": VERSION, "favorites": {"people": liked["person"], "works": liked["work"]}, "annotations": notes}


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """Writes one document as the whole content of a file, replacing it: through a file beside it, so that readers never see half of it."""
    jvm = spark._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(staged, target):
        raise OSError(f"the document stays at {staged}, as it couldn't be moved to {target}")


def write_export(spark: SparkSession, rows: DataFrame, exported_at: str, path: str) -> None:
    """The exported document of a library as a file."""
    write_document(spark, export_document(rows, exported_at), path)


def write_stored(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """The stored form of a library as a file."""
    write_document(spark, json.dumps(stored_document(rows), ensure_ascii=False), path)
