"""One log of review commands, replayed in order: every event keeps whole images from before and after, and an undo puts the former back.

Commands on an entity need only that entity and those it is merged with or split from, so they are folded by connected component of these.
Commands on a relation need its own past, the merges of its ends, and whether both ends were accepted at that moment. The last is looked up in the
entities' history; the rest is folded by family: relations whose ends' components and kind are the same, since only these can run into one another.
Both folds read rows sorted by group and sequence and hold one group's records and the images of events that are undone later, not its log.

``commands``: seq (unique), kind (entity or relation), action, id, text, other, moved, valid_from, valid_to, undone_seq.

* accept, reject, reopen: of an entity or relation. A relation is accepted only with evidence and with two accepted, unmerged ends.
* rename (text), pin, unpin: the old name becomes an alias.
* merge (other goes into id): names become aliases, evidence is united; relations of other move, equal ones are reconciled, loops go.
* split (text and other: the new entity's name and id; moved: some, not all, of the evidence).
* validity (valid_from, valid_to): dates in order, or null.
* undo (undone_seq): neither an undo, nor a refused event, nor one undone before. Images are put back whole, whatever came later.

Relations are named ``source::relation::target``. A command that can't be applied is in the log with a reason and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .components import connected_components
from .review import MERGED, valid_period

Record = dict
EVENT = "grp string, seq long, kind string, id string, action string, before string, after string, reason string, changed array<string>, usable array<boolean>, target_action string, undone_seq long, final string"
_COLUMNS = ["grp", "seq", "kind", "id", "action", "before", "after", "reason", "changed", "usable", "target_action", "undone_seq", "final"]
_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.list_(pa.string()), pa.list_(pa.bool_()), pa.string(), pa.int64(), pa.string()]
STATUS = {"accept": "accepted", "reject": "rejected", "reopen": "pending"}
SEPARATOR = "::"
HELD = 2000  # events before they are passed on


class Refused(Exception):
    pass


def _union(*lists: list | None) -> list:
    return list(dict.fromkeys(x for values in lists for x in values or []))


def usable(record: Record | None) -> bool:
    return record is not None and record.get("status") == "accepted" and record.get("merged_into") is None


def _known(records: dict[str, Record], key: str | None) -> Record:
    if key not in records:
        raise Refused("unknown")
    return records[key]


def entity_change(records: dict[str, Record], c: Record) -> tuple[list[Record], list[Record]]:
    """The records that a command reads and those that it makes of them."""
    action, old = c["action"], _known(records, c["id"])
    if action in STATUS:
        return [old], [old | {"status": STATUS[action]}]
    if action in ("pin", "unpin"):
        return [old], [old | {"pinned": action == "pin"}]
    name = (c["text"] or "").strip()
    if action == "rename":
        if not name:
            raise Refused("empty name")
        return [old], [old | {"name": name, "aliases": _union(old.get("aliases"), [old["name"]])}]
    if action == "merge":
        if c["id"] == c["other"]:
            raise Refused("merged into itself")
        gone = _known(records, c["other"])
        kept = old | {"aliases": _union(old.get("aliases"), [gone["name"]], gone.get("aliases")), "evidence": _union(old.get("evidence"), gone.get("evidence"))}
        if "confidence" in old and "confidence" in gone:
            kept["confidence"] = max(old["confidence"], gone["confidence"])
        return [old, gone], [kept, gone | {"merged_into": old["id"], "status": "rejected"}]
    if action == "split":
        chosen = [x for x in _union(c["moved"]) if x in (old.get("evidence") or [])]
        if not name or not 0 < len(chosen) < len(old["evidence"]) or not c["other"] or c["other"] in records:
            raise Refused("a split takes a name, an id of its own and some, not all, of the evidence")
        made = old | {"id": c["other"], "name": name, "aliases": [], "evidence": chosen, "status": "pending", "pinned": False, "merged_into": None}
        return [old], [old | {"evidence": [x for x in old["evidence"] if x not in chosen]}, made]
    raise Refused("no such action")


def reconciled(a: Record, b: Record) -> Record:
    """Two relations that have become one."""
    same = lambda c: a.get(c) if a.get(c) == b.get(c) else None
    out = a | {"evidence": _union(a.get("evidence"), b.get("evidence")), "status": same("status") or "pending", "valid_from": same("valid_from"), "valid_to": same("valid_to")}
    if "confidence" in a and "confidence" in b:
        out["confidence"] = max(a["confidence"], b["confidence"])
    if "observed_at" in a:
        out["observed_at"] = min(filter(None, [a.get("observed_at"), b.get("observed_at")]), default=None)
    if a.get("extractor") != b.get("extractor"):
        out["extractor"] = MERGED
    return out


def relation_change(records: dict[str, Record], c: Record) -> tuple[list[Record], list[Record]]:
    action = c["action"]
    if action == "merge":
        moved = [records[k] for k in sorted(records) if c["other"] in (records[k]["source"], records[k]["target"])]
        rest = {k: r for k, r in records.items() if c["other"] not in (r["source"], r["target"])}
        made: dict[str, Record] = {}
        for r in moved:
            ends = {side: c["id"] if r[side] == c["other"] else r[side] for side in ("source", "target")}
            if ends["source"] == ends["target"]:
                continue
            new = r | ends | {"id": SEPARATOR.join([ends["source"], r["relation"], ends["target"]])}
            met = made.get(new["id"]) or rest.get(new["id"])
            made[new["id"]] = reconciled(met, new) if met else new
        return moved + [rest[k] for k in made if k in rest], list(made.values())
    old = _known(records, c["id"])
    if action in STATUS:
        if action == "accept" and not old.get("evidence"):
            raise Refused("no evidence")
        if action == "accept" and not c["fine"]:
            raise Refused("an end isn't accepted")
        return [old], [old | {"status": STATUS[action]}]
    if action == "validity":
        if not c["fine"]:
            raise Refused("no dates in order")
        clean = lambda v: (v or "").strip() or None
        return [old], [old | {"valid_from": clean(c["valid_from"]), "valid_to": clean(c["valid_to"])}]
    raise Refused("no such action")


def replace(records: dict[str, Record], old: list[Record], new: list[Record]) -> None:
    """Records as they are once old ones have become new ones."""
    for r in old:
        records.pop(r["id"], None)
    records.update({r["id"]: r for r in new})


def _fold(change: Callable, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Events of rows sorted by group, records first, then commands by seq; and each group's last records (final)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, records, images, out = None, {}, {}, []

        def event(c: Record, before: list, after: list, reason: str | None) -> None:
            touched = {r["id"]: None for r in before} | {r["id"]: r for r in after}
            out.append((c["grp"], c["seq"], kind, c["id"], c["action"], json.dumps(before), json.dumps(after), reason, list(touched), [usable(r) for r in touched.values()], c["target_action"], c["undone_seq"], None))

        def last() -> None:
            out.extend((group, None, kind, k, None, None, None, None, None, None, None, None, json.dumps(r)) for k, r in records.items())

        def passed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(_COLUMNS)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], names=_COLUMNS)

        for batch in batches:
            for c in batch.to_pylist():
                if c["grp"] != group:
                    last()
                    group, records, images = c["grp"], {}, {}
                if c["record"] is not None:
                    r = json.loads(c["record"])
                    records[r["id"]] = r
                    continue
                try:
                    if c["action"] == "undo":
                        if c["undone_seq"] not in images:
                            raise Refused("not in the log")
                        if images[c["undone_seq"]] is None:
                            raise Refused("undone before")
                        after, before = images[c["undone_seq"]]
                        images[c["undone_seq"]] = None
                    else:
                        before, after = change(records, c)
                        if c["kept"]:
                            images[c["seq"]] = (before, after)
                    replace(records, before, after)
                    event(c, before, after, None)
                except Refused as e:
                    event(c, [], [], str(e))
                if len(out) > HELD:
                    yield passed()
        if group is not None:
            last()
        yield passed()

    return run


def _folded(records: DataFrame, commands: DataFrame, change: Callable, kind: str, name: str) -> DataFrame:
    """records(grp, record), commands(grp, seq, ...)."""
    rows = commands.withColumns({"ord": F.lit(1), "record": F.lit(None).cast("string")}).unionByName(records.select("grp", "record", F.lit(0).alias("ord")), allowMissingColumns=True)
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "ord", "seq")
    return materialize(dealt.mapInArrow(_fold(change, kind), EVENT), name)


def replay(entities: DataFrame, relations: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and the log (seq, kind, id, action, before, after, reason; images are JSON lists) after all commands, in order of seq.

    Entities need id, name, status, merged_into, aliases, evidence, pinned; relations id, source, relation, target, status, evidence, valid_from, valid_to; other columns go along.
    A merge is logged once for the entities and once for each family of relations that it changed. Empty tables and an empty log are fine; ids must not be null.
    """
    commands = materialize(commands, "commands")
    done = commands.select(F.col("seq").alias("undone_seq"), F.col("kind").alias("_kind"), F.col("id").alias("_id"), F.col("action").alias("target_action"), F.lit(True).alias("_there"))
    wanted = commands.select("undone_seq").where("undone_seq IS NOT NULL").distinct().select(F.col("undone_seq").alias("seq"), F.lit(True).alias("kept"))
    known = commands.join(done, "undone_seq", "left").join(wanted, "seq", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    undo = F.col("action") == "undo"
    known = known.withColumns({"kind": F.when(undo, F.col("_kind")).otherwise(F.col("kind")), "id": F.when(undo, F.col("_id")).otherwise(F.col("id"))})
    lost = undo & (F.col("_there").isNull() | (F.col("target_action") == "undo"))
    known = materialize(known.withColumn("lost", F.coalesce(lost, F.lit(False))).drop("_kind", "_id", "_there"), "known")
    never = known.where("lost").select("seq", "kind", "id", "action", F.lit("[]").alias("before"), F.lit("[]").alias("after"), F.when(F.col("target_action") == "undo", "an undo").otherwise("not in the log").alias("reason"))
    known = known.where("NOT lost")

    # entities, by component of merges and splits
    own = known.where("kind = 'entity'")
    edges = own.where("action IN ('merge', 'split') AND other IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    component = materialize(connected_components(edges).select("vertex", "component"), "components")
    grouped = lambda df, c: df.join(component.withColumnRenamed("vertex", c), c, "left").withColumn("grp", F.coalesce("component", c)).drop("component")
    own = grouped(own, "id")
    touched = own.select("grp").distinct()
    record = lambda df: df.withColumn("record", F.to_json(F.struct(*df.columns)))
    members = grouped(record(entities), "id").join(touched, "grp", "left_semi")
    events = _folded(members.select("grp", "record"), own.withColumn("fine", F.lit(True)), entity_change, "entity", "entity-events")
    finals = lambda df, like: df.where("final IS NOT NULL").select(F.from_json("final", like.schema).alias("r")).select("r.*")
    out_entities = grouped(entities, "id").join(touched, "grp", "left_anti").select(entities.columns).unionByName(finals(events, entities))

    # whether a relation's ends were accepted at the moment of a command: the last change before it
    judged = known.where("kind = 'relation'").withColumn("fine", F.when(F.col("action") == "validity", valid_period(F.trim("valid_from"), F.trim("valid_to"))))
    ends = F.split("id", SEPARATOR)
    asked = judged.where("action = 'accept' AND id IS NOT NULL").select("seq", F.explode(F.array_distinct(F.array(ends[0], F.element_at(ends, -1)))).alias("end"))
    now = entities.join(asked.select(F.col("end").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("end"), F.lit(None).cast("long").alias("seq"), F.coalesce((F.col("status") == "accepted") & F.col("merged_into").isNull(), F.lit(False)).alias("ok"))
    later = events.where("changed IS NOT NULL AND reason IS NULL").select("seq", F.explode(F.arrays_zip("changed", "usable")).alias("c")).select(F.col("c.changed").alias("end"), "seq", F.col("c.usable").alias("ok"))
    later = later.join(asked.select("end").distinct(), "end", "left_semi")
    history = now.unionByName(later).withColumn("asked", F.lit(False)).unionByName(asked.select("end", "seq", F.lit(None).cast("boolean").alias("ok"), F.lit(True).alias("asked")))
    past = Window.partitionBy("end").orderBy(F.asc_nulls_first("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = history.withColumn("ok", F.last("ok", ignorenulls=True).over(past)).where("asked").groupBy("seq").agg(F.min(F.coalesce("ok", F.lit(False))).alias("_ok"))
    judged = judged.join(held, "seq", "left").withColumn("fine", F.coalesce("_ok", "fine", F.lit(False))).drop("_ok")

    # relations, by family
    def familied(df: DataFrame, source: F.Column, kind: F.Column, target: F.Column) -> DataFrame:
        df = df.withColumns({"_s": source, "_k": kind, "_t": target})
        for side in ("_s", "_t"):
            df = df.join(component.withColumnRenamed("vertex", side), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
        return df.withColumn("grp", F.concat_ws("\u0000", "_s", "_k", "_t"))

    parts = F.split("id", SEPARATOR)
    judged = familied(judged, parts[0], F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), SEPARATOR), F.element_at(parts, -1))
    filed = familied(record(relations), F.col("source"), F.col("relation"), F.col("target"))
    families = filed.select("grp", "_s", "_t").unionByName(judged.select("grp", "_s", "_t")).distinct()
    sides = families.select("grp", F.explode(F.array_distinct(F.array("_s", "_t"))).alias("component"))
    merges = events.where("reason IS NULL AND (action = 'merge' OR target_action = 'merge')").select(F.col("grp").alias("component"), "seq", "undone_seq", "target_action", "action")
    merges = merges.join(known.select("seq", "id", "other", "kept"), "seq").join(sides, "component").drop("component").withColumn("fine", F.lit(True))
    every = judged.select("grp", "seq", "action", "id", "other", "valid_from", "valid_to", "undone_seq", "target_action", "kept", "fine").unionByName(merges, allowMissingColumns=True)
    changed = every.select("grp").distinct()
    moved = _folded(filed.join(changed, "grp", "left_semi").select("grp", "record"), every, relation_change, "relation", "relation-events")
    out_relations = filed.join(changed, "grp", "left_anti").select(relations.columns).unionByName(finals(moved, relations))

    columns = ["seq", "kind", "id", "action", "before", "after", "reason"]
    some = F.col("reason").isNotNull() | (F.col("before") != "[]") | (F.col("after") != "[]")
    log = events.where("seq IS NOT NULL").select(columns).unionByName(moved.where(F.col("seq").isNotNull() & some).where("reason IS NULL OR (action <> 'merge' AND coalesce(target_action, '') <> 'merge')").select(columns)).unionByName(never)
    return out_entities, out_relations, log
