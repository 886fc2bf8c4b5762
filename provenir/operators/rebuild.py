"""Candidates kept up to date: after an edit only changed blocks are read again, and only what rests on them is counted anew.

A state has five tables: blocks (block_id, pos, hash), mentions, entities, evidence (of relations, a row for each block) and relations, as in ``extraction``.
Where only entities are asked for, a state has the first three. ``increment`` gives just the state that ``full`` gives for the new blocks. What it reads again is the changed blocks, and the blocks that mention an entity whose
name or id changed with them, since relations are found by the names' places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt, materialize
from . import extraction as E
from . import review as RV

State = dict[str, DataFrame]
KEY = ["type", "normalized"]


def hashed(blocks: DataFrame) -> DataFrame:
    """block_id, pos, hash of blocks(block_id, pos, text); a null text is as an empty one."""
    return blocks.select("block_id", "pos", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def full(blocks: DataFrame, relations: bool = True) -> State:
    """The state of blocks(block_id, pos, text), without ``relations`` that of its entities alone."""
    mentions = materialize(E.mentions(blocks), "mentions")
    entities = materialize(E.entity_candidates(mentions), "entities")
    state = {"blocks": materialize(hashed(blocks), "blocks"), "mentions": mentions, "entities": entities}
    if not relations:
        return state
    evidence = materialize(E.relation_evidence(blocks.select("block_id", "text"), mentions, entities), "evidence")
    return state | {"evidence": evidence, "relations": materialize(E.relation_candidates(evidence), "relations")}


def changes(old: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_id, pos, action for each block of old(block_id, pos, hash) and blocks: extract (new or another text), move (another place), remove, keep."""
    was = old.select("block_id", F.col("pos").alias("_pos"), F.col("hash").alias("_hash"))
    both = dealt(hashed(blocks), old.count(), "block_id").join(was, "block_id", "full")
    action = F.when(F.col("hash").isNull(), "remove").when(~F.col("hash").eqNullSafe(F.col("_hash")), "extract").when(~F.col("pos").eqNullSafe(F.col("_pos")), "move").otherwise("keep")
    return both.select("block_id", "pos", action.alias("action"))


def increment(old: State, blocks: DataFrame) -> tuple[State, DataFrame]:
    """The state of the new blocks, from the old state; and the blocks that were read again (block_id, again: extract or relate). Of an old state without relations, only the entities' state and the blocks that were extracted."""
    plan = materialize(changes(old["blocks"], blocks).where("action <> 'keep'"), "changes")
    read = plan.where("action = 'extract'").select("block_id")
    gone = plan.where("action IN ('extract', 'remove')").select("block_id")
    moved = plan.where("action = 'move'").select("block_id", F.col("pos").alias("_pos"))

    n = {k: old[k].count() for k in ("mentions", "evidence", "relations") if k in old}  # of written tables
    by_block = {k: dealt(old[k], n[k], "block_id") for k in ("mentions", "evidence") if k in old}
    fresh = materialize(E.mentions(blocks.join(read, "block_id", "left_semi")), "fresh")
    kept = by_block["mentions"].join(gone, "block_id", "left_anti").join(moved, "block_id", "left")
    first = F.when(F.col("_pos").isNotNull(), F.col("first").withField("pos", F.col("_pos"))).otherwise(F.col("first"))
    mentions = materialize(kept.withColumn("first", first).select(fresh.columns).unionByName(fresh), "mentions")

    touched = by_block["mentions"].join(plan.select("block_id"), "block_id", "left_semi").select(KEY).unionByName(fresh.select(KEY)).distinct()
    touched = materialize(touched, "touched")
    counted = materialize(E.entity_candidates(dealt(mentions, n["mentions"], *KEY).join(touched, KEY, "left_semi")), "counted")
    entities = materialize(old["entities"].join(touched, KEY, "left_anti").unionByName(counted), "entities")
    state = {"blocks": materialize(hashed(blocks), "blocks"), "mentions": mentions, "entities": entities}
    if "relations" not in old:
        return state, read.withColumn("again", F.lit("extract"))
    before = old["entities"].join(touched, KEY, "left_semi").select(*KEY, F.col("id").alias("_id"), F.col("name").alias("_name"))
    other = counted.join(before, KEY, "full").where(~(F.col("id").eqNullSafe(F.col("_id")) & F.col("name").eqNullSafe(F.col("_name")))).select(KEY)

    related = dealt(mentions, n["mentions"], *KEY).join(other, KEY, "left_semi").select("block_id").distinct().join(read, "block_id", "left_anti")
    again = materialize(read.withColumn("again", F.lit("extract")).unionByName(related.withColumn("again", F.lit("relate"))), "again")
    reread = materialize(dealt(mentions, n["mentions"], "block_id").join(again, "block_id", "left_semi"), "reread")
    found = materialize(E.relation_evidence(blocks.join(again, "block_id", "left_semi").select("block_id", "text"), reread, entities), "found")
    dropped = gone.unionByName(again.select("block_id")).distinct()
    evidence = materialize(by_block["evidence"].join(dropped, "block_id", "left_anti").unionByName(found), "evidence")
    ids = materialize(by_block["evidence"].join(dropped, "block_id", "left_semi").select("id").unionByName(found.select("id")).distinct(), "ids")
    few = ids.hint("shuffle_hash")  # beside the evidence, which then needs no sort by its long ids
    counted = E.relation_candidates(dealt(evidence, n["evidence"], "id").join(few, "id", "left_semi"), 0)
    relations = dealt(old["relations"], n["relations"], "id").join(few, "id", "left_anti").unionByName(counted)
    return state | {"evidence": evidence, "relations": materialize(relations, "relations")}, again


def reviewed(state: State, entities: DataFrame, relations: DataFrame, extractor: str) -> tuple[DataFrame, DataFrame]:
    """The state's entities and relations with the earlier reviews of entities and relations (as ``reconcile_entities`` and ``reconcile_relations`` take them); a row for each id.

    What an earlier review says of an id that is no candidate any more goes with it.
    """
    none = F.array().cast("array<string>")
    fresh = state["entities"].groupBy("id").agg(F.min("name").alias("name"), F.max("confidence").alias("confidence"))
    fresh = fresh.select("id", "name", F.lit(extractor).alias("extractor"), F.lit("pending").alias("status"), none.alias("aliases"), F.lit(False).alias("pinned"), F.lit(None).cast("string").alias("merged_into"), none.alias("evidence"), "confidence")
    empty = F.lit(None).cast("string")
    found = state["relations"].select("id", "source", "relation", "target", "confidence", F.lit(extractor).alias("extractor"), empty.alias("valid_from"), empty.alias("valid_to"))
    return RV.reconcile_entities(entities, fresh).drop("evidence"), RV.reconcile_relations(relations, found)
