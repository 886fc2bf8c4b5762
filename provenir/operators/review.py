"""Review decisions as table operations: state tables are rewritten, and every change adds a row to an audit log that undo reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_spaces
from ..storage import discard, materialize

MERGED = "merge-reconciled"


def reconcile_entities(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh candidates with earlier decisions: the status, pin and merge stay if the extractor is the same, aliases and pin in any case.

    Both: id, name, extractor, status, aliases, pinned, merged_into, evidence, confidence.
    """
    p = previous.select("id", *[F.col(c).alias(f"_{c}") for c in ("extractor", "status", "aliases", "pinned", "merged_into")])
    same = F.col("_extractor") == F.col("extractor")
    j = fresh.join(p, "id", "left")
    known = F.col("_extractor").isNotNull()
    return j.select(
        "id",
        "name",
        "extractor",
        F.when(~known, F.col("status")).when(same, F.col("_status")).otherwise("pending").alias("status"),
        F.when(known, F.array_union("aliases", F.coalesce("_aliases", F.array().cast("array<string>")))).otherwise(F.col("aliases")).alias("aliases"),
        F.when(known, F.col("_pinned")).otherwise(F.col("pinned")).alias("pinned"),
        F.when(same, F.col("_merged_into")).otherwise(F.when(known, None).otherwise(F.col("merged_into"))).alias("merged_into"),
        "evidence",
        "confidence",
    )


def reconcile_relations(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh relations with the status and validity of the earlier ones of the same extractor; others are pending."""
    p = previous.select("id", F.col("extractor").alias("_extractor"), F.col("status").alias("_status"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    same = F.coalesce(F.col("_extractor") == F.col("extractor"), F.lit(False))
    j = fresh.join(p, "id", "left")
    return j.withColumn("status", F.when(same, F.col("_status")).otherwise("pending")).withColumn("valid_from", F.when(same, F.coalesce("_from", "valid_from")).otherwise(F.col("valid_from"))).withColumn("valid_to", F.when(same, F.coalesce("_to", "valid_to")).otherwise(F.col("valid_to"))).drop("_extractor", "_status", "_from", "_to")


def resolve_merges(mapping: DataFrame) -> DataFrame:
    """mapping(old, new) with each chain followed to its end: a into b and b into c are a and b into c. Of several targets of one entity the least counts; circles, which lead nowhere, are left out.

    Pointers double their reach in each round, so a chain of n merges takes log2(n) rounds.
    """
    current = materialize(mapping.where("old IS NOT NULL AND new IS NOT NULL").groupBy("old").agg(F.min("new").alias("new")), "merges")
    rounds = max(1, current.count()).bit_length() + 1
    for _ in range(rounds):
        further = current.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        if current.join(further, "new", "left_semi").isEmpty():
            break
        before, current = current, materialize(current.join(further, "new", "left").select("old", F.coalesce("_next", "new").alias("new")), "merges")
        discard(before)
    return current.join(current.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new")


def merge_relations(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations after entities are merged by mapping(old, new), its chains resolved (``resolve_merges``): ends are rewritten, self-loops go and equal ones become one.

    Of equal ones: all evidence, the largest confidence, pending where their status differs, no validity where it differs, the least date of observation.
    """
    to = lambda side: mapping.select(F.col("old").alias(side), F.col("new").alias(f"_{side}"))
    moved = relations.join(to("source"), "source", "left").join(to("target"), "target", "left")
    moved = moved.withColumn("source", F.coalesce("_source", "source")).withColumn("target", F.coalesce("_target", "target")).where("source <> target")
    one = lambda c: F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.min(c)).alias(c)
    return moved.groupBy("source", "relation", "target").agg(
        F.concat_ws("::", "source", "relation", "target").alias("id"),
        F.when(F.count_distinct("status") == 1, F.min("status")).otherwise("pending").alias("status"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        F.max("confidence").alias("confidence"),
        F.min("observed_at").alias("observed_at"),
        one("valid_from"),
        one("valid_to"),
    )


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities after merging by mapping(old, new), its chains resolved (``resolve_merges``): the kept one takes names as aliases and evidence, the other is rejected and points to it."""
    m = mapping.join(entities.select(F.col("id").alias("old"), F.col("name").alias("_n"), F.col("aliases").alias("_a"), F.col("evidence").alias("_e")), "old")
    gained = m.groupBy("new").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("_n"), "_a"))))).alias("_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_e")))).alias("_more"))
    j = entities.join(gained, entities.id == gained.new, "left").join(mapping.select(F.col("old"), F.col("new").alias("_into")), entities.id == F.col("old"), "left")
    empty = F.array().cast("array<string>")
    return j.select(
        "id",
        "name",
        F.when(F.col("_into").isNotNull(), "rejected").otherwise(F.col("status")).alias("status"),
        F.coalesce("_into", "merged_into").alias("merged_into"),
        F.array_union("aliases", F.coalesce("_names", empty)).alias("aliases"),
        F.array_union("evidence", F.coalesce("_more", empty)).alias("evidence"),
    )


def split_entities(entities: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities after splits(id, new_id, new_name, moved), and the splits refused: one moves some of the evidence, not all, to a pending entity.

    Of several splits of one entity that of the least new_id stands; ``review_log.replay`` takes them in turn.
    """
    j = splits.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("new_id"))).join(entities, "id", "left")
    chosen = F.array_intersect("evidence", F.array_distinct("moved"))
    fine = F.col("name").isNotNull() & (F.trim("new_name") != "") & (F.size(chosen) > 0) & (F.size(chosen) < F.size("evidence")) & (F.col("_k") == 1)
    good = j.where(fine)
    rest = entities.join(good.select("id", "moved"), "id", "left").withColumn("evidence", F.when(F.col("moved").isNotNull(), F.array_except("evidence", "moved")).otherwise(F.col("evidence"))).select(entities.columns)
    made = good.select(
        *[
            {"id": F.col("new_id"), "name": F.trim("new_name"), "status": F.lit("pending"), "aliases": F.array().cast("array<string>"), "evidence": chosen, "merged_into": F.lit(None).cast("string")}.get(c, F.col(c)).alias(c)
            for c in entities.columns
        ]
    )
    return rest.unionByName(made), j.where(~F.coalesce(fine, F.lit(False))).select("id", "new_id")


def review_entities(entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities after decisions(seq, id, status, name), the last of each id standing, and audit rows(seq, id, action, before, after)."""
    known = decisions.join(entities, "id", "left_semi")
    last = known.groupBy("id").agg(F.max_by("status", "seq").alias("_s"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("_n"))
    j = entities.join(last, "id", "left")
    renamed = F.col("_n").isNotNull() & (F.trim("_n") != "")
    after = j.withColumn("aliases", F.when(renamed, F.array_union("aliases", F.array("name"))).otherwise(F.col("aliases"))).withColumn("name", F.when(renamed, F.trim("_n")).otherwise(F.col("name"))).withColumn("status", F.coalesce("_s", "status")).select(entities.columns)
    w = Window.partitionBy("id").orderBy("seq")
    action = F.when(F.col("status") == "accepted", "accept").when(F.col("status") == "rejected", "reject").otherwise("reopen")
    before = F.coalesce(F.lag("status").over(w), F.col("_old"))
    audit = known.join(entities.select("id", F.col("status").alias("_old")), "id").select("seq", "id", action.alias("action"), before.alias("before"), F.col("status").alias("after"))
    return after, audit


def review_relations(relations: DataFrame, decisions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations after decisions(id, status, and seq where there are several of an id: the last stands), and the decisions refused with the reason: accepting takes evidence and two accepted, unmerged ends.

    ``review_log.replay`` judges each decision in its turn and logs it.
    """
    ok = entities.where("status = 'accepted' and merged_into is null").select("id")
    last = decisions.groupBy("id").agg(F.max_by("status", "seq" if "seq" in decisions.columns else "status").alias("new_status"))
    unknown = last.join(relations, "id", "left_anti").select("id", F.lit("unknown").alias("reason"))
    j = last.join(relations, "id")
    j = j.join(ok.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ok.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    reason = F.when((F.col("new_status") == "accepted") & (F.size("evidence") <= 0), "no evidence").when((F.col("new_status") == "accepted") & (F.col("_s").isNull() | F.col("_t").isNull()), "an end isn't accepted")
    judged = j.select("id", "new_status", reason.alias("reason"))
    fine = judged.where("reason is null").select("id", F.col("new_status").alias("_n"))
    return relations.join(fine, "id", "left").withColumn("status", F.coalesce("_n", "status")).select(relations.columns), judged.where("reason is not null").select("id", "reason").unionByName(unknown)


def valid_period(valid_from: Column, valid_to: Column) -> Column:
    """Whether both dates, where given, are dates and in order."""
    a, b = F.try_to_timestamp(valid_from), F.try_to_timestamp(valid_to)
    return (valid_from.isNull() | a.isNotNull()) & (valid_to.isNull() | b.isNotNull()) & F.coalesce(a <= b, F.lit(True))


def undo(entities: DataFrame, audit: DataFrame, undone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with the decisions of undone(seq) taken back, and the requests refused: one that isn't in the log, is itself an undo, or was taken back before.

    audit: seq, id, action, before, after; an undo is a row with action 'undo' and the undone seq in after. The state goes back to before of the earliest of an entity's undone decisions that no later decision follows.
    """
    earlier = audit.where("action = 'undo'").select(F.col("after").cast("long").alias("seq"))
    asked = undone.distinct().join(audit.where("action <> 'undo'"), "seq", "left")
    fine = asked.where("id is not null").join(earlier, "seq", "left_anti")
    refused = undone.distinct().join(fine, "seq", "left_anti")
    live = audit.where("action <> 'undo'").join(earlier, "seq", "left_anti").join(undone.withColumn("_u", F.lit(1)).distinct(), "seq", "left")
    tail = Window.partitionBy("id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = live.withColumn("_kept", F.max(F.when(F.col("_u").isNull(), 1).otherwise(0)).over(tail)).where("_kept = 0").groupBy("id").agg(F.min_by("before", "seq").alias("_b"))
    return entities.join(back, "id", "left").withColumn("status", F.coalesce("_b", "status")).select(entities.columns), refused


def twins(model: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates of a model(type, name, ...) without those that a known(type, name) one already names."""
    return model.withColumn("_k", normalize_spaces(F.col("name"))).join(known.select("type", normalize_spaces(F.col("name")).alias("_k")), ["type", "_k"], "left_anti").drop("_k")


def review_queue(candidates: DataFrame, pending: bool) -> DataFrame:
    """Candidates that wait for a decision, or those that have one; merged ones are in neither."""
    state = F.col("status") == "pending"
    return candidates.where("merged_into is null").where(state if pending else ~state)


def pin(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities with the pins of decisions(seq, id, pinned), the last of each id standing."""
    last = decisions.groupBy("id").agg(F.max_by("pinned", "seq").alias("_p"))
    return entities.join(last, "id", "left").withColumn("pinned", F.coalesce("_p", "pinned")).select(entities.columns)


def merge_target(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """asked, id of wanted(asked): the entity whose id it is, else the least one with that name, in any case."""
    by_id = wanted.join(entities.select("id"), F.col("asked") == F.col("id")).select("asked", "id", F.lit(0).alias("rank"))
    by_name = wanted.join(entities.select("id", normalize_spaces(F.col("name")).alias("_n")), normalize_spaces(F.col("asked")) == F.col("_n")).select("asked", "id", F.lit(1).alias("rank"))
    return by_id.unionByName(by_name).groupBy("asked").agg(F.min(F.struct("rank", "id")).alias("_b")).select("asked", "_b.id")


def merge_log(entities: DataFrame, relations: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What undoing merges(seq, old, new) takes: entities(seq, ...) and relations(seq, rewritten, ...) as they were before.

    Logged relations are those of the merged entity and those that its own run into under their new ids (``rewritten``, null for the latter and for loops).
    """
    ends = merges.select("seq", F.explode(F.array("old", "new")).alias("id"))
    before = entities.join(ends, "id").select("seq", *entities.columns)
    touched = relations.join(merges, (F.col("source") == F.col("old")) | (F.col("target") == F.col("old")))
    to = lambda c: F.when(F.col(c) == F.col("old"), F.col("new")).otherwise(F.col(c))
    made = F.when(to("source") != to("target"), F.concat_ws("::", to("source"), "relation", to("target")))
    affected = touched.select("seq", made.alias("rewritten"), *relations.columns)
    met = affected.where("rewritten is not null").select("seq", F.col("rewritten").alias("id")).distinct()
    collided = relations.join(met, "id").select("seq", F.lit(None).cast("string").alias("rewritten"), *relations.columns)
    return before, affected.unionByName(collided)


def undo_merges(entities: DataFrame, relations: DataFrame, logged: tuple[DataFrame, DataFrame], undone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations with the merges of undone(seq) taken back: logged rows stand again, and what was rewritten goes."""
    before, old = (df.join(undone.select("seq").distinct(), "seq", "left_semi").drop("seq") for df in logged)
    back = entities.join(before.select("id").distinct(), "id", "left_anti").unionByName(before.dropDuplicates(["id"]).select(entities.columns))
    gone = old.select("id").unionByName(old.where("rewritten is not null").select(F.col("rewritten").alias("id"))).distinct()
    return back, relations.join(gone, "id", "left_anti").unionByName(old.drop("rewritten").dropDuplicates(["id"]).select(relations.columns))


def undo_splits(entities: DataFrame, before: DataFrame, splits: DataFrame) -> DataFrame:
    """Entities with splits(id, new_id) taken back: before holds the split entities as they were, and those that were made go."""
    gone = splits.select("id").unionByName(splits.select(F.col("new_id").alias("id"))).distinct()
    return entities.join(gone, "id", "left_anti").unionByName(before.join(splits.select("id").distinct(), "id", "left_semi").select(entities.columns))
