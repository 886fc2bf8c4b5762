"""Trash, snapshots and portable copies of a workspace's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import violations

NODES = "array<struct<id:string,kind:string,ref:string,x:double,y:double>>"
EDGES = "array<struct<id:string,source:string,target:string>>"


def trash_notes(notes: DataFrame, canvases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes and canvases without the notes of gone(id), and the trash: id, note (JSON), placements (array of canvas, nodes, edges).

    canvases: id, nodes (NODES), edges (EDGES). A note's nodes leave a canvas together with their edges and come back with them.
    """
    wanted = gone.select("id").distinct()
    rest = notes.join(wanted, "id", "left_anti")
    placed = canvases.select("id", "edges", F.explode("nodes").alias("n")).where("n.kind = 'note'").join(wanted.withColumnRenamed("id", "_ref"), F.col("n.ref") == F.col("_ref"))
    out = placed.groupBy("id").agg(F.collect_set("n.id").alias("_out"))
    left = F.filter("nodes", lambda n: ~F.array_contains("_out", n["id"]))
    kept = F.filter("edges", lambda e: ~F.array_contains("_out", e["source"]) & ~F.array_contains("_out", e["target"]))
    bare = canvases.join(out, "id", "left").withColumns({"nodes": F.when(F.col("_out").isNull(), F.col("nodes")).otherwise(left), "edges": F.when(F.col("_out").isNull(), F.col("edges")).otherwise(kept)}).drop("_out")
    per = placed.groupBy("_ref", "id").agg(F.collect_list("n").alias("nodes"), F.first("edges").alias("edges"))
    own = F.filter("edges", lambda e: F.exists("nodes", lambda n: (n["id"] == e["source"]) | (n["id"] == e["target"])))
    placements = per.groupBy("_ref").agg(F.collect_list(F.struct(F.col("id").alias("canvas"), "nodes", own.alias("edges"))).alias("placements"))
    trash = notes.join(wanted, "id", "left_semi").select("id", F.to_json(F.struct(*notes.columns)).alias("note")).join(placements, F.col("id") == F.col("_ref"), "left").drop("_ref")
    return rest, bare, trash


def restore_notes(notes: DataFrame, canvases: DataFrame, trash: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes and canvases with the notes of back(id) again, and the trash without them. Edges come back where both their ends are there."""
    chosen = trash.join(back.select("id").distinct(), "id", "left_semi")
    again = chosen.select(F.from_json("note", notes.schema).alias("n")).select("n.*").select(notes.columns)
    all_notes = notes.join(chosen.select("id"), "id", "left_anti").unionByName(again)
    gained = chosen.select(F.explode("placements").alias("p")).groupBy(F.col("p.canvas").alias("id")).agg(F.flatten(F.collect_list("p.nodes")).alias("_n"), F.flatten(F.collect_list("p.edges")).alias("_e"))
    j = canvases.join(gained, "id", "left")
    there = lambda items, one: F.exists(items, lambda x: x["id"] == one["id"])
    nodes = F.concat("nodes", F.filter(F.coalesce("_n", F.array().cast(NODES)), lambda n: ~there("nodes", n)))
    j = j.withColumn("nodes", nodes)
    both = lambda e: F.exists("nodes", lambda n: n["id"] == e["source"]) & F.exists("nodes", lambda n: n["id"] == e["target"])
    edges = F.concat("edges", F.filter(F.array_distinct(F.coalesce("_e", F.array().cast(EDGES))), lambda e: ~there("edges", e) & both(e)))
    return all_notes, j.withColumn("edges", edges).select(canvases.columns), trash.join(back.select("id"), "id", "left_anti")


def dangling_edges(canvases: DataFrame) -> DataFrame:
    """id, edge of canvas edges with an end that isn't a node of their canvas."""
    rows = canvases.select("id", "nodes", F.explode("edges").alias("e"))
    has = lambda end: F.exists("nodes", lambda n: n["id"] == F.col(f"e.{end}"))
    return rows.where(~has("source") | ~has("target")).select("id", F.col("e.id").alias("edge"))


def canvas_json(canvases: DataFrame) -> DataFrame:
    """id, json of each canvas."""
    return canvases.select("id", F.to_json(F.struct("id", "nodes", "edges")).alias("json"))


def canvas_from_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canvases of rows(json), and the refused ones: what can't be read or has a dangling edge."""
    read = rows.select("json", F.from_json("json", f"struct<id:string,nodes:{NODES},edges:{EDGES}>").alias("c")).select("json", "c.*")
    whole = read.where("id is not null and nodes is not null and edges is not null")
    bad = dangling_edges(whole).select("id").distinct()
    return whole.join(bad, "id", "left_anti").select("id", "nodes", "edges"), read.join(whole.join(bad, "id", "left_anti").select("json"), "json", "left_anti").select("json")


def save(tables: dict[str, DataFrame], path: str) -> None:
    """A portable copy or snapshot: one folder of Parquet for each table. Embeddings are left out, since they can be made again."""
    for name, df in tables.items():
        if name != "embeddings":
            df.write.parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a copy. Raises ValueError if relations, notes or entities break the rules of ``violations``."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    if {"notes", "entities", "relations"} <= tables.keys():
        wrong = portable_violations(tables).limit(5).collect()
        if wrong:
            raise ValueError(f"the copy isn't consistent: {[tuple(r) for r in wrong]}")
    return tables


def portable_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, id: ids used twice, relations without an end or without evidence, blocks without their document."""
    found = violations(tables["notes"], tables["entities"], tables["relations"]).where("kind <> 'title twice'")
    found = found.unionByName(tables["relations"].where("coalesce(size(evidence), 0) <= 0").select(F.lit("relation without evidence").alias("kind"), "id"))
    if {"documents", "blocks"} <= tables.keys():
        lost = tables["blocks"].join(tables["documents"].select("doc_id"), "doc_id", "left_anti")
        found = found.unionByName(lost.select(F.lit("block without document").alias("kind"), F.col("block_id").alias("id")))
    return found
