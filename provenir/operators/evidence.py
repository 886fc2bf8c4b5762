"""The whole evidence query, for many questions at once: route, restrict to the time asked for, rank in channels, fuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import materialize
from . import graph as G
from . import reasoning as R
from . import retrieval as V

DEFAULT_LIMIT, MOST = 10, 50
ENGINE = "provenir-evidence-1"


def evidence_query(questions: DataFrame, blocks: DataFrame, entities: DataFrame, relations: DataFrame, vectors: DataFrame | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """question_id, block_id, mode, each channel's rank and score, fused, rnk.

    questions(question_id, question), blocks(block_id, text, and created and updated where there are such columns), entities and relations as in ``graph``, vectors(question_id, block_id, score) of a provider.
    A question with a time is asked of the blocks of that time, and their statistics alone count; its graph has the relations of that time,
    and so have the communities that stand in for the graph where it names no entity.
    Channels go on to the fusion with three times the limit, 20 at least.
    """
    limit = max(1, min(limit, MOST))
    depth = max(20, 3 * limit)
    routed = materialize(R.route(questions, entities), "routed")
    timed = routed.where("time is not null").select("question_id", "time")
    plain = routed.where("time is null")
    every = plain.select("question_id", F.lit("all").alias("scope"), "question").unionByName(routed.where("time is not null").select("question_id", F.to_json("time").alias("scope"), "question"))
    times = timed.select(F.to_json("time").alias("scope"), "time").dropDuplicates(["scope"])  # one row for each time asked for
    of_times = R.blocks_of_times(blocks, times, "block_id", "scope").join(blocks, "block_id")
    eligible = blocks.select(F.lit("all").alias("scope"), "block_id", F.col("text").alias("body")).unionByName(of_times.select("scope", "block_id", F.col("text").alias("body")))
    bm25 = V.bm25(every, eligible, "question_id", "block_id", F.col("question"), F.col("body"), depth)

    own = materialize(R.relations_of_times(relations, timed).drop("time"), "relations")
    named = G.anchors(questions, entities, with_aliases=False).select("question_id").distinct()
    proofs = R.proofs(routed, relations)
    unnamed = routed.join(named, "question_id", "left_anti").select("question_id", F.to_json("time").alias("scope"), "question")
    dated = unnamed.where("scope is not null")
    of_scopes = materialize(R.relations_of_times(relations, times.join(dated, "scope", "left_semi")).drop("time"), "relations")
    graph = (
        G.graph_rank(plain.select("question_id", "question"), entities, relations)
        .unionByName(G.graph_rank(routed.where("time is not null").select("question_id", "question"), entities, own))
        .unionByName(G.community_rank(unnamed.where("scope is null").drop("scope"), entities, relations, tokens))
        .unionByName(G.community_rank(dated, entities, of_scopes, tokens))
        .unionByName(R.proof_evidence(proofs, relations))
        .groupBy("question_id", "block_id")
        .agg(F.max("score").alias("score"))
    )
    inside = every.select("question_id", "scope").join(eligible.select("scope", "block_id"), "scope").select("question_id", "block_id")
    graph = V.top(graph.join(inside, ["question_id", "block_id"], "left_semi"), "question_id", "score", "block_id", depth)
    channels = {"bm25": bm25, "graph": graph}
    if vectors is not None:
        channels["vector"] = V.top(vectors.where("score > 0").join(inside, ["question_id", "block_id"], "left_semi"), "question_id", "score", "block_id", depth)
    order = [c for c in ("bm25", "vector", "graph") if c in channels]
    fused = V.reciprocal_rank_fusion({c: channels[c] for c in order}, "question_id", "block_id", limit)
    return fused.join(routed.select("question_id", "mode"), "question_id")


def traces(result: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, engine, trace: each question's results as JSON, for an append-only table of traces."""
    rows = result.groupBy("question_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rnk", "block_id", "fused")))).alias("results"))
    return questions.join(rows, "question_id", "left").select("question_id", F.lit(ENGINE).alias("engine"), F.to_json(F.struct("question", "results")).alias("trace"))


def graph_plan(questions: DataFrame, notes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """question_id, ident, hops, score, rnk: weighted lexical hits over notes(pos, id, title, markdown), lifted by how near they are, within three resolved links, to the first note that the question names."""
    blocks = notes.select(F.col("id").alias("ident"), "title", F.lit("").alias("heading"), F.col("markdown").alias("text"))
    hits = materialize(V.weighted_lexical(questions, blocks, 4 * limit).select("question_id", "ident", "score"), "hits")
    anchors = V.note_anchors(questions, notes).where("size(anchors) > 0").select("question_id", F.col("anchors")[0]["id"].alias("start"))
    links = materialize(edges.where("resolved").select(F.lit(0).cast("long").alias("pos"), "source", "target").distinct(), "links")
    walked = G.shortest_paths(hits.join(anchors, "question_id").select(F.col("question_id").alias("question"), F.col("start").alias("source"), F.col("ident").alias("target")), links, 3)
    hops = walked.select(F.col("question").alias("question_id"), F.col("target").alias("ident"), F.size("path").alias("hops"))
    lift = F.when(F.col("hops") > 0, F.greatest(F.lit(0.03), 0.12 - F.col("hops") * 0.025)).otherwise(0.0)
    scored = hits.join(hops, ["question_id", "ident"], "left").withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + lift), 6))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.lower("title"), "ident")
    return scored.join(blocks.select("ident", "title"), "ident").withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= limit).select("question_id", "ident", "hops", "score", "rnk")
