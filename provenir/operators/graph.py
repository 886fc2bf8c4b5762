"""Authored and accepted graphs: edges from links, neighbourhoods, shortest paths, components, ranks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body, first_year, links, normalize
from ..storage import discard, materialize
from .components import connected_components
from .intervals import numbered
from .names import name_rows


HOPS = 3  # steps of a sweep between two written tables
FEW = 64  # nodes that a row may carry along
TASK_ROWS = 1 << 22  # that meet in a task


def authored_edges(notes: DataFrame) -> DataFrame:
    """source, target, title, resolved, pos, link_pos of every wiki link of notes(pos, id, title, markdown).

    A title that two notes share resolves to neither.
    """
    titles = notes.groupBy(normalize(F.col("title")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("note_id"))
    found = notes.select("pos", "id", F.posexplode(links(F.col("markdown"))).alias("link_pos", "link")).select("pos", "link_pos", F.col("id").alias("source"), F.col("link.target").alias("title"), normalize(F.col("link.target")).alias("key"))
    joined = found.join(titles, "key", "left")
    resolved = F.coalesce(F.col("n") == 1, F.lit(False))
    return joined.select("source", F.when(resolved, F.col("note_id")).otherwise(F.concat(F.lit("unresolved:"), "key")).alias("target"), "title", resolved.alias("resolved"), "pos", "link_pos")


def both_ways(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def neighbourhood(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """start, node, hops of all nodes within depth of starts(start), over edges(source, target) either way.

    A start with few known nodes finds the neighbours of its last ones without an exchange of what it finds (``_onward``), so a hub between many starts and many nodes costs its rows and no shuffle of them.
    """
    near = materialize(both_ways(edges).distinct(), "near")
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    if depth > 0:
        seen = materialize(seen, "starts")
    for hop in range(1, depth + 1):
        if hop == 1:
            step = seen.join(near, seen.node == near.u).select("start", F.col("v").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        else:
            step = _onward(seen, near, hop)
        frontier = step.withColumn("hops", F.lit(hop))
        seen = seen.unionByName(materialize(frontier, "frontier") if hop < depth else frontier)
    return seen


def _onward(seen: DataFrame, near: DataFrame, hop: int) -> DataFrame:
    """start, node, each once: what lies one step beyond the last nodes of seen(start, node, hops) and isn't in it.

    A start of FEW known nodes and a node of FEW neighbours meet through the least of their common ones only, which each row knows by itself; where either has more, the pairs are made distinct by an exchange.
    """
    few = seen.groupBy("start").agg((F.count("*") <= FEW).alias("few"))
    known = seen.join(few.where("few"), "start").groupBy("start").agg(F.collect_set("node").alias("seen"), F.array_sort(F.collect_list(F.when(F.col("hops") == hop - 1, F.col("node")))).alias("last"))
    known = materialize(known.select("start", "seen", "last", F.explode("last").alias("u")).select("start", "seen", "u", F.filter("last", lambda x: x < F.col("u")).alias("before")), "known")
    sizes = near.groupBy("v").agg((F.count("*") <= FEW).alias("few"))
    beside = near.join(sizes.where("few"), "v").groupBy("v").agg(F.collect_list("u").alias("beside"))
    meets = known.groupBy("u").agg(F.count("*").alias("starts")).join(near.groupBy("u").agg(F.count("*").alias("n")), "u")
    parts = materialize(meets.select("u", F.ceil(F.col("starts") * F.col("n") / TASK_ROWS).cast("int").alias("parts"), (F.col("starts") * F.col("n")).alias("rows")), "parts")
    tasks = max(1, math.ceil((parts.agg(F.sum("rows").alias("n")).first().n or 0) / TASK_ROWS))
    from_few = known.join(parts, "u").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    to_few = near.join(beside, "v").join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select("u", "part", "v", "beside").repartition(tasks, "u", "part")
    direct = from_few.join(to_few, ["u", "part"]).where(~F.arrays_overlap("before", "beside") & ~F.array_contains("seen", F.col("v"))).select("start", F.col("v").alias("node"))
    last = seen.where(F.col("hops") == hop - 1).join(few, "start").select("start", F.col("node").alias("u"), "few")
    other = near.join(sizes, "v").select("u", "v", F.col("few").alias("_few"))
    rest = last.where("few").join(other.where("not _few"), "u").select("start", F.col("v").alias("node")).unionByName(last.where("not few").join(other, "u").select("start", F.col("v").alias("node")))
    return direct.unionByName(rest.distinct().join(seen, ["start", "node"], "left_anti"))


def _frontier(last: DataFrame, seen: DataFrame, near: DataFrame, backwards: bool) -> DataFrame:
    """origin, node, path, nodes one step beyond ``last``: for each origin and node not in seen the first sequence of positions, read from the path's start."""
    step = last.join(near, last.node == near.u)
    path, nodes = (F.concat(F.array("pos"), "path"), F.concat(F.array("v"), "nodes")) if backwards else (F.concat("path", F.array("pos")), F.concat("nodes", F.array("v")))
    best = step.select("origin", F.col("v").alias("node"), F.struct(path.alias("path"), nodes.alias("nodes")).alias("p")).groupBy("origin", "node").agg(F.min("p").alias("p"))
    return best.join(seen, ["origin", "node"], "left_anti").select("origin", "node", "p.path", "p.nodes")


def between(relations: DataFrame, ends: DataFrame) -> DataFrame:
    """The relations whose both ends are among ends(node) or have another relation too: no shortest path between two of ends takes any other.

    One grouping of all nodes finds these; the relations themselves are exchanged only where the nodes that stay are too many for each task.
    """
    real = relations.where("source <> target")
    many = real.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    kept = materialize(many.union(ends.select("node")).distinct(), "kept")
    return real.join(kept.withColumnRenamed("node", "source"), "source", "left_semi").join(kept.withColumnRenamed("node", "target"), "target", "left_semi")


def shortest_paths(pairs: DataFrame, relations: DataFrame, max_hops: int = 4) -> DataFrame:
    """question, source, target, path (relation positions), nodes: the shortest path of each distinct pair(question, source, target).

    Of equally short paths the one whose sequence of relation positions comes first wins, which is what a queue
    that scans relations in order finds. relations(pos, source, target); they are walked either way.

    A source is searched from once, however many targets it has, and so is a target; a level is taken by the side whose frontier has fewer relations to follow, and a pair is answered at
    the first level at which they meet. Both halves of the winning path are the first ones to their meeting node, so the least of the joined sequences is the pair's. A pair is met along
    whichever of its two frontiers is smaller, so a hub on one side isn't unrolled for each pair. Nodes with one neighbour are followed only as ends, since no path leads
    through them; origins without an open pair aren't followed further, and a pair with an end from which nothing more is reached isn't open.
    """
    asked = pairs.select("question", "source", "target").distinct()
    done = asked.where("source = target").select("question", "source", "target", F.array().cast("array<bigint>").alias("path"), F.array("source").alias("nodes"))
    ends = materialize(asked.where("source <> target").select("source", "target").distinct(), "pairs")
    useful = between(relations, ends.select(F.explode(F.array("source", "target")).alias("node")))
    steps = F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v")))
    near = materialize(useful.select("pos", F.explode(steps).alias("_s")).select("pos", "_s.*").groupBy("u", "v").agg(F.min("pos").alias("pos")), "near")
    through = near.groupBy(F.col("u").alias("v")).agg((F.count("*") > 1).alias("through"))
    asked_ends = ends.select(F.col("source").alias("v")).union(ends.select("target")).distinct().withColumn("_end", F.lit(True))
    near = materialize(near.join(through, "v").join(asked_ends, "v", "left").where("through or _end").select("u", "v", "pos", "through"), "near")
    fan = near.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.count_if("through").alias("n_through"))
    open_pairs, found = ends, None
    sides, moved = {}, set()
    for end in ("source", "target"):
        start = ends.select(F.col(end).alias("origin")).distinct().select("origin", F.col("origin").alias("node"), F.array().cast("array<bigint>").alias("path"), F.array("origin").alias("nodes"))
        sides[end] = (start, start.select("origin", "node"))
    for _ in range(max_hops):
        onward = {end: bool(moved - {end}) for end in sides}  # where the other side has left its ends, a node with one neighbour meets nothing
        last = {end: sides[end][0].join(open_pairs.select(F.col(end).alias("origin")).distinct(), "origin", "left_semi") for end in sides}
        both = last["source"].select("node", F.lit("source").alias("end")).unionByName(last["target"].select("node", F.lit("target").alias("end")))
        followed = both.join(fan, "node").groupBy("end").agg(F.sum("n").alias("n"), F.sum("n_through").alias("n_through"))
        cost = {r["end"]: r["n_through"] if onward[r["end"]] else r["n"] for r in followed.collect()}
        if len(cost) < 2:
            break
        end = min(sides, key=cost.get)
        step = materialize(_frontier(last[end], sides[end][1], near.where("through") if onward[end] else near, end == "target"), "frontier")
        moved.add(end)
        sides[end] = step, sides[end][1].unionByName(step.select("origin", "node"))
        met = materialize(_meetings(open_pairs, sides["source"][0], sides["target"][0]), "met")
        found = met if found is None else found.unionByName(met)
        left = open_pairs.join(met, ["source", "target"], "left_anti").join(step.select(F.col("origin").alias(end)).distinct(), end, "left_semi")
        open_pairs = materialize(left.select("source", "target"), "pairs")
        if open_pairs.isEmpty():
            break
    return done if found is None else done.unionByName(asked.join(found, ["source", "target"]).select("question", "source", "target", "path", "nodes"))


def _meetings(pairs: DataFrame, ahead: DataFrame, back: DataFrame) -> DataFrame:
    """source, target, path, nodes of the pairs whose frontiers share a node."""
    count = lambda f, end: f.groupBy(F.col("origin").alias(end)).agg(F.count("*").alias(f"n_{end}"))
    sized = pairs.join(count(ahead, "source"), "source").join(count(back, "target"), "target")
    forth = ahead.select(F.col("origin").alias("source"), "node", F.col("path").alias("path_a"), F.col("nodes").alias("nodes_a"))
    rest = back.select(F.col("origin").alias("target"), "node", F.col("path").alias("path_b"), F.col("nodes").alias("nodes_b"))
    columns = ["source", "target", "path_a", "nodes_a", "path_b", "nodes_b"]
    near_source = sized.where("n_source <= n_target").select("source", "target").join(forth, "source").join(rest, ["target", "node"]).select(columns)
    near_target = sized.where("n_source > n_target").select("source", "target").join(rest, "target").join(forth, ["source", "node"]).select(columns)
    whole = F.struct(F.concat("path_a", "path_b").alias("path"), F.concat("nodes_a", F.slice("nodes_b", 2, F.size("nodes_b"))).alias("nodes"))
    return near_source.unionByName(near_target).groupBy("source", "target").agg(F.min(whole).alias("p")).select("source", "target", "p.path", "p.nodes")


def accepted_entities(entities: DataFrame) -> DataFrame:
    return entities.where("status = 'accepted' and merged_into is null")


def accepted_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Accepted relations both of whose ends are accepted and not merged."""
    ok = accepted_entities(entities).select("id")
    return relations.where("status = 'accepted'").join(ok.withColumnRenamed("id", "source"), "source", "left_semi").join(ok.withColumnRenamed("id", "target"), "target", "left_semi")


def communities(entities: DataFrame, relations: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """id, community (its least member), size, idx (0 for the largest) of accepted entities; lone ones are communities of one.

    With scopes(scope), a few rows, each scope has communities of its own, along its rows of relations(scope, ...); the result has scope too.
    """
    own = accepted_entities(entities).select("id")
    usable = accepted_relations(entities, relations)
    if scopes is None:
        cc = connected_components(usable.select(F.col("source").alias("a"), F.col("target").alias("b")))
        members = own.join(cc, own.id == cc.vertex, "left").select("id", F.coalesce("component", "id").alias("community"))
        sizes = members.groupBy("community").agg(F.count("*").alias("size"))
        idx = numbered(sizes, [F.desc("size"), F.col("community")], "idx")
        return members.join(idx, "community").select("id", "community", "size", "idx")
    vertex = lambda c: F.struct("scope", F.col(c).alias("id"))
    cc = connected_components(usable.select(vertex("source").alias("a"), vertex("target").alias("b"))).select(F.col("vertex.scope").alias("scope"), F.col("vertex.id").alias("id"), F.col("component.id").alias("component"))
    members = scopes.select("scope").distinct().join(own).join(cc, ["scope", "id"], "left").select("scope", "id", F.coalesce("component", "id").alias("community"))
    sizes = members.groupBy("scope", "community").agg(F.count("*").alias("size"))
    placed = numbered(sizes, [F.col("scope"), F.desc("size"), F.col("community")], "place")
    first = placed.groupBy("scope").agg(F.min("place").alias("first"))
    idx = placed.join(first, "scope").select("scope", "community", "size", (F.col("place") - F.col("first")).alias("idx"))
    return members.join(idx, ["scope", "community"]).select("scope", "id", "community", "size", "idx")


def anchors(questions: DataFrame, entities: DataFrame, with_aliases: bool = True) -> DataFrame:
    """question_id, question, id, name of accepted entities that a question names (three characters and more).

    Names are looked up as substrings (``names``), however many questions and entities there are.
    """
    names = F.array("name")
    if with_aliases:
        names = F.concat(names, "aliases")
    known = accepted_entities(entities).select("id", "name", F.explode(F.array_distinct(F.transform(names, F.lower))).alias("called")).where("length(called) >= 3")
    found = name_rows(questions.select("question_id", F.lower("question").alias("text")), known, "question_id")
    return found.select("question_id", "id", "name").distinct().join(questions.select("question_id", "question"), "question_id").select("question_id", "question", "id", "name")


def swept(starts: DataFrame, relations: DataFrame, sweeps: int = 2) -> DataFrame:
    """question_id, id, at: what a number of sweeps over the relations in order reaches, each adding both ends of a relation with one end reached.

    A sweep travels along relations of rising position within itself, so a node's arrival is a time (sweep, position), and the earliest arrivals are
    the fixed point of: a relation passes an arrival on in the same sweep if it comes later in it, else in the next one. A round follows the
    relations HOPS steps before it writes what it found; rounds go on until nothing changes, so a chain of any length is walked.
    starts(question_id, id); relations(pos, source, target), with a column question_id where each question has its own.
    """
    own = "question_id" in relations.columns
    extra = [F.col("question_id").alias("q")] if own else []
    near = relations.select("pos", F.col("source").alias("u"), F.col("target").alias("v"), *extra).unionByName(relations.select("pos", F.col("target").alias("u"), F.col("source").alias("v"), *extra)).where("u <> v")
    begin = F.struct(F.lit(0).alias("sweep"), F.lit(-1).cast("long").alias("pos"))
    state = materialize(starts.select("question_id", "id", begin.alias("at")).distinct(), "swept")
    changed = state
    on = (F.col("id") == near.u) & (F.col("question_id") == near.q) if own else F.col("id") == near.u

    def step(frontier: DataFrame) -> DataFrame:
        """The earliest arrivals one relation on from a frontier, before they are held against the state."""
        sweep = F.when(F.col("pos") > F.col("at.pos"), F.col("at.sweep")).otherwise(F.col("at.sweep") + 1)
        moved = frontier.join(near, on).select("question_id", F.col("v").alias("id"), F.struct(sweep.alias("sweep"), F.col("pos").alias("pos")).alias("new")).where(F.col("new.sweep") < sweeps)
        return moved.groupBy("question_id", "id").agg(F.min("new").alias("new"))

    while True:
        every = frontier = step(changed)
        for _ in range(HOPS - 1):
            frontier = step(frontier.withColumnRenamed("new", "at"))
            every = every.unionByName(frontier)
        best = every.groupBy("question_id", "id").agg(F.min("new").alias("new"))
        better = best.join(state, ["question_id", "id"], "left").where(F.col("at").isNull() | (F.col("new") < F.col("at"))).select("question_id", "id", F.col("new").alias("at"))
        changed = materialize(better, "swept")
        if changed.isEmpty():
            return state
        before, state = state, materialize(state.join(changed, ["question_id", "id"], "left_anti").unionByName(changed), "swept")
        discard(before)


def graph_rank(questions: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """question_id, block_id, score: evidence of anchors (1.0), of entities that two sweeps reach (0.7) and of relations between reached ones (0.82).

    relations with a column question_id are each question's own, such as those of its time.
    """
    found = anchors(questions, entities, with_aliases=False).select("question_id", "id")
    usable = materialize(accepted_relations(entities, relations), "usable")
    reached = swept(found, usable).select("question_id", "id")
    scored = reached.join(found.withColumn("_a", F.lit(1.0)), ["question_id", "id"], "left").select("question_id", "id", F.coalesce("_a", F.lit(0.7)).alias("score"))
    blocks = scored.join(accepted_entities(entities), "id").select("question_id", F.explode("evidence").alias("block_id"), "score")
    a, b = reached.withColumnRenamed("id", "source"), reached.withColumnRenamed("id", "target")
    ends = usable.join(a, ["source", "question_id"] if "question_id" in usable.columns else "source")
    between = ends.join(b, ["question_id", "target"]).select("question_id", F.explode("evidence").alias("block_id"), F.lit(0.82).alias("score"))
    return blocks.unionByName(between).groupBy("question_id", "block_id").agg(F.max("score").alias("score"))


def community_rank(questions: DataFrame, entities: DataFrame, relations: DataFrame, tokenise: Callable[[Column], Column]) -> DataFrame:
    """question_id, block_id, score for questions that name no entity: communities by the terms they share with the question, or by breadth for broad questions.

    With a column scope in both questions and relations, such as the time asked for, a question has the communities of the relations of its scope.
    """
    scoped = "scope" in questions.columns
    own = ["scope"] if scoped else []
    member = communities(entities, relations, questions if scoped else None)
    usable = accepted_relations(entities, relations).join(member.select(*own, F.col("id").alias("source"), "community", "size", "idx"), [*own, "source"])
    named = member.join(entities.select("id", "name"), "id").select(*own, "community", F.explode(tokenise(F.col("name"))).alias("term"))
    labels = usable.select(*own, "community", F.explode(tokenise(F.col("relation"))).alias("term"))
    vocabulary = named.unionByName(labels).distinct()
    asked = questions.select("question_id", *own, F.explode(tokenise(F.col("question"))).alias("term"))
    matches = asked.join(vocabulary, [*own, "term"]).groupBy("question_id", *own, "community").agg(F.count("*").alias("matches"))
    shape = member.groupBy(*own, "community").agg(F.first("size").alias("size"), F.first("idx").alias("idx"))
    broad = questions.select("question_id", *own, F.col("question").rlike(r"(?i)(?<![A-Za-z0-9_])(?:overall|overview|summari[sz]e|themes?|communities|clusters?|landscape|big picture)(?![A-Za-z0-9_])").alias("broad"))
    breadth = F.least(F.lit(1.0), F.log2(F.col("size") + 1) / 5)
    lexical = matches.join(shape, [*own, "community"]).select("question_id", *own, "community", F.least(F.lit(1.0), 0.55 + 0.12 * F.col("matches") + 0.2 * breadth).alias("score"))
    wide = broad.where("broad").join(shape, own or None).select("question_id", *own, "community", F.greatest(F.lit(0.15), breadth * (1 - F.col("idx") * 0.08)).alias("score"))
    wide = wide.join(lexical, ["question_id", "community"], "left_anti")
    score = lexical.unionByName(wide)
    of_entities = score.join(member, [*own, "community"]).join(entities.select("id", "evidence"), "id").select("question_id", F.explode("evidence").alias("block_id"), "score")
    more = score.join(usable.select(*own, "community", "evidence"), [*own, "community"]).select("question_id", F.explode("evidence").alias("block_id"), F.least(F.lit(1.0), F.col("score") + 0.08).alias("score"))
    return of_entities.unionByName(more).groupBy("question_id", "block_id").agg(F.round(F.max("score"), 6).alias("score"))


def relation_years(valid_from: Column, valid_to: Column, observed_at: Column) -> tuple[Column, Column]:
    """The years a relation holds: an open end is the year of its beginning."""
    begin = F.coalesce(first_year(valid_from), first_year(observed_at))
    end = F.coalesce(first_year(valid_to), begin)
    return F.coalesce(begin, end), end


def resolved_subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Resolved edges of authored_edges both of whose ends are in members(id)."""
    ends = lambda side: members.select(F.col("id").alias(side)).distinct()
    return edges.where("resolved").join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")


def induced_subgraphs(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """start and the columns of edges, for each start all edges between nodes within depth of it, the unresolved ones too."""
    near = neighbourhood(starts, edges, depth).select("start", "node")
    inside = edges.join(near.withColumnRenamed("node", "source"), "source")
    return inside.join(near.withColumnRenamed("node", "target"), ["start", "target"], "left_semi").select("start", *edges.columns)


def layered_graph(notes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes(id, label, kind) and edges(source, target, layer) of the authored graph and of the accepted one over it, with ids that tell them apart."""
    tag = lambda prefix, c: F.concat(F.lit(prefix), c)
    missing = edges.where("not resolved").groupBy("target").agg(F.min("title").alias("title"))
    nodes = (
        notes.select(tag("note:", F.col("id")).alias("id"), F.col("title").alias("label"), F.lit("note").alias("kind"))
        .unionByName(missing.select(tag("note:", F.col("target")).alias("id"), F.col("title").alias("label"), F.lit("unresolved").alias("kind")))
        .unionByName(accepted_entities(entities).select(tag("entity:", F.col("id")).alias("id"), F.col("name").alias("label"), F.lit("entity").alias("kind")))
    )
    authored = edges.select(tag("note:", F.col("source")).alias("source"), tag("note:", F.col("target")).alias("target"), F.lit("authored").alias("layer"))
    inferred = accepted_relations(entities, relations).select(tag("entity:", F.col("source")).alias("source"), tag("entity:", F.col("target")).alias("target"), F.lit("inferred").alias("layer"))
    return nodes, authored.unionByName(inferred)


WORD = r"[\p{L}\p{N}_]+"
MENTION_WORDS = 3  # of a title, by which texts are found that may hold it


def unlinked_mentions(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """target, source: notes(id, title, markdown) whose body, without its links, has another note's title between signs that aren't part of a word, and doesn't link to it.

    Titles meet bodies by their first words (up to MENTION_WORDS), and the whole title is then looked for; a title without a letter or digit has no mention.
    """
    plain = notes.select(F.col("id").alias("source"), F.lower(F.regexp_replace(body(F.col("markdown")), r"\[\[[^\]]*\]\]", " ")).alias("body"))
    words = F.regexp_extract_all("body", F.lit(WORD), 0)

    def run_of(n: int) -> Column:
        return F.transform(F.col("w"), lambda _, i: F.when(i + n <= F.size("w"), F.array_join(F.slice(F.col("w"), i + 1, n), " ")))

    runs = [run_of(n) for n in range(1, MENTION_WORDS + 1)]
    found = plain.select("source", words.alias("w")).select("source", F.explode(F.array_distinct(F.array_compact(F.flatten(F.array(*runs))))).alias("key"))
    titles = notes.select(F.col("id").alias("target"), F.lower("title").alias("t"), F.regexp_extract_all(F.lower("title"), F.lit(WORD), 0).alias("w")).where("size(w) > 0")
    titles = titles.select("target", "t", F.array_join(F.slice("w", 1, MENTION_WORDS), " ").alias("key"))
    pairs = found.join(titles, "key").where("source <> target").select("source", "target", "t").join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti")
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])\Q"), "t", F.lit(r"\E([^\p{L}\p{N}_]|$)"))
    return pairs.join(plain, "source").where(F.rlike("body", pattern)).select("target", "source")
