"""Workspace tables: views, properties, titles, calendars, canvases, checks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expand_template, js_trim, normalize, properties, rename_links, tags


def note_properties(notes: DataFrame) -> DataFrame:
    """id, key, kind, value, items: one row for each property of a note."""
    return notes.select("id", F.explode(properties(F.col("markdown"))).alias("p")).select("id", "p.key", F.col("p.value.kind").alias("kind"), F.col("p.value.text").alias("value"), F.col("p.value.items").alias("items"))


def property_columns(notes: DataFrame) -> DataFrame:
    """key, n: how many notes have a property, the most frequent first."""
    return note_properties(notes).groupBy("key").agg(F.count("*").alias("n"))


def saved_view(rows: DataFrame, filters: list[tuple[str, str, str]]) -> DataFrame:
    """Rows that pass all filters (column, op, value): equals, contains (any case) or exists. A missing value counts as empty, an array as its members joined."""
    for column, op, value in filters:
        c = F.col(column)
        text = F.coalesce(F.array_join(c, ", ") if dict(rows.dtypes)[column].startswith("array") else c.cast("string"), F.lit(""))
        if op == "equals":
            keep = F.lower(text) == value.lower()
        elif op == "contains":
            keep = F.contains(F.lower(text), F.lit(value.lower()))
        elif op == "exists":
            keep = text != ""
        else:
            raise ValueError(f"no such filter: {op}")
        rows = rows.where(keep)
    return rows


def view_groups(rows: DataFrame, by: str | None) -> DataFrame:
    """grp and the row's columns: an array puts a row into each of its members' groups, a missing value into 'Unspecified'; without a column all are 'All'."""
    if by is None:
        return rows.withColumn("grp", F.lit("All"))
    c = F.col(by)
    if dict(rows.dtypes)[by].startswith("array"):
        return rows.withColumn("grp", F.explode(F.when(F.size(c) > 0, c.cast("array<string>")).otherwise(F.array(F.lit("Unspecified")))))
    return rows.withColumn("grp", F.when(c.isNull() | (c.cast("string") == ""), "Unspecified").otherwise(c.cast("string")))


# Fixed value: a title with a number from 2 on.
NUMBERED = r"^(.*) \(([2-9]|[1-9][0-9]+)\)$"


class _Taken:
    """Titles of a family: each is a base, or a number from 2 on of a base; a base's numbers are kept as runs."""

    def __init__(self) -> None:
        self.plain: set[str] = set()
        self.runs: dict[str, tuple[list[int], list[int]]] = {}  # firsts and lasts

    def find(self, title: str) -> bool:
        m = re.match(NUMBERED, title, re.S)
        if not m:
            return title in self.plain
        firsts, lasts = self.runs.get(m[1], ([], []))
        i = bisect_right(firsts, int(m[2])) - 1
        return i >= 0 and lasts[i] >= int(m[2])

    def add(self, title: str) -> None:
        if self.find(title):
            return
        m = re.match(NUMBERED, title, re.S)
        if not m:
            self.plain.add(title)
            return
        firsts, lasts = self.runs.setdefault(m[1], ([], []))
        n = int(m[2])
        i = bisect_right(firsts, n)
        after, before = i < len(firsts) and firsts[i] == n + 1, i > 0 and lasts[i - 1] == n - 1
        if after and before:
            lasts[i - 1] = lasts[i]
            del firsts[i], lasts[i]
        elif after:
            firsts[i] = n
        elif before:
            lasts[i - 1] = n
        else:
            firsts.insert(i, n)
            lasts.insert(i, n)

    def free(self, base: str) -> int:
        firsts, lasts = self.runs.get(base, ([], []))
        return lasts[0] + 1 if firsts and firsts[0] == 2 else 2


def unique_titles(wanted: DataFrame, notes: DataFrame) -> DataFrame:
    """id, title of wanted(id, title), one after another in order of id: the title, or where it is taken by then, with the least suffix (2), (3), ... that is free.

    Titles that differ only in such suffixes are a family, which a task goes through in order; it holds runs of numbers, not the titles. Case and outer spaces don't count; an empty or null title is Untitled.
    """
    trimmed = F.coalesce(js_trim(F.col("title")), F.lit(""))
    asked = wanted.select("id", F.when(trimmed == "", "Untitled").otherwise(trimmed).alias("title"), F.lit(1).alias("turn"))
    there = notes.where("title IS NOT NULL").select(F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), "title", F.lit(0).alias("turn"))
    key = normalize(F.col("title"))
    family = F.regexp_replace(key, r"( \((?:[2-9]|[1-9][0-9]+)\))+$", "")
    asked, there = (df.withColumns({"key": key, "family": family}) for df in (asked, there))
    rows = there.join(asked.select("family").distinct(), "family", "left_semi").select(asked.columns).unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, _Taken()
        for batch in batches:
            kept, titles = [], []
            for i, (title, turn, key, family) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                if family != now:
                    now, taken = family, _Taken()
                if turn:
                    if taken.find(key):
                        n = taken.free(key)
                        title, key = f"{title} ({n})", f"{key} ({n})"
                    kept.append(i)
                    titles.append(title)
                taken.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(titles, pa.string())], names=["id", "title"])

    return rows.repartition("family").sortWithinPartitions("family", "turn", "id").mapInArrow(run, wanted.select("id", F.lit("").alias("title")).schema)


def rename_note(notes: DataFrame, ident: str, title: str) -> DataFrame:
    """Notes with one renamed and the links to its old title rewritten."""
    old = notes.where(F.col("id") == ident).select(F.col("title").alias("_old"))
    return notes.join(old).withColumn("markdown", rename_links(F.col("markdown"), F.col("_old"), F.lit(title))).withColumn("title", F.when(F.col("id") == ident, F.lit(title)).otherwise(F.col("title"))).drop("_old")


def daily_title(day: Column, prefix: str = "Daily") -> Column:
    return F.concat(F.lit(prefix + " "), F.date_format(day, "yyyy-MM-dd"))


def parse_daily(title: Column, prefix: str = "Daily") -> Column:
    """The day of a daily title, null for any other text or a day that doesn't exist."""
    text = F.regexp_extract(js_trim(title), rf"^{prefix}\s+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$", 1)
    return F.try_to_date(F.nullif(text, F.lit("")), "yyyy-MM-dd")


def library(notes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """id, title, tags, n_links, n_backlinks and a column for each key of a note."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_links"))
    back = edges.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("n_backlinks"))
    props = note_properties(notes).groupBy("id").pivot("key", keys).agg(F.first("value"))
    return notes.select("id", "title", F.array_join(F.array_sort(tags(F.col("markdown"))), ",").alias("tags")).join(out, "id", "left").join(back, "id", "left").join(props, "id", "left").fillna(0, ["n_links", "n_backlinks"])


def violations(notes: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, id: titles and ids used twice, relations with an end that is missing."""
    twice = lambda df, key, kind: df.groupBy(key.alias("id")).count().where("count > 1").select(F.lit(kind).alias("kind"), "id")
    end = lambda side: relations.join(entities.select(F.col("id").alias(side)), side, "left_anti").select(F.lit(f"relation without {side}").alias("kind"), "id")
    return (
        twice(notes, normalize(F.col("title")), "title twice")
        .unionByName(twice(notes, F.col("id"), "note id twice"))
        .unionByName(twice(entities, F.col("id"), "entity id twice"))
        .unionByName(end("source"))
        .unionByName(end("target"))
    )


# Canvases: nodes array<struct<id,x,y,width,height,grp>>, edges array<struct<source,target,label>>


def move_node(nodes: Column, ident: Column, x: Column, y: Column) -> Column:
    return F.transform(nodes, lambda n: F.when(n["id"] == ident, n.withField("x", x).withField("y", y)).otherwise(n))


def resize_node(nodes: Column, ident: Column, width: Column, height: Column) -> Column:
    """No node gets narrower than 80 or lower than 50."""
    return F.transform(nodes, lambda n: F.when(n["id"] == ident, n.withField("width", F.greatest(width, F.lit(80.0))).withField("height", F.greatest(height, F.lit(50.0)))).otherwise(n))


def add_edge(nodes: Column, edges: Column, source: Column, target: Column, label: Column) -> Column:
    """Edges with one more, unless it is there, joins a node with itself or an end is missing."""
    has = lambda i: F.exists(nodes, lambda n: n["id"] == i)
    there = F.exists(edges, lambda e: (e["source"] == source) & (e["target"] == target) & (F.coalesce(e["label"], F.lit("")) == F.coalesce(label, F.lit(""))))
    edge = F.struct(source.alias("source"), target.alias("target"), label.alias("label"))
    return F.when((source != target) & has(source) & has(target) & ~there, F.concat(edges, F.array(edge))).otherwise(edges)


def remove_node(nodes: Column, edges: Column, ident: Column) -> tuple[Column, Column]:
    """Nodes without one, and edges without its edges."""
    return F.filter(nodes, lambda n: n["id"] != ident), F.filter(edges, lambda e: (e["source"] != ident) & (e["target"] != ident))


def group_box(nodes: Column, members: Column) -> Column:
    """struct(x, y, width, height) around members: 24 on each side and 44 above."""
    inside = F.filter(nodes, lambda n: F.array_contains(members, n["id"]))
    left, top = F.array_min(F.transform(inside, lambda n: n["x"])), F.array_min(F.transform(inside, lambda n: n["y"]))
    right = F.array_max(F.transform(inside, lambda n: n["x"] + n["width"]))
    bottom = F.array_max(F.transform(inside, lambda n: n["y"] + n["height"]))
    return F.struct((left - 24).alias("x"), (top - 44).alias("y"), (right - left + 48).alias("width"), (bottom - top + 68).alias("height"))


def touch(recent: Column, ident: Column, limit: int = 20) -> Column:
    """The list with ident in front, once, and limit entries at most."""
    return F.slice(F.concat(F.array(ident), F.array_remove(recent, ident)), 1, limit)


def search_notes(notes: DataFrame, text: str) -> DataFrame:
    """Notes whose title or markdown holds the text, in any case."""
    return notes.where(F.contains(F.lower(F.concat_ws("\n", "title", "markdown")), F.lit(text.lower())))


def first_blocks(blocks: DataFrame, ident: str, k: int = 3) -> DataFrame:
    """ident, n_blocks and first, the first k blocks(ident, n, text) of each document as an array of structs."""
    w = Window.partitionBy(ident).orderBy("n")
    few = blocks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("first"))
    return blocks.groupBy(ident).agg(F.count("*").alias("n_blocks")).join(few, ident)


def dashboard(notes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, n: what a workspace holds, and what waits for review."""
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    waiting = entities.where("status = 'pending' and merged_into is null").select("id").unionByName(relations.where("status = 'pending'").select("id"))
    return (
        one(notes, "notes")
        .unionByName(one(entities.where("status = 'accepted' and merged_into is null"), "accepted entities"))
        .unionByName(one(relations.where("status = 'accepted'"), "accepted relations"))
        .unionByName(one(edges.where("resolved"), "resolved links"))
        .unionByName(one(waiting, "pending"))
    )


def forget(opened: Column, recent: Column, active: Column, ident: Column) -> Column:
    """struct(opened, recent, active) of a workspace without a note; where it was the active one, the last opened is."""
    left = F.array_remove(opened, ident)
    return F.struct(left.alias("opened"), F.array_remove(recent, ident).alias("recent"), F.when(active == ident, F.get(left, F.size(left) - 1)).otherwise(active).alias("active"))


def opened_with(opened: Column, ident: Column, most: int = 12) -> Column:
    """The open notes with one more at the end, once, the latest ``most`` of them."""
    every = F.array_distinct(F.concat(opened, F.array(ident)))
    return F.slice(every, F.greatest(F.lit(1), F.size(every) - most + 1), F.lit(most))


def daily_notes(notes: DataFrame, days: DataFrame, template: Column, prefix: str = "Daily") -> DataFrame:
    """Notes(id, title, markdown) with one for each of days(day) that has none under its title yet; {{date}} and {{title}} of the template are filled in."""
    title = daily_title(F.col("day"), prefix)
    body = expand_template(template, {"date": F.date_format("day", "yyyy-MM-dd"), "title": title})
    new = days.select("day").distinct().select(F.concat(F.lit("note-"), F.substring(F.sha2(title, 256), 1, 24)).alias("id"), title.alias("title"), body.alias("markdown"))
    missing = new.join(notes.select(normalize(F.col("title")).alias("_k")).distinct(), normalize(F.col("title")) == F.col("_k"), "left_anti")
    return notes.select("id", "title", "markdown").unionByName(missing)


def put_templates(templates: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates(id, title, body) after changes(seq, id, title, body), the last of each id standing, null leaving a part as it is; and the changes refused for an empty title or body."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("title", "body"), "seq").alias("_c"))
    j = templates.join(last, "id", "full")
    new = j.select("id", F.trim(F.coalesce("_c.title", "title")).alias("title"), F.coalesce("_c.body", "body").alias("body"), F.col("title").alias("_t"), F.col("body").alias("_b"))
    wrong = (F.coalesce("title", F.lit("")) == "") | (F.trim(F.coalesce("body", F.lit(""))) == "")
    kept = new.select("id", F.when(wrong, F.col("_t")).otherwise(F.col("title")).alias("title"), F.when(wrong, F.col("_b")).otherwise(F.col("body")).alias("body")).where("title is not null")
    return kept, new.where(wrong).select("id")
