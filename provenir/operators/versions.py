"""Versions of a set of tables, and portable copies: a manifest is written last and commits them all.

A version's tables lie in a folder of their own; its manifest has each table's number of rows and checksum and is created exclusively, so of
two writers one fails. A reader takes the newest whole manifest: what a writer left unfinished is never seen, and a swap is a single file. A copy in the
same form is taken over only if every table is as its manifest says and no reference is broken; else what stood before stands.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recovery import portable_violations

FORMAT = 3
# The tables of a portable copy, and what later formats added.
REQUIRED = ("notes", "documents", "blocks", "entities", "relations", "canvases", "views", "trash", "snapshots")
ADDED = {2: ("review_audit", "query_traces"), 3: ("templates", "workspace_state", "migrations", "semantic_suggestions")}
DERIVED = ("embeddings",)  # made again rather than copied


def fingerprint(df: DataFrame) -> dict[str, str]:
    """Rows and a checksum that doesn't depend on their order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))) if df.columns else F.lit(0)
    got = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return {"rows": str(got.rows), "sum": got["sum"]}


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def manifests(spark: SparkSession, base: str) -> list[dict]:
    """The whole manifests of a folder, oldest first."""
    files, place = _place(spark, base)
    if not files.exists(place):
        return []
    names = sorted(x.getPath().toString() for x in files.listStatus(place) if x.getPath().getName().startswith("manifest-"))
    out = []
    for name in names:
        row = spark.read.text(name, wholetext=True).first()
        try:
            out.append(json.loads(row[0]) if row else None)
        except ValueError:  # its writer was lost
            continue
    return [m for m in out if m]


def publish(spark: SparkSession, tables: dict[str, DataFrame], base: str, form: int = FORMAT) -> int:
    """Write all tables as the next version of the folder and commit it; the version's number. Raises FileExistsError if another writer was faster."""
    files, place = _place(spark, base)
    taken = [int(x.getPath().getName()[9:17]) for x in files.listStatus(place) if x.getPath().getName().startswith("manifest-")] if files.exists(place) else []
    number, data = max(taken, default=0) + 1, f"{base}/data-{uuid.uuid4().hex}"
    listed = {}
    for name, df in tables.items():
        if name in DERIVED:
            continue
        df.write.parquet(f"{data}/{name}")
        listed[name] = fingerprint(spark.read.parquet(f"{data}/{name}"))
    text = json.dumps({"format": form, "number": number, "data": data.rsplit("/", 1)[1], "tables": listed})
    _, manifest = _place(spark, f"{base}/manifest-{number:08}.json")
    if files.exists(manifest):
        raise FileExistsError(f"version {number} was published meanwhile")
    out = files.create(manifest, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    return number


def current(spark: SparkSession, base: str, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of the newest version. Raises ValueError if there is none, or, with ``verify``, if a table isn't as the manifest says."""
    known = manifests(spark, base)
    if not known:
        raise ValueError(f"no version in {base}")
    return _tables(spark, base, known[-1], verify)


def _tables(spark: SparkSession, base: str, manifest: dict, verify: bool) -> dict[str, DataFrame]:
    out = {}
    for name, listed in manifest["tables"].items():
        path = f"{base}/{manifest['data']}/{name}"
        try:
            out[name] = spark.read.parquet(path)
            sound = not verify or fingerprint(out[name]) == listed
        except Exception as e:  # missing or unreadable files come as various errors
            raise ValueError(f"table {name} of the copy can't be read") from e
        if not sound:
            raise ValueError(f"table {name} of the copy isn't what its manifest says")
    return out


def upgraded(spark: SparkSession, tables: dict[str, DataFrame], form: int) -> dict[str, DataFrame]:
    """Tables of format 1, 2 or 3 as of format 3: those that later formats added are empty. Raises ValueError for another format or a missing table."""
    if form not in (1, 2, FORMAT):
        raise ValueError(f"no such format: {form}")
    lost = [name for name in REQUIRED if name not in tables]
    if lost:
        raise ValueError(f"the copy lacks {', '.join(lost)}")
    later = [name for v in sorted(ADDED) for name in ADDED[v]]
    return {k: tables[k] for k in REQUIRED} | {k: tables.get(k, spark.createDataFrame([], "id string")) for k in later}


def broken(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, id of what ``portable_violations`` finds, and of suggested links without an entity at an end or without evidence."""
    found = portable_violations(tables)
    links = tables.get("semantic_suggestions")
    if links is not None and {"source", "target", "evidence"} <= set(links.columns):
        ids = tables["entities"].select("id")
        for side in ("source", "target"):
            found = found.unionByName(links.join(ids.withColumnRenamed("id", side), side, "left_anti").select(F.lit("suggestion without entity").alias("kind"), "id"))
        found = found.unionByName(links.where("coalesce(size(evidence), 0) <= 0").select(F.lit("suggestion without evidence").alias("kind"), "id"))
    return found


def take_over(spark: SparkSession, copy: str, base: str) -> int:
    """Replace the tables of a folder by those of a copy, upgraded; the new version's number. Whatever is wrong with the copy raises ValueError and leaves the folder as it was.

    Derived tables aren't taken over: what rests on the old ones, such as embeddings, is gone with the swap.
    """
    known = manifests(spark, copy)
    if not known:
        raise ValueError(f"no copy in {copy}")
    tables = upgraded(spark, _tables(spark, copy, known[-1], True), known[-1]["format"])
    wrong = broken(tables).limit(5).collect()
    if wrong:
        raise ValueError(f"the copy isn't consistent: {[tuple(r) for r in wrong]}")
    return publish(spark, tables, base)
