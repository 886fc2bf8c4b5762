"""Notes, relations and sentences derived from the star-schema tables: the same rows in DataFrame and in SQL form.

The tables hold no wiki links, tags, front matter or dated sentences, so these templates make them, with every row of their tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import read_table, spread


KEYS = {"supplier": "s_suppkey", "customer": "c_custkey"}  # of the tables that grow


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    read = {n: read_table(spark, sf_dir, n) for n in names}
    return {n: spread(df, KEYS[n]) if n in KEYS else df for n, df in read.items()}


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, id, title, markdown: a note for each region, nation, supplier and customer."""
    t = _tables(spark, sf_dir, "region", "nation", "supplier", "customer")
    region = t["region"].select(F.col("r_regionkey").cast("long").alias("pos"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.concat(F.lit("# "), "r_name").alias("markdown"))
    nation = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        (1000 + F.col("n_nationkey")).cast("long").alias("pos"),
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.col("n_name").alias("title"),
        F.format_string("---\nregion: %s\nkey: %d\nbig: true\nnames: [%s, 'x']\n---\n# %s\n\nBelongs to [[%s]].", "r_name", "n_nationkey", "n_name", "n_name", "r_name").alias("markdown"),
    )
    supplier = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select(
        (10_000_000_000 + F.col("s_suppkey")).alias("pos"),
        F.concat(F.lit("s"), "s_suppkey").alias("id"),
        F.col("s_name").alias("title"),
        F.format_string("# %s\n\nBased in [[%s]]. #supplier #ops/%s", "s_name", "n_name", F.lower("n_name")).alias("markdown"),
    )
    customer = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        (20_000_000_000 + F.col("c_custkey")).alias("pos"),
        F.concat(F.lit("c"), "c_custkey").alias("id"),
        F.col("c_name").alias("title"),
        F.format_string("# %s\n\nBased in [[%s|home]], see [[%s#History]] and [[Missing %s]]. #%s\n\nIn %d %s trades with NATION_%d.", "c_name", "n_name", "n_name", "c_mktsegment", F.lower("c_mktsegment"), 1990 + F.col("c_custkey") % 35, "c_name", F.col("c_custkey") % 25).alias("markdown"),
    )
    return region.unionByName(nation).unionByName(supplier).unionByName(customer)


NOTES_SQL = """notes AS (
  SELECT r_regionkey::BIGINT AS pos, 'r' || r_regionkey AS id, r_name AS title, '# ' || r_name AS markdown FROM region
  UNION ALL SELECT 1000 + n_nationkey, 'n' || n_nationkey, n_name, '---' || chr(10) || 'region: ' || r_name || chr(10) || 'key: ' || n_nationkey || chr(10) || 'big: true' || chr(10) || 'names: [' || n_name || ', ''x'']' || chr(10) || '---' || chr(10) || '# ' || n_name || chr(10) || chr(10) || 'Belongs to [[' || r_name || ']].' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 10000000000 + s_suppkey, 's' || s_suppkey, s_name, '# ' || s_name || chr(10) || chr(10) || 'Based in [[' || n_name || ']]. #supplier #ops/' || lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 20000000000 + c_custkey, 'c' || c_custkey, c_name, '# ' || c_name || chr(10) || chr(10) || 'Based in [[' || n_name || '|home]], see [[' || n_name || '#History]] and [[Missing ' || c_mktsegment || ']]. #' || lower(c_mktsegment) || chr(10) || chr(10) || 'In ' || (1990 + c_custkey % 35) || ' ' || c_name || ' trades with NATION_' || c_custkey % 25 || '.' FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, status, merged_into, aliases, evidence, pos. Suppliers divisible by 7 are pending, those divisible by 11 merged."""
    t = _tables(spark, sf_dir, "region", "nation", "supplier", "customer")
    make = lambda df, kind, key, name, status="'accepted'", merged="cast(null as string)": df.selectExpr(
        f"concat('{kind}', {key}) id", f"{name} name", f"{status} status", f"{merged} merged_into", f"array(concat('the ', lower({name}))) aliases", f"array(concat('b{kind}', {key})) evidence"
    )
    return (
        make(t["region"], "r", "r_regionkey", "r_name")
        .unionByName(make(t["nation"], "n", "n_nationkey", "n_name"))
        .unionByName(make(t["supplier"], "s", "s_suppkey", "s_name", "if(s_suppkey % 7 = 0, 'pending', 'accepted')", "if(s_suppkey % 11 = 0, 's1', null)"))
        .unionByName(make(t["customer"], "c", "c_custkey", "c_name"))
    )


ENTITIES_SQL = """entities AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'accepted' AS status, NULL::VARCHAR AS merged_into, ['the ' || lower(r_name)] AS aliases, ['br' || r_regionkey] AS evidence FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'accepted', NULL, ['the ' || lower(n_name)], ['bn' || n_nationkey] FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN 'pending' ELSE 'accepted' END, CASE WHEN s_suppkey % 11 = 0 THEN 's1' END, ['the ' || lower(s_name)], ['bs' || s_suppkey] FROM supplier
  UNION ALL SELECT 'c' || c_custkey, c_name, 'accepted', NULL, ['the ' || lower(c_name)], ['bc' || c_custkey] FROM customer
)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, id, source, target, relation, status, evidence, confidence, observed_at, valid_from, valid_to."""
    t = _tables(spark, sf_dir, "nation", "supplier", "customer")
    make = lambda df, base, src, key, dst, to: df.selectExpr(
        f"cast({base} + {key} as long) pos",
        f"concat('{src}', {key}, '::part-of::{dst}', {to}) id",
        f"concat('{src}', {key}) source",
        f"concat('{dst}', {to}) target",
        "'part-of' relation",
        f"if({key} % 13 = 5, 'rejected', 'accepted') status",
        f"array(concat('b{src}', {key}), concat('b{dst}', {to})) evidence",
        f"0.5 + ({key} % 5) / 10.0D confidence",
        f"concat(cast(1990 + {key} % 35 as string), '-05-17') observed_at",
        f"if({key} % 3 = 0, concat(cast(1985 + {key} % 30 as string), '-01'), null) valid_from",
        f"if({key} % 6 = 0, cast(1999 + {key} % 20 as string), null) valid_to",
    )
    return make(t["nation"], 0, "n", "n_nationkey", "r", "n_regionkey").unionByName(make(t["supplier"], 10_000_000_000, "s", "s_suppkey", "n", "s_nationkey")).unionByName(make(t["customer"], 20_000_000_000, "c", "c_custkey", "n", "c_nationkey"))


def _relations_sql() -> str:
    def one(table: str, base: int, src: str, key: str, dst: str, to: str) -> str:
        return (
            f"SELECT ({base} + {key})::BIGINT AS pos, '{src}' || {key} || '::part-of::{dst}' || {to} AS id, '{src}' || {key} AS source, '{dst}' || {to} AS target, 'part-of' AS relation,"
            f" CASE WHEN {key} % 13 = 5 THEN 'rejected' ELSE 'accepted' END AS status, ['b{src}' || {key}, 'b{dst}' || {to}] AS evidence, 0.5::DOUBLE + ({key} % 5) / 10.0::DOUBLE AS confidence,"
            f" (1990 + {key} % 35)::VARCHAR || '-05-17' AS observed_at, CASE WHEN {key} % 3 = 0 THEN (1985 + {key} % 30)::VARCHAR || '-01' END AS valid_from, CASE WHEN {key} % 6 = 0 THEN (1999 + {key} % 20)::VARCHAR END AS valid_to FROM {table}"
        )

    parts = [one("nation", 0, "n", "n_nationkey", "r", "n_regionkey"), one("supplier", 10_000_000_000, "s", "s_suppkey", "n", "s_nationkey"), one("customer", 20_000_000_000, "c", "c_custkey", "n", "c_nationkey")]
    return "relations AS (" + " UNION ALL ".join(parts) + ")"


RELATIONS_SQL = _relations_sql()


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, text: what each customer ordered and when, from orders, with verbs by priority. Orders are dealt into tasks by their customers, since what is looked for in a sentence costs far more than its bytes tell."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    verb = "CASE o_orderkey % 4 WHEN 0 THEN 'uses' WHEN 1 THEN 'acquired' WHEN 2 THEN 'depends on' ELSE 'and' END"
    text = f"concat('Buyer', c_custkey, ' ', {verb}, ' Clerk', o_orderkey % 97, ' on ', date_format(o_orderdate, 'yyyy-MM-dd'), '. See https://x.example/', o_orderkey % 50, ')')"
    o = spread(o.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey block_id", f"{text} text", "o_orderdate")


SENTENCES_SQL = """sentences AS (
  SELECT o_orderkey AS block_id, o_orderdate, 'Buyer' || c_custkey || ' ' || CASE o_orderkey % 4 WHEN 0 THEN 'uses' WHEN 1 THEN 'acquired' WHEN 2 THEN 'depends on' ELSE 'and' END
    || ' Clerk' || o_orderkey % 97 || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || '. See https://x.example/' || o_orderkey % 50 || ')' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
