"""Corpora that are derived from the given tables, with the same rule in Spark and in SQL.

The given prose holds no requirements, references or quantities, so the domain
operators work on a specification corpus made of line items, parts and
suppliers; feedback, caches and history are made of events and conversations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per order line: chunk_id, file_name, section_number, section_title, page_number, pos, text."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").alias("qty"))
    parts, suppliers = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(parts, F.col("pk") == F.col("p_partkey")).join(suppliers, F.col("sk") == F.col("s_suppkey"))
    section = F.concat_ws(".", F.col("p_size") % 9 + 1, F.col("l_linenumber"))
    kind = F.col("l_linenumber") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("The cable for "), "p_name", F.lit(" shall be rated "), F.col("qty").cast("long").cast("string"), F.lit(" A in accordance with EN "), (50000 + F.col("pk") % 90).cast("string"), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("Conductor size must be at least "), F.col("p_size").cast("string"), F.lit(" mm2 as specified in Section "), section, F.lit(".")))
        .when(kind == 2, F.concat(F.lit("The luminaire should provide "), (100 * F.col("p_size")).cast("string"), F.lit(" lux per IS "), (3000 + F.col("pk") % 40).cast("string"), F.lit(".")))
        .otherwise(F.concat(F.lit("This standard supersedes BS "), (5000 + F.col("pk") % 50).cast("string"), F.lit(".")))
    )
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"),
        F.concat(F.lit("SPEC-"), F.col("s_nationkey").cast("string")).alias("file_name"),
        section.alias("section_number"),
        F.col("p_name").alias("section_title"),
        (F.col("l_orderkey") % 40 + 1).alias("page_number"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        text.alias("text"),
    )


SPEC_SQL = """
    spec AS (
        SELECT l_orderkey || '-' || l_linenumber AS chunk_id, 'SPEC-' || s_nationkey AS file_name,
               (p_size % 9 + 1) || '.' || l_linenumber AS section_number, p_name AS section_title,
               l_orderkey % 40 + 1 AS page_number, l_orderkey * 10 + l_linenumber AS pos,
               CASE l_linenumber % 4
                   WHEN 0 THEN 'The cable for ' || p_name || ' shall be rated ' || qty::BIGINT || ' A in accordance with EN ' || (50000 + pk % 90) || '.'
                   WHEN 1 THEN 'Conductor size must be at least ' || p_size || ' mm2 as specified in Section ' || (p_size % 9 + 1) || '.' || l_linenumber || '.'
                   WHEN 2 THEN 'The luminaire should provide ' || (100 * p_size) || ' lux per IS ' || (3000 + pk % 40) || '.'
                   ELSE 'This standard supersedes BS ' || (5000 + pk % 50) || '.' END AS text
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS qty FROM lineitem GROUP BY ALL)
        JOIN part ON pk = p_partkey JOIN supplier ON sk = s_suppkey
    )"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: feedback_id, ts, query, document_name, page_number, feedback_type, stars, rating."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return e.select(
        F.col("event_id").alias("feedback_id"),
        "ts",
        "user_id",
        F.concat(F.lit("what is the rating of part "), (F.col("user_id") % 40).cast("string")).alias("query"),
        F.concat(F.lit("SPEC-"), (k % 25).cast("string")).alias("document_name"),
        (k % 7).alias("page_number"),
        F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral").alias("feedback_type"),
        (F.col("event_id") % 5 + 1).cast("int").alias("stars"),
        F.when(F.col("event_type") == "error", "irrelevant").when(F.col("event_type") == "view", "not_helpful").otherwise("helpful").alias("rating"),
    )


FEEDBACK_SQL = """
    fb AS (
        SELECT event_id AS feedback_id, ts, user_id, 'what is the rating of part ' || (user_id % 40) AS query, 'SPEC-' || (k % 25) AS document_name, k % 7 AS page_number,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS feedback_type,
               (event_id % 5 + 1)::INTEGER AS stars,
               CASE WHEN event_type = 'error' THEN 'irrelevant' WHEN event_type = 'view' THEN 'not_helpful' ELSE 'helpful' END AS rating
        FROM (SELECT *, coalesce(json_extract_string(props, '$.k')::INTEGER, 0) AS k FROM events)
    )"""


def spec_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown document per order: a heading of level 1 to 3 and its text for each line, in order of line."""
    order, line = F.floor(F.col("pos") / 10), F.col("pos") % 10
    level = (line % 3 + 1).cast("int")
    body = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "section_number", F.lit(" "), "section_title", F.lit("\n"), "text")
    parts = spec_chunks(spark, sf_dir).groupBy(order.alias("doc")).agg(F.sort_array(F.collect_list(F.struct(line.alias("line"), body.alias("body")))).alias("parts"))
    return parts.select(F.concat(F.lit("ORD-"), F.col("doc").cast("string")).alias("doc_name"), F.array_join(F.col("parts.body"), "\n").alias("text"))


def spec_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order that holds a caption and a Markdown table of its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_quantity").cast("long").alias("qty"))
    row = F.concat(F.lit("| Part "), F.col("pk").cast("string"), F.lit(" | "), F.col("qty").cast("string"), F.lit(" A | "), (F.col("pk") % 50).cast("string"), F.lit(" |"))
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), row.alias("row")))).alias("rows"))
    head = F.concat(F.lit("Intro line.\nTable "), (F.col("l_orderkey") % 9 + 1).cast("string"), F.lit(": Ratings\n| Item | Current | Code |\n|---|---|---|\n"))
    return rows.select(F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("doc_name"), F.concat(head, F.array_join(F.col("rows.row"), "\n"), F.lit("\nEnd.")).alias("text"))


#: Clauses of technical documents: text, and in braces the numbers that follow from a line item.
CLAUSES = (
    "The cable length of run shall not exceed {q} m and the conductor size shall be {d}.5 mm2 per EN 50{e}-1-{n}.",
    "The rated current of the breaker must be {q} A at 230 V; the response time is {d}00 ms.",
    "Bedding sand in the trench shall be 1,{d} m deep for the cable duct. In use since {y}.",
    "The ambient temperature of the motor panel shall be between {t} °C and 40.5 °C.",
    "Power cables shall not be laid in the trench without sand bedding and protection of {d}0 mm.",
    "Power cables shall be laid in the trench with sand bedding and protection of {d}0 mm.",
    "The voltage drop of the lighting circuit should be below {d}.2 % of {h} V.",
    "The motor may run at {x} rpm with a torque of {t} Nm, weight {s} kg.",
    "IEC 60364 of {y} requires {q} kW for the transformer; a pipe pressure of {d} bar is required.",
    "The panel lighting must give {x} lux in the motor room, with {t} dB of noise.",
    "The depth of the cable trench shall be {m} mm and the maximum cable length {t} m.",
    "A fuse rating of {q} A is mandatory for the cable in the duct; see BS-{b}.",
)
_NUMBERS = {"q": "qty", "d": "pk % 9 + 1", "e": "100 + pk % 90", "n": "line", "y": "1985 + pk % 50", "t": "pk % 60", "h": "100 + pk % 60", "x": "10 * qty", "s": "sk", "m": "100 * qty", "b": "1000 + pk % 7000"}


def _clause(text: str, quoted) -> list:
    """The parts of a clause: texts, and expressions of numbers as text."""
    parts = re.split(r"\{(\w)\}", text)
    return [f"CAST({_NUMBERS[p]} AS {quoted})" if i % 2 else "'" + p + "'" for i, p in enumerate(parts) if p]


def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per order line, a document per order: chunk_id, file_name, section_number, section_title, pos, text."""
    name = F.concat(F.lit("DOC-"), F.col("l_orderkey").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(name.alias("file_name"), "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey", "l_quantity")
    # dealt by document while rows are numbers: what joins or groups documents finds them in place
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_name")
    lines = lines.groupBy("file_name", "l_orderkey", "line").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("long").alias("qty"))
    kinds = " ".join(f"WHEN {i} THEN concat({', '.join(_clause(t, 'STRING'))})" for i, t in enumerate(CLAUSES))
    return lines.select(
        F.concat_ws("-", "l_orderkey", "line").alias("chunk_id"),
        "file_name",
        F.concat_ws(".", F.col("pk") % 9 + 1, "line").alias("section_number"),
        F.when(F.col("pk") % 3 == 0, "").otherwise(F.concat(F.lit("Part "), (F.col("pk") % 100).cast("string"))).alias("section_title"),
        F.col("line").alias("pos"),
        F.expr(f"CASE (pk + 3 * line) % {len(CLAUSES)} {kinds} END").alias("text"),
    )


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_doc, reference_doc): each order's document against that of the same customer's next order."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", following.alias("next")).filter("next IS NOT NULL")
    return rows.select(F.concat(F.lit("DOC-"), F.col("o_orderkey").cast("string")).alias("source_doc"), F.concat(F.lit("DOC-"), F.col("next").cast("string")).alias("reference_doc"))


CLAUSE_SQL = f"""
    cl AS (
        SELECT l_orderkey || '-' || line AS chunk_id, 'DOC-' || l_orderkey AS file_name, (pk % 9 + 1) || '.' || line AS section_number,
               CASE WHEN pk % 3 = 0 THEN '' ELSE 'Part ' || (pk % 100) END AS section_title, line AS pos,
               CASE (pk + 3 * line) % {len(CLAUSES)} {' '.join(f"WHEN {i} THEN {' || '.join(_clause(t, 'VARCHAR'))}" for i, t in enumerate(CLAUSES))} END AS text
        FROM (SELECT l_orderkey, l_linenumber::BIGINT AS line, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY ALL)
    ),
    op AS (SELECT 'DOC-' || o_orderkey AS source_doc, 'DOC-' || nxt AS reference_doc FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL)"""
