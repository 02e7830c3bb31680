"""Markdown bundles: front matter, sections and tables by lines.

A text becomes an array of lines; section headings are carried down within the array, so nothing
shuffles and the lines of one document stay in one row until they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), value."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def headings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, level, title of `#` headings."""
    at = lines(df, key, text).where(F.col("value").rlike("^#{1,6} "))
    return at.select(key, "line", F.char_length(F.regexp_extract("value", "^(#+) ", 1)).alias("level"), F.trim(F.regexp_replace("value", "^#+ ", "")).alias("title"))


def _sections(text: str) -> Column:
    """Lines with the title of the `## ` section that they stand in, by one fold along the array."""
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<line:int,section:string,value:string>>").alias("out"))

    def step(acc, x):
        section = F.when(x["value"].rlike("^## "), F.trim(F.substring(x["value"], 4, 2**31 - 1))).otherwise(acc["section"])
        return F.struct(section.alias("section"), F.when(x["value"].rlike(r"^\s*\|"), F.concat(acc["out"], F.array(F.struct(x["line"].alias("line"), section.alias("section"), x["value"].alias("value"))))).otherwise(acc["out"]).alias("out"))

    numbered = F.transform(F.split(text, "\n"), lambda v, i: F.struct((i + 1).alias("line"), v.alias("value")))
    return F.aggregate(numbered, start, step)["out"]


def table_rows(df: DataFrame, section: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, section, cells of table rows, without the rule under a head. section: only rows below that heading."""
    has = F.col(text).rlike(r"(?m)^\s*\|")
    rows = df.where(has).select(key, F.explode(_sections(text)).alias("r")).select(key, "r.line", "r.section", F.trim("r.value").alias("value"))
    rows = rows.where(~F.col("value").rlike(r"^\|[\s:|-]+$"))
    if section is not None:
        rows = rows.where(F.col("section") == section)
    inner = F.regexp_replace(F.regexp_replace("value", r"^\|", ""), r"\|$", "")
    return rows.select(key, "line", "section", F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c)).alias("cells"))


def front_matter(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, value of the `name: value` lines between leading `---` rules."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    return df.select(key, F.explode(F.split(block, "\n")).alias("l")).where(F.col("l").rlike(r"^[A-Za-z_][\w-]*\s*:")).select(key, F.regexp_extract("l", r"^([\w-]+)\s*:", 1).alias("name"), F.trim(F.regexp_replace("l", r"^[\w-]+\s*:", "")).alias("value"))


def edges(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, target, verb of front-matter relationships written `- target: X` with an optional `type: verb`; the verb is `references` where none is given."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    items = F.regexp_extract_all(block, F.lit(r"(?m)^\s*-\s*(?:\{\s*)?target:\s*([^\n,}]+)(?:[,\n]\s*type:\s*([^\n}]+))?"), F.lit(0))
    each = df.select(key, F.explode(items).alias("i"))
    verb = F.trim(F.regexp_extract("i", r"type:\s*([^\n}]+)", 1))
    return each.select(key, F.trim(F.regexp_extract("i", r"target:\s*([^\n,}]+)", 1)).alias("target"), F.when(verb == "", "references").otherwise(verb).alias("verb")).distinct()


def properties(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fields of the `## Properties` table: name, type_ref, lower, upper, rule."""
    r = table_rows(df, "Properties", key, text).where("lower(cells[0]) <> 'field'")
    m = F.get("cells", F.lit(2))
    lower = F.regexp_extract(m, r"^(\d+)", 1).cast("long")
    upper = F.when(m.rlike(r"\*$"), F.lit(None)).when(m.rlike(r"\.\."), F.regexp_extract(m, r"\.\.(\d+)$", 1)).otherwise(F.regexp_extract(m, r"^(\d+)$", 1))
    return r.select(key, "line", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("type_ref"), lower.alias("lower"), upper.cast("long").alias("upper"), F.get("cells", F.lit(3)).alias("rule"))
