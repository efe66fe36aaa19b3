"""Markdown documents: sections with places, bullets, checklists, decision ledgers, status documents; the share of each excerpt."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Fixed value: what counts as a heading: one to six number signs, blanks, a title.
HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", re.MULTILINE)
#: A bullet, its box if it has one, and its text.
BULLET = r"^\s*-\s+(?:\[([ xX])\]\s+)?(\S.*)$"


def section_rows(text: str) -> Iterator[tuple[str, int, str, int, int, int, int]]:
    """(heading, level, text, first line, last line, start, end) of each section: from its heading to the next one of any level."""
    found = list(HEADING.finditer(text))
    line, at = 1, 0
    for here, after in zip(found, [*found[1:], None]):
        end = after.start() if after else len(text)
        line, at = line + text.count("\n", at, here.start()), here.start()
        yield here[2].strip(), len(here[1]), text[at:end], line, line + text.count("\n", at, max(at, end - 1)), at, end


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, heading, level, text, start_line, end_line, start_char, end_char); texts without a heading, empty and null ones have none."""
    ship(docs.sparkSession)
    names = [id_col, "ordinal", "heading", "level", "text", "start_line", "end_line", "start_char", "end_char"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, k, *s) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1]) for k, s in enumerate(section_rows(t))], columns=names)

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ordinal long, heading string, level long, text string, start_line long, end_line long, start_char long, end_char long"
    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).mapInPandas(run, schema)


def plain_tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def section_score(heading: Column, text: Column, query: list[str]) -> Column:
    """Four for each word of the query in the heading, one for each in the section."""
    q = F.array(*map(F.lit, query))
    return 4 * F.size(F.array_intersect(plain_tokens(heading), q)) + F.size(F.array_intersect(plain_tokens(text), q))


def best_sections(found: DataFrame, query: list[str], per: str = "doc_id", most: int = 3) -> DataFrame:
    """The sections of each document that score most, ties in the order of the text; sections without any word of the query stay out."""
    scored = found.withColumn("score", section_score(F.col("heading"), F.col("text"), query)).where("score > 0")
    w = Window.partitionBy(per).orderBy(F.desc("score"), "ordinal")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def level_two(text: Column) -> Column:
    """The sections under ## headings as array<struct<heading, body>>; a body runs to the next ## heading, deeper headings included."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n##[ \t]+"), lambda p, i: i > 0)
    cut = lambda p: F.struct(F.trim(F.regexp_replace(F.substring_index(p, "\n", 1), r"[ \t\r]+$", "")).alias("heading"), F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p)).alias("body"))
    return F.transform(parts, cut)


def section_body(text: Column, heading: str) -> Column:
    """The body of the first ## section with this heading; null without one."""
    return F.try_element_at(F.filter(level_two(text), lambda s: s["heading"] == heading), F.lit(1))["body"]


def first_line(body: Column) -> Column:
    """The first line that is not blank, trimmed; null without one."""
    return F.try_element_at(F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))


def bullets(body: Column) -> Column:
    """array<struct<text, checked>>: checked is null for a bullet without a box."""
    held = F.filter(F.split(body, r"\r?\n"), lambda x: F.rlike(x, F.lit(BULLET)))
    box = lambda x: F.regexp_extract(x, BULLET, 1)
    return F.transform(held, lambda x: F.struct(F.rtrim(F.regexp_extract(x, BULLET, 2)).alias("text"), F.when(box(x) != "", F.lower(box(x)) == "x").alias("checked")))


def completion(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, total, completed, percentage) of the bullets under ## headings; unless every bullet has a box, nothing is known of completion."""
    all_of = F.flatten(F.transform(level_two(F.col(text_col)), lambda s: bullets(s["body"])))
    d = docs.select(id_col, all_of.alias("b")).where(F.size("b") > 0)
    known = F.forall("b", lambda x: x["checked"].isNotNull())
    done = F.when(known, F.size(F.filter("b", lambda x: x["checked"])))
    return d.select(id_col, F.size("b").cast("long").alias("total"), done.cast("long").alias("completed"), F.round(100 * done / F.size("b"), 2).alias("percentage"))


def status_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, status, in_progress, pending, next_step) of documents with the sections STATUS, IN PROGRESS, PENDING and NEXT STEP; one that lacks any stays out."""
    t = F.col(text_col)
    texts = lambda name: F.transform(bullets(section_body(t, name)), lambda b: b["text"])
    d = docs.select(id_col, first_line(section_body(t, "STATUS")).alias("status"), texts("IN PROGRESS").alias("in_progress"), texts("PENDING").alias("pending"), first_line(section_body(t, "NEXT STEP")).alias("next_step"))
    return d.dropna(subset=["status", "in_progress", "pending", "next_step"])


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids: str = r"[A-Z]+-ADR-[0-9]+") -> DataFrame:
    """(id, decision_id, title, status) of ledgers with a ## heading "ID - title" and a **Status:** line for each; a ledger with one that has no status has no rows."""
    head = rf"^({ids})[ \t]+[—-][ \t]+(.+)$"
    held = F.filter(level_two(F.col(text_col)), lambda s: F.rlike(s["heading"], F.lit(head)))
    state = lambda s: F.regexp_extract(s["body"], r"(?m)^\*\*Status:\*\*[ \t]*(\S.*?)[ \t\r]*$", 1)
    rows = F.transform(held, lambda s: F.struct(F.regexp_extract(s["heading"], head, 1).alias("decision_id"), F.regexp_extract(s["heading"], head, 2).alias("title"), state(s).alias("status")))
    d = docs.select(id_col, rows.alias("r")).where(F.forall("r", lambda r: r["status"] != ""))
    return d.select(id_col, F.explode("r").alias("r")).select(id_col, "r.*")


def fair_excerpts(items: DataFrame, group: str, order: str, text: str, budget: int, most: int = 1600) -> DataFrame:
    """(group, order, excerpt): each text in turn may use an equal share of the characters that are left to it and those after it, at most `most`.

    A group is one document's governance sections, so it is short; its shares are a fold over its lengths in order.
    """
    g = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n")))).alias("x"))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        share = F.floor(acc["left"] / (F.size("x") - F.size(acc["cuts"]))).cast("int")
        cut = F.least(x["n"], share, F.lit(most))
        return F.struct((acc["left"] - cut).alias("left"), F.concat(acc["cuts"], F.array(cut)).alias("cuts"))

    cuts = g.select(group, F.explode(F.arrays_zip(F.col("x.o").alias(order), F.aggregate("x", start, step)["cuts"].alias("_cut"))).alias("z")).select(group, "z.*")
    return items.select(group, order, text).join(cuts, [group, order]).select(group, order, F.left(text, F.col("_cut")).alias("excerpt"))
