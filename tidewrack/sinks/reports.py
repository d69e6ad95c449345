"""Reports of findings: tables are written by Spark, only bounded summaries reach the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import quality as Q
from tidewrack.functions import text as X
from tidewrack.operators import summary

#: Findings that a page of text lists; all are in the tables.
LISTED = 500
COLUMNS = ("host", "share", "file_path", "rule_id", "category", "severity", "confidence", "match", "tags")


def redacted(findings: DataFrame) -> DataFrame:
    """Findings whose evidence has its secret values starred out."""
    shown: dict[str, Column] = {c: Q.redact(F.col(c)) for c in ("match", "context") if c in findings.columns}
    return findings.withColumns(shown)


def _flat(findings: DataFrame) -> DataFrame:
    have = [c for c in COLUMNS if c in findings.columns]
    return findings.select(*[F.array_join(c, ",").alias(c) if c == "tags" else F.col(c) for c in have])


def write_csv(findings: DataFrame, path: str, clear: bool = False) -> None:
    """A row for each finding; evidence is redacted unless ``clear``."""
    _flat(findings if clear else redacted(findings)).write.option("header", True).option("escape", '"').csv(path)


def write_json(findings: DataFrame, path: str, clear: bool = False) -> None:
    """A line for each finding, and one document with the summaries beside them."""
    (findings if clear else redacted(findings)).write.json(f"{path}/findings")
    spark = findings.sparkSession
    parts = {"categories": summary.by_category(findings), "severities": summary.by_severity(findings)}
    body = {name: [r.asDict() for r in df.collect()] for name, df in parts.items()}  # a row for each category and severity
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.text(f"{path}/summary")


def read_json(findings_path: str, spark, schema: str | None = None) -> DataFrame:
    """Findings of an earlier report."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{findings_path}/findings")


def _listed(findings: DataFrame, clear: bool) -> tuple[list, list, list]:
    order = [X.severity_rank(F.col("severity")).desc(), "host", "share", "file_path", "rule_id"]
    rows = _flat(findings if clear else redacted(findings)).orderBy(*order).limit(LISTED).collect()
    return rows, summary.by_category(findings).orderBy(F.desc("n"), "category").collect(), summary.by_severity(findings).collect()


def markdown(findings: DataFrame, clear: bool = False) -> str:
    """Summary tables and the most severe findings."""
    rows, categories, severities = _listed(findings, clear)
    cell = lambda v: str(v if v is not None else "").replace("|", "\\|").replace("\n", " ")
    table = lambda head, body: ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *["| " + " | ".join(map(cell, r)) + " |" for r in body]]
    out = ["# Findings", "", *table(["severity", "findings"], [(r["severity"], r["n"]) for r in severities]), ""]
    out += [*table(["category", "findings", "highest"], [(r["category"], r["n"], r["highest"]) for r in categories]), ""]
    head = [c for c in COLUMNS if rows and c in rows[0]]
    return "\n".join([*out, *table(head, [[r[c] for c in head] for r in rows]), ""])


def page(findings: DataFrame, clear: bool = False) -> str:
    """The same as one HTML page."""
    rows, categories, severities = _listed(findings, clear)
    tag = lambda name, values: "<tr>" + "".join(f"<{name}>{html.escape(str(v if v is not None else ''))}</{name}>" for v in values) + "</tr>"
    table = lambda head, body: "<table>" + tag("th", head) + "".join(tag("td", r) for r in body) + "</table>"
    head = [c for c in COLUMNS if rows and c in rows[0]]
    parts = [table(["severity", "findings"], [(r["severity"], r["n"]) for r in severities]), table(["category", "findings", "highest"], [(r["category"], r["n"], r["highest"]) for r in categories]), table(head, [[r[c] for c in head] for r in rows])]
    return "<!doctype html><meta charset=utf-8><title>Findings</title><h1>Findings</h1>" + "".join(parts)


def write_audit(audit: DataFrame, path: str) -> None:
    """Targets and what became of them, separated by tabs."""
    audit.write.option("header", True).option("sep", "\t").csv(path)


def fan_out(findings: DataFrame, sinks: list) -> None:
    """Give findings to several sinks (callables), computed once."""
    kept = findings.persist()
    try:
        for s in sinks:
            s(kept)
    finally:
        kept.unpersist()
