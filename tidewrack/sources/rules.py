"""Rules: defaults, YAML overlays, validation and selection, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidewrack.functions import regex
from tidewrack.sources.rule_pack import RULES

TYPES = ("content", "filename", "extension")
SEVERITIES = ("low", "medium", "high", "critical")
CONFIDENCES = ("", "low", "medium", "high")
ACTIONS = ("report", "skip", "prioritize")
_DEFAULTS = {
    "description": "", "enabled": True, "action": "report", "severity": "medium", "confidence": "", "case_sensitive": False, "tags": [], "category": "",
    "include_paths": [], "exclude_paths": [], "file_extensions": [], "max_file_size": 0, "explanation": "", "remediation": "",
}
KEYS = {"id", "name", "type", "pattern", *_DEFAULTS}
TOP = {"version", "name", "description", "rules"}
SCHEMA = (
    "id string, name string, description string, type string, pattern string, category string, severity string, confidence string, action string, explanation string, "
    "remediation string, case_sensitive boolean, enabled boolean, tags array<string>, include_paths array<string>, exclude_paths array<string>, file_extensions array<string>, max_file_size long"
)


@dataclass
class Loaded:
    """Valid rules in order, and what was wrong with others."""

    rules: list[dict] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def validate(rule: dict) -> list[str]:
    """What is wrong with a rule that has its defaults."""
    name = rule.get("id") or "a rule without id"
    out = [f"{name}: unknown key {k}" for k in sorted(set(rule) - KEYS)]
    out += [f"{name}: {k} is missing" for k in ("id", "name", "type", "pattern", "category") if not str(rule.get(k) or "").strip()]
    for key, allowed in (("type", TYPES), ("severity", SEVERITIES), ("confidence", CONFIDENCES), ("action", ACTIONS)):
        if rule.get(key) and rule[key] not in allowed:
            out.append(f"{name}: {key} {rule[key]!r} is unknown")
    if not isinstance(rule.get("max_file_size"), int) or rule["max_file_size"] < 0:
        out.append(f"{name}: max_file_size must be a number of bytes")
    if rule.get("pattern") and (why := regex.check(rule["pattern"])):
        out.append(f"{name}: pattern: {why}")
    return out


def collect(documents: list[tuple[str, dict]]) -> Loaded:
    """Rules of parsed rule files (name and content); of rules with one id the first counts."""
    out, seen = Loaded(), {}
    for where, doc in documents:
        if not isinstance(doc, dict) or doc.get("version") != 1:
            out.issues.append(f"{where}: version must be 1")
            continue
        out.warnings += [f"{where}: unknown key {k}" for k in sorted(set(doc) - TOP)]
        for raw in doc.get("rules") or []:
            rule = _DEFAULTS | raw
            wrong = validate(rule)
            if not wrong and rule["id"] in seen:
                wrong = [f"{rule['id']}: also in {seen[rule['id']]}"]
            if wrong:
                out.issues += [f"{where}: {w}" for w in wrong]
                continue
            seen[rule["id"]] = where
            out.rules.append(rule)
    return out


def default_rules() -> list[dict]:
    """The rule pack."""
    return [dict(r) for r in RULES]


def load(paths: list[str] | None = None, with_defaults: bool = True) -> Loaded:
    """The pack and the YAML files below ``paths``, in order of their paths."""
    import yaml

    documents = [("defaults", {"version": 1, "rules": RULES})] if with_defaults else []
    found: set[Path] = set()
    for p in map(Path, paths or []):
        found |= {p} if p.is_file() else {x for x in p.rglob("*") if x.suffix in (".yml", ".yaml")}
    for p in sorted(found):
        try:
            documents.append((str(p), yaml.safe_load(p.read_text()) or {}))
        except yaml.YAMLError as e:
            documents.append((str(p), {"version": None}))
            documents[-1][1]["error"] = str(e)
    return collect(documents)


def select(rules: list[dict], enable: set[str] = frozenset(), disable: set[str] = frozenset(), tags: set[str] = frozenset(), without_tags: set[str] = frozenset(), least_severity: str = "low") -> list[dict]:
    """Rules that run: enabled (or named so), with a wanted tag and no unwanted one, severe enough. Skip rules are always severe enough."""
    rank = SEVERITIES.index
    out = []
    for r in rules:
        own = {t.lower() for t in r["tags"]}
        on = (r["enabled"] or r["id"] in enable) and r["id"] not in disable
        if on and (not tags or own & tags) and not own & without_tags and (r["action"] == "skip" or rank(r["severity"]) >= rank(least_severity)):
            out.append(r)
    return out


def of_type(rules: list[dict], kind: str) -> list[dict]:
    """Rules of a type that report, in order."""
    return [r for r in rules if r["type"] == kind and r["action"] != "skip"]


def table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a table."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rules], SCHEMA)
