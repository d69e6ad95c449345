"""All queries of the triage operators, with their DuckDB equivalents."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import quality as Q
from tidewrack.functions import text as X
from tidewrack.operators import compare, crossfile, findings, gating, inspect_db, inspect_paths, matching, planner, review, summary
from tidewrack.plans import duck
from tidewrack.sources import content, rules, scratch, vfs
from tidewrack.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
RULES = rules.select(rules.default_rules())
PLACED = ["file_id", "host", "share", "file_path", "name", "extension", "size", "modified_at", "source", "from_sysvol"]
CONTENT = rules.of_type(RULES, "content")
SUPPRESSIONS = [
    {"id": "s1", "enabled": True, "categories": ["scripts"], "shares": ["it-ops"]},
    {"id": "s2", "enabled": True, "path_contains": ["/archive/", "temp/"]},
    {"id": "s3", "enabled": False, "hosts": ["fs01.corp.example"]},
    {"id": "s4", "enabled": True, "rule_ids": ["filename.password_manager_artifacts", "extension.sensitive_config_extensions"], "hosts": ["dc02.corp.example"]},
]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


_FILES = f"WITH {vfs.CTE} "
_HITS = f"WITH {duck.hits(RULES)} "


_HIT = ("rule_id", "signal_type", "category", "severity", "confidence", "match", "tags")


def _as_hits(matches: Column, signal: Callable[[Column], Column]) -> Column:
    """Matches of rules or detectors as structs alike."""
    return F.transform(matches, lambda m: F.struct(*[(signal(m) if n == "signal_type" else m[n]).cast("array<string>" if n == "tags" else "string").alias(n) for n in _HIT]))


def _path_found() -> Column:
    p = F.col("__path")
    return F.concat(inspect_paths.backup_matches(p), inspect_paths.browser_matches(p), inspect_paths.windows_matches(p), inspect_paths.aws_matches(p), inspect_db.artifact_matches())


@X.untraced
def all_hits(files: DataFrame) -> DataFrame:
    """Matches of all rules, contents included, and of the detectors that need only a path: each file is read once, by all of them."""
    files = X.once(files, __path=inspect_paths.path())
    of_rules = lambda m: m["rule_type"]
    named, inside = F.array_compact(F.array(*matching.metadata_hits(RULES))), matching.content_found(RULES, F.col("text"))
    every = F.concat(_as_hits(named, of_rules), F.when(F.col("text").isNotNull(), _as_hits(inside, of_rules)).otherwise(F.array()), _as_hits(_path_found(), lambda _: F.lit("validated")))
    rows = X.once(files, __hits=X.aside(every)).select(*PLACED, F.explode("__hits").alias("h")).select(*PLACED, "h.*")
    return rows.withColumn("confidence_score", F.when(F.col("signal_type") == "validated", 40).when(F.col("signal_type") == "content", 32).when(F.col("signal_type") == "filename", 18).otherwise(10))


@X.untraced
def path_hits(files: DataFrame) -> DataFrame:
    """Matches of the detectors that need only a path."""
    files = X.once(files.drop("text"), __path=inspect_paths.path())
    files = X.once(files, __found=X.aside(_path_found())).drop("__path")
    return files.select("*", F.explode("__found").alias("m")).select("*", "m.rule_id", "m.category", "m.severity", "m.confidence", "m.match", "m.tags").drop("__found", "m").withColumn("signal_type", F.lit("validated"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_hits(vfs.files(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the files of the corpus lie, without a look at their texts."""
    return vfs.files(spark, sf_dir, "file_id", "host", "share", "file_path", "name", "extension", "source")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(f"{_FILES} SELECT file_id, host, share, file_path, name, extension, size, modified_at, source, length(text) AS n_chars FROM files")
def vfs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file corpus."""
    return vfs.files(spark, sf_dir).select("file_id", "host", "share", "file_path", "name", "extension", "size", "modified_at", "source", F.length("text").alias("n_chars"))


@_query(f"{_FILES} SELECT file_id, regexp_extract(file_path, '([^/]*)$', 1) AS base, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(name, '([.][^./]*)$', 1)) AS ext, len(string_split(file_path, '/')) - 1 AS depth FROM files")
def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of paths."""
    p = X.slashes(F.col("file_path"))
    return vfs.files(spark, sf_dir).select("file_id", X.base_name(p).alias("base"), X.directory(p).alias("dir"), X.extension(X.base_name(p)).alias("ext"), planner.depth(p).cast("long").alias("depth"))


def _skip_sql() -> str:
    cases = []
    for r in RULES:
        if r["action"] == "skip":
            on = "lower(extension)" if r["type"] == "extension" else "name"
            cases.append(f"WHEN {duck.eligible(r)} AND regexp_matches({on}, {duck.pattern(r)}) THEN {duck.text(r['id'])}")
    return "CASE " + " ".join(cases) + " END"


@_query(f"{_FILES} SELECT file_id, {_skip_sql()} AS skip_rule FROM files")
def skip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first skip rule of each file."""
    return vfs.files(spark, sf_dir).select("file_id", gating.skip_rule(RULES).alias("skip_rule"))


@_query(_FILES + " UNION ALL ".join(f"SELECT {duck.text(r['id'])} AS rule_id, count(*) FILTER (WHERE {duck.eligible(r)}) AS n FROM files" for r in RULES))
def rule_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files that each rule may look at."""
    wide = vfs.files(spark, sf_dir).agg(*[F.count_if(gating.eligible(r)).alias(r["id"].replace(".", "_")) for r in RULES])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r["id"]).alias("rule_id"), F.col(r["id"].replace(".", "_")).alias("n")) for r in RULES])).alias("x")).select("x.*")


def _gate_sql() -> str:
    ext = "CASE WHEN ends_with(lower(name), '.tar.gz') THEN '.tar.gz' ELSE lower(extension) END"
    kind = f"CASE WHEN {ext} IN {duck.among(gating.ARCHIVES)} THEN 'archive' WHEN {ext} = '.wim' THEN 'wim' WHEN {ext} IN {duck.among(gating.SQLITE)} THEN 'sqlite' ELSE 'standard' END"
    rule = " OR ".join(duck.eligible(r) for r in rules.of_type(RULES, "content"))
    aws = "contains(lower(file_path), '/.aws/') AND regexp_matches(lower(name), '^(?:credentials|config)(?:\\.(?:bak|old|backup|copy))?$')"
    hinted = f"({duck.any_of('lower(file_path)', inspect_db.HINTS)} OR {duck.any_of('lower(name)', inspect_db.HINTS)})"
    db = f"lower(name) IN {duck.among(inspect_db.FILES)} OR lower(extension) IN ('.dsn', '.sql', '.udl', '.ora') OR (lower(extension) IN {duck.among(inspect_db.TEXTS)} AND {hinted})"
    read = f"((size <= {gating.Limits().max_read} AND ({rule})) OR ({aws}) OR lower(name) IN {duck.among(inspect_paths.KEY_FILES)} OR {db} OR kind <> 'standard')"
    return f"{_FILES}, k AS (SELECT *, {kind} AS kind, {_skip_sql()} AS skip_rule FROM files), l AS (SELECT *, CASE WHEN skip_rule IS NOT NULL THEN 'matched skip rule' WHEN kind = 'archive' AND size > {gating.Limits().archive_max} THEN 'archive exceeds its size limit' WHEN kind = 'sqlite' AND size > {gating.Limits().sqlite} THEN 'database exceeds its size limit' WHEN kind = 'wim' AND size > {gating.Limits().wim} THEN 'image exceeds its size limit' END AS skip_reason FROM k) SELECT file_id, kind, skip_reason, skip_reason IS NULL AND {read} AS needs_content FROM l"


@_query(_gate_sql())
def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file is handled as, and whether it is read."""
    return gating.decide(vfs.files(spark, sf_dir), RULES).select("file_id", "kind", "skip_reason", "needs_content")


@_query(f"{_FILES} SELECT file_id FROM files WHERE lower(share) IN ('sysvol', 'it-ops') AND NOT (file_path LIKE 'vol0/Deploy%' AND (file_path = 'vol0/Deploy' OR file_path LIKE 'vol0/Deploy/%')) AND len(string_split(file_path, '/')) - 1 <= 5")
def share_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and paths of a plan."""
    rows = planner.allow_shares(vfs.files(spark, sf_dir), include=["SYSVOL", "IT-Ops"])
    return planner.allow_paths(rows, exclude=["vol0/Deploy"], max_depth=5).select("file_id")


@_query(f"{_FILES} SELECT share, count(*) AS n FROM files WHERE lower(share) IN ('sysvol', 'netlogon') GROUP BY share")
def policy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files of policy shares."""
    return planner.allow_shares(vfs.files(spark, sf_dir), only_policy=True).groupBy("share").agg(F.count("*").alias("n"))


@_query(f"{_FILES} SELECT DISTINCT share, CASE WHEN upper(share) = 'SYSVOL' THEN 'sysvol' WHEN ends_with(share, '$') THEN 'disk-hidden' ELSE 'disk' END AS share_type FROM files")
def share_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of shares."""
    return vfs.files(spark, sf_dir).select("share", planner.share_type(F.col("share")).alias("share_type")).distinct()


@_query(f"{_FILES} SELECT * FROM ({duck.rule_hits(rules.of_type(RULES, 'filename') + rules.of_type(RULES, 'extension'), 'file_id')})")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: matches of file name and extension rules."""
    rows = matching.metadata_matches(vfs.files(spark, sf_dir), RULES)
    return rows.select("file_id", "rule_id", F.col("rule_type").alias("signal_type"), "category", "severity", "match")


_LINE = "length(substr(text, 1, instr(text, match) - 1)) - length(replace(substr(text, 1, instr(text, match) - 1), chr(10), '')) + 1"


@_query(f"{_FILES}, c AS ({duck.rule_hits(CONTENT, 'file_id, text')}) SELECT file_id, rule_id, category, severity, match, CAST({_LINE} AS INTEGER) AS line FROM c")
def content_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M6: first match of each content rule, and its line."""
    return matching.content_matches(vfs.files(spark, sf_dir), CONTENT).select("file_id", "rule_id", "category", "severity", "match", "line")


_ASSIGNED = f"SELECT file_id, unnest(regexp_extract_all(text, {duck.text(Q.ASSIGNMENT)}, 4)) AS v FROM files"
_CHARS = "string_split(v, '')"


@_query(
    f"{_FILES}, a AS ({_ASSIGNED}) SELECT file_id, v AS value, round(-list_sum(list_transform(list_distinct({_CHARS}), lambda c: (len(list_filter({_CHARS}, lambda x: x = c)) / length(v)) * log2(len(list_filter({_CHARS}, lambda x: x = c)) / length(v)))), 6) + 0.0 AS entropy, "
    f"CAST(regexp_matches(v, '\\p{{Ll}}') AS INTEGER) + CAST(regexp_matches(v, '\\p{{Lu}}') AS INTEGER) + CAST(regexp_matches(v, '\\p{{Nd}}') AS INTEGER) + CAST(regexp_matches(v, '[^\\p{{Ll}}\\p{{Lu}}\\p{{Nd}}]') AS INTEGER) AS classes, CAST(len(list_distinct({_CHARS})) AS INTEGER) AS n_unique FROM a"
)
def value_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned values with their entropy, classes and different characters."""
    rows = vfs.files(spark, sf_dir).select("file_id", F.explode(X.all_matches(F.col("text"), Q.ASSIGNMENT, 4)).alias("value"))
    v = F.col("value")
    return rows.select("file_id", "value", F.round(Q.entropy(v), 6).alias("entropy"), Q.classes(v).alias("classes"), Q.unique(v).alias("n_unique"))


@_query(f"{_FILES}, a AS ({_ASSIGNED}) SELECT file_id, v AS value, unnest({duck.value_quality('v')}) FROM a")
def value_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of assigned values."""
    rows = vfs.files(spark, sf_dir).select("file_id", F.explode(X.all_matches(F.col("text"), Q.ASSIGNMENT, 4)).alias("value"))
    return rows.select("file_id", "value", Q.value_quality(F.col("value")).alias("q")).select("file_id", "value", "q.*")


@_query(f"{_FILES} SELECT file_id, {duck.redacted('text')} AS text FROM files")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: texts with their secrets starred out."""
    return vfs.files(spark, sf_dir).select("file_id", Q.redact(F.col("text")).alias("text"))


def _key_sql() -> str:
    header = "CASE " + " ".join(f"WHEN contains(text, '-----BEGIN {k}PRIVATE KEY-----') THEN '-----BEGIN {k}PRIVATE KEY-----'" for k in inspect_paths.KEY_KINDS) + " END"
    return f"{_FILES} SELECT file_id, {header} AS match FROM files WHERE lower(name) IN {duck.among(inspect_paths.KEY_FILES)} AND {header} IS NOT NULL"


@_query(_key_sql())
def key_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private keys by name and header."""
    return vfs.files(spark, sf_dir).select("file_id", F.explode(inspect_paths.key_matches(F.col("text"))).alias("m")).select("file_id", "m.match")


_COUNTED = {"creates": r"(?im)\bCREATE\s+TABLE\b", "inserts": r"(?im)\bINSERT\s+INTO\b", "drops": r"(?im)\bDROP\s+TABLE\s+IF\s+EXISTS\b", "locks": r"(?im)\bLOCK\s+TABLES\b"}


@_query(f"{_FILES} SELECT * FROM (SELECT file_id, {', '.join(f'CAST(len(regexp_extract_all(text, {duck.text(p)})) AS INTEGER) AS {n}' for n, p in _COUNTED.items())} FROM files) WHERE creates + inserts + drops + locks > 0")
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of SQL dumps."""
    rows = vfs.files(spark, sf_dir).select("file_id", inspect_db.sql_counts(F.col("text")).alias("c"))
    return rows.select("file_id", *[f"c.{n}" for n in _COUNTED]).where("creates + inserts + drops + locks > 0")


@_query(f"{_FILES} SELECT file_id, rule_id, category, severity, match FROM ({duck.path_hits('file_id')})")
def path_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors that need only a path."""
    return path_hits(vfs.files(spark, sf_dir)).select("file_id", "rule_id", "category", "severity", "match")


@_query()
def connection_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection strings and URLs."""
    return inspect_db.connections(vfs.files(spark, sf_dir)).select("file_id", "rule_id", "severity", "match", "ecosystem", "line", "user", "has_password")


@_query()
def dsn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of INI files."""
    return inspect_db.sections(vfs.files(spark, sf_dir)).select("file_id", "rule_id", "severity", "match", "ecosystem", "section")


@_query(duck.tns_blocks())
def tns_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of network files."""
    return inspect_db.tns_services(vfs.files(spark, sf_dir)).select("file_id", "alias", "host_name", "port", "service", "match", "line")


@_query(duck.cloud_bundles())
def cloud_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cloud profiles, by their places only."""
    return vfs.files(spark, sf_dir).where(inspect_paths.is_aws()).select("file_id", F.explode(inspect_paths.aws_content_matches(F.col("text"))).alias("m")).select("file_id", "m.rule_id", "m.match", "m.line")


@_query(f"{_FILES}, p AS (SELECT file_id, {duck.file_score()} AS priority FROM files) SELECT file_id, priority, CASE WHEN priority >= 120 THEN 'critical' WHEN priority >= 80 THEN 'high' WHEN priority >= 40 THEN 'medium' ELSE 'low' END AS band FROM p")
def planned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of files."""
    return planner.score_files(vfs.files(spark, sf_dir)).select("file_id", "priority", planner.band(F.col("priority")).alias("band"))


@_query(duck.pairs(RULES))
def cross_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefacts that complete each other."""
    rows = _hits(spark, sf_dir).withColumns({"context": F.col("match"), "matched_rule_ids": F.array("rule_id")})
    return crossfile.correlated(rows).select("host", "share", "file_path", "rule_id", "severity", "confidence_score", "match")


@_query(duck.exposure(RULES, 8))
def exposure_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ways in."""
    rows = _hits(spark, sf_dir).withColumns({"context": F.col("match"), "matched_rule_ids": F.array("rule_id")})
    return crossfile.exposure_paths(crossfile.correlated(rows), top=8)


def _meets_sql(r: dict) -> str:
    on = {"categories": "lower(category)", "shares": "lower(share)", "hosts": "lower(host)", "rule_ids": "lower(rule_id)"}
    parts = [f"{on[c]} IN {duck.among(v)}" for c, v in r.items() if c in on] + ([duck.any_of("lower(file_path)", r["path_contains"])] if "path_contains" in r else [])
    return " AND ".join(parts)


_SUPPRESSED = "CASE " + " ".join(f"WHEN {_meets_sql(r)} THEN {duck.text(r['id'])}" for r in SUPPRESSIONS if r["enabled"]) + " END"
_PRINT = f"concat_ws('|', lower(rule_id), lower(host), lower(share), lower(file_path), {duck.norm('match')})"


@_query(f"{_HITS} SELECT file_id, rule_id FROM hits WHERE {_SUPPRESSED} IS NULL")
def suppression_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no rule suppresses."""
    return review.survivors(_hits(spark, sf_dir), SUPPRESSIONS).select("file_id", "rule_id")


@_query(f"{_HITS}, s AS (SELECT {_SUPPRESSED} AS suppression_id, {_PRINT} AS f FROM hits), n AS (SELECT *, row_number() OVER (PARTITION BY suppression_id ORDER BY f) AS pos FROM s WHERE suppression_id IS NOT NULL) SELECT suppression_id, count(*) AS n, string_agg(f, ';' ORDER BY f) FILTER (WHERE pos <= 3) AS samples FROM n GROUP BY suppression_id")
def suppression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed findings by rule."""
    return review.suppression_summary(_hits(spark, sf_dir), SUPPRESSIONS)


@_query(f"{_HITS} SELECT host, share, file_path, rule_id, match, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY lower(host), lower(share), lower(file_path), lower(rule_id), lower(category), {duck.norm('match')} ORDER BY confidence_score DESC) AS n FROM hits) WHERE n = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: findings without exact repeats."""
    return review.exact_dedup(_hits(spark, sf_dir)).select("host", "share", "file_path", "rule_id", "match", "confidence_score")


@_query(f"{_HITS}, p AS (SELECT DISTINCT rule_id, category, match, confidence_score, concat_ws('/', lower(host), lower(share), file_path) AS place FROM hits), q AS (SELECT *, row_number() OVER (PARTITION BY rule_id, category, match ORDER BY confidence_score DESC, place) AS pos FROM p) SELECT rule_id, category, match, max(CASE WHEN pos = 1 THEN place END) AS canonical, count(*) AS n_places, string_agg(place, ';' ORDER BY place) FILTER (WHERE pos <= 20) AS places FROM q GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material that stands in several places."""
    return review.duplicate_groups(_hits(spark, sf_dir))


@_query(f"{_HITS} SELECT category, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE severity = {duck.text(s)}) AS {s}' for s in summary.SEVERITIES[1:])}, arg_max(severity, severity_rank) AS highest FROM hits GROUP BY category")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: findings by category."""
    return summary.by_category(_hits(spark, sf_dir))


@_query(f"{_HITS} SELECT s.severity, count(hits.file_id) AS n FROM (SELECT unnest({list(summary.SEVERITIES)}) AS severity) s LEFT JOIN hits USING (severity) GROUP BY s.severity")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: findings by severity."""
    return summary.by_severity(_hits(spark, sf_dir))


@_query(f"{_HITS} SELECT host, count(*) AS n, count(DISTINCT share) AS shares, count(DISTINCT category) AS categories, bool_or(severity = 'critical') AS has_critical, bool_or(from_sysvol) AS has_policy_share FROM hits GROUP BY host")
def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by host."""
    return summary.by_host(_hits(spark, sf_dir))


@_query(f"{_HITS} SELECT 'category' AS kind, category AS name, count(*) AS n FROM hits GROUP BY category UNION ALL SELECT 'severity', severity, count(*) FROM hits GROUP BY severity UNION ALL SELECT 'rule', rule_id, count(*) FROM hits GROUP BY rule_id")
def benchmark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by category, severity and rule."""
    return summary.benchmark_counts(_hits(spark, sf_dir))


@_query(f"{_HITS} SELECT " + ", ".join(f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS {c}" for c in ("category", "severity", "source", "signal_type")) + " FROM hits")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a report filters by."""
    return summary.filter_options(_hits(spark, sf_dir))


@_query(f"{_HITS} SELECT * FROM (SELECT count(DISTINCT host) AS hosts, count(DISTINCT (host, share)) AS shares, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files), (SELECT count(*) AS findings, count(DISTINCT file_id) AS files_with_findings FROM hits)")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was looked at and found."""
    return summary.scan_summary(vfs.files(spark, sf_dir), _hits(spark, sf_dir))


@_query(f"{_FILES} SELECT lower(extension) AS extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest FROM files WHERE lower(extension) IN ('.bak', '.wim', '.mtf') GROUP BY 1")
def backup_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backup files."""
    return summary.backup_inventory(vfs.files(spark, sf_dir))


@_query(
    f"{_FILES}, c AS ({duck.rule_hits([r for r in CONTENT if r['id'] in summary.EXPORTED], 'host, share, file_path')}) SELECT rule_id, host, substr(sha256(trim(match)), 1, 16) AS value, count(DISTINCT (share, file_path)) AS n_places, string_agg(DISTINCT share || '/' || file_path, ';' ORDER BY share || '/' || file_path) AS places FROM c GROUP BY 1, 2, 3"
)
def credential_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exportable credentials, as digests."""
    return summary.credential_inventory(matching.content_matches(vfs.files(spark, sf_dir), CONTENT))


def _runs(hits: DataFrame) -> DataFrame:
    """Findings of this run and the one before, from one pass: the one before didn't know the hosts of one source, and judged one share less severe."""
    run = lambda name, severity: F.struct(F.lit(name).alias("run"), severity.alias("severity"))
    severity = F.col("severity")
    sides = F.array_compact(F.array(run("now", severity), F.when(F.col("source") != "ldap", run("before", F.when(F.col("share") == "it-ops", F.lit("low")).otherwise(severity)))))
    return hits.select(*[c for c in hits.columns if c != "severity"], F.explode(sides).alias("side")).select("*", "side.*").drop("side")


_KEYS = f"lower(rule_id) AS rule, lower(host) AS host_key, lower(share) AS share_key, lower(file_path) AS path, {duck.norm('match')} AS match_key, category, severity, confidence_score, signal_type"
_BEFORE = f"before AS (SELECT {_KEYS.replace(' severity,', ' CASE WHEN share = ' + duck.text('it-ops') + ' THEN ' + duck.text('low') + ' ELSE severity END AS severity,')} FROM hits WHERE source <> 'ldap'), now AS (SELECT {_KEYS} FROM hits)"


@_query(
    f"{_HITS}, {_BEFORE} SELECT rule, host_key, share_key, path, match_key, CASE WHEN b.category IS NULL THEN 'new' WHEN c.category IS NULL THEN 'removed' WHEN b.severity <> c.severity THEN 'changed' ELSE 'unchanged' END AS status, "
    "CASE WHEN b.severity <> c.severity THEN 'severity' ELSE '' END AS changed_fields FROM before b FULL JOIN now c USING (rule, host_key, share_key, path, match_key)"
)
def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against the one before."""
    return compare.diff_runs(_runs(_hits(spark, sf_dir).drop("confidence")))


@_query(f"{_HITS}, {_BEFORE} SELECT coalesce(b.severity, c.severity) AS severity, coalesce(b.n, 0) AS before, coalesce(c.n, 0) AS now, coalesce(c.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT severity, count(*) AS n FROM before GROUP BY 1) b FULL JOIN (SELECT severity, count(*) AS n FROM now GROUP BY 1) c ON b.severity = c.severity")
def class_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: counts against the run before."""
    return compare.class_deltas_of_runs(_runs(_hits(spark, sf_dir)), "severity")


_LABELS = "labels_ AS (SELECT 'e' || file_id AS id, lower(file_path) AS p, CASE WHEN extension IN ('.txt', '') THEN 'credentials' ELSE 'configuration' END AS c, CASE WHEN name = 'SAM' THEN 'filename.secret_store_artifacts' END AS wanted FROM files WHERE extension IN ('.txt', '', '.xml', '.ini', '.yaml'))"
_JUDGED = f"{_HITS}, {_LABELS}, j AS (SELECT id, coalesce(bool_or(hit), false) AS matched, count(*) FILTER (WHERE hit) AS n_findings, coalesce(bool_or(hit AND severity_rank >= 3), false) AS severity_ok, coalesce(bool_or(hit), false) AS confidence_ok FROM (SELECT l.id, h.severity_rank, h.rule_id IS NOT NULL AND (l.wanted IS NULL OR h.rule_id = l.wanted) AS hit FROM labels_ l LEFT JOIN hits h ON lower(h.file_path) = l.p AND h.category = l.c) GROUP BY id)"


def _labels(files: DataFrame) -> DataFrame:
    """What a reviewer expects of the corpus."""
    kind = F.when(F.col("extension").isin(".txt", ""), "credentials").otherwise("configuration")
    wanted = F.when(F.col("name") == "SAM", F.array(F.lit("filename.secret_store_artifacts"))).otherwise(F.array().cast("array<string>"))
    return files.where(F.col("extension").isin(".txt", "", ".xml", ".ini", ".yaml")).select(
        F.concat(F.lit("e"), F.col("file_id").cast("string")).alias("id"), F.col("file_path").alias("path"), kind.alias("category"), wanted.alias("rule_ids"), F.lit("high").alias("minimum_severity"), F.lit("").alias("minimum_confidence")
    )


@_query(f"{_JUDGED} SELECT * FROM j")
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations and what met them."""
    return compare.judge(_hits(spark, sf_dir), _labels(_placed(spark, sf_dir)))


_NOISY = "noisy AS (SELECT h.* FROM hits h ANTI JOIN labels_ l ON lower(h.file_path) = l.p AND h.category = l.c)"


@_query(f"{_HITS}, {_LABELS}, {_NOISY} SELECT file_id, rule_id FROM noisy")
def eval_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that nobody expects."""
    return compare.noisy(_hits(spark, sf_dir), _labels(_placed(spark, sf_dir))).select("file_id", "rule_id")


@_query(f"{_JUDGED}, {_NOISY} SELECT expected, matched, expected - matched AS missed, noisy, round(matched / (matched + noisy), 6) AS precision_like, round(matched / expected, 6) AS recall_like FROM (SELECT count(*) AS expected, count(*) FILTER (WHERE matched) AS matched FROM j), (SELECT count(*) AS noisy FROM noisy)")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall."""
    return compare.judge_summary(_hits(spark, sf_dir), _labels(_placed(spark, sf_dir)))


_MANIFEST = "manifest AS (SELECT host, share, file_path AS path, CASE WHEN extension IN ('.log', '.md') THEN 'noise' ELSE 'planted' END AS intended_as, CASE WHEN extension = '' THEN 'actionable' ELSE 'config-only' END AS expected_class FROM files WHERE source <> 'file')"


def _manifest(files: DataFrame) -> DataFrame:
    return files.where("source <> 'file'").select(
        "host", "share", F.col("file_path").alias("path"), F.when(F.col("extension").isin(".log", ".md"), "noise").otherwise("planted").alias("intended_as"), F.when(F.col("extension") == "", "actionable").otherwise("config-only").alias("expected_class")
    )


_VERIFIED = f"{_HITS}, {_MANIFEST}, v AS (SELECT m.*, coalesce(f.observed, 0) AS observed, f.observed IS NOT NULL AS found FROM manifest m LEFT JOIN (SELECT host, share, lower(file_path) AS p, max(severity_rank) AS observed FROM hits GROUP BY ALL) f ON m.host = f.host AND m.share = f.share AND lower(m.path) = f.p WHERE m.intended_as <> 'noise')"


@_query(f"{_VERIFIED} SELECT host, share, path, intended_as, expected_class, observed, found FROM v")
def verify_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted items and what was found."""
    return compare.verify(_hits(spark, sf_dir), _manifest(_placed(spark, sf_dir)))


@_query(f"{_VERIFIED} SELECT expected_class, count(*) AS expected, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE NOT found) AS missed FROM v GROUP BY expected_class")
def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of planted items."""
    return compare.coverage(compare.verify(_hits(spark, sf_dir), _manifest(_placed(spark, sf_dir))), "expected_class")


@_query(f"{_HITS}, {_MANIFEST} SELECT file_id, rule_id FROM hits h ANTI JOIN manifest m ON h.host = m.host AND h.share = m.share AND lower(h.file_path) = lower(m.path)")
def verify_unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at places that weren't planted."""
    return compare.unexpected(_hits(spark, sf_dir), _manifest(_placed(spark, sf_dir))).select("file_id", "rule_id")


_TARGETS = "targets AS (SELECT c_custkey AS seq, 'FS' || c_nationkey || '.corp.example' AS host, CASE WHEN c_mktsegment = 'BUILDING' THEN '10.0.0.' || c_nationkey ELSE '' END AS ip, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ldap' ELSE 'cli' END AS source, c_acctbal >= 0 AS reachable FROM customer)"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("string")
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), F.concat(F.lit("FS"), nation, F.lit(".corp.example")).alias("host"), F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("10.0.0."), nation)).otherwise("").alias("ip"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "ldap").otherwise("cli").alias("source"), (F.col("c_acctbal") >= 0).alias("reachable"),
    )


_UNIQUE = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(ip, ''), lower(host)) ORDER BY seq) AS n FROM targets) WHERE n = 1)"


@_query(f"WITH {_TARGETS}, {_UNIQUE} SELECT seq, host, ip, source, reachable FROM u")
def target_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, each once."""
    return summary.unique_targets(_targets(spark, sf_dir))


@_query(f"WITH {_TARGETS}, {_UNIQUE} SELECT * FROM (SELECT count(*) AS loaded FROM targets), (SELECT count(*) AS unique_targets, count(*) FILTER (WHERE reachable) AS reachable, count(*) FILTER (WHERE NOT reachable) AS skipped FROM u)")
def target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of targets."""
    return summary.target_stats(_targets(spark, sf_dir))


@_query(f"WITH {_TARGETS}, planned AS (SELECT 'fs' || n_nationkey || '.corp.example' AS host, '10.0.0.' || n_nationkey AS ip FROM nation WHERE n_regionkey <= 1) SELECT seq, host, ip, source, reachable, ok AS scanned, CASE WHEN ok THEN '' WHEN NOT reachable THEN 'unreachable' ELSE 'not planned' END AS skip_reason FROM (SELECT *, lower(host) IN (SELECT host FROM planned) OR ip IN (SELECT ip FROM planned) AS ok FROM targets)")
def target_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and what became of them."""
    nation = F.col("n_nationkey").cast("string")
    planned = _table(spark, sf_dir, "nation").where("n_regionkey <= 1").select(F.concat(F.lit("fs"), nation, F.lit(".corp.example")).alias("host"), F.concat(F.lit("10.0.0."), nation).alias("ip"))
    return summary.target_audit(_targets(spark, sf_dir), planned)


_HINTS = "hints AS (SELECT DISTINCT 'fs' || n_nationkey || '.corp.example' AS host, n_name AS share FROM nation)"


@_query("SELECT DISTINCT '\\\\FS' || n_nationkey || '.corp.example\\' || replace(n_name, ' ', '_') || '\\root' AS unc, 'fs' || n_nationkey || '.corp.example' AS server, replace(n_name, ' ', '_') AS share, 'root' AS path FROM nation")
def dfs_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servers, shares and paths of UNC names."""
    unc = F.concat(F.lit("target \\\\FS"), F.col("n_nationkey").cast("string"), F.lit(".corp.example\\"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("\\root; state=online"))
    return summary.dfs_targets(_table(spark, sf_dir, "nation").select(unc.alias("attribute")), "attribute")


_DONE = "done AS (SELECT host, share, file_path, size, CASE WHEN share = 'Users$' THEN modified_at - 1 ELSE modified_at END AS modified_at FROM files WHERE source <> 'ldap')"


@_query(f"{_FILES}, {_DONE} SELECT file_id FROM files f ANTI JOIN done d ON f.host = d.host AND f.share = d.share AND f.file_path = d.file_path AND f.size = d.size AND f.modified_at = d.modified_at")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are still to be done."""
    files = vfs.files(spark, sf_dir).drop("text")
    done = files.where("source <> 'ldap'").withColumn("modified_at", F.when(F.col("share") == "Users$", F.col("modified_at") - 1).otherwise(F.col("modified_at")))
    return compare.resume(files, done).select("file_id")


@_query(f"{_FILES} SELECT host, share, count(*) AS n_files, bool_and(size < 100000 AND share <> 'Users$') AS completed FROM files GROUP BY host, share")
def share_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: shares that are done."""
    return compare.completed_shares(vfs.files(spark, sf_dir).withColumns({"ok": F.col("size") < 100000, "listed": F.col("share") != "Users$"}))


_TEXTS = "SELECT doc_id AS file_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"


@_query(f"SELECT * FROM ({_TEXTS}) WHERE text <> '' OR file_id % 5 < 3")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in five encodings, with and without a mark, decoded again; no bytes are no text."""
    docs = _table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    mark = lambda name, raw: F.concat(F.unhex(F.lit(raw)), F.encode("text", name))
    kind = F.pmod("doc_id", F.lit(5))
    latin = F.col("text").rlike("^[\\x00-\\x7f\\u00a0-\\u00bf\\u00e0-\\u00ff]*$") & ~F.col("text").rlike("[\\u00e0-\\u00f7][\\u00a0-\\u00bf]")  # its bytes are no UTF-8
    encoded = F.when(kind == 0, mark("UTF-16LE", "FFFE")).when(kind == 1, mark("UTF-16BE", "FEFF")).when(kind == 2, mark("UTF-8", "EFBBBF")).when((kind == 3) & latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return content.decoded(docs.select(F.col("doc_id").alias("file_id"), F.lit("a.txt").alias("name"), encoded.alias("content")))


#: Files and bytes of content that are made before they are passed on.
_FILES_AT_ONCE, _BYTES_AT_ONCE = 256, 1 << 20


def _made(batches: Iterator[pa.RecordBatch], of, name: str) -> Iterator[pa.RecordBatch]:
    """Files of texts, a few at a time: a database is several times as large as its text, and a batch has thousands."""

    def some(ids: pa.Array, contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([name] * len(contents)), pa.array(contents, pa.binary())], ["file_id", "name", "content"])

    for b in batches:
        start, contents, held = 0, [], 0
        for i, (number, text) in enumerate(zip(b.column(0), b.column(1))):
            contents.append(of(number.as_py(), text.as_py()))
            held += len(contents[-1])
            if len(contents) >= _FILES_AT_ONCE or held >= _BYTES_AT_ONCE:
                yield some(b.column(0).slice(start, len(contents)), contents)
                start, contents, held = i + 1, [], 0
        if contents:
            yield some(b.column(0).slice(start, len(contents)), contents)


def _packed(docs: DataFrame, of, name: str) -> DataFrame:
    """Files whose content ``of`` makes of a text, for the readers to open."""
    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(lambda batches: _made(batches, of, name), "file_id long, name string, content binary")


def _zipped(number: int, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"notes/{number}.txt", text)
        z.writestr("../outside.txt", text)
        z.writestr("image.png", b"\x89PNG\0")
    return out.getvalue()


@_query(f"SELECT file_id, 'notes/' || file_id || '.txt' AS member, text FROM ({_TEXTS}) WHERE text <> ''")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives."""
    return content.archive_members(_packed(_table(spark, sf_dir, "documents"), _zipped, "a.zip")).select("file_id", "member", "text")


def _database(number: int, text: str) -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("create table accounts (id integer, user text, password text, picture text)")
    db.executemany("insert into accounts values (?, ?, ?, ?)", [(k, f"user{number}", f"{number}-{len(text)}-{k}", "x") for k in (1, 2)])
    db.commit()
    return db.serialize()


_CELLS = "SELECT doc_id AS file_id, 'accounts' AS table_name, column_name, row_number, CASE WHEN column_name = 'user' THEN 'user' || doc_id ELSE doc_id || '-' || length(text) || '-' || row_number END AS value FROM documents, (SELECT unnest(['user', 'password']) AS column_name), (SELECT unnest([1, 2]) AS row_number) WHERE doc_id IS NOT NULL AND text IS NOT NULL"


@_query(_CELLS)
def sqlite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of databases."""
    return content.sqlite_cells(_packed(_table(spark, sf_dir, "documents"), _database, "a.sqlite"))


@_query(
    f"SELECT file_id, table_name, column_name, row_number, 'sqliteinspect.credentials.sensitive_value' AS rule_id, 'credentials' AS category, CASE WHEN q.strong THEN 'high' ELSE 'medium' END AS severity, CASE WHEN q.strong THEN 'high' ELSE 'medium' END AS confidence, "
    f"table_name || '.' || column_name AS match, q.label AS quality FROM (SELECT *, {duck.value_quality('value')} AS q FROM ({_CELLS})) WHERE NOT q.weak AND NOT {duck.any_of('lower(value)', inspect_db._SAMPLES)}"
)
def sqlite_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable secrets in the cells of databases."""
    return inspect_db.cell_findings(content.sqlite_cells(_packed(_table(spark, sf_dir, "documents"), _database, "a.sqlite")))


@_query(f"{_HITS} SELECT file_id, rule_id, match FROM hits")
def streaming_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a file stream, which must be those of the batch."""
    at = scratch.folder(spark)
    files = vfs.files(spark, sf_dir)
    files.write.parquet(f"{at}/files")
    incremental.run(incremental.stream(spark, f"{at}/files", files.schema), all_hits, f"{at}/found", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/found").select("file_id", "rule_id", "match")


@_query(f"{_HITS} SELECT category, severity, count(*) AS n, count(DISTINCT file_id) AS n_files FROM hits GROUP BY category, severity")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by category and severity: names, paths and contents."""
    return _hits(spark, sf_dir).groupBy("category", "severity").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


@_query()
def scored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored finding for each file and category, from all rules and inspectors."""
    keep = ("file_id", "host", "share", "file_path", "category", "rule_id", "severity", "confidence", "confidence_score", "signal_type", "match", "line", "account", "content_score", "heuristic_score", "path_score", "correlation_score", "triage_class", "actionable", "correlated")
    return findings.evaluate(vfs.files(spark, sf_dir), RULES).select(*keep, F.col("quality.label").alias("quality"), F.concat_ws(",", "matched_rule_ids").alias("rules"), F.concat_ws(",", "matched_signal_types").alias("signals"))


flagship = finding_summary


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
