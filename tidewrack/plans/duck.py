"""DuckDB SQL of rule matches, path detectors and pairs, generated from the same rules and names."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from tidewrack.functions import quality as Q
from tidewrack.operators import inspect_db, inspect_paths, matching, planner
from tidewrack.sources import vfs


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def any_of(on: str, parts) -> str:
    return "(" + (" OR ".join(f"contains({on}, {text(p)})" for p in parts) or "false") + ")"


def eligible(rule: dict) -> str:
    out = ["true"]
    if rule["max_file_size"]:
        out.append(f"size <= {rule['max_file_size']}")
    if rule["file_extensions"]:
        out.append(f"lower(extension) IN {among(e.lower() for e in rule['file_extensions'])}")
    if rule["include_paths"]:
        out.append(any_of("lower(file_path)", [p.lower() for p in rule["include_paths"]]))
    if rule["exclude_paths"]:
        out.append("NOT " + any_of("lower(file_path)", [p.lower() for p in rule["exclude_paths"]]))
    return "(" + " AND ".join(out) + ")"


def pattern(rule: dict) -> str:
    p = rule["pattern"]
    return text(p if rule["case_sensitive"] or p.startswith("(?i") else "(?i)" + p if not p.startswith("(?") else p.replace("(?", "(?i", 1))


_names = count()
BLANK = "[\\s\\x0B\\x{85}\\x{A0}]+"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a name that stands for the value."""
    name = f"v{next(_names)}"
    return f"(list_transform([{value}], lambda {name}: {body(name)})[1])"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{BLANK}', ''), '{BLANK}$', '')"


def norm(c: str) -> str:
    return f"lower({strip(c)})"


def unwrap(c: str) -> str:
    return strip(f"regexp_replace({c}, '^[\"'']+|[\"'']+$', '', 'g')")


def entropy(v: str) -> str:
    chars = f"string_split({v}, '')"
    return f"(-coalesce(list_sum(list_transform(list_distinct({chars}), lambda c: (len(list_filter({chars}, lambda x: x = c)) / length({v})) * log2(len(list_filter({chars}, lambda x: x = c)) / length({v})))), 0))"


def value_quality(raw: str) -> str:
    """Struct ``score label weak strong`` of a value."""
    q = lambda score, label, weak=False, strong=False: f"{{'score': {score}, 'label': {text(label)}, 'weak': {weak}, 'strong': {strong}}}"
    words = among(["database", "server", "username", "token", "secret", "password"])

    def known(v: str) -> str:
        low = let(f"lower({unwrap(v)})", lambda w: f"{w} = '' OR regexp_matches({w}, '(?s)^(?:<.*>|\\$\\{{.*\\}}|\\{{.*\\}})$') OR {w} IN {words} OR {any_of(w, Q.PLACEHOLDERS)}")
        flat = let(f"lower(regexp_replace({unwrap(v)}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))", lambda w: f"{w} = '' OR {w} IN {among(Q.BASES)} OR regexp_matches({w}, '^{Q.NUMBERED}\\p{{Nd}}+$')")
        return f"(({low}) OR ({flat}))"

    def judged(m: str) -> str:
        return (
            f"CASE WHEN {m}.v = '' THEN {q(0, 'low', True)} WHEN {m}.known THEN {q(1, 'low', True)} WHEN {m}.n < 8 OR {m}.u <= 2 THEN {q(2, 'low', True)} WHEN {m}.h < 1.8 OR ({m}.h < 2.4 AND {m}.k < 2) THEN {q(3, 'low', True)} "
            f"WHEN {m}.n >= 14 AND {m}.u >= 6 AND ({m}.k >= 3 OR {m}.h >= 3.2) THEN {q(18, 'high', False, True)} WHEN {m}.n >= 10 AND {m}.u >= 5 AND ({m}.k >= 2 OR {m}.h >= 2.7) THEN {q(12, 'medium')} ELSE {q(8, 'medium')} END"
        )

    kinds = lambda v: " + ".join(f"CAST(regexp_matches({v}, '{p}') AS INTEGER)" for p in ("\\p{Ll}", "\\p{Lu}", "\\p{Nd}", "[^\\p{Ll}\\p{Lu}\\p{Nd}]"))
    measured = lambda v: f"{{'v': {v}, 'known': {known(v)}, 'n': strlen({v}), 'h': {entropy(v)}, 'k': {kinds(v)}, 'u': len(list_distinct(string_split({v}, '')))}}"
    return let(unwrap(raw), lambda v: let(measured(v), judged))


def pair_of(line: str) -> str:
    """Struct ``label sep value`` of a line that pairs an account with a value, null for any other."""

    def judged(p: str) -> str:
        bad = f"((lower({p}.label) IN {among(Q.SCHEMES)} AND starts_with({p}.value, '//')) OR regexp_matches({p}.label, {text(Q.RESOURCE)}))"
        good = f"(regexp_matches({p}.label, {text(Q.ACCOUNT)}) OR (regexp_matches({p}.label, {text(Q.ALIAS)}) AND NOT ({value_quality(f'{p}.value')}).weak))"
        return f"CASE WHEN {p}.label <> '' AND NOT {bad} AND {good} THEN {p} END"

    got = lambda x, i: f"regexp_extract({x}, {text(Q.PAIR)}, {i})"
    taken = lambda x: f"{{'label': {strip(got(x, 1))}, 'sep': {got(x, 2)}, 'value': {strip(got(x, 3))}}}"
    return let(strip(line), lambda x: f"CASE WHEN regexp_matches({x}, '[:=]') THEN {let(taken(x), judged)} END")


def redacted(c: str) -> str:
    """A text with its secret values starred out."""
    stars, label = "********", "(?:" + "|".join(Q.SECRET_LABELS) + ")"
    out = f"regexp_replace({c}, {text(Q.ASSIGNMENT)}, '\\1\\2\\3{stars}', 'g')"
    out = f"regexp_replace({out}, {text(Q.XML_TAG)}, '<\\1>{stars}</\\1>', 'g')"
    add = rf"(?i)(<add\b[^>]*\b(?:name|key)\s*=\s*[\"']\s*{label}\s*[\"'][^>]*\bvalue\s*=\s*[\"'])[^\"']+([\"'][^>]*/?>)"
    attribute = rf"(?i)(<[^>]+\b(?:{Q._LABELS})\s*=\s*[\"'])[^\"']+([\"'][^>]*/?>)"
    for p in (add, attribute):
        out = f"regexp_replace({out}, {text(p)}, '\\1{stars}\\2', 'g')"
    line = lambda x: let(pair_of(x), lambda p: f"coalesce({p}.label || {p}.sep || '{stars}', {x})")
    return f"CASE WHEN {strip(c)} = '' THEN '' ELSE array_to_string(list_transform(string_split({out}, chr(10)), lambda x: {line('x')}), chr(10)) END"


def _element(labels: tuple[str, ...]) -> str:
    """First element of a text that gives one of the labels a value."""
    first = lambda p: f"(list_filter(list_zip(regexp_extract_all(text, {text(p)}, 0), regexp_extract_all(text, {text(p)}, 1)), lambda z: {norm('z[2]')} IN {among(labels)})[1])[1]"
    return f"coalesce({first(Q.XML_ADD)}, {first(Q.XML_ATTRIBUTE)}, '')"


def content_match(rule: dict) -> str:
    """A content rule's match in ``text``, empty if none."""
    got = f"regexp_extract(text, {pattern(rule)}, 0)"
    if rule["id"] == matching.NOTE_RULE:
        return f"coalesce(list_filter(regexp_extract_all(text, {text(rule['pattern'])}, 0), lambda x: {pair_of('x')} IS NOT NULL)[1], '')"
    labels = {matching.PASSWORD_RULE: Q.PASSWORD_LABELS, matching.SECRET_RULE: Q.SECRET_LABELS}.get(rule["id"])
    return f"CASE WHEN {got} <> '' THEN {got} ELSE {_element(labels)} END" if labels else got


def rule_hits(rules: list[dict], columns: str) -> str:
    """Matches of rules, by their types: a SELECT over ``files``."""
    on = {"filename": "name", "extension": "lower(extension)", "content": "text"}
    parts = []
    for r in rules:
        got = content_match(r) if r["type"] == "content" else f"regexp_extract({on[r['type']]}, {pattern(r)}, 0)"
        parts.append(f"SELECT {columns}, {text(r['id'])} AS rule_id, {text(r['type'])} AS signal_type, {text(r['category'])} AS category, {text(r['severity'])} AS severity, match FROM (SELECT *, {got} AS match FROM files WHERE {eligible(r)}) WHERE match <> ''")
    return " UNION ALL ".join(parts)


PATH = "lower(file_path)"


def path_hits(columns: str) -> str:
    """Matches of the detectors that need only a path: a SELECT over ``files``."""
    one = lambda rule, category, severity, match, where: f"SELECT {columns}, {text(rule)} AS rule_id, 'validated' AS signal_type, {text(category)} AS category, {text(severity)} AS severity, {match} AS match FROM files WHERE {where}"
    parts = [one(f"backupinspect.path.{n}", "backup-exposure", "high", text(f"/{p}/"), f"contains({PATH}, {text(f'/{p}/')})") for n, p in inspect_paths._BACKUPS]
    for kind, name, severity, chromium in inspect_paths._BROWSERS:
        inside = any_of(PATH, inspect_paths._CHROMIUM) if chromium else any_of(PATH, [inspect_paths._FIREFOX])
        parts.append(one(f"browsercredinspect.{kind}", "browser-credentials", severity, text(name), f"lower(name) = {text(name)} AND {inside}"))
    for kind, severity in (("credentials", "high"), ("vault", "high"), ("protect", "medium")):
        parts.append(one(f"wincredinspect.path.{kind}", "windows-credentials", severity, text(f"/microsoft/{kind}/"), f"contains({PATH}, '/microsoft/{kind}/')"))
    aws = lambda n: f"contains({PATH}, '/.aws/') AND regexp_matches(lower(name), '^{n}(?:\\.(?:bak|old|backup|copy))?$')"
    parts += [one("awsinspect.path.credentials", "cloud", "high", "'.aws/credentials'", aws("credentials")), one("awsinspect.path.config", "infrastructure", "medium", "'.aws/config'", aws("config"))]
    parts += [one(f"dbinspect.artifact.{i}", "database-artifacts", "medium", text(n), f"lower(name) = {text(n)}") for n, (i, _) in inspect_db.FILES.items()]
    parts += [one(f"dbinspect.artifact.{i}", "database-artifacts", "medium", text(x), f"lower(extension) = {text(x)}") for x, (i, _) in inspect_db.EXTENSIONS.items()]
    for x in inspect_db.BACKUPS:
        parts.append(one("dbinspect.artifact.database_backup", "database-artifacts", "medium", text(x), f"lower(extension) = {text(x)} AND {any_of(f'substr(lower(name), 1, length(name) - {len(x)})', inspect_db.BACKUP_HINTS)}"))
    return " UNION ALL ".join(parts)


COLUMNS = "file_id, host, share, file_path, name, extension, size, modified_at, source, from_sysvol"
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def hits(rules: list[dict]) -> str:
    """``files`` and ``hits``: matches of all rules and of the path detectors, scored by their signals."""
    rules = [r for r in rules if r["action"] != "skip"]
    score = "CASE signal_type WHEN 'validated' THEN 40 WHEN 'content' THEN 32 WHEN 'filename' THEN 18 ELSE 10 END"
    return f"{vfs.CTE}, hits AS MATERIALIZED (SELECT *, {score} AS confidence_score, {RANK} AS severity_rank FROM ({rule_hits(rules, COLUMNS)} UNION ALL {path_hits(COLUMNS)}))"


def points(*cases: tuple[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p in cases) + " ELSE 0 END"


def file_score() -> str:
    p = "lower(replace(file_path, '\\', '/'))"
    s = "lower(share)"
    return " + ".join([
        "10", points((f"{s} = 'sysvol'", 35), (f"{s} = 'netlogon'", 30)), points((f"contains({p}, 'policies/')", 30), (f"contains({p}, 'preferences/')", 28), (f"contains({p}, 'scripts/')", 24)),
        points((any_of(p, planner.SECRETS), 55), (any_of(p, planner.SETTINGS), 40), (any_of(p, planner.COPIES), 28), (any_of(p, planner.BUSINESS), 35), (any_of(p, planner.OPERATIONS), 22)),
        points((f"lower(extension) IN {among(['.jks', '.pfx', '.p12', '.pem', '.key'])}", 55), (f"lower(extension) IN {among(['.tfvars', '.yml', '.yaml', '.xml', '.toml', '.json', '.ini', '.conf', '.config', '.env'])}", 35),
               (f"lower(extension) IN {among(['.bat', '.cmd', '.py', '.sh', '.psm1', '.ps1'])}", 24), (f"lower(extension) IN {among(['.xlsx', '.xls', '.tsv', '.csv', '.bak', '.sqlite3', '.sqlite', '.db', '.sql'])}", 18)),
        points(("contains(lower(source), 'dfs')", 10)),
    ])


DIRECTORY = "lower(regexp_extract(file_path, '^(.*)/[^/]*$', 1))"


def _anchors(name: str, family: str, context: str) -> str:
    keys = "lower(host) AS kh, lower(share) AS ks"
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kh, ks, ctx, fam ORDER BY confidence_score DESC, severity_rank DESC, file_path, rule_id) AS n
    FROM (SELECT *, {keys}, {context} AS ctx, {family} AS fam FROM hits) WHERE fam IS NOT NULL AND ctx <> '') WHERE n = 1)"""


def _pair(name: str, first: str, second: str, rule: str, severity: str, score: str, match: str) -> str:
    return f"SELECT a.host, a.share, a.file_path, 'correlation.{rule}' AS rule_id, {severity} AS severity, {score} AS confidence_score, {match} AS match FROM {name} a JOIN {name} b USING (kh, ks, ctx) WHERE a.fam = '{first}' AND b.fam = '{second}'"


def pairs(rules: list[dict]) -> str:
    """Findings that follow from several others, of the kinds that names and paths decide."""
    base = "lower(name)"
    before = lambda marker: f"CASE WHEN instr({PATH}, '{marker}') > 1 THEN trim(substr({PATH}, 1, instr({PATH}, '{marker}') - 1), '/') END"
    tier = f"CASE WHEN regexp_matches({DIRECTORY}, '/tier-?[0-9]+$') THEN regexp_extract({DIRECTORY}, '^(.*)/[^/]*$', 1) ELSE {DIRECTORY} END"
    key = (
        f"CASE WHEN {base} IN {among(inspect_paths.KEY_FILES)} THEN 'private_key' WHEN {base} IN ('authorized_keys', 'known_hosts') THEN 'ssh' WHEN lower(extension) IN ('.ovpn', '.ppk') THEN 'client' "
        "WHEN rule_id = 'filename.private_key_artifacts' THEN 'private_key' WHEN rule_id = 'filename.ssh_supporting_artifacts' THEN 'ssh' WHEN rule_id = 'extension.client_auth_artifacts' THEN 'client' END"
    )
    profile = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({PATH}, '^(.*?{root}[^/]+)/', 1), '/'), '')" for root in (inspect_paths._FIREFOX, *inspect_paths._CHROMIUM)) + ", '')"
    backup = "coalesce(" + ", ".join(f"CASE WHEN instr({PATH}, '{t}') > 0 THEN trim(substr({PATH}, 1, instr({PATH}, '{t}') + {len(t) - 1}), '/') END" for t in ("/windowsimagebackup/", "/system volume information/", "/windows/system32/config/regback/", "/regback/", "/windows/repair/")) + ", '')"
    ctes = [
        _anchors("ad", f"CASE WHEN regexp_matches({base}, '^ntds\\.dit(?:\\.(?:bak|old))?$') THEN 'ntds' WHEN regexp_matches({base}, '^system(?:\\.(?:bak|old))?$') THEN 'system' END", DIRECTORY),
        _anchors("aws", "CASE rule_id WHEN 'awsinspect.path.credentials' THEN 'credentials' WHEN 'awsinspect.path.config' THEN 'config' END", before("/.aws/")),
        _anchors("keys", key, tier),
        _anchors("certs", f"CASE WHEN regexp_matches({base}, '[.](?:pfx|p12)$') AND rule_id = 'extension.key_and_certificate_extensions' THEN 'certificate' WHEN rule_id IN ('content.password_assignment_indicators', 'content.password_note_value_indicators', 'content.note_style_credential_pair_indicators') THEN 'password' END", tier),
        _anchors("browser", "CASE WHEN starts_with(rule_id, 'browsercredinspect.') THEN replace(substr(rule_id, 20), '.', '_') END", profile),
        _anchors("dpapi", "CASE WHEN starts_with(rule_id, 'wincredinspect.path.') THEN regexp_extract(rule_id, '([a-z]+)$', 1) END", f"coalesce({before('/appdata/roaming/')}, {before('/appdata/local/')})"),
        _anchors("stores", f"nullif(regexp_replace(regexp_extract({base}, '^(ntds\\.dit|system|sam|security)(?:\\.(?:bak|old))?$', 1), '\\.dit$', ''), '')", backup),
        _anchors("places", "CASE WHEN starts_with(rule_id, 'backupinspect.path.') THEN 'place' END", backup),
    ]
    gone = lambda name, fam: f"NOT EXISTS (SELECT 1 FROM {name} c WHERE c.kh = a.kh AND c.ks = a.ks AND c.ctx = a.ctx AND c.fam = '{fam}')"
    has = lambda name, fam: gone(name, fam)[4:]
    fire = f"({has('browser', 'firefox_logins')} AND {has('browser', 'firefox_key4')})"
    selects = [
        _pair("ad", "ntds", "system", "ad.ntds_system", "'critical'", "82", "'NTDS + SYSTEM'"),
        _pair("aws", "credentials", "config", "cloud.aws_profile_bundle", "'high'", "78", "'credentials + config'"),
        _pair("keys", "private_key", "client", "remote_access.private_key_bundle", "'critical'", "84", "'private key + client-auth artifact'"),
        _pair("keys", "private_key", "ssh", "remote_access.private_key_bundle", "'high'", "76", "'private key + SSH support'") + f" AND {gone('keys', 'client')}",
        _pair("certs", "certificate", "password", "remote_access.certificate_bundle", "'critical'", "82", "'certificate + password evidence'"),
        _pair("browser", "firefox_logins", "firefox_key4", "browser.profile_credential_store", "'critical'", "84", "'Firefox logins + key4'"),
        _pair("browser", "chromium_login_data", "chromium_cookies", "browser.profile_credential_store", "'high'", "78", "'Chromium Login Data + Cookies'") + f" AND NOT {fire}",
        f"SELECT a.host, a.share, a.file_path, 'correlation.windows.dpapi_credential_store', 'critical', CASE WHEN {has('dpapi', 'credentials')} AND {has('dpapi', 'vault')} THEN 88 ELSE 84 END, "
        f"concat_ws(' + ', CASE WHEN {has('dpapi', 'credentials')} THEN 'Credentials' END, CASE WHEN {has('dpapi', 'vault')} THEN 'Vault' END, 'Protect') "
        f"FROM dpapi a WHERE {has('dpapi', 'protect')} AND (a.fam = 'credentials' OR (a.fam = 'vault' AND {gone('dpapi', 'credentials')}))",
        f"SELECT host, share, file_path, 'correlation.backup.system_state_exposure', 'critical', CASE WHEN {has('places', 'place')} THEN 86 ELSE 82 END, "
        f"concat_ws(' + ', {', '.join(f'''CASE WHEN {has('stores', s)} THEN '{s.upper()}' END''' for s in ('ntds', 'sam', 'system', 'security'))}) "
        "FROM (SELECT *, row_number() OVER (PARTITION BY kh, ks, ctx ORDER BY confidence_score DESC, severity_rank DESC, file_path) AS best, count(*) OVER (PARTITION BY kh, ks, ctx) AS many FROM stores) a WHERE best = 1 AND many >= 2",
    ]
    return f"WITH {hits(rules)}, {', '.join(ctes)} " + " UNION ALL ".join(selects)


def cloud_bundles() -> str:
    """Bundles of keys in the files of cloud profiles."""
    plain = strip("regexp_replace(substr(x, cut + 1), '^[\"'']+|[\"'']+$', '', 'g')")
    inside = f"contains({PATH}, '/.aws/') AND regexp_matches(lower(name), '^(?:credentials|config)(?:\\.(?:bak|old|backup|copy))?$')"
    kinds = {"aws_access_key_id": inspect_paths._KEY, "aws_secret_access_key": inspect_paths._SECRET, "aws_session_token": inspect_paths._SESSION}
    valid = " OR ".join(f"(k = '{k}' AND regexp_matches(v, '{p}'))" for k, p in kinds.items())
    return f"""WITH {vfs.CTE}, split AS (SELECT file_id, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {strip('x')}) AS lines FROM files WHERE {inside}),
l AS (SELECT file_id, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS i FROM split),
c AS (SELECT *, CASE WHEN instr(x, '=') > 1 THEN instr(x, '=') WHEN instr(x, ':') > 1 THEN instr(x, ':') END AS cut FROM l WHERE x <> '' AND NOT regexp_matches(x, '^[#;\\[]')),
p AS (SELECT file_id, i, {norm('substr(x, 1, cut - 1)')} AS k, {plain} AS v FROM c WHERE cut IS NOT NULL),
g AS (SELECT * FROM p WHERE NOT regexp_matches(v, '(?i)example|fake|test|changeme|placeholder') AND ({valid}))
SELECT file_id, 'awsinspect.content.credentials_bundle' AS rule_id, 'aws_access_key_id + aws_secret_access_key' || CASE WHEN count(*) FILTER (WHERE k = 'aws_session_token') > 0 THEN ' + aws_session_token' ELSE '' END AS match,
  CAST(min(i) AS INTEGER) AS line FROM g GROUP BY file_id HAVING count(*) FILTER (WHERE k = 'aws_access_key_id') > 0 AND count(*) FILTER (WHERE k = 'aws_secret_access_key') > 0"""


def meaningful(c: str) -> str:
    """A value without its wrapping, empty for a placeholder."""
    words = among(["dsn", "dbname", "database", "host", "server", "pwd", "password", "user", "username"])
    bad = lambda v: f"regexp_matches(lower({v}), '^(?:<.*>|\\$?\\{{.*\\}})$') OR lower({v}) IN {words} OR {any_of(f'lower({v})', inspect_db.PLACEHOLDERS)}"
    return let(strip(f"regexp_replace({strip(c)}, '^[\"'']+|[\"'']+$', '', 'g')"), lambda v: f"CASE WHEN {bad(v)} THEN '' ELSE {v} END")


def tns_blocks() -> str:
    """Services of network files: a text is split before each alias."""
    alias = "(?im)^\\s*([\\w.-]+)\\s*=\\s*\\(DESCRIPTION\\b"
    got = lambda key, of: meaningful(f"regexp_extract(block, '(?i)\\b{key}\\s*=\\s*{of}', 1)")
    value = "([^) \\t\\r\\n]+)"
    return f"""WITH {vfs.CTE}, b AS (SELECT file_id, string_split(regexp_replace(text, '{alias.replace('([', '([', 1)}', chr(1) || '\\0', 'g'), chr(1)) AS blocks FROM files WHERE lower(name) = 'tnsnames.ora' OR contains(upper(text), '(DESCRIPTION=')),
n AS (SELECT file_id, unnest(blocks) AS block, unnest(list_transform(range(1, len(blocks) + 1), lambda i: coalesce(list_sum(list_transform(blocks[1:i - 1], lambda x: length(x) - length(replace(x, chr(10), '')))), 0) + 1)) AS line FROM b),
p AS (SELECT file_id, CAST(line AS INTEGER) AS line, regexp_extract(block, '{alias}', 1) AS alias, {got('HOST', value)} AS host_name, {got('PORT', '([0-9]{2,5})')} AS port, coalesce(nullif({got('SERVICE_NAME', value)}, ''), {got('SID', value)}) AS service FROM n),
m AS (SELECT *, alias || ' -> ' || host_name || CASE WHEN port <> '' THEN ':' || port ELSE '' END || '/' || service AS match FROM p WHERE alias <> '' AND host_name <> '' AND service <> '')
SELECT file_id, alias, host_name, port, service, match, line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, lower(match) ORDER BY line) AS nth FROM m) WHERE nth = 1"""


def exposure(rules: list[dict], top: int) -> str:
    """The first ways in: correlated findings by how exploitable they are."""
    both = "contains(lower(match), 'ntds') AND contains(lower(match), 'system')"
    families = " + ".join(f"CAST(contains(lower(match), '{w}') AS INTEGER)" for w in ("ntds", "system", "sam", "security"))
    every = " AND ".join(f"contains(lower(match), '{w}')" for w in ("credentials", "vault", "protect"))
    kinds = [
        ("ad.ntds_system", "", "ad-compromise-path", 95, "complete"), ("cloud.aws_profile_bundle", "", "cloud-credential-path", 88, "paired"),
        ("windows.dpapi_credential_store", every, "windows-credential-store-exposure", 88, "complete"), ("windows.dpapi_credential_store", "", "windows-credential-store-exposure", 84, "paired"),
        ("remote_access.private_key_bundle", "contains(lower(match), 'client-auth')", "vpn-client-auth-access-path", 86, "complete"), ("remote_access.private_key_bundle", "", "ssh-access-path", 78, "paired"),
        ("remote_access.certificate_bundle", "", "certificate-client-auth-path", 88, "paired"),
        ("browser.profile_credential_store", "contains(lower(match), 'firefox')", "browser-credential-store-exposure", 76, "paired"), ("browser.profile_credential_store", "", "browser-credential-store-exposure", 72, "paired"),
        ("backup.system_state_exposure", both, "backup-exposure-path", 92, "complete"), ("backup.system_state_exposure", f"{families} >= 3", "backup-exposure-path", 90, "multi-artifact"), ("backup.system_state_exposure", "", "backup-exposure-path", 88, "paired"),
    ]
    case = "CASE " + " ".join(f"WHEN rule_id = 'correlation.{r}'{' AND ' + w if w else ''} THEN {{'t': '{t}', 's': {n}, 'c': '{c}'}}" for r, w, t, n, c in kinds) + " END"
    order = f"score DESC, {RANK} DESC, host, share, file_path, rule_id"
    return f"""SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, score, CASE WHEN score >= 90 THEN 'high' WHEN score >= 75 THEN 'medium' ELSE 'low' END AS tier, k.t AS path_type, '' AS base_type,
  k.c AS completeness, host, share, file_path, rule_id, severity, 2 AS n_related
FROM (SELECT *, CAST(least(k.s + CASE k.c WHEN 'complete' THEN 4 WHEN 'multi-artifact' THEN 6 ELSE 2 END, 100) AS INTEGER) AS score FROM (SELECT *, {case} AS k FROM ({pairs(rules)})) WHERE k IS NOT NULL) ORDER BY {order} LIMIT {top}"""
