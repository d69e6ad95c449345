"""Detectors that need no more than a path and a name, and those of keys and cloud profiles.

Each gives an array of match structs for a row of ``files``; nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions import text as X

MATCH = "array<struct<rule_id:string,rule_type:string,signal_type:string,severity:string,confidence:string,category:string,match:string,text:string,line:int,tags:array<string>>>"
KEY_FILES = ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "identity")
KEY_KINDS = ("OPENSSH ", "RSA ", "EC ", "DSA ", "")


def match(rule_id: str, rule_type: str, severity: str, category: str, found: Column, text: Column, tags: Column, signal: str = "validated", confidence: str = "high", line: Column | None = None) -> Column:
    """One match struct."""
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(rule_type).alias("rule_type"), F.lit(signal).alias("signal_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
        F.lit(category).alias("category"), found.alias("match"), text.alias("text"), (line if line is not None else F.lit(0)).cast("int").alias("line"), tags.alias("tags"),
    )


def _tags(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def present(*matches: Column) -> Column:
    """The matches that are there, in order."""
    return F.array_compact(F.array(*matches)) if matches else F.array().cast(MATCH)


def path() -> Column:
    """The path in the form that detectors compare: clean, lower case."""
    return F.lower(X.slashes(X.strip(F.col("file_path"))))


_BACKUPS = (("windowsimagebackup", "windowsimagebackup"), ("system_volume_information", "system volume information"), ("regback", "regback"), ("windows_repair", "windows/repair"))


def backup_matches(p: Column | None = None) -> Column:
    """Families of system-state backups; a path may be in several."""
    p = path() if p is None else p
    out = []
    for name, part in _BACKUPS:
        token = f"/{part}/"
        tags = _tags("backup", "windows", "artifact:backup-family", "backup-family:" + name.replace("_", "-"))
        out.append(F.when(p.contains(token), match(f"backupinspect.path.{name}", "filename", "high", "backup-exposure", F.lit(token), p, tags)))
    return present(*out)


def backup_context(p: Column | None = None) -> Column:
    """The backup that a path belongs to, empty if none."""
    p = path() if p is None else p
    out = []
    for token in ("/windowsimagebackup/", "/system volume information/", "/windows/system32/config/regback/", "/regback/", "/windows/repair/"):
        at = F.instr(p, token)
        out.append(F.when(at > 0, X.bare(F.substring(p, F.lit(1), at + len(token) - 1))))
    return F.coalesce(*out, F.lit(""))


_CHROMIUM = ("/google/chrome/user data/", "/microsoft/edge/user data/", "/bravesoftware/brave-browser/user data/")
_FIREFOX = "/mozilla/firefox/profiles/"
_BROWSERS = (
    ("firefox.logins", "logins.json", "medium", False), ("firefox.key4", "key4.db", "medium", False),
    ("chromium.login_data", "login data", "medium", True), ("chromium.cookies", "cookies", "low", True),
)


def browser_matches(p: Column | None = None) -> Column:
    """Stores of browser credentials in their profiles."""
    p = path() if p is None else p
    out = []
    for kind, name, severity, chromium in _BROWSERS:
        inside = X.contains_any(p, list(_CHROMIUM)) if chromium else p.contains(_FIREFOX)
        family = kind.replace(".", "-").replace("_", "-")
        tags = _tags("browser", kind.split(".")[0], "artifact:browser-credstore", f"browsercred:type:{family}")
        out.append(F.when((X.base_name(p) == name) & inside, match(f"browsercredinspect.{kind}", "filename", severity, "browser-credentials", F.lit(name), p, tags)))
    return present(*out)


def browser_profile(p: Column | None = None) -> Column:
    """The browser profile that a path belongs to, empty if none."""
    p = path() if p is None else p
    out = []
    for root in (_FIREFOX, *_CHROMIUM):
        got = F.regexp_extract(p, f"^(.*?{root}[^/]+)/", 1)
        out.append(F.when(got != "", X.bare(got)))
    return F.coalesce(*out, F.lit(""))


def windows_matches(p: Column | None = None) -> Column:
    """Stores of Windows credentials."""
    p = path() if p is None else p
    out = []
    for kind, severity in (("credentials", "high"), ("vault", "high"), ("protect", "medium")):
        token = f"/microsoft/{kind}/"
        more = ["credstore:type:dpapi-protect"] if kind == "protect" else []
        tags = _tags("windows", "dpapi", "artifact:windows-credstore", "credstore:path-exact", f"credstore:type:{kind}", *more)
        out.append(F.when(p.contains(token), match(f"wincredinspect.path.{kind}", "filename", severity, "windows-credentials", F.lit(token), p, tags)))
    return present(*out)


def windows_profile(p: Column | None = None) -> Column:
    """The user's profile that a path belongs to, empty if none."""
    p = path() if p is None else p
    out = []
    for marker in ("/appdata/roaming/", "/appdata/local/"):
        at = F.instr(p, marker)
        out.append(F.when(at > 1, X.bare(F.substring(p, F.lit(1), at - 1))))
    return F.coalesce(*out, F.lit(""))


def aws_kind(p: Column | None = None) -> Column:
    """``credentials``, ``config`` or null."""
    p = path() if p is None else p
    name = X.base_name(p)
    copies = "(?:\\.(?:bak|old|backup|copy))?$"
    inside = p.contains("/.aws/")
    return F.when(inside & name.rlike("^credentials" + copies), "credentials").when(inside & name.rlike("^config" + copies), "config")


def is_aws(p: Column | None = None) -> Column:
    return aws_kind(p).isNotNull()


def aws_matches(p: Column | None = None) -> Column:
    """Files of a cloud profile, by their place."""
    p = path() if p is None else p
    kind = aws_kind(p)
    return present(
        F.when(kind == "credentials", match("awsinspect.path.credentials", "filename", "high", "cloud", F.lit(".aws/credentials"), p, _tags("aws", "cloud", "artifact:aws-credentials", "aws:type:credentials"), line=F.lit(1))),
        F.when(kind == "config", match("awsinspect.path.config", "filename", "medium", "infrastructure", F.lit(".aws/config"), p, _tags("aws", "cloud", "artifact:aws-config", "aws:type:config"), line=F.lit(1))),
    )


def aws_profile(p: Column | None = None) -> Column:
    p = path() if p is None else p
    at = F.instr(p, "/.aws/")
    return F.when(at > 1, X.bare(F.substring(p, F.lit(1), at - 1))).otherwise("")


_KEY, _SECRET, _SESSION = "^(?:AKIA|ASIA)[A-Z0-9]{16}$", "^[A-Za-z0-9/+=]{40}$", "^[A-Za-z0-9/+=_-]{60,}$"


def aws_bundle(text: Column) -> Column:
    """Struct of the last valid access key, secret key, session token and profile, and the first line that has one.

    Profiles are mixed: the last valid value of each key in the file counts.
    """
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), X.strip)

    def pair(line: Column, at: Column) -> Column:
        by = F.when(F.instr(line, "=") > 1, "=").when(F.instr(line, ":") > 1, ":")
        cut = F.instr(line, by)
        value = X.strip(F.regexp_replace(F.substring(line, cut + 1, F.length(line)), "^[\"']+|[\"']+$", ""))
        return F.struct((at + 1).cast("int").alias("line"), X.norm(F.substring(line, F.lit(1), cut - 1)).alias("key"), value.alias("value"))

    plain = F.transform(lines, lambda x, i: F.when((x != "") & ~x.rlike("^[#;\\[]"), pair(x, i)))
    bad = "(?i)example|fake|test|changeme|placeholder"

    def valid(key: str, pattern: str) -> Column:
        return F.filter(plain, lambda p: (p["key"] == key) & p["value"].rlike(pattern) & ~p["value"].rlike(bad))

    key, secret, session = valid("aws_access_key_id", _KEY), valid("aws_secret_access_key", _SECRET), valid("aws_session_token", _SESSION)
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1)["value"], F.lit(""))
    first = F.array_min(F.transform(F.concat(key, secret, session), lambda p: p["line"]))
    sections = F.filter(lines, lambda x: x.rlike("^\\[.*\\]$"))
    profile = F.coalesce(X.strip(F.regexp_extract(F.get(sections, F.size(sections) - 1), "^\\[(.*)\\]$", 1)), F.lit(""))
    return F.struct(last(key).alias("access_key"), last(secret).alias("secret_key"), last(session).alias("session_token"), F.coalesce(first, F.lit(0)).alias("line"), profile.alias("profile"))


def aws_content_matches(text: Column, p: Column | None = None) -> Column:
    """A bundle of access and secret key in a cloud profile's file; texts of other files aren't looked at."""
    return F.when(is_aws(p), X.let(aws_bundle(text), lambda b: _bundle_match(b, p))).otherwise(F.array().cast(MATCH))


def _bundle_match(b: Column, p: Column | None) -> Column:
    long = b["session_token"] != ""
    found = F.when(long, "aws_access_key_id + aws_secret_access_key + aws_session_token").otherwise("aws_access_key_id + aws_secret_access_key")
    lines = F.concat_ws("\n", F.concat(F.lit("aws_access_key_id="), b["access_key"]), F.concat(F.lit("aws_secret_access_key="), b["secret_key"]), F.when(long, F.concat(F.lit("aws_session_token="), b["session_token"])))
    tags = F.array_compact(F.array(F.lit("aws"), F.lit("cloud"), F.lit("credentials"), F.lit("artifact:aws-credentials"), F.lit("aws:type:bundle"), F.when(long, "aws:type:session-bundle"), F.when(b["profile"] != "", F.concat(F.lit("aws:profile:"), F.lower(b["profile"])))))
    good = is_aws(p) & (b["access_key"] != "") & (b["secret_key"] != "")
    return present(F.when(good, match("awsinspect.content.credentials_bundle", "content", "critical", "credentials", found, lines, tags, line=b["line"])))


def is_key() -> Column:
    return X.norm(F.col("name")).isin(*KEY_FILES)


def key_matches(text: Column) -> Column:
    """A private key's header in a file that has a key's name; of several the first kind counts."""
    headers = [f"-----BEGIN {k}PRIVATE KEY-----" for k in KEY_KINDS]
    header = F.coalesce(*[F.when(text.contains(h), h) for h in headers])
    line = F.size(F.split(F.substring(text, F.lit(1), F.instr(text, header) - 1), "\n"))
    tags = _tags("crypto", "keys", "remote-access", "artifact:private-key", "validated:private-key-header")
    return present(F.when(is_key() & header.isNotNull(), match("keyinspect.content.private_key_header", "content", "critical", "crypto", header, X.limit(X.strip(text), 320), tags, line=line)))


