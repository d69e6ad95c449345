"""Detection rules over files: each file is looked at once, by all rules together.

Rules are known before the query is planned, so they aren't joined but compiled:
one array of guarded match structs for each type of rule, exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import needed
from tidewrack.functions import quality as Q
from tidewrack.functions import text as X
from tidewrack.functions.regex import to_java
from tidewrack.operators.gating import eligible
from tidewrack.sources.rules import of_type

NOTE_RULE = "content.note_style_credential_pair_indicators"
PASSWORD_RULE, SECRET_RULE = "content.password_assignment_indicators", "content.secret_assignment_indicators"
CONNECTION_RULE = "content.database_connection_string_indicators"
WEIGHTS = {"validated": 40, "content": 32, "filename": 18, "extension": 10, "path": 12, "share_priority": 10, "planner_priority": 12}


def _hit(rule: dict, at: int, found: Column) -> Column:
    """A struct for a rule's match, null where it has none; the match is looked for once."""
    fields = [("seq", F.lit(at)), ("rule_id", F.lit(rule["id"])), ("rule_type", F.lit(rule["type"])), ("category", F.lit(rule["category"])), ("severity", F.lit(rule["severity"])), ("confidence", F.lit(rule["confidence"]))]
    tags = F.array(*[F.lit(t) for t in rule["tags"]]) if rule["tags"] else F.array().cast("array<string>")
    made = lambda m: F.when(m != "", F.struct(*[v.alias(n) for n, v in fields], m.alias("match"), tags.alias("tags")))
    return F.when(eligible(rule), X.let(found, made))


def _exploded(files: DataFrame, hits: list[Column], drop: tuple[str, ...] = ()) -> DataFrame:
    if not hits:
        hits = [F.lit(None).cast("struct<seq:int,rule_id:string,rule_type:string,category:string,severity:string,confidence:string,match:string,tags:array<string>>")]
    rows = X.once(files, __hits=X.aside(F.array_compact(F.array(*hits)))).drop(*drop)
    return rows.select("*", F.explode("__hits").alias("hit")).select("*", "hit.*").drop("hit", "__hits")


def metadata_hits(rules: list[dict]) -> list[Column]:
    """A struct or null for each file name and extension rule, in the order of evaluation (``seq``)."""
    hits = []
    for kind, on in (("filename", F.col("name")), ("extension", F.lower("extension"))):
        for r in of_type(rules, kind):
            hits.append(_hit(r, len(hits), X.first_match(on, r["pattern"], ignore_case=not r["case_sensitive"])))
    return hits


@X.untraced
def metadata_matches(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Matches of file name and extension rules, in the order of evaluation (``seq``); no content is touched."""
    return _exploded(files.drop("text"), metadata_hits(rules))


def xml_fallback(text: Column, labels: tuple[str, ...], seen: Column) -> Column:
    """First element that gives one of the labels a value; empty if none. ``seen`` is the text, folded."""

    def first(pattern: str) -> Column:
        got = F.arrays_zip(X.all_matches(text, pattern, 0).alias("m"), X.all_matches(text, pattern, 1).alias("k"))
        return F.when(needed.may_match(seen, pattern), F.get(F.filter(got, lambda p: X.norm(p["k"]).isin(*labels)), F.lit(0))["m"])

    return F.coalesce(first(Q.XML_ADD), first(Q.XML_ATTRIBUTE), F.lit(""))


def content_match(rule: dict, text: Column, seen: Column) -> Column:
    """A rule's first match in a text, empty if none; of account lines the first valid one. ``seen`` is the text, folded: a pattern is tried where that has what it needs."""
    worth = needed.may_match(seen, rule["pattern"])
    if rule["id"] == NOTE_RULE:
        lines = X.all_matches(text, rule["pattern"], 0)
        return F.when(worth, F.coalesce(F.get(F.filter(lines, lambda x: Q.parse_pair(x).isNotNull()), F.lit(0)), F.lit(""))).otherwise("")
    found = F.when(worth, X.first_match(text, rule["pattern"], ignore_case=not rule["case_sensitive"])).otherwise("")
    labels = {PASSWORD_RULE: Q.PASSWORD_LABELS, SECRET_RULE: Q.SECRET_LABELS}.get(rule["id"])
    return X.let(found, lambda f: F.when(f != "", f).otherwise(xml_fallback(text, labels, seen))) if labels else found


def content_found(rules: list[dict], text: Column) -> Column:
    """Array of the first match of each content rule, without its place; null or empty for a null text."""
    numbered = list(enumerate(of_type(rules, "content")))
    if not numbered:
        return F.array().cast("array<struct<seq:int,rule_id:string,rule_type:string,category:string,severity:string,confidence:string,match:string,tags:array<string>>>")
    return X.let(needed.folded(text), lambda seen: F.array_compact(F.array(*[_hit(r, 1000 + i, content_match(r, text, seen)) for i, r in numbered])))


def content_hits(rules: list[dict], text: Column) -> Column:
    """Array of the first match of each content rule with its ``line``, ``context`` and ``account``.

    The context is the line and its neighbours, the account an identity nearby;
    positions are those of the first place where the matched text stands.
    """
    if not of_type(rules, "content"):
        return F.array().cast("array<struct<seq:int,rule_id:string,rule_type:string,category:string,severity:string,confidence:string,match:string,tags:array<string>,line:int,context:string,account:string>>")
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def placed(h: Column, clean: Column, lines: Column) -> Column:
        line = F.size(F.split(F.substring(clean, F.lit(1), F.instr(clean, h["match"]) - 1), "\n"))
        return X.let(line, lambda n: F.struct(*[h[c].alias(c) for c in ("seq", "rule_id", "rule_type", "category", "severity", "confidence", "match", "tags")], n.alias("line"), _around(lines, n).alias("context"), _account(lines, n).alias("account")))

    both = F.struct(plain.alias("clean"), F.split(plain, "\n").alias("lines"))
    return X.let(content_found(rules, text), lambda hs: F.when(F.size(hs) == 0, F.array()).otherwise(X.let(both, lambda t: F.transform(hs, lambda h: placed(h, t["clean"], t["lines"])))))


def _around(lines: Column, line: Column) -> Column:
    return X.strip(F.array_join(F.slice(lines, F.greatest(line - 1, F.lit(1)), F.when(line > 1, 3).otherwise(2)), "\n"))


def _account(lines: Column, line: Column) -> Column:
    near = F.transform(F.array(*[F.lit(o) for o in (0, -1, 1, -2, 2, -3, 3)]), lambda o: identity(X.strip(F.coalesce(F.get(lines, line - 1 + o), F.lit("")))))
    return F.coalesce(F.get(F.filter(near, lambda x: x != ""), F.lit(0)), F.lit(""))


@X.untraced
def content_matches(files: DataFrame, rules: list[dict]) -> DataFrame:
    """The matches of :func:`content_hits` as rows; a null text has none."""
    rows = X.once(files, __hits=X.aside(content_hits(rules, F.col("text")))).drop("text")
    return rows.select("*", F.explode("__hits").alias("hit")).select("*", "hit.*").drop("hit", "__hits")


def identity(line: Column) -> Column:
    """Who a line speaks of: an account's label, an element's, or the line itself; empty if nobody."""

    def element(x: Column) -> Column:
        got = F.struct(X.strip(F.regexp_extract(x, to_java(Q.XML_ADD), 1)).alias("k"), X.strip(F.regexp_extract(x, to_java(Q.XML_ADD), 2)).alias("v"))
        return X.let(got, lambda e: F.when(e["k"].rlike(to_java(Q.ACCOUNT)), F.when(e["v"] != "", F.concat(e["k"], F.lit("="), e["v"])).otherwise(e["k"])))

    words = r"(?i)\b(?:dom(?:ain|ene) administrator|domene|domain|upn|email|account|login|user(?:name)?)\b"
    return F.when(line == "", "").otherwise(F.coalesce(Q.parse_pair(line)["label"], element(line), F.when(line.rlike(to_java(words)), line), F.lit("")))


@X.untraced
def drop_weak(matches: DataFrame, where: Column | None = None) -> DataFrame:
    """Content matches without those whose values are all placeholders or weak; adds ``quality``, null where that isn't asked.

    ``where`` says which rows are content matches; the others stay.
    """
    blob = F.when(X.strip(F.col("context")) != "", F.col("context")).otherwise(F.col("match"))
    connection = F.col("rule_id") == CONNECTION_RULE
    applies = connection | X.norm(F.col("category")).isin("credentials", "infrastructure")
    applies = applies if where is None else where & applies
    judged = X.let(blob, lambda b: X.let(Q.sensitive_values(b), lambda v: X.let(Q.best_quality(v), lambda q: F.when(connection, F.when(Q.is_connection(b), Q.connection_of(v, q)).otherwise(Q.none())).otherwise(q))))
    rows = X.once(matches, quality=judged if where is None else F.when(where, judged))
    return rows.where(~F.coalesce(applies & (X.strip(blob) != "") & F.col("quality.weak"), F.lit(False)))


def sample_matches(files: DataFrame, rules: list[dict], most: int = 5, around: int = 40) -> DataFrame:
    """Up to ``most`` matches of each rule, for testing rules: ``rule_id match snippet``.

    A snippet has up to ``around`` characters on both sides of the place where
    the matched text first stands.
    """
    on = {"filename": F.col("name"), "extension": F.lower("extension"), "content": F.col("text")}
    cases = [F.when(eligible(r), _samples(r, on[r["type"]], most, around)) for r in rules if r["action"] != "skip"]
    rows = files.select("*", F.explode(F.flatten(F.array_compact(F.array(*cases)))).alias("hit")).drop("text")
    return rows.select("*", "hit.*").drop("hit").where("match <> ''")


def _samples(rule: dict, on: Column, most: int, around: int) -> Column:
    got = F.slice(F.regexp_extract_all(on, F.lit(to_java(rule["pattern"], not rule["case_sensitive"])), F.lit(0)), 1, most)

    def one(m: Column) -> Column:
        at = F.greatest(F.instr(on, m) - around, F.lit(1))
        return F.struct(F.lit(rule["id"]).alias("rule_id"), m.alias("match"), F.substring(on, at, F.instr(on, m) - at + F.length(m) + around).alias("snippet"))

    return F.transform(got, one)
