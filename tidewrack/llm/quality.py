"""Line-first cleaning: bad lines go, then documents that lost too much text.

All rules are built-in expressions on an array of lines, so a text is cleaned
where it is read: no shuffle and no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm._rows import fresh

#: Greatest share of a text's characters that its failing lines may hold.
MOST_LOST = 0.5

#: Line ends of all systems, and what is trimmed from a line.
LINE_END = "\r\n|[\n\r\u0085\u2028\u2029]"
BLANKS = " \t\f\v\u00a0\u2007\u202f\u3000\ufeff"

#: A line ends a sentence, perhaps inside quotes or brackets.
ENDING = "[.!?:;…。！？][\"'”’»)\\]]*$"
#: Runs of marks that prose doesn't have; more than one to ten words fails a line.
MARKS = "[!?]{2,}|[#$%&*~=+^|<>]{2,}"
#: Separators of menus and breadcrumbs; two or more with at most four words to an entry fail a line.
ENTRIES = " [|>/›»•·] "
BOILERPLATE = (
    "(?i)(all rights reserved|licen[cs]ed under|released under the|under the gnu|terms of (use|service)|privacy policy|"
    "cookie policy|uses cookies|enable javascript|requires javascript|subscribe to our|sign up for|log in to|sign in to|"
    "click here|read more|share this|follow us|skip to (main )?content|copyright ©|© ?[12][0-9]{3}|lorem ipsum|"
    "alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|verwendet cookies|cookie-richtlinie|hier klicken|mehr lesen|weiterlesen|folgen sie uns|newsletter abonnieren|"
    "tous droits réservés|conditions d'utilisation|politique de confidentialité|utilise des cookies|cliquez ici|en savoir plus|suivez-nous|abonnez-vous|"
    "todos los derechos reservados|condiciones de uso|política de privacidad|utiliza cookies|haga clic aquí|leer más|síguenos|suscríbete)"
)


#: The phrases of :data:`BOILERPLATE` one by one, in lower case, and what remains of it.
PHRASES = (
    "all rights reserved", "licenced under", "licensed under", "released under the", "under the gnu", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "enable javascript", "requires javascript", "subscribe to our", "sign up for", "log in to", "sign in to",
    "click here", "read more", "share this", "follow us", "skip to main content", "skip to content", "copyright ©", "lorem ipsum",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "cookie-richtlinie", "hier klicken", "mehr lesen", "weiterlesen", "folgen sie uns", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "cliquez ici", "en savoir plus", "suivez-nous", "abonnez-vous",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utiliza cookies", "haga clic aquí", "leer más", "síguenos", "suscríbete",
)
DATED = "© ?[12][0-9]{3}"
#: Marks that end a sentence, and those that may follow.
ENDS, CLOSERS = ".!?:;…。！？", "\"'”’»)]"


def line_passes(line: Column) -> Column:
    """Whether a trimmed line passes the punctuation, navigation and boilerplate rules.

    The rules are :data:`ENDING`, :data:`MARKS`, :data:`ENTRIES` and
    :data:`BOILERPLATE`. Fixed phrases are searched as they are, and words are
    counted only in lines that have marks or separators at all.
    """
    words = F.regexp_count(line, F.lit(f"[^{BLANKS}]+"))
    ended = F.substring(F.rtrim(line, F.lit(CLOSERS)), -1, 1).isin(*ENDS)
    clean = ~line.rlike(MARKS) | (F.regexp_count(line, F.lit(MARKS)) * 10 <= words)
    separators = F.regexp_count(line, F.lit(ENTRIES))
    navigation = line.rlike(ENTRIES) & (separators >= 2) & (words - separators <= 4 * (separators + 1))
    dated = line.contains("©") & line.rlike(DATED)
    phrase = F.exists(F.array(F.lower(line)), lambda low: reduce(Column.__or__, [low.contains(p) for p in PHRASES]))
    return ended & clean & ~navigation & ~dated & ~phrase


def _judged(docs: DataFrame, text_col: str, most_lost: float) -> tuple[DataFrame, str, str, str]:
    """``docs`` that stay, with their kept lines and the characters before and after.

    The lines are exploded as one struct a row, so that no optimizer rule
    copies their evaluation into the conditions that use it.
    """
    one, good, before, after = fresh(docs, "one", "good", "before", "after")
    length = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x))
    split = F.filter(F.transform(F.split(docs[text_col].cast("string"), LINE_END), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")
    kept = lambda x: F.struct(length(x).alias("before"), F.filter(x, line_passes).alias("good"))
    counted = lambda x: F.struct(x["before"].alias("before"), x["good"].alias("good"), length(x["good"]).alias("after"))
    out = docs.select("*", F.explode(F.transform(F.transform(F.array(split), kept), counted)).alias(one))
    out = out.withColumns({good: F.col(f"{one}.good"), before: F.col(f"{one}.before"), after: F.col(f"{one}.after")}).drop(one)
    lost = F.col(before) - F.col(after)
    return out.where((F.col(after) > 0) & (lost <= F.col(before) * F.lit(most_lost))), good, before, after


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", most_lost: float = MOST_LOST) -> DataFrame:
    """``docs`` with failing lines removed and without documents that lost too much.

    Same columns; ``chars_col``, where there is one, is counted anew. Lines may
    end as on any system and are joined by line feeds; they are trimmed of all
    white space and empty ones dropped, which counts as no loss. A text that is
    null, empty, or left without a line is rejected; repeated rows are judged
    alike, each by itself; an empty table gives no rows.
    """
    out, good, _, _ = _judged(docs, text_col, most_lost)
    out = out.withColumn(text_col, F.array_join(good, "\n"))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """Kept documents: ``doc_id``, cleaned ``text``, kept lines, characters before and after.

    Null, empty and repeated rows as in :func:`clean`.
    """
    out, good, before, after = _judged(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", most_lost)
    return out.select("doc_id", F.array_join(good, "\n").alias("text"), F.size(good).alias("n_lines"), F.col(before).alias("chars_before"), F.col(after).alias("chars_after"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{LINE_END}'), lambda x: trim(x, '{BLANKS}')), lambda x: x <> '') AS lines
  FROM documents
), judged AS (
  SELECT doc_id, lines, list_filter(lines, lambda x:
    regexp_matches(x, '{_quoted(ENDING)}')
    AND len(regexp_extract_all(x, '{MARKS}')) * 10 <= len(regexp_extract_all(x, '[^{BLANKS}]+'))
    AND NOT (len(regexp_extract_all(x, '{ENTRIES}')) >= 2
      AND len(regexp_extract_all(x, '[^{BLANKS}]+')) - len(regexp_extract_all(x, '{ENTRIES}')) <= 4 * (len(regexp_extract_all(x, '{ENTRIES}')) + 1))
    AND NOT regexp_matches(x, '{_quoted(BOILERPLATE)}')) AS good
  FROM split
), counted AS (
  SELECT doc_id, array_to_string(good, chr(10)) AS text, CAST(len(good) AS INTEGER) AS n_lines,
    CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS INTEGER) AS chars_before,
    CAST(coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS INTEGER) AS chars_after
  FROM judged
)
SELECT * FROM counted WHERE chars_after > 0 AND chars_before - chars_after <= chars_before * {MOST_LOST}
"""
