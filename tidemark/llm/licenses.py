"""License scans by sentence rules, in DataFrame operations only.

A text is cut into sentences; each is normalised and mapped to identifiers of known licence
sentences; the sequence of identifiers is matched against ordered licence rules. A rule that
matches names its licence and takes its identifiers away, so later, less specific rules see
what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings of public licences. Of one family a sentence gets the first that
# matches; it may get identifiers of several families. Patterns see lower-case words with
# single blanks; of other characters only . + - are left.
_LATER = r".*\b(or|and) (at your option )?(any )?(later|newer)"
FAMILIES: list[list[tuple[str, str]]] = [
    [
        ("MITgrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("MITref", r"\bmit( x11| expat)?( style)? licen[cs]e|licensed under (the )?mit\b|spdx-license-identifier mit\b"),
    ],
    [("MITnotice", r"above copyright notice and this permission notice shall be included")],
    [("ISCgrant", r"permission to use copy modify (and or|and|or) distribute this software for any purpose"),
     ("ISCref", r"\bisc licen[cs]e|spdx-license-identifier isc\b")],
    [("AsIs", r"software is provided (by .* )?as is")],
    [("NoLiability", r"in no event shall the? ?.*(authors?|copyright (holders?|owner)|contributors) .*be liable")],
    [("BSDsource", r"redistributions of source code must retain"),
     ("BSDbinary", r"redistributions in binary form must reproduce"),
     ("BSDhead", r"redistribution and use in source and binary forms"),
     ("BSDendorse", r"neither the name .* (nor|may) .*endorse or promote"),
     ("BSD3ref", r"\bbsd[ -]3|3[ -]clause bsd|(new|modified|revised) bsd licen[cs]e"),
     ("BSD2ref", r"\bbsd[ -]2|2[ -]clause bsd|simplified bsd licen[cs]e"),
     ("BSDref", r"\bbsd( style)? licen[cs]e")],
    [("Apache2ref", r"apache( software)? licen[cs]e (v|version )?2|\bapache-2\.0\b"),
     ("Apache1ref", r"apache( software)? licen[cs]e (v|version )?1"),
     ("ApacheRef", r"\bapache( software)? licen[cs]e")],
    [("Apache2terms", r"you may not use this file except in compliance with the license"),
     ("Apache2copy", r"you may obtain a copy of the license at"),
     ("Apache2basis", r"distributed on an as is basis")],
    [("AGPL3later", rf"affero general public licen[cs]e.*\bv?3{_LATER}|\bagpl-3\.0-or-later\b"),
     ("AGPL3ref", r"affero general public licen[cs]e.*\bv?3|\bagpl(v| v|-)?3"),
     ("LGPL3later", rf"(lesser|library) general public licen[cs]e.*\bv?3{_LATER}|\blgpl-3\.0-or-later\b"),
     ("LGPL3ref", r"(lesser|library) general public licen[cs]e.*\bv?3|\blgpl(v| v|-)?3"),
     ("LGPL2later", rf"(lesser|library) general public licen[cs]e.*\bv?2{_LATER}|\blgpl-2\.[01]-or-later\b"),
     ("LGPL2ref", r"(lesser|library) general public licen[cs]e.*\bv?2|\blgpl(v| v|-)?2"),
     ("GPL3later", rf"general public licen[cs]e.*\bv?3{_LATER}|version 3 of the gnu general public licen[cs]e{_LATER}|\bgpl-3\.0-or-later\b"),
     ("GPL3ref", r"general public licen[cs]e.*\bv?3|version 3 of the gnu general public licen[cs]e|\bgpl(v| v|-)?3"),
     ("GPL2later", rf"general public licen[cs]e.*\bv?2{_LATER}|version 2 of the gnu general public licen[cs]e{_LATER}|\bgpl-2\.0-or-later\b"),
     ("GPL2ref", r"general public licen[cs]e.*\bv?2|version 2 of the gnu general public licen[cs]e|\bgpl(v| v|-)?2"),
     ("GPLref", r"general public licen[cs]e")],
    [("GPLnowarranty", r"distributed in the hope that it will be useful but without any warranty")],
    [("MPL2ref", r"mozilla public licen[cs]e.*\bv?2|\bmpl-2\.0\b"),
     ("MPL1ref", r"mozilla public licen[cs]e"),
     ("EPLref", r"eclipse public licen[cs]e"),
     ("BSLref", r"boost software licen[cs]e"),
     ("ZlibRef", r"\bzlib( libpng)? licen[cs]e"),
     ("Unlicense", r"free and unencumbered software released into the public domain|\bthe unlicense\b"),
     ("PublicDomain", r"\bpublic domain\b")],
    [("CC0ref", r"\b(cc0|cc zero|creative commons zero)\b"),
     ("CCBYNCSAref", r"\b(cc|creative commons)[ -](by|attribution)[ -]+(nc|noncommercial)[ -]+(sa|sharealike)\b"),
     ("CCBYNCNDref", r"\b(cc|creative commons)[ -](by|attribution)[ -]+(nc|noncommercial)[ -]+(nd|noderiv)"),
     ("CCBYNCref", r"\b(cc|creative commons)[ -](by|attribution)[ -]+(nc|noncommercial)\b"),
     ("CCBYSAref", r"\b(cc|creative commons)[ -](by|attribution)[ -]+(sa|sharealike)\b"),
     ("CCBYNDref", r"\b(cc|creative commons)[ -](by|attribution)[ -]+(nd|noderiv)"),
     ("CCBYref", r"\b(cc|creative commons)[ -](by|attribution)\b")],
    [("Copyright", r"\bcopyright (c |by |[0-9])")],
    [("AllRights", r"\ball rights reserved\b")],
]
LIKE_A_LICENCE = r"\blicen[cs]ed? (under|agreement|terms|and conditions)|\bthe terms of th(e|is) licen[cs]e"
# Sequences of identifiers, the most specific first, and the licence they name.
RULES: list[tuple[str, str]] = [
    ("BSD-3-Clause", r"(\|BSDhead)?\|BSDsource\|BSDbinary\|BSDendorse(\|AsIs)?(\|NoLiability)?\|"),
    ("BSD-2-Clause", r"(\|BSDhead)?\|BSDsource\|BSDbinary(\|AsIs)?(\|NoLiability)?\|"),
    ("MIT", r"(\|MITref)?\|MITgrant\|MITnotice(\|AsIs)?(\|NoLiability)?\|"),
    ("ISC", r"\|ISCgrant(\|AsIs)?(\|NoLiability)?\|"),
    ("Apache-2.0", r"\|Apache2ref(\|Apache2terms)?(\|Apache2copy)?(\|Apache2basis)?\|"),
    ("AGPL-3.0-or-later", r"\|AGPL3later(\|GPLnowarranty)?(\|AGPL3later|\|AGPL3ref)?\|"),
    ("AGPL-3.0", r"\|AGPL3ref(\|GPLnowarranty)?\|"),
    ("LGPL-3.0-or-later", r"\|LGPL3later(\|GPLnowarranty)?\|"),
    ("LGPL-3.0", r"\|LGPL3ref(\|GPLnowarranty)?\|"),
    ("LGPL-2-or-later", r"\|LGPL2later(\|GPLnowarranty)?\|"),
    ("LGPL-2", r"\|LGPL2ref(\|GPLnowarranty)?\|"),
    ("GPL-3.0-or-later", r"\|GPL3later(\|GPLnowarranty)?(\|GPLref)?\|"),
    ("GPL-3.0", r"\|GPL3ref(\|GPLnowarranty)?(\|GPLref)?\|"),
    ("GPL-2.0-or-later", r"\|GPL2later(\|GPLnowarranty)?(\|GPLref)?\|"),
    ("GPL-2.0", r"\|GPL2ref(\|GPLnowarranty)?(\|GPLref)?\|"),
    ("GPL", r"\|GPLref(\|GPLnowarranty)?\|"),
    ("MIT", r"\|MITref\|"),
    ("MIT-incomplete", r"\|MITgrant(\|AsIs)?(\|NoLiability)?\|"),
    ("ISC", r"\|ISCref\|"),
    ("BSD-3-Clause", r"\|BSD3ref\|"),
    ("BSD-2-Clause", r"\|BSD2ref\|"),
    ("BSD", r"\|BSDref\|"),
    ("Apache-1", r"\|Apache1ref\|"),
    ("Apache", r"\|ApacheRef\|"),
    ("MPL-2.0", r"\|MPL2ref\|"),
    ("MPL-1", r"\|MPL1ref\|"),
    ("EPL", r"\|EPLref\|"),
    ("BSL-1.0", r"\|BSLref\|"),
    ("Zlib", r"\|ZlibRef\|"),
    ("Unlicense", r"\|Unlicense\|"),
    ("Public-domain", r"\|PublicDomain\|"),
    ("CC0-1.0", r"\|CC0ref\|"),
    ("CC-BY-NC-SA", r"\|CCBYNCSAref\|"),
    ("CC-BY-NC-ND", r"\|CCBYNCNDref\|"),
    ("CC-BY-NC", r"\|CCBYNCref\|"),
    ("CC-BY-SA", r"\|CCBYSAref\|"),
    ("CC-BY-ND", r"\|CCBYNDref\|"),
    ("CC-BY", r"\|CCBYref\|"),
    ("All-rights-reserved", r"(\|Copyright)?\|AllRights\|"),
    ("Unknown", r"\|Unknown\|"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Every pattern above needs one of these words, so other texts need not be cut up. Between
# words anything may stand that normalising makes a blank.
TRIGGER = (
    r"licen[cs]e|permission|warranty|redistribution|neither|in[^a-z0-9]+no[^a-z0-9]+event|as[^a-z0-9]+is|copyright|reserved|"
    r"public[^a-z0-9]+domain|unencumbered|spdx|gpl|bsd|apache-2|mpl-2|cc0|cc[^a-z0-9]+(by|zero|attribution)|"
    r"creative[^a-z0-9]+commons|you[^a-z0-9]+may"
)
# A point after these ends no sentence if it goes on with one of the words, or with a number;
# nor does any point inside the clause on names, whatever names stand there.
_GAP = r"[^a-z0-9.+-]{1,40}"
_GOES_ON = (
    r"(?<=\b(?:inc|ltd|llc|co|corp|plc)\.)\s[^a-z0-9.+-]*+(?:nor|or|and|may|as|be|shall|not|inc|ltd|llc|co|corp|plc)\b|"
    r"(?<=\bno\.)\s+[0-9]|"
    rf"(?<=\bneither{_GAP}the{_GAP}name\b[^!?]{{1,200}}\.)\s+[^!?]{{0,300}}?\bendorse{_GAP}or{_GAP}promote\b"
)
VERSION = r"\bv\.[^a-z0-9.+-]+(?=[0-9])"  # the patterns know versions as v2
SENTENCE_END = rf"[.!?]+(?!{_GOES_ON})\s+|\n\s*\n"
NOT_A_WORD = r"[^a-z0-9.+-]+"
# Of the SQL twin, which has no look-behind: it ends sentences at abbreviations too, and it
# leaves out texts whose only words are cc attribution or an in no event over two lines.
TWIN_SENTENCE_END = r"[.!?]+\s+|\n\s*\n"
TWIN_TRIGGER = (
    r"licen[cs]e|licensed|permission|warranty|redistribution|neither the name|in no event|as[^a-z0-9]+is|"
    r"copyright|reserved|public[^a-z0-9]+domain|unencumbered|spdx|gpl|bsd|apache-2|mpl-2|cc0|cc[^a-z0-9]+(by|zero)|"
    r"creative[^a-z0-9]+commons|you may|neither"
)


def _identifiers(sentence: Column) -> Column:
    """Identifiers of one normalised sentence, one at most from each family."""
    known = [F.coalesce(*(F.when(sentence.rlike(p), F.lit(n)) for n, p in family)) for family in FAMILIES]
    found = F.array_compact(F.array(*known))
    unknown = F.when(sentence.rlike(LIKE_A_LICENCE), F.array(F.lit("Unknown"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(unknown)


def sentences(text: Column) -> Column:
    """Normalised sentences of a lower-case text."""
    whole = F.regexp_replace(text, VERSION, "v")
    normal = F.transform(F.split(whole, SENTENCE_END), lambda s: F.regexp_replace(s, NOT_A_WORD, " "))
    return F.transform(normal, lambda s: F.regexp_replace(F.trim(s), r"[ .+-]+$", ""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licences, status for every row of ``docs(doc_id, text)``.

    sentence_ids are the identifiers in text order, licences those that the rules name in rule
    order (both joined by commas); status is ``none``, ``unknown`` (something that reads like
    a licence, but no known one) or ``known``. A null or empty text gives ``none``. Repeated
    rows each come out; other columns, whatever their names, are ignored; an empty table
    gives an empty result. No shuffle.
    """
    lowered = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    cut = F.when(F.col("low").rlike(TRIGGER), sentences(F.col("low"))).otherwise(F.array().cast("array<string>"))
    mapped = lowered.select("doc_id", F.flatten(F.transform(cut, _identifiers)).alias("ids"))
    rules = F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(p).alias("pattern")) for n, p in RULES))
    start = F.struct(
        F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")).alias("left"),
        F.array().cast("array<string>").alias("found"),
    )

    def apply(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["left"], rule["pattern"])
        return F.struct(
            F.when(hit, F.regexp_replace(state["left"], rule["pattern"], F.lit("|"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["licence"]))).otherwise(state["found"]).alias("found"),
        )

    licences = F.when(F.size("ids") > 0, F.aggregate(rules, start, apply)["found"])
    named = mapped.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), licences.alias("found"))
    known = F.coalesce(F.array_distinct("found"), F.array().cast("array<string>"))
    return named.withColumn("found", known).select(
        "doc_id",
        "sentence_ids",
        F.array_join("found", ",").alias("licences"),
        F.when(F.size("found") == 0, "none")
        .when((F.size("found") == 1) & (F.col("found")[0] == "Unknown"), "unknown")
        .otherwise("known")
        .alias("status"),
    )


def duckdb_sql() -> str:
    """The same scan for DuckDB, from the same tables, but for the two constants above."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def case(family: list[tuple[str, str]]) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN '{n}'" for n, p in family) + " END"

    known = ", ".join(map(case, FAMILIES))
    steps, found = [], []
    for k, (licence, pattern) in enumerate(RULES):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (rest, found), regexp_replace(rest, {quoted(pattern)}, '|', 'g') AS rest, "
            f"CASE WHEN regexp_matches(rest, {quoted(pattern)}) AND NOT list_contains(found, '{licence}') "
            f"THEN list_append(found, '{licence}') ELSE found END AS found FROM r{k})"
        )
        found.append(licence)
    return rf"""
WITH n AS (
  SELECT doc_id, row_number() OVER () AS row,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low
  FROM documents),
s AS (
  SELECT row, unnest(list_transform(string_split_regex(low, {quoted(TWIN_SENTENCE_END)}),
         lambda x: regexp_replace(trim(regexp_replace(x, {quoted(NOT_A_WORD)}, ' ', 'g'), ' '), '[ .+-]+$', ''))) AS s,
         generate_subscripts(string_split_regex(low, {quoted(TWIN_SENTENCE_END)}), 1) AS place
  FROM n WHERE regexp_matches(low, {quoted(TWIN_TRIGGER)})),
k AS (SELECT row, place, s, list_filter([{known}], lambda x: x IS NOT NULL) AS known FROM s),
i AS (
  SELECT row, place, CASE WHEN len(known) > 0 THEN known
                          WHEN regexp_matches(s, {quoted(LIKE_A_LICENCE)}) THEN ['Unknown'] ELSE [] END AS ids
  FROM k),
g AS (SELECT row, flatten(list(ids ORDER BY place)) AS ids FROM i GROUP BY row),
r0 AS MATERIALIZED (
  SELECT doc_id, array_to_string(coalesce(ids, []), ',') AS sentence_ids,
         CASE WHEN len(coalesce(ids, [])) > 0 THEN '|' || array_to_string(ids, '|') || '|' ELSE '' END AS rest,
         []::VARCHAR[] AS found
  FROM n LEFT JOIN g USING (row)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, array_to_string(found, ',') AS licences,
       CASE WHEN len(found) = 0 THEN 'none' WHEN found = ['Unknown'] THEN 'unknown' ELSE 'known' END AS status
FROM r{len(RULES)}
"""
