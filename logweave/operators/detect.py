"""Format families, fingerprints and the rules that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions import fixed
from logweave.functions.text import clean, is_json_object, matches, occurrences, strip, tokens
from logweave.functions.timestamps import looks_like_time_or_severity

_S = fixed.SHAPES


def _python_severity(s: Column) -> Column:
    return matches(s, rf"^(?:{'|'.join(w for w in fixed.SEVERITY_WORDS if 3 <= len(w) <= 8)}):[a-zA-Z0-9_.]+:")


def family(s: Column, now: Column) -> Column:
    """Family of a cleaned line; the first that fits."""
    pipes, commas, semicolons, tabs, equals = (occurrences(s, c) for c in "|,;\t=")
    pairs = F.regexp_extract_all(s, F.lit(_S["pair"]), F.lit(0))
    covered = F.aggregate(pairs, F.lit(0), lambda n, p: n + F.length(p))
    java = matches(s, _S["java_time"]) & (matches(s, _S["java_main"]) | matches(s, _S["java_dashes"]) | matches(s, _S["java_level"]))
    csv = looks_like_time_or_severity(F.substring_index(s, ",", 1), now) | (tokens(s) <= 6) | (commas >= 3)
    tests = (
        ("generic", s == ""),
        ("json", is_json_object(s)),
        ("cef", s.startswith("CEF:")),
        ("leef", s.startswith("LEEF:")),
        ("ncsa", matches(s, _S["ncsa"])),
        ("rfc5424", matches(s, _S["rfc5424"])),
        ("rfc3164", matches(s, _S["rfc3164"])),
        ("cri", matches(s, _S["cri"])),
        ("nginx_error", matches(s, _S["nginx_error"])),
        ("python", _python_severity(s)),
        ("java", java),
        ("postgres", matches(s, _S["postgres"])),
        ("pipe", pipes >= 2),
        ("csv", (commas >= 2) & (equals < 3) & csv),
        ("semicolon", (semicolons >= 2) & (equals < 3)),
        ("tab", tabs >= 2),
        ("logfmt", (equals >= 3) & ~s.rlike(r"[\[(]") & (F.size(pairs) >= 3) & (covered >= F.length(s) * 0.35)),
    )
    out = F.when(tests[0][1], tests[0][0])
    for name, test in tests[1:]:
        out = out.when(test, name)
    return out.otherwise("generic")


def fingerprint(s: Column, fam: Column, now: Column) -> Column:
    """Nine features of a cleaned line."""
    is_json = is_json_object(s)
    pipes, commas, equals = (occurrences(s, c) for c in "|,=")
    header = s.startswith("CEF:") | s.startswith("LEEF:")
    first = looks_like_time_or_severity(F.substring_index(s, ",", 1), now)
    delim = F.when(is_json | header, F.lit(None)).when(pipes >= 2, "|").when((commas >= 3) & ((tokens(s) == 1) | first), ",")
    shape = (
        F.when(is_json, "json")
        .when(s.startswith("CEF:"), "cef")
        .when(s.startswith("LEEF:"), "leef")
        .when(matches(s, _S["ncsa"]), "ncsa")
        .when(matches(s, _S["rfc5424"]), "rfc5424")
        .when(matches(s, _S["rfc3164_loose"]), "rfc3164")
        .when(matches(s, _S["cri_loose"]), "cri")
        .when(matches(s, _S["nginx_error"]), "nginx_err")
        .when(matches(s, _S["python"]), "python")
        .when(matches(s, _S["java_main"]) | matches(s, _S["java_dashes"]), "java")
        .when((equals >= 3) & ~s.rlike(r"[\[(]") & s.rlike(r"=\S+"), "logfmt")
        .when(delim.isNotNull(), F.concat(F.lit("delim_"), delim))
        .otherwise("generic")
    )
    brackets = occurrences(s, "[") + occurrences(s, "(")
    return F.struct(
        brackets.alias("bracket_count"),
        commas.alias("comma_count"),
        delim.alias("delim"),
        equals.alias("eq_count"),
        fam.alias("family"),
        shape.alias("fmt_type"),
        is_json.alias("is_json"),
        pipes.alias("pipe_count"),
        tokens(s).alias("tok_count"),
    )


def fingerprint_key(f: Column) -> Column:
    """JSON with sorted keys, nulls written."""
    return F.to_json(f, {"ignoreNullFields": "false"})


def heuristic_rule(raw: Column, f: Column) -> Column:
    """Rule (method, delimiter, signature, inferred_by) of a record and its fingerprint; the record keeps its colour codes here."""
    s = strip(raw)
    labels = F.lit(None).cast("string")
    logfmt = matches(s, r"=\S+") & (F.regexp_count(s, F.lit(r"\b[a-zA-Z0-9_.-]+=")) >= 3)
    labels = F.when(logfmt, fixed.LOGFMT_LABEL).otherwise(labels)
    for label, shape in reversed(fixed.FORMAT_LABELS):
        labels = F.when(matches(s, shape), label).otherwise(labels)
    delim = f["delim"]
    fields = F.when(delim == "|", F.concat(F.lit("Pipe-Delimited ("), f["pipe_count"] + 1)).otherwise(F.concat(F.lit("Comma-Delimited ("), f["comma_count"] + 1))
    zones = F.concat(F.lit("Compositional Zone Extraction (Tokens: "), f["tok_count"], F.lit(", K/V: "), f["eq_count"], F.lit(", Brackets: "), f["bracket_count"], F.lit(")"))
    by_delimiter = ~f["is_json"] & labels.isNull() & delim.isNotNull()
    return F.struct(
        F.when(f["is_json"], "json").when(by_delimiter, "delimiter").otherwise("compositional").alias("method"),
        F.when(by_delimiter, delim).alias("delimiter"),
        F.when(f["is_json"], "JSON Object").when(labels.isNotNull(), labels).when(by_delimiter, F.concat(fields, F.lit(" fields)"))).otherwise(zones).alias("signature"),
        F.lit("heuristic").alias("inferred_by"),
    )


def cleaned(raw: str = "raw") -> Column:
    return clean(F.col(raw))
