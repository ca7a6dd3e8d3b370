"""Rules from an outside provider: an injected callable, its reply read and checked on the driver, once per unseen family."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from logweave.functions.fixed import FAMILIES

METHODS, DELIMITERS = ("json", "delimiter", "compositional"), {"|": "Pipe", ",": "Comma", "\t": "Tab", ";": "Semicolon"}
LONGEST_INPUT, LONGEST_ERROR = 500, 300


def reply_object(text: str | None) -> dict | None:
    """The JSON object of a reply: a fenced block, the whole text, else the last flat object that names a method, else the first."""
    body = (text or "").strip()
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)\s*```", body)
    body = fenced[1] if fenced else body
    candidates = [body, *re.findall(r"\{[^{}]*\}", body)]
    read = []
    for c in candidates:
        try:
            value = json.loads(c)
        except ValueError:
            continue
        if isinstance(value, dict):
            if c is body:
                return value
            read.append(value)
    return next((o for o in reversed(read) if "method" in o), read[0] if read else None)


def checked_rule(reply: str | None, line: str, is_json: bool, fallback: str, provider: str = "provider") -> tuple[dict | None, str | None]:
    """(rule, None) or (None, what is wrong with it)."""
    if not reply:
        return None, f"no reply from {provider}"
    found = reply_object(reply)
    if found is None:
        return None, f"no JSON object in the reply of {provider}"
    method, delimiter = found.get("method"), found.get("delimiter")
    if method not in METHODS:
        return None, f"{provider} names the unknown method {method!r}"
    if method == "json":
        return ({"method": "json", "signature": "JSON Object", "inferred_by": "llm"}, None) if is_json else (None, f"{provider} sees JSON where there is none")
    if method == "compositional":
        return {"method": method, "signature": fallback, "inferred_by": "llm"}, None
    if delimiter not in DELIMITERS:
        return None, f"{provider} names the unknown delimiter {delimiter!r}"
    if delimiter not in line:
        return None, f"{provider} names the delimiter {delimiter!r}, which the line lacks"
    return {"method": method, "delimiter": delimiter, "signature": f"{DELIMITERS[delimiter]}-Delimited", "inferred_by": "llm"}, None


def discover(firsts: DataFrame, providers: dict[str, Callable[[str], str]]) -> list[dict]:
    """Rules for the first record of each unseen family (family, raw, own_rule), of which there are 17 at most.

    Providers are asked in turn; a denial ends a provider for the run; without a good reply the heuristic rule stays.
    """
    out, denied = [], set()
    for row in firsts.limit(len(FAMILIES) + 1).collect():
        own, errors, rule = row["own_rule"].asDict(), [], None
        for name, ask in providers.items():
            if name in denied:
                continue
            try:
                rule, error = checked_rule(ask(row["raw"][:LONGEST_INPUT]), row["raw"], own["method"] == "json", own["signature"], name)
            except PermissionError as e:
                denied.add(name)
                rule, error = None, f"{name}: {e}"
            except Exception as e:  # a provider's failure is reported with the rule
                rule, error = None, f"{name} failed: {type(e).__name__}"
            if rule:
                break
            errors.append(error)
        out.append({"family": row["family"], **(rule or own), "llm_error": "; ".join(errors)[:LONGEST_ERROR] or None if not rule else None})
    return out
