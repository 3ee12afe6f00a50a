"""Schema languages: SQL, Prisma and GraphQL definitions with what they refer to; shallow YAML."""

from __future__ import annotations

import re

from loomgraph.sources.frontends.record import TOPLEVEL, new_file, new_function

_COMMENTS = {"sql": r"--[^\n]*|/\*.*?\*/", "prisma": r"//[^\n]*", "graphql": r'#[^\n]*|""".*?"""', "yaml": r"(?m)(?<!\S)#[^\n]*"}
_DEFS = {
    "sql": r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:unique\s+)?(?:materialized\s+)?(?:table|view|function|procedure|index|trigger)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)",
    "prisma": r"(?m)^\s*(?:model|enum|type|view)\s+(?P<name>\w+)",
    "graphql": r"(?m)^\s*(?:extend\s+)?(?:type|interface|input|enum|union|scalar)\s+(?P<name>\w+)",
    "yaml": r"(?m)^(?P<name>[A-Za-z_/][\w./{}-]*)\s*:",
}
_REFS = {
    "sql": r"(?i)\b(?:from|join|references|into|update|on)\s+(?P<name>[\w.\"`]+)",
    "prisma": r"(?m)^\s+\w+\s+(?P<name>[A-Z]\w*)",
    "graphql": r"[:=|&]\s*\[?(?P<name>[A-Z]\w*)",
    "yaml": r"\$ref\s*:\s*['\"]?#?(?:/\w+)*/(?P<name>\w+)",
}
_PLAIN = {"Int", "String", "Boolean", "Float", "ID", "DateTime", "Json", "Decimal", "BigInt", "Bytes"}


def parse(language: str, text: str) -> dict:
    record = new_file()
    code = re.sub(_COMMENTS[language], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    line = lambda at: text.count("\n", 0, at) + 1
    found = list(re.finditer(_DEFS[language], code))
    top = new_function(TOPLEVEL, is_toplevel=True, end=len(text))
    for i, m in enumerate(found):
        stop = found[i + 1].start() if i + 1 < len(found) else len(code)
        body_end = code.find(";", m.end()) + 1 if language == "sql" else m.start() + len(code[m.start() : stop].rstrip())
        end = min(stop, body_end) if body_end > 0 else stop
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        f = new_function(_clean(m["name"]), start=start, end=end, start_line=line(start), end_line=line(max(start, end - 1)), signature=text[start : text.find("\n", start) if "\n" in text[start:] else len(text)].strip())
        record["functions"].append(f)
    for m in re.finditer(_REFS[language], code):
        name = _clean(m["name"])
        if name in _PLAIN or (language == "sql" and name.lower() in ("select", "delete", "update", "conflict", "true", "false")):
            continue
        owner = next((f for f in record["functions"] if f["start"] <= m.start("name") < f["end"]), top)
        at = m.start("name")
        if owner["name"] == name and language == "sql" and at - owner["start"] < 60:
            continue
        owner["calls"].append({"name": name, "receiver": None, "line": line(at), "arg_count": 0, "start": at, "end": m.end(), "name_line": line(at), "name_col": at - (text.rfind("\n", 0, at) + 1), "arg_lits": [], "type_args": [], "assigned_to": None})
    record["top"] = top
    return record


def _clean(name: str) -> str:
    return re.split(r"\.", name.strip("\"`"))[-1].strip("\"`")
