"""The record of a file, and the choice of its frontend."""

from __future__ import annotations

import math
import re

import regex

_LITS = "array<struct<index:int,key:string,kind:string,text:string>>"
_CALLS = f"array<struct<name:string,receiver:string,line:int,arg_count:int,start:int,end:int,name_line:int,name_col:int,arg_lits:{_LITS},type_args:array<string>,assigned_to:string>>"
_DECOS = f"array<struct<name:string,line:int,arg_lits:{_LITS}>>"
_FUNCTIONS = (
    "array<struct<name:string,start_line:int,end_line:int,start:int,end:int,signature:string,containing_type:string,param_count:int,"
    f"is_toplevel:boolean,is_exported:boolean,calls:{_CALLS},decorations:{_DECOS},ret_strs:array<string>,locals:array<struct<name:string,type:string>>,features:map<string,int>>>"
)
SCHEMA = (
    f"package string, imports array<struct<path:string,names:array<string>,line:int,system:boolean>>, functions {_FUNCTIONS}, "
    "type_decorations array<struct<type_name:string,name:string,line:int,arg_lits:" + _LITS + ">>, consts array<struct<name:string,value:string>>, "
    "fields array<struct<owner:string,name:string,type_name:string>>, hierarchy array<struct<derived:string,base:string>>"
)
#: Most literals of a call, characters of a literal, constants and fields of a file.
MAX_LITS, MAX_TEXT, MAX_CONSTS, MAX_FIELDS, MAX_LOCALS = 10, 200, 200, 400, 64
TOPLEVEL = "(toplevel)"

_SPLIT = [regex.compile(p) for p in (r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})")]
_BREAK = regex.compile(r"[^\p{L}\p{N}]+")


def words_of(name: str) -> list[str]:
    for p in _SPLIT:
        name = p.sub(r"\1 \2", name)
    return [w for w in _BREAK.split(name.lower()) if w]


def simple_type(t: str | None) -> str | None:
    """The last part of a plain type name; null for generics, unions and the like."""
    t = (t or "").strip().strip("?*&").strip()
    if not t or len(t) > 200 or re.search(r"[\s<>\[\](){},|&*'\"]", t):
        return None
    last = re.split(r"[.:\\]", t)[-1]
    return last if 0 < len(last) <= 64 else None


def new_function(name: str, **known) -> dict:
    f = {"name": name, "start_line": 1, "end_line": 1, "start": 0, "end": 0, "signature": "", "containing_type": None, "param_count": 0, "is_toplevel": False, "is_exported": False}
    return {**f, "calls": [], "decorations": [], "ret_strs": [], "locals": [], "features": {}, **known}


def new_file() -> dict:
    return {"package": None, "imports": [], "functions": [], "type_decorations": [], "consts": [], "fields": [], "hierarchy": []}


def bump(features: dict, key: str, n: int = 1) -> None:
    features[key] = features.get(key, 0) + n


def finish(record: dict, text: str) -> dict:
    """Completes shared features and caps, and puts the module scope, if it calls anything, last."""
    top = record.pop("top", None)
    for f in record["functions"]:
        feats = f["features"]
        bump(feats, f"arity:{min(f['param_count'], 12)}")
        bump(feats, f"size:{int(math.log2(max(1, f['end_line'] - f['start_line'] + 1)))}")
        for c in f["calls"]:
            bump(feats, f"call:{c['name']}")
    record["functions"].sort(key=lambda f: (f["start"], -f["end"]))
    if top and (top["calls"] or top["decorations"]):
        top["end_line"] = text.count("\n") + 1
        top["features"] = {"ast:toplevel": 1}
        for c in top["calls"]:
            bump(top["features"], f"call:{c['name']}")
        record["functions"].append(top)
    for f in record["functions"]:
        f["calls"].sort(key=lambda c: (c["start"], c["end"]))
        f["locals"], f["ret_strs"] = f["locals"][:MAX_LOCALS], f["ret_strs"][:2]
        f["signature"] = f["signature"][:160]
        for c in [*f["calls"], *f["decorations"]]:
            c["arg_lits"] = [{**x, "text": x["text"][:MAX_TEXT]} for x in c["arg_lits"][: MAX_LITS if not c.get("deep") else None]]
            c.pop("deep", None)
    record["consts"], record["fields"] = record["consts"][:MAX_CONSTS], record["fields"][:MAX_FIELDS]
    for d in record["type_decorations"]:
        d["arg_lits"] = d["arg_lits"][:MAX_LITS]
    return record


def extract_text(language: str, path: str, text: str) -> dict:
    """The record of one file; an empty one for languages without functions and for text that cannot be read."""
    from loomgraph.sources.frontends import generic, python, schemas

    text = text or ""
    try:
        if language == "python":
            return finish(python.parse(text), text)
        if language in ("sql", "prisma", "graphql", "yaml"):
            return finish(schemas.parse(language, text), text)
        if language in generic.PROFILES:
            return finish(generic.parse(language, text), text)
    except (RecursionError, ValueError, SyntaxError):
        pass
    return new_file()
