"""Python through the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from loomgraph.sources.frontends.record import TOPLEVEL, bump, new_file, new_function, simple_type, words_of

_LOOPS, _BRANCHES = (ast.For, ast.AsyncFor, ast.While), (ast.If, ast.IfExp, ast.Try, ast.Match)


def _dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else None
    return None


def _literal(node, index: int, key: str | None, out: list) -> None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        out.append({"index": index, "key": key, "kind": "str", "text": node.value})
    elif isinstance(node, ast.JoinedStr):
        parts = [v.value if isinstance(v, ast.Constant) else "{" + (ast.unparse(v.value) if isinstance(v, ast.FormattedValue) else "") + "}" for v in node.values]
        out.append({"index": index, "key": key, "kind": "str", "text": "".join(map(str, parts))})
    elif isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mod, ast.Add)) and isinstance(node.left, ast.Constant) and isinstance(node.left.value, str):
        # A formatted or joined string: what is filled in becomes a parameter.
        text = re.sub(r"%[-\d.]*[a-z]", "{}", node.left.value) if isinstance(node.op, ast.Mod) else node.left.value + "{}"
        out.append({"index": index, "key": key, "kind": "str", "text": text})
    elif name := _dotted(node):
        out.append({"index": index, "key": key, "kind": "ident", "text": name})
    elif isinstance(node, (ast.List, ast.Tuple, ast.Set)) and (key or len(node.elts) <= 4):
        for x in node.elts:
            _literal(x, index, key, out)
    elif isinstance(node, ast.Dict):
        for k, v in zip(node.keys, node.values, strict=True):
            if isinstance(k, ast.Constant) and isinstance(k.value, str):
                _literal(v, index, k.value, out)
    elif isinstance(node, ast.Call) and (name := _dotted(node.func)):
        out.append({"index": index, "key": key, "kind": "ident", "text": name})


def _literals(args, keywords) -> list:
    out: list = []
    for i, a in enumerate(args):
        _literal(a, i, None, out)
    for i, k in enumerate(keywords, len(args)):
        if k.arg:
            _literal(k.value, i, k.arg, out)
    return out


class _Walk(ast.NodeVisitor):
    def __init__(self, text: str):
        self.lines, self.record = text.split("\n"), new_file()
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line.encode()) + 1)
        self.top = new_function(TOPLEVEL, is_toplevel=True)
        self.record["top"] = self.top
        self.stack, self.types, self.depth = [self.top], [], 0

    def at(self, line: int, col: int) -> int:
        return self.starts[line - 1] + col

    def _decorations(self, nodes) -> list:
        out = []
        for d in nodes:
            call = isinstance(d, ast.Call)
            if name := _dotted(d.func if call else d):
                out.append({"name": name, "line": d.lineno, "arg_lits": _literals(d.args, d.keywords) if call else []})
        return out

    def visit_ClassDef(self, node):
        for d in self._decorations(node.decorator_list):
            self.record["type_decorations"].append({"type_name": node.name, **d})
        for b in node.bases:
            if base := simple_type(_dotted(b)):
                self.record["hierarchy"].append({"derived": node.name, "base": base})
        self.types.append(node.name)
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and (t := simple_type(ast.unparse(x.annotation))):
                self.record["fields"].append({"owner": node.name, "name": x.target.id, "type_name": t})
        self.generic_visit(node)
        self.types.pop()

    def _function(self, node):
        a = node.args
        params = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
        f = new_function(
            node.name,
            start_line=node.lineno,
            end_line=node.end_lineno,
            start=self.at(node.lineno, node.col_offset),
            end=self.at(node.end_lineno, node.end_col_offset),
            signature=self.lines[node.lineno - 1].strip(),
            containing_type=self.types[-1] if self.types else None,
            param_count=len(params),
            decorations=self._decorations(node.decorator_list),
        )
        for p in params:
            if p.annotation is not None and (t := simple_type(ast.unparse(p.annotation).strip("'\""))):
                f["locals"].append({"name": p.arg, "type": t})
        for n, w in enumerate(words_of(ast.get_docstring(node) or "")):
            if n < 40 and 3 <= len(w) <= 24 and not w.isdigit():
                f["features"][f"doc:{w}"] = 1
        self.record["functions"].append(f)
        for d in node.decorator_list:
            self.visit(d)
        self.stack.append(f)
        types, self.types = self.types, self.types[:] if self.types else []
        depth, self.depth = self.depth, 0
        for x in [*node.body, *a.defaults, *(k for k in a.kw_defaults if k)]:
            self.visit(x)
        self.types, self.depth = types, depth
        self.stack.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, node):
        for a in node.names:
            self.record["imports"].append({"path": a.name, "names": [a.asname or a.name.split(".")[0]], "line": node.lineno, "system": False})

    def visit_ImportFrom(self, node):
        self.record["imports"].append({"path": "." * node.level + (node.module or ""), "names": [a.asname or a.name for a in node.names], "line": node.lineno, "system": False})

    def visit_Call(self, node):
        name, recv = None, None
        if isinstance(node.func, ast.Name):
            name = node.func.id
        elif isinstance(node.func, ast.Attribute):
            name, recv = node.func.attr, ast.unparse(node.func.value)
            recv = recv if len(recv) <= 48 and "(" not in recv and "\n" not in recv else None
        if name:
            self.stack[-1]["calls"].append({
                "name": name, "receiver": recv, "line": node.lineno, "arg_count": len(node.args) + len(node.keywords),
                "start": self.at(node.lineno, node.col_offset), "end": self.at(node.end_lineno, node.end_col_offset),
                "name_line": node.func.end_lineno, "name_col": node.func.end_col_offset - len(name.encode()),
                "arg_lits": _literals(node.args, node.keywords), "type_args": [], "assigned_to": getattr(node, "_to", None),
            })
        self.generic_visit(node)

    def visit_Assign(self, node):
        if len(node.targets) == 1:
            t, v = node.targets[0], node.value
            if isinstance(v, ast.Call):
                v._to = _dotted(t)
                made = simple_type(_dotted(v.func))
                if isinstance(t, ast.Name) and made and made[:1].isupper():
                    self.stack[-1]["locals"].append({"name": t.id, "type": made})
                if isinstance(t, ast.Attribute) and self.types and made and made[:1].isupper():
                    self.record["fields"].append({"owner": self.types[-1], "name": t.attr, "type_name": made})
            if isinstance(t, ast.Attribute) and _dotted(t.value) == "self" and isinstance(v, ast.Name) and self.types:
                typed = {x["name"]: x["type"] for x in self.stack[-1]["locals"]}
                if v.id in typed:
                    self.record["fields"].append({"owner": self.types[-1], "name": t.attr, "type_name": typed[v.id]})
            if isinstance(t, ast.Name) and isinstance(v, ast.Constant) and isinstance(v.value, str) and len(self.stack) == 1 and len(v.value) <= 200:
                self.record["consts"].append({"name": t.id, "value": v.value})
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name) and len(self.stack) > 1 and (t := simple_type(ast.unparse(node.annotation))):
            self.stack[-1]["locals"].append({"name": node.target.id, "type": t})
        self.generic_visit(node)

    def visit_Return(self, node):
        if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and len(node.value.value) <= 64:
            self.stack[-1]["ret_strs"].append(node.value.value)
        self.generic_visit(node)

    def generic_visit(self, node):
        feats = self.stack[-1]["features"]
        if len(self.stack) > 1:
            bump(feats, f"ast:{type(node).__name__}")
            if isinstance(node, ast.Name):
                bump(feats, f"id:{node.id}")
            elif isinstance(node, ast.Attribute):
                bump(feats, f"id:{node.attr}")
            nested = isinstance(node, (*_LOOPS, *_BRANCHES))
            if nested:
                bump(feats, "flow:loops" if isinstance(node, _LOOPS) else "flow:branches")
                self.depth += 1
                feats[f"flow:depth:{min(self.depth, 8)}"] = 1
            super().generic_visit(node)
            self.depth -= nested
        else:
            super().generic_visit(node)


def parse(text: str) -> dict:
    walk = _Walk(text)
    walk.visit(ast.parse(text))
    by_name: dict = {}
    for c in walk.record["consts"]:
        by_name.setdefault(c["name"], set()).add(c["value"])
    walk.record["consts"] = [c for c in walk.record["consts"] if len(by_name[c["name"]]) == 1]
    return walk.record
