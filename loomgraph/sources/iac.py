"""Routes declared as infrastructure: CloudFormation and SAM, serverless, Terraform, route files in YAML."""

from __future__ import annotations

import re

try:
    import yaml
except ImportError:  # YAML sources then give no rows
    yaml = None

ROW = "array<struct<kind:string,method:string,path:string,framework:string,line:int,high:boolean,handler:string,require_handler:boolean>>"
_WILD_METHODS = {"*": "ANY", "ANY": "ANY", "": "ANY"}


def _row(method, path, framework, line, high=True, handler=None, require=False, kind="http") -> dict:
    m = (method or "ANY").upper()
    return {"kind": kind, "method": _WILD_METHODS.get(m, m), "path": path, "framework": framework, "line": line, "high": high and "${" not in path, "handler": handler, "require_handler": require}


class _Lines(yaml.SafeLoader if yaml else object):
    """Safe loading that keeps each mapping's line, takes any tag and lets the last of equal keys win."""


def _mapping(loader, node):
    out = {"__line__": node.start_mark.line + 1}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        out[key if isinstance(key, (str, int, float, bool)) else str(key)] = loader.construct_object(v, deep=True)
    return out


def _tagged(loader, suffix, node):
    if isinstance(node, yaml.ScalarNode):
        return {"Ref" if suffix == "Ref" else f"Fn::{suffix}": loader.construct_scalar(node), "__line__": node.start_mark.line + 1}
    value = loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else _mapping(loader, node)
    return {f"Fn::{suffix}": value, "__line__": node.start_mark.line + 1}


if yaml:
    _Lines.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)
    _Lines.add_multi_constructor("!", _tagged)


def reference(v) -> str | None:
    """The logical name that an intrinsic or a plain string refers to."""
    if isinstance(v, str):
        m = re.search(r"\$\{([A-Za-z0-9]+)", v)
        return m[1] if m else v
    if isinstance(v, dict):
        for k, x in v.items():
            if k == "Ref":
                return x
            if k == "Fn::GetAtt":
                return (x if isinstance(x, str) else x[0]).split(".")[0]
            if k == "Fn::Sub":
                return reference(x if isinstance(x, str) else x[0])
            if k in ("Fn::Join", "Fn::Select"):
                parts = x[-1] if isinstance(x, list) else []
                return next((r for p in parts if isinstance(p, dict) and (r := reference(p))), None)
    return None


def split_key(key: str) -> tuple[str, str]:
    """``GET /x`` as (method, path); ``$default`` is any path."""
    if key == "$default":
        return "ANY", "/{proxy+}"
    m = re.match(r"\s*(\S+)\s+(/\S*)", key)
    return (m[1].upper(), m[2]) if m else ("ANY", key)


def _handler(props: dict, shared: dict) -> str | None:
    code, name = props.get("CodeUri", shared.get("CodeUri")), props.get("Handler", shared.get("Handler"))
    if not isinstance(name, str):
        return None
    return f"{code.strip('/')}/{name}" if isinstance(code, str) and code not in (".", "./") else name


def cloudformation(doc: dict) -> list[dict]:
    out, res = [], {k: v for k, v in (doc.get("Resources") or {}).items() if isinstance(v, dict)}
    shared = ((doc.get("Globals") or {}).get("Function")) or {}
    functions = {k: _handler(v.get("Properties") or {}, shared) for k, v in res.items() if v.get("Type") in ("AWS::Serverless::Function", "AWS::Lambda::Function")}
    parents = {k: (reference(p.get("ParentId")), p.get("PathPart", "")) for k, v in res.items() if v.get("Type") == "AWS::ApiGateway::Resource" and (p := v.get("Properties") or {})}

    def path_of(name: str | None) -> tuple[str, bool]:
        parts, known = [], True
        for _ in range(32):
            if name not in parents:
                known = known and (name is None or "." in (name or "") or "Root" in (name or "") or name in res)
                break
            name, part = parents[name]
            parts.insert(0, str(part))
        return ("" if known else "/{*}") + "/" + "/".join(parts), known

    routed = set()
    integrations = {k: reference((v.get("Properties") or {}).get("IntegrationUri")) for k, v in res.items() if v.get("Type") == "AWS::ApiGatewayV2::Integration"}
    for name, v in res.items():
        p, line = v.get("Properties") or {}, v.get("__line__", 1)
        kind = v.get("Type", "")
        if kind == "AWS::Serverless::Function":
            for e in (p.get("Events") or {}).values():
                if not isinstance(e, dict):
                    continue
                ep = e.get("Properties") or {}
                if e.get("Type") in ("Api", "HttpApi"):
                    out.append(_row(ep.get("Method"), ep.get("Path", "/{proxy+}"), "sam", e.get("__line__", line), handler=functions.get(name)))
                    routed.add(name)
        elif kind == "AWS::ApiGateway::Method":
            path, known = path_of(reference(p.get("ResourceId")))
            target = reference((p.get("Integration") or {}).get("Uri"))
            out.append(_row(p.get("HttpMethod"), path, "cloudformation", line, known, functions.get(target)))
            routed.add(target)
        elif kind == "AWS::ApiGatewayV2::Route":
            method, path = split_key(str(p.get("RouteKey", "")))
            target = integrations.get((reference(p.get("Target")) or "").split("/")[-1])
            web = not path.startswith("/")
            out.append(_row(method, f"/ws/{path.lstrip('$')}" if web else path, "cloudformation-websocket" if web else "cloudformation", line, handler=functions.get(target)))
            routed.add(target)
        elif kind == "AWS::AppSync::Resolver":
            out.append(_row("ANY", f"/{str(p.get('FieldName', '')).lower()}", "appsync", line, kind="graphql"))
    for name, handler in functions.items():
        if name not in routed and handler:
            out.append(_row("ANY", f"/lambda/{name}", "lambda", res[name].get("__line__", 1), False, handler, True))
    return out


def _expand(doc: dict, value: str) -> str:
    """One level of ``${self:a.b}`` and the default of ``${opt:x, 'd'}``."""

    def one(m):
        at = doc
        for part in m[1].split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return str(at) if isinstance(at, (str, int)) else m[0]

    value = re.sub(r"\$\{self:([\w.-]+)\}", one, value)
    return re.sub(r"\$\{opt:[\w-]+,\s*'([^']*)'\}", r"\1", value)


def serverless(doc: dict) -> list[dict]:
    out, functions = [], doc.get("functions") or {}
    blocks = functions if isinstance(functions, list) else [functions]
    for block in blocks:
        for f in (block.values() if isinstance(block, dict) else []):
            if not isinstance(f, dict):
                continue
            handler = f.get("handler")
            for e in f.get("events") or []:
                if not isinstance(e, dict):
                    continue
                for kind in ("http", "httpApi", "websocket"):
                    if kind not in e:
                        continue
                    v, line = e[kind], e.get("__line__", f.get("__line__", 1))
                    if isinstance(v, dict):
                        method, path = v.get("method"), str(v.get("path", v.get("route", "/{proxy+}")))
                    elif v == "*":
                        method, path = "ANY", "/{proxy+}"
                    else:
                        method, path = split_key(str(v)) if " " in str(v) else ("ANY", str(v))
                    path = _expand(doc, path)
                    out.append(_row("ANY" if kind == "websocket" else method, f"/ws/{path.lstrip('$')}" if kind == "websocket" else "/" + path.lstrip("/"), "serverless", line, handler=handler))
    return out


def routes_yaml(doc: dict) -> list[dict]:
    """Symfony-like route files: names to mappings with a path."""
    out = []
    for v in doc.values():
        if isinstance(v, dict) and isinstance(v.get("path"), str) and ("controller" in v or "defaults" in v or "methods" in v):
            target = v.get("controller") or (v.get("defaults") or {}).get("_controller")
            for m in v.get("methods") or ["ANY"]:
                out.append(_row(str(m), v["path"], "symfony", v.get("__line__", 1), handler=target))
    return out


_BLOCK = re.compile(r'(?m)^\s*(resource|module|locals)\s*(?:"([\w-]+)")?\s*(?:"([\w-]+)")?\s*\{')


def _blocks(text: str):
    for m in _BLOCK.finditer(text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        yield m[1], m[2], m[3], text[m.end() : i - 1], text.count("\n", 0, m.start()) + 1


def terraform(text: str) -> list[dict]:
    code = re.sub(r"(?m)#[^\n]*|//[^\n]*$", "", text)
    found, local = {}, {}
    for kind, t, n, body, line in _blocks(code):
        values = {k: v.strip() for k, v in re.findall(r"(?m)^\s*(\w+)\s*=\s*(.+?)\s*$", body)}
        if kind == "locals":
            local.update({k: v.strip('"') for k, v in values.items()})
        elif kind == "resource":
            found[t, n] = values, line

    def text_of(v: str | None) -> str:
        v = (v or "").strip('"')
        v = re.sub(r"\$\{local\.(\w+)\}", lambda m: local.get(m[1], m[0]), v)
        return local.get(v[6:], v) if v.startswith("local.") else v

    def ref(v: str | None) -> tuple[str, str] | None:
        m = re.search(r"(aws_\w+)\.([\w-]+)", v or "")
        return (m[1], m[2]) if m else None

    lambdas = {k: text_of(v.get("handler")) for k, (v, _) in found.items() if k[0] == "aws_lambda_function"}

    def path_of(key) -> tuple[str, bool]:
        parts, known = [], True
        for _ in range(32):
            if key is None or key[0] != "aws_api_gateway_resource":
                known = key is not None and key[0] == "aws_api_gateway_rest_api"
                break
            if key not in found:
                known = False
                break
            parts.insert(0, text_of(found[key][0].get("path_part")))
            key = ref(found[key][0].get("parent_id"))
        return ("" if known else "/{*}") + "/" + "/".join(parts), known

    out, routed = [], set()
    rest = {(ref(v.get("resource_id")), text_of(v.get("http_method")) or str(ref(v.get("http_method")))): ref(v.get("uri")) for k, (v, _) in found.items() if k[0] == "aws_api_gateway_integration"}
    v2 = {k: ref(v.get("integration_uri")) for k, (v, _) in found.items() if k[0] == "aws_apigatewayv2_integration"}
    for k, (v, line) in found.items():
        if k[0] == "aws_api_gateway_method":
            path, known = path_of(ref(v.get("resource_id")))
            target = next((t for (r, _), t in rest.items() if r == ref(v.get("resource_id"))), None)
            out.append(_row(text_of(v.get("http_method")), path, "terraform", line, known, lambdas.get(target)))
            routed.add(target)
        elif k[0] == "aws_apigatewayv2_route":
            method, path = split_key(text_of(v.get("route_key")))
            target = v2.get(ref(v.get("target")))
            out.append(_row(method, path if path.startswith("/") else f"/ws/{path.lstrip('$')}", "terraform", line, handler=lambdas.get(target)))
            routed.add(target)
        elif k[0] == "aws_apigatewayv2_api" and v.get("route_key"):
            method, path = split_key(text_of(v["route_key"]))
            out.append(_row(method, path, "terraform", line, handler=lambdas.get(ref(v.get("target")))))
        elif k[0] == "aws_lambda_function_url":
            target = ref(v.get("function_name"))
            out.append(_row("ANY", "/{proxy+}", "terraform-url", line, False, lambdas.get(target)))
            routed.add(target)
        elif k[0] == "aws_appsync_resolver":
            out.append(_row("ANY", f"/{text_of(v.get('field')).lower()}", "appsync", line, kind="graphql"))
    for k, handler in lambdas.items():
        if k not in routed and handler:
            out.append(_row("ANY", f"/lambda/{k[1]}", "lambda", found[k][1], False, handler, True))
    return out


def findings(path: str, text: str) -> list[dict]:
    """The declared routes of one file; cheap tests on name and text come before any parsing."""
    name = path.rsplit("/", 1)[-1]
    if name.endswith(".tf"):
        return terraform(text) if "resource" in text else []
    if yaml is None or not name.endswith((".yml", ".yaml", ".json")):
        return []
    try:
        doc = yaml.load(text, Loader=_Lines) if re.search(r"AWS::|functions:|path:|controller:", text) else None
    except yaml.YAMLError:
        return []
    if not isinstance(doc, dict):
        return []
    if "AWS::" in text and isinstance(doc.get("Resources"), dict):
        return cloudformation(doc)
    if name.startswith("serverless") or ("functions" in doc and "provider" in doc):
        return serverless(doc)
    return routes_yaml(doc)
