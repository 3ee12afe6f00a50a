"""Detectors: routes, outgoing calls, remote procedures, bridges and tests of one file's record.

Rules see only what extraction gives: calls with literal arguments, decorations, imports and types.
A rule applies if the file's evidence (imports, base types, project manifests) names its framework.
Prefixes within a file are composed here, by class, by variable or by enclosing calls; those
across files are left as mounts, which the caller composes as joins.
"""

from __future__ import annotations

import re


HTTP = ("get", "post", "put", "delete", "patch", "head", "options")
_ANY = ("all", "any", "route", "match")
_JS, _JVM = ("javascript", "typescript", "tsx"), ("java", "kotlin")
#: The routes of a REST resource as (action, method, path), for lists and for single ones.
RESOURCE = [("index", "GET", ""), ("create", "GET", "/create"), ("store", "POST", ""), ("show", "GET", "/{id}"), ("edit", "GET", "/{id}/edit"), ("update", "PUT", "/{id}"), ("destroy", "DELETE", "/{id}")]
RAILS = [("index", "GET", ""), ("new", "GET", "/new"), ("create", "POST", ""), ("show", "GET", "/:id"), ("edit", "GET", "/:id/edit"), ("update", "PATCH", "/:id"), ("destroy", "DELETE", "/:id")]
#: The routes of a registered view set as (action, method, path).
VIEWSET = [("list", "GET", ""), ("create", "POST", ""), ("retrieve", "GET", "/{pk}"), ("update", "PUT", "/{pk}"), ("partial_update", "PATCH", "/{pk}"), ("destroy", "DELETE", "/{pk}")]
#: Block functions of test runners and the modifiers that may follow them.
BLOCKS = {"cpp": ["TEST_CASE", "SCENARIO", "SECTION"], "ruby": ["it", "specify", "example", "scenario", "test", "describe", "context", "feature"], "js": ["it", "test", "describe", "context", "suite", "bench"]}
GROUPS = {"cpp": ["SCENARIO"], "ruby": ["describe", "context", "feature"], "js": ["describe", "context", "suite"]}
MODIFIERS = ["only", "skip", "todo", "each", "concurrent", "failing", "sequential", "fails"]

ENDPOINTS = "array<struct<kind:string,method:string,path:string,framework:string,line:int,handler:string,handler_type:string,high:boolean,var:string,versions:array<string>,action:string>>"
CLIENTS = "array<struct<kind:string,method:string,url:string,library:string,line:int,caller:int,high:boolean>>"
MOUNTS = "array<struct<target:string,prefix:string,line:int>>"
CASES = "array<struct<name:string,framework:string,kind:string,line:int,suite:string,function:int>>"
NATIVES = "array<struct<module:string,alias:string,method:string,mechanism:string,function:int>>"
JSCALLS = "array<struct<module:string,method:string,line:int,caller:int,high:boolean>>"
FACTS = "array<struct<kind:string,name:string,value:string>>"
SCHEMA = f"endpoints {ENDPOINTS}, clients {CLIENTS}, mounts {MOUNTS}, cases {CASES}, natives {NATIVES}, bridge_calls {JSCALLS}, facts {FACTS}"


def strings(x: dict, index: int | None = None) -> list[str]:
    """Unkeyed string arguments, of one position or of all."""
    return [a["text"] for a in x["arg_lits"] if a["kind"] == "str" and a["key"] is None and index in (None, a["index"])]


def keyed(x: dict, *keys: str) -> list[str]:
    return [a["text"] for a in x["arg_lits"] if a["key"] in keys]


def first(items: list[str], default: str | None = None) -> str | None:
    return items[0] if items else default


def handler_of(x: dict) -> str | None:
    """The last identifier argument, without its receiver."""
    names = [a["text"] for a in x["arg_lits"] if a["kind"] == "ident" and a["key"] in (None, "handler", "to", "controller")]
    return re.split(r"[.:\\>@]", names[-1])[-1].lstrip("$:&") if names else None


def join(prefix: str | None, path: str | None) -> str:
    p, s = (prefix or "").strip("/"), (path or "").lstrip("/")
    return "/" + "/".join(x for x in (p, s) if x)


def method_of(name: str) -> str | None:
    n = name.lower()
    return n.upper() if n in HTTP else "ANY" if n in _ANY else None


def url_like(s: str) -> bool:
    return " " not in s and (s.startswith("/") or "://" in s)


class File:
    def __init__(self, language: str, path: str, record: dict, evidence: list[str]):
        self.language, self.path, self.record = language, path, record
        self.functions = record["functions"]
        self.text = " ".join([i["path"].lower() for i in record["imports"]] + [f"implements:{h['base']}".lower() for h in record["hierarchy"]])
        self.project = " ".join(evidence)
        self.out = {"endpoints": [], "clients": [], "mounts": [], "cases": [], "natives": [], "bridge_calls": [], "facts": []}
        self.calls = sorted(((c, i) for i, f in enumerate(self.functions) for c in f["calls"]), key=lambda x: (x[0]["start"], -x[0]["end"]))
        self.types: dict[str, list[dict]] = {}
        for d in record["type_decorations"]:
            self.types.setdefault(d["type_name"], []).append(d)
        self.bases: dict[str, list[str]] = {}
        for h in record["hierarchy"]:
            self.bases.setdefault(h["derived"], []).append(h["base"])
        self.imported = {n: i["path"] for i in record["imports"] for n in i["names"]}

    def has(self, *needles: str, project: bool = False) -> bool:
        text = self.text + (" " + self.project if project else "")
        return any(n in text for n in needles)

    def endpoint(self, method: str, path: str, framework: str, line: int, handler=None, owner=None, high=True, kind="http", var=None, versions=None, action=None) -> None:
        self.out["endpoints"].append({"kind": kind, "method": method, "path": path, "framework": framework, "line": line, "handler": handler, "handler_type": owner, "high": high and "${" not in path, "var": var, "versions": versions, "action": action})

    def client(self, method: str, url: str, library: str, line: int, caller: int, high=True, kind="http") -> None:
        self.out["clients"].append({"kind": kind, "method": method, "url": url, "library": library, "line": line, "caller": caller, "high": high})

    def around(self, call: dict, names: tuple[str, ...]) -> list[dict]:
        """Calls of the given names that enclose one, outermost first."""
        return [c for c, _ in self.calls if c["name"] in names and c["start"] <= call["start"] and call["end"] <= c["end"] and c is not call]


def _decorated(f: File) -> None:
    """Routes by decorators and annotations on functions and their types."""
    for fn in f.functions:
        owner = fn["containing_type"]
        above = f.types.get(owner, [])
        for d in fn["decorations"]:
            base, _, verb = d["name"].rpartition(".")
            path = first(strings(d)) or first(keyed(d, "value", "path", "rule", "template")) or ""
            if f.language == "python" and base and f.has("flask", "fastapi", "starlette", "sanic", "quart") and (verb in HTTP or verb in ("route", "api_route", "websocket")):
                framework = "fastapi" if f.has("fastapi") else "flask"
                methods = keyed(d, "methods") or (["GET"] if verb == "route" and framework == "flask" else [verb])
                for m in methods:
                    f.endpoint("ANY" if m in ("api_route", "websocket") else m.upper(), path, framework, fn["start_line"], fn["name"], owner, var=base.split(".")[-1])
            elif f.language == "python" and base == "routes" and f.has("aiohttp") and verb in HTTP:
                f.endpoint(verb.upper(), path, "aiohttp", fn["start_line"], fn["name"], owner)
            elif f.language in _JS and f.has("@nestjs") and (m := method_of(d["name"])) and d["name"][:1].isupper():
                prefixes = [p for t in above if t["name"] == "Controller" for p in (strings(t) or keyed(t, "path") or [""])] or [""]
                versions = [v for x in fn["decorations"] if x["name"] == "Version" for v in strings(x)] or [v for t in above if t["name"] == "Controller" for v in keyed(t, "version")]
                for p in prefixes:
                    f.endpoint(m, join(p, path), "nestjs", fn["start_line"], fn["name"], owner, versions=versions or None)
            elif f.language in _JVM and d["name"].split(".")[-1] in ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping") and f.has("springframework"):
                name = d["name"].split(".")[-1]
                stated = [m.rsplit(".", 1)[-1].upper() for m in keyed(d, "method")]
                m = stated[0] if stated else "ANY" if name == "RequestMapping" else name.removesuffix("Mapping").upper()
                prefixes = [p for t in above if t["name"].endswith("RequestMapping") for p in (strings(t) or keyed(t, "value", "path") or [""])] or [""]
                feign = [t for t in above if t["name"].endswith("FeignClient")]
                for p in prefixes:
                    for s in strings(d) or keyed(d, "value", "path") or [""]:
                        if feign:
                            f.client(m, join(first(keyed(feign[0], "path"), p), s), "feign", fn["start_line"], f.functions.index(fn))
                        else:
                            f.endpoint(m, join(p, s), "spring", fn["start_line"], fn["name"], owner, high=name != "RequestMapping" or bool(stated))
            elif f.language in _JVM and d["name"] in ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS") and (strings(d) or f.has("retrofit")):
                f.client(d["name"], join("", path), "retrofit", fn["start_line"], f.functions.index(fn))
            elif f.language in _JVM and d["name"] in ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS") and f.has("ws.rs"):
                sub = next((first(strings(x), "") for x in fn["decorations"] if x["name"] == "Path"), "")
                prefix = next((first(strings(t), "") for t in above if t["name"] == "Path"), "")
                if any(t["name"].endswith("RegisterRestClient") for t in above):
                    f.client(d["name"], join(prefix, sub), "rest-client", fn["start_line"], f.functions.index(fn))
                else:
                    f.endpoint(d["name"], join(prefix, sub), "jaxrs", fn["start_line"], fn["name"], owner, high=False)
            elif f.language == "csharp" and (m := re.fullmatch(r"Http(Get|Post|Put|Delete|Patch|Head|Options)", d["name"].split(".")[-1])):
                prefix = next((first(strings(t), "") for t in above if t["name"] == "Route"), "")
                extra = next((first(strings(x)) for x in fn["decorations"] if x["name"] == "Route"), None)
                raw = path or extra or ""
                full = raw.lstrip("~") if raw.startswith(("/", "~/")) else join(prefix, raw)
                f.endpoint(m[1].upper(), full.replace("[controller]", re.sub("Controller$", "", owner or "")).replace("[action]", fn["name"]), "aspnet", fn["start_line"], fn["name"], owner)
            elif f.language == "php" and d["name"].split("\\")[-1] == "Route":
                prefix = next((first(strings(t) or keyed(t, "path"), "") for t in above if t["name"].endswith("Route")), "")
                for m in [x.upper() for x in keyed(d, "methods")] or ["ANY"]:
                    f.endpoint(m, join(prefix, path), "symfony", fn["start_line"], fn["name"], owner)
            elif f.language == "rust" and d["name"] in HTTP and f.has("actix"):
                f.endpoint(d["name"].upper(), path, "actix", fn["start_line"], fn["name"])
            elif d["name"].split(".")[-1] in ("WebMethod", "OperationContract"):
                f.endpoint("ANY", f"/{fn['name'].lower()}", "jaxws" if f.language in _JVM else "wcf" if d["name"].endswith("Contract") else "asmx", fn["start_line"], fn["name"], owner, kind="soap")
            elif f.language == "python" and verb in ("rpc", "srpc") or d["name"] in ("rpc", "srpc") and f.has("spyne"):
                f.endpoint("ANY", f"/{fn['name'].lower()}", "spyne", fn["start_line"], fn["name"], owner, kind="soap")
            elif f.language == "python" and d["name"] in ("method", "dispatcher.add_method") and f.has("jsonrpc"):
                f.endpoint("ANY", f"/{fn['name'].lower()}", "jsonrpcserver", fn["start_line"], fn["name"], owner, kind="jsonrpc")
    for owner, bases in f.bases.items():
        grpc = [b for b in bases if b.endswith(("Servicer", "ImplBase", "GrpcImplBase"))]
        if grpc:
            for fn in f.functions:
                if fn["containing_type"] == owner and not fn["name"].startswith("_"):
                    f.endpoint("ANY", f"/{fn['name'].lower()}", "grpc", fn["start_line"], fn["name"], owner, kind="grpc")


def _prefixes(f: File) -> dict[str, str]:
    """Prefixes of routers by variable."""
    out: dict[str, str] = {}
    for c, _ in f.calls:
        to = (c["assigned_to"] or "").split(".")[-1].lstrip("$")
        if not to:
            continue
        if c["name"] in ("Blueprint", "APIRouter", "Router", "Blueprint"):
            if p := first(keyed(c, "url_prefix", "prefix")):
                out[to] = p
        elif c["name"] in ("Group", "group", "Party", "Route", "scope") and (p := first(strings(c))):
            out[to] = join(out.get((c["receiver"] or "").split(".")[-1], ""), p)
        elif c["name"] in ("PathPrefix", "Subrouter") and (p := first(strings(c)) or _chain_prefix(f, c)):
            out[to] = p
    return out


def _chain_prefix(f: File, call: dict) -> str | None:
    inner = [c for c, _ in f.calls if c["name"] == "PathPrefix" and c["start"] >= call["start"] and c["end"] <= call["end"]]
    return first(strings(inner[0])) if inner else None


def _js(f: File, prefix: dict[str, str]) -> None:
    frameworks = [(n, e) for n, e in (("hono", "hono"), ("koa", "koa"), ("fastify", "fastify"), ("restify", "restify"), ("express", "express")) if f.has(e)]
    framework = frameworks[0][0] if frameworks else None
    if framework is None and any(c["name"] in ("Router", "express") for c, _ in f.calls):
        framework = "express"
    if framework is None and f.has("express", project=True) and re.search(r"rout|api|server|app", f.path.lower()):
        framework = "express"
    hosts = {"app", "router", "server", "api", "fastify", "route", "routes", *prefix} | {(c["assigned_to"] or "") for c, _ in f.calls if c["name"] in ("express", "Router", "Hono", "Koa", "fastify", "createServer", "basePath")}
    for c, _ in f.calls:
        recv = (c["receiver"] or "").split(".")[-1]
        if c["name"] in ("use", "register", "route", "mount") and framework and (p := first(strings(c, 0)) or first(keyed(c, "prefix"))):
            for target in [a["text"] for a in c["arg_lits"] if a["kind"] == "ident" and a["key"] is None]:
                name = target.split(".")[0]
                if name in f.imported:
                    f.out["mounts"].append({"target": f.imported[name], "prefix": p, "line": c["line"]})
                else:
                    prefix[name] = join(p, prefix.get(name, ""))
    for c, i in f.calls:
        recv = (c["receiver"] or "").split(".")[-1]
        m = "DELETE" if c["name"] == "del" else method_of(c["name"])
        path = first(strings(c, 0))
        if framework and m and recv in hosts and path is not None and (path.startswith(("/", "*")) or path == "") and c["arg_count"] >= 2:
            f.endpoint(m, join(prefix.get(recv, ""), path), framework, c["line"], handler_of(c), var=recv)
        elif framework == "fastify" and c["name"] == "route" and (url := first(keyed(c, "url"))):
            for m in keyed(c, "method") or ["ANY"]:
                f.endpoint(m.upper(), join(prefix.get(recv, ""), url), framework, c["line"], first(keyed(c, "handler")), var=recv)
        elif c["name"] in ("method", "JSONRPCServer", "addMethod") and f.has("json-rpc", "jayson") and path:
            f.endpoint("ANY", f"/{path.lower()}", "json-rpc", c["line"], handler_of(c), kind="jsonrpc")
        elif c["name"] == "request" and f.has("json-rpc", "jayson") and path and not url_like(path):
            f.client("ANY", f"/{path.lower()}", "json-rpc", c["line"], i, kind="jsonrpc")
        elif c["name"] == "fetch" and c["receiver"] in (None, "window", "globalThis") and path and url_like(path):
            f.client(first([m.upper() for m in keyed(c, "method")], "GET"), path, "fetch", c["line"], i)
        elif recv in ("axios", "got", "ky", "superagent", "request") and m and path:
            f.client(m, path, recv, c["line"], i)
        elif c["name"] in ("axios", "got", "ky") and (path or keyed(c, "url")):
            f.client(first([m.upper() for m in keyed(c, "method")], "GET"), path or keyed(c, "url")[0], c["name"], c["line"], i)
        elif c["receiver"] in ("$", "jQuery") and c["name"] in ("get", "post", "ajax", "getJSON") and (path or keyed(c, "url")):
            m = first([m.upper() for m in keyed(c, "method", "type")], "POST" if c["name"] == "post" else "GET")
            f.client(m, path or keyed(c, "url")[0], "jquery", c["line"], i, high=False)
        elif c["name"] == "open" and len(strings(c)) >= 2 and strings(c)[0].lower() in HTTP and url_like(strings(c)[1]):
            f.client(strings(c)[0].upper(), strings(c)[1], "xhr", c["line"], i, high=False)
        elif m and path and url_like(path) and c["receiver"] and _made_by(f, recv, "create", "axios") is not None:
            f.client(m, join(_made_by(f, recv, "create", "axios"), path), "axios", c["line"], i, high=False)
        elif f.has("aws-cdk", "@aws-cdk") and c["name"] == "addMethod" and path:
            f.endpoint(path.upper(), _cdk_path(f, recv), "cdk", c["line"], None, high=False)
        elif f.has("aws-cdk", "@aws-cdk") and c["name"] == "addRoutes" and (p := first(keyed(c, "path"))):
            for m in [x.rsplit(".", 1)[-1] for x in keyed(c, "methods")] or ["ANY"]:
                f.endpoint(m.upper(), p, "cdk", c["line"], None, high=False)
        if recv in f.imported and "native" in f.imported.get(recv, "").lower() or (c["receiver"] or "").startswith("NativeModules."):
            module = (c["receiver"] or "").split(".")[-1]
            f.out["bridge_calls"].append({"module": module, "method": c["name"], "line": c["line"], "caller": i, "high": (c["receiver"] or "").startswith("NativeModules.")})
        elif "NativeModules" in f.imported and c["receiver"] and c["receiver"][:1].isupper() and "." not in c["receiver"]:
            f.out["bridge_calls"].append({"module": c["receiver"], "method": c["name"], "line": c["line"], "caller": i, "high": False})


def _nest_facts(f: File) -> None:
    """What a Nest project states once for all its controllers."""
    fact = lambda kind, name=None, value=None: f.out["facts"].append({"kind": kind, "name": name, "value": value})
    for c, _ in f.calls:
        if c["name"] == "setGlobalPrefix" and strings(c):
            fact("global_prefix", None, strings(c)[0])
        elif c["name"] == "enableVersioning":
            # By path unless another type is named.
            kinds = [a["text"] for a in c["arg_lits"] if a["kind"] == "ident" and a["text"].startswith("VersioningType.")]
            if all(k == "VersioningType.URI" for k in kinds):
                fact("uri_versions")
        elif c["name"] == "register" and (c["receiver"] or "").split(".")[-1] == "RouterModule":
            path = None
            for a in c["arg_lits"]:
                if a["key"] == "path":
                    path = a["text"]
                elif a["key"] == "module" and path is not None:
                    fact("module_prefix", a["text"], path)
                    path = None
    for owner, above in f.types.items():
        for d in above:
            if d["name"] == "Module":
                for controller in keyed(d, "controllers"):
                    fact("module_controller", owner, controller)


def _made_by(f: File, variable: str, name: str, receiver: str) -> str | None:
    """The base address of a client made under a variable; None if it was not made so."""
    for c, _ in f.calls:
        if c["name"] == name and c["receiver"] == receiver and (c["assigned_to"] or "").split(".")[-1] == variable:
            return first(keyed(c, "baseURL", "base_uri", "baseUrl"), "")
    return None


def _cdk_path(f: File, variable: str) -> str:
    made = {(c["assigned_to"] or "").split(".")[-1]: c for c, _ in f.calls if c["name"] in ("addResource", "addProxy")}
    parts: list[str] = []
    for _ in range(32):
        c = made.get(variable)
        if c is None:
            break
        parts.insert(0, first(strings(c), "{proxy+}"))
        variable = (c["receiver"] or "").split(".")[-1]
    return "/" + "/".join(parts)


def _python(f: File, prefix: dict[str, str]) -> None:
    for e in f.out["endpoints"]:
        if e["framework"] in ("flask", "fastapi"):
            e["path"] = join(prefix.get(e["var"], ""), e["path"]) if prefix.get(e["var"]) else e["path"]
    for c, i in f.calls:
        name, path, recv = c["name"], first(strings(c, 0)), (c["receiver"] or "")
        if name in ("include_router", "register_blueprint") and (p := first(keyed(c, "prefix", "url_prefix"))):
            for target in [a["text"] for a in c["arg_lits"] if a["kind"] == "ident" and a["key"] is None][:1]:
                head = target.split(".")[0]
                if head in f.imported:
                    f.out["mounts"].append({"target": head, "prefix": p, "line": c["line"]})
                else:
                    for e in f.out["endpoints"]:
                        if e["var"] == head:
                            e["path"] = join(p, e["path"])
        elif name in ("path", "re_path", "url") and path is not None and f.has("django"):
            clean = re.sub(r"\(\?P<(\w+)>[^)]*\)", r"{\1}", path.strip("^$"))
            if any(x["name"] == "include" and x["start"] >= c["start"] and x["end"] <= c["end"] for x, _ in f.calls):
                inner = next(x for x, _ in f.calls if x["name"] == "include" and x["start"] >= c["start"])
                if target := first(strings(inner)):
                    f.out["mounts"].append({"target": target, "prefix": clean, "line": c["line"]})
                continue
            names = [a["text"] for a in c["arg_lits"] if a["kind"] == "ident"]
            handler = names[0].removesuffix(".as_view").split(".")[-1] if names else None
            view = bool(names) and names[0].endswith(".as_view")
            f.endpoint("ANY", join("", clean), "django", c["line"], handler, handler if view else None, high=name != "url", action="view" if view else None)
        elif name == "register" and path is not None and f.has("rest_framework"):
            view = handler_of(c)
            for action, m, s in VIEWSET:
                f.endpoint(m, join(path, s), "drf", c["line"], action, view, high=False, action=action)
        elif name == "add_url_rule" and path:
            target = first(keyed(c, "view_func")) or handler_of(c)
            view = target.removesuffix(".as_view").split(".")[-1] if target and target.endswith(".as_view") and not keyed(c, "methods") else None
            for m in keyed(c, "methods") or ["GET"]:
                f.endpoint(m.upper(), join(prefix.get(recv.split(".")[-1], ""), path), "flask", c["line"], view or target, view, action="view" if view else None)
        elif name.startswith("add_") and name[4:] in (*HTTP, "route") and f.has("aiohttp"):
            s = strings(c)
            if name == "add_route" and len(s) >= 2:
                f.endpoint("ANY" if s[0] == "*" else s[0].upper(), s[1], "aiohttp", c["line"], handler_of(c))
            elif s:
                f.endpoint(name[4:].upper(), s[0], "aiohttp", c["line"], handler_of(c))
        elif recv in ("requests", "httpx") and method_of(name) and path:
            f.client(method_of(name), path, recv, c["line"], i)
        elif recv in ("session", "client", "s") and name in HTTP and path and url_like(path):
            f.client(name.upper(), path, "aiohttp" if f.has("aiohttp") else "httpx" if f.has("httpx") else "requests", c["line"], i, high=False)
        elif name == "register_function" and f.has("xmlrpc"):
            op = strings(c)[0] if strings(c) else handler_of(c)
            if op:
                f.endpoint("ANY", f"/{op.lower()}", "xmlrpc", c["line"], handler_of(c), kind="xmlrpc")
        elif ".service" in recv and f.has("zeep", "suds"):
            f.client("ANY", f"/{name.lower()}", "zeep", c["line"], i, kind="soap")
        elif f.has("xmlrpc") and recv and re.search(r"proxy|server|client", recv.lower()) and not name.startswith(("register", "serve")):
            f.client("ANY", f"/{name.lower()}", "xmlrpc", c["line"], i, kind="xmlrpc")
        elif f.has("grpc") and re.search(r"stub", recv.lower()):
            f.client("ANY", f"/{name.lower()}", "grpc", c["line"], i, kind="grpc")
        elif f.has("jsonrpcclient") and name == "request" and path:
            f.client("ANY", f"/{path.lower()}", "jsonrpcclient", c["line"], i, kind="jsonrpc")


def _go(f: File, prefix: dict[str, str]) -> None:
    framework = next((n for n, e in (("gin", "gin-gonic"), ("echo", "labstack/echo"), ("fiber", "gofiber"), ("chi", "go-chi"), ("gorilla", "gorilla/mux")) if f.has(e)), "net/http" if f.has("net/http") else None)
    for c, i in f.calls:
        name, s, recv = c["name"], strings(c), (c["receiver"] or "").split(".")[-1]
        outer = "".join(join("", first(strings(x), "")) for x in f.around(c, ("Route", "Group")) if x["arg_count"] >= 2)
        base = join(prefix.get(recv, ""), outer) if prefix.get(recv) or outer else ""
        m = method_of(name)
        if framework == "net/http" and recv == "http" and name in ("Get", "Post", "Head", "NewRequest") and s:
            if name == "NewRequest" and len(s) >= 2:
                f.client(s[0].upper(), s[1], "net/http", c["line"], i)
            elif url_like(s[0]):
                f.client(name.upper(), s[0], "net/http", c["line"], i)
        elif framework and name in ("HandleFunc", "Handle") and s:
            verb = re.match(r"([A-Z]+)\s+(/.*)", s[0])
            chained = [x for x, _ in f.calls if x["name"] == "Methods" and x["start"] <= c["start"] and c["end"] <= x["end"] and x["line"] == c["line"]]
            for m in ([verb[1]] if verb else strings(chained[0]) if chained else ["ANY"]):
                f.endpoint(m.upper(), join(base, verb[2] if verb else s[0]), framework, c["line"], handler_of(c))
        elif framework and framework != "net/http" and m and s and recv and (s[0].startswith("/") or s[0] == ""):
            f.endpoint(m, join(base, s[0]), framework, c["line"], handler_of(c))
        elif name.startswith("Register") and name.endswith("Server") and f.has("grpc"):
            for fn in f.functions:
                if fn["containing_type"] and fn["name"][:1].isupper():
                    f.endpoint("ANY", f"/{fn['name'].lower()}", "grpc", fn["start_line"], fn["name"], fn["containing_type"], kind="grpc")
        elif f.has("grpc") and recv in ("client", "c", "stub") and name[:1].isupper() and name not in ("Close", "Dial"):
            f.client("ANY", f"/{name.lower()}", "grpc", c["line"], i, kind="grpc")


def _php(f: File) -> None:
    framework = "laravel" if f.has("illuminate") or f.has("laravel", project=True) or "routes/" in f.path else "slim" if f.has("slim") else "silex" if f.has("silex") else "php"
    for c, i in f.calls:
        name, s, recv = c["name"], strings(c), c["receiver"] or ""
        outer = "".join(join("", p) for x in f.around(c, ("group", "prefix")) for p in (strings(x)[:1] if x["name"] == "prefix" else keyed(x, "prefix") or strings(x, 0)[:1]))
        chain = [x for x, _ in f.calls if x["name"] == "prefix" and x["line"] == c["line"] and x["start"] < c["start"]]
        base = join(outer, first(strings(chain[0]), "") if chain else "")
        m = method_of(name)
        target = next((a["text"] for a in c["arg_lits"] if a["index"] == 1 and a["kind"] == "str"), None)
        handler = re.split(r"[@:]+", target)[-1] if target and re.search(r"@|::", target) else target if target and name != "match" else handler_of(c)
        if recv == "Route" and name in ("resource", "apiResource") and s:
            keep, drop = keyed(c, "only"), keyed(c, "except")
            for action, m, sub in RESOURCE:
                if (name == "apiResource" and action in ("create", "edit")) or (keep and action not in keep) or action in drop:
                    continue
                f.endpoint(m, join(base, s[0] + sub), "laravel", c["line"], action, high=False)
        elif recv == "Route" and name == "match" and len(s) >= 2:
            for v in s[:-1] if not s[-1].startswith("/") else s[:-1]:
                if v.lower() in HTTP:
                    f.endpoint(v.upper(), join(base, next(x for x in s if x.lower() not in HTTP)), "laravel", c["line"], handler)
        elif m and s and (recv == "Route" or re.search(r"(app|router|route|controllers|group)$", recv.lower())) and (s[0].startswith("/") or recv == "Route"):
            f.endpoint(m, join(base, s[0]), framework if recv != "Route" else "laravel", c["line"], handler, high=framework != "php" and not outer)
        elif name in ("request", *HTTP) and f.has("guzzle") and s:
            if name == "request" and len(s) >= 2:
                f.client(s[0].upper(), s[1], "guzzle", c["line"], i, high=False)
            elif name != "request" and url_like(s[0]):
                f.client(name.upper(), s[0], "guzzle", c["line"], i, high=False)
        elif name == "__soapCall" and s:
            f.client("ANY", f"/{s[0].lower()}", "soap", c["line"], i, kind="soap")
        elif name in ("addFunction", "xmlrpc_server_register_method") and s:
            f.endpoint("ANY", f"/{s[0].lower()}", "php-soap" if name == "addFunction" else "php-xmlrpc", c["line"], s[-1], kind="soap" if name == "addFunction" else "xmlrpc")


def _ruby(f: File) -> None:
    rails = f.path.endswith("routes.rb") and not f.has("sinatra", "grape") and "Grape::API" not in str(f.record["hierarchy"])
    bases = {b for bs in f.bases.values() for b in bs}
    framework = "rails" if rails else "sinatra" if f.has("sinatra") or "Base" in bases else "grape" if f.has("grape") or "API" in bases else None
    for c, i in f.calls:
        name, s, recv = c["name"], strings(c), c["receiver"]
        symbols = [a["text"].lstrip(":") for a in c["arg_lits"] if a["kind"] == "ident" and a["key"] is None and a["text"].startswith(":")]
        outer = ""
        for x in f.around(c, ("namespace", "scope", "resources", "resource", "group")):
            part = first(strings(x)) or first([a["text"].lstrip(":") for a in x["arg_lits"] if a["kind"] == "ident" and a["key"] is None]) or ""
            outer = join(outer, part + ("/:" + re.sub("s$", "", part) + "_id" if x["name"] == "resources" else ""))
        if framework == "rails" and name in ("resources", "resource"):
            keep, drop = [k.lstrip(":") for k in keyed(c, "only")], [k.lstrip(":") for k in keyed(c, "except")]
            for r in symbols or s:
                for action, m, sub in RAILS:
                    if (keep and action not in keep) or action in drop or (name == "resource" and action == "index"):
                        continue
                    f.endpoint(m, join(outer, r + (sub.replace("/:id", "") if name == "resource" else sub)), "rails", c["line"], action, high=False)
        elif framework and not recv and method_of(name) and name in HTTP and (s or symbols):
            to = first(keyed(c, "to"))
            f.endpoint(name.upper(), join(outer, s[0] if s else symbols[0]), framework, c["line"], to.split("#")[-1] if to else None)
        elif framework == "rails" and name == "root":
            f.endpoint("GET", "/", "rails", c["line"], None)
        elif recv in ("HTTParty", "Faraday", "RestClient") and name in HTTP and s:
            f.client(name.upper(), s[0], recv.lower(), c["line"], i)
        elif recv == "Net::HTTP" and s and url_like(s[-1]):
            f.client("GET" if name.startswith("get") else "POST", s[-1], "net-http-rb", c["line"], i)


def _rust(f: File) -> None:
    framework = "axum" if f.has("axum") else "actix" if f.has("actix") else None
    for c, i in f.calls:
        s = strings(c)
        if framework and c["name"] == "route" and s:
            outer = "".join(join("", first(strings(x), "")) for x in f.around(c, ("scope", "nest")))
            inner = [x for x, _ in f.calls if x["start"] >= c["start"] and x["end"] <= c["end"] and x["name"] in HTTP]
            for x in inner or [None]:
                handler = handler_of(x) if x else None
                if x and handler is None:
                    to = [y for y, _ in f.calls if y["name"] == "to" and c["start"] <= y["start"] and y["end"] <= c["end"]]
                    handler = handler_of(to[0]) if to else None
                f.endpoint(x["name"].upper() if x else "ANY", join(outer, s[0]), framework, c["line"], handler)
        elif c["receiver"] in ("reqwest", "client") and c["name"] in HTTP and s:
            f.client(c["name"].upper(), s[0], "reqwest", c["line"], i)


def _jvm(f: File) -> None:
    for c, i in f.calls:
        m, s = method_of(c["name"]), strings(c)
        if f.language == "kotlin" and f.has("ktor") and c["name"] in HTTP and not c["receiver"] and s:
            outer = "".join(join("", first(strings(x), "")) for x in f.around(c, ("route",)))
            f.endpoint(c["name"].upper(), join(outer, s[0]), "ktor", c["line"], None, high=False)
        elif f.has("ktor.client") and m and c["receiver"] and s and url_like(s[0]):
            f.client(m, s[0], "ktor", c["line"], i)


def _csharp(f: File) -> None:
    for c, i in f.calls:
        s = strings(c)
        if m := re.fullmatch(r"Map(Get|Post|Put|Delete|Patch)", c["name"]):
            group = next((first(strings(x), "") for x, _ in f.calls if x["name"] == "MapGroup" and x["assigned_to"] == c["receiver"]), "")
            if s:
                f.endpoint(m[1].upper(), join(group, s[0]), "aspnet", c["line"], handler_of(c))
        elif (m := re.fullmatch(r"(Get|Post|Put|Delete|Patch)(?:String|Stream|FromJson|AsJson|ByteArray)?Async", c["name"])) and s and c["receiver"]:
            f.client(m[1].upper(), s[0], "httpclient", c["line"], i, high=False)


def _natives(f: File) -> None:
    names = [x for fn in f.functions if fn["name"] == "getName" for x in fn["ret_strs"]]
    for i, fn in enumerate(f.functions):
        marks = [d["name"].split(".")[-1] for d in fn["decorations"]]
        owner = fn["containing_type"] or ""
        alias = first(names) or re.sub("Module$", "", owner)
        if f.language in _JVM and "ReactMethod" in marks:
            f.out["natives"].append({"module": owner, "alias": alias, "method": fn["name"], "mechanism": "ReactMethod", "function": i})
        elif f.language == "swift" and "objc" in marks and f.has("react") or (f.language == "swift" and "objc" in marks and owner.endswith("Module")):
            f.out["natives"].append({"module": owner, "alias": alias, "method": fn["name"], "mechanism": "objc", "function": i})
    if f.language == "objc":
        module = first([h["type_name"] for h in f.record["type_decorations"]]) or re.sub(r".*/|\.mm?$", "", f.path)
        exported = [a["text"] for c, _ in f.calls if c["name"] == "RCT_EXPORT_MODULE" for a in c["arg_lits"]]
        for c, i in f.calls:
            if c["name"] in ("RCT_EXPORT_METHOD", "RCT_EXTERN_METHOD") and c["arg_lits"]:
                f.out["natives"].append({"module": module, "alias": first(exported) or re.sub("Module$", "", module), "method": c["arg_lits"][0]["text"].split(":")[0], "mechanism": c["name"], "function": i})


def _is_test_path(path: str) -> bool:
    p = path.lower()
    base = p.rsplit("/", 1)[-1]
    stem = base.rsplit(".", 1)[0]
    return bool(re.search(r"(^|/)(tests?|__tests__|specs?|testing)/", p) or re.search(r"\.(test|spec)\.", base) or base == "conftest.py" or re.search(r"(_test|_spec)$|^test_", stem) or re.search(r".tests?\.(java|kt|cs|scala|swift)$", base))


def _cases(f: File) -> None:
    lang, in_test = f.language, _is_test_path(f.path)

    def add(name, framework, kind, line, suite, function):
        f.out["cases"].append({"name": name, "framework": framework, "kind": kind, "line": line, "suite": suite, "function": function})

    for i, fn in enumerate(f.functions):
        name, suite, line = fn["name"], fn["containing_type"], fn["start_line"]
        marks = [d["name"] for d in fn["decorations"]]
        last = [re.split(r"[.:]", m)[-1] for m in marks]
        bases = f.bases.get(suite or "", [])
        inherits = lambda x, bases=bases: any(b.endswith(x) for b in bases)
        starts = lambda p, name=name: bool(re.match(p + r"[A-Z0-9_]", name))
        hit = None
        if any(m in ("ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate") for m in last) or (lang in _JVM and "Test" in last):
            hit = ("junit", "case")
        elif {"Fact", "Theory"} & set(last):
            hit = ("xunit", "case")
        elif "TestMethod" in last:
            hit = ("mstest", "case")
        elif lang == "csharp" and {"Test", "TestCase"} & set(last):
            hit = ("nunit", "case")
        elif lang == "php" and ("Test" in last or "@test" in marks):
            hit = ("phpunit", "case")
        elif lang == "swift" and {"test", "Test"} & set(last):
            hit = ("swift-testing", "case")
        elif lang == "rust" and {"test", "bench"} & set(last):
            hit = ("rust-test", "case")
        elif any(m.startswith("pytest.mark") for m in marks) and lang == "python":
            hit = ("pytest", "case")
        elif {"BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "Before", "After"} & set(last):
            hit = ("junit", "hook")
        elif {"SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown"} & set(last):
            hit = ("nunit", "hook")
        elif {"TestInitialize", "TestCleanup"} & set(last):
            hit = ("mstest", "hook")
        elif lang == "python" and "fixture" in last:
            hit = ("pytest", "hook")
        elif lang == "go" and any(starts(p) for p in ("Test", "Benchmark", "Fuzz", "Example")):
            hit = ("go-test", "case")
        elif lang == "python" and name.startswith("test_"):
            hit = ("unittest" if inherits("TestCase") else "pytest", "case")
        elif lang == "python" and in_test and name in ("setUp", "tearDown", "setUpClass", "tearDownClass"):
            hit = ("unittest", "hook")
        elif lang == "ruby" and name.startswith("test_"):
            hit = ("minitest", "case")
        elif lang == "ruby" and in_test and name in ("setup", "teardown"):
            hit = ("minitest", "hook")
        elif lang == "php" and starts("test") and (in_test or inherits("TestCase")):
            hit = ("phpunit", "case")
        elif lang == "php" and in_test and name in ("setUp", "tearDown", "setUpBeforeClass", "tearDownAfterClass"):
            hit = ("phpunit", "hook")
        elif lang in ("swift", "objc") and (in_test or inherits("XCTestCase") or re.search(r"(Tests?|Spec)$", suite or "")):
            hit = ("xctest", "case") if starts("test") else ("xctest", "hook") if name in ("setUp", "tearDown", "setUpWithError", "tearDownWithError") else None
        elif lang == "bash" and f.path.endswith(".bats"):
            hit = ("bats", "hook") if name in ("setup", "teardown", "setup_file", "teardown_file") else None if fn["is_toplevel"] else ("bats", "case")
        elif lang == "bash":
            hit = ("shunit2", "case") if starts("test") else ("shunit2", "hook") if in_test and name in ("setUp", "tearDown", "oneTimeSetUp", "oneTimeTearDown") else None
        elif lang == "c" and in_test and name.startswith("test_"):
            hit = ("c-test", "case")
        if hit:
            add(name, *hit, line, suite, i)
    family = "js" if lang in _JS else lang if lang in ("ruby", "cpp") else None
    if family is None:
        return
    paths = [i["path"] for i in f.record["imports"]]
    runner = {"ruby": "rspec", "cpp": "catch2"}.get(family) or next((r for p in paths for r, hit in (("vitest", "vitest" in p), ("jest", "jest" in p), ("mocha", p == "mocha"), ("node-test", p in ("node:test", "test"))) if hit), "jest")
    groups = []
    for c, i in f.calls:
        modified = family == "js" and c["name"] in MODIFIERS and c["receiver"] in BLOCKS["js"]
        plain = c["name"] in BLOCKS[family] and (c["receiver"] is None or c["receiver"] == "RSpec") and (c["arg_count"] >= 2 or family != "js")
        if family == "cpp" and c["name"] in ("TEST", "TEST_F", "TEST_P", "TYPED_TEST") and len(c["arg_lits"]) >= 2:
            add(c["arg_lits"][1]["text"], "gtest", "case", c["line"], c["arg_lits"][0]["text"], i)
            continue
        title = first(strings(c, 0)) or (c["arg_lits"][0]["text"] if family == "ruby" and c["arg_lits"] and c["name"] in GROUPS["ruby"] else None)
        if not (modified or plain) or not title or not title.strip():
            continue
        suite = min(((e - s, n) for s, e, n in groups if s < c["start"] and c["end"] <= e), default=(0, None))[1]
        group = c["name"] in GROUPS[family] or c["receiver"] in GROUPS[family]
        if group:
            groups.append((c["start"], c["end"], title))
        add(title, runner, "suite" if group else "case", c["line"], suite, i)


def detect(language: str, path: str, record: dict, evidence: list[str] | None = None) -> dict:
    """All detections of one file, as lists of rows."""
    f = File(language, path, record, evidence or [])
    if not record["functions"]:
        if language in _JS and f.has("@nestjs"):
            _nest_facts(f)
        return f.out
    prefix = _prefixes(f)
    _decorated(f)
    if language in _JS:
        _js(f, prefix)
        if f.has("@nestjs"):
            _nest_facts(f)
    elif language == "python":
        _python(f, prefix)
    elif language == "go":
        _go(f, prefix)
    elif language == "php":
        _php(f)
    elif language == "ruby":
        _ruby(f)
    elif language == "rust":
        _rust(f)
    elif language in _JVM:
        _jvm(f)
    elif language == "csharp":
        _csharp(f)
    _natives(f)
    _cases(f)
    return f.out


