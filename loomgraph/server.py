"""A JSON-RPC server on standard input and output, and the command line."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
import webbrowser

from loomgraph.plans.tools import TOOLS, Tools

#: Protocol versions that are understood, the newest first.
VERSIONS = ["2025-06-18", "2025-03-26", "2024-11-05"]
_KINDS = {"bool": "boolean", "list[str]": "array"}


def schemas() -> list[dict]:
    """Name, description and arguments of every tool, from its signature."""
    out = []
    for name in TOOLS:
        properties, required = {}, []
        for p in list(inspect.signature(getattr(Tools, name)).parameters.values())[1:]:
            kind = "integer" if p.name in ("limit", "max_depth") else _KINDS.get(str(p.annotation), "string")
            properties[p.name] = {"type": kind, **({"items": {"type": "string"}} if kind == "array" else {})}
            if p.default is inspect.Parameter.empty:
                required.append(p.name)
        out.append({"name": name, "description": (getattr(Tools, name).__doc__ or name.replace("_", " ")).strip(), "inputSchema": {"type": "object", "properties": properties, "required": required}})
    return out


class Server:
    def __init__(self, tools: Tools):
        self.tools = tools

    def call(self, name: str, arguments: dict) -> dict:
        if name not in TOOLS:
            raise KeyError(name)
        return getattr(self.tools, name)(**arguments)

    def one(self, m) -> dict | None:
        """The answer to a message; None for notifications."""
        if not isinstance(m, dict) or m.get("jsonrpc") != "2.0" or not isinstance(m.get("method"), str):
            return self._error(m.get("id") if isinstance(m, dict) else None, -32600, "invalid request")
        if "id" not in m:
            return None
        params, method = m.get("params") or {}, m["method"]
        if method == "initialize":
            asked = params.get("protocolVersion")
            result = {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": schemas()}
        elif method == "tools/call":
            try:
                data = self.call(params.get("name", ""), params.get("arguments") or {})
                result = {"content": [{"type": "text", "text": json.dumps(data, indent=2, default=str)}]}
            except KeyError:
                return self._error(m["id"], -32602, f"unknown tool {params.get('name')}")
            except (ValueError, TypeError) as e:
                result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
        else:
            return self._error(m["id"], -32601, f"unknown method {method}")
        return {"jsonrpc": "2.0", "id": m["id"], "result": result}

    @staticmethod
    def _error(i, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": message}}

    def line(self, text: str) -> str | None:
        """The answer to one line, a message or a batch; None if there is none."""
        try:
            m = json.loads(text)
        except ValueError:
            return json.dumps(self._error(None, -32700, "parse error"))
        if isinstance(m, list):
            if not m:
                return json.dumps(self._error(None, -32600, "empty batch"))
            answers = [a for x in m if (a := self.one(x)) is not None]
            return json.dumps(answers) if answers else None
        answer = self.one(m)
        return None if answer is None else json.dumps(answer)

    def serve(self, source=sys.stdin, sink=sys.stdout) -> None:
        for text in source:
            if text.strip() and (answer := self.line(text)) is not None:
                sink.write(answer + "\n")
                sink.flush()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("serve", "index", "visualize", "touch", "touches", "query"):
        s = sub.add_parser(name)
        s.add_argument("--root", default=".")
        if name == "index":
            s.add_argument("--force", action="store_true")
        if name == "visualize":
            s.add_argument("--output")
            s.add_argument("--open", action="store_true")
        if name == "touch":
            s.add_argument("files", nargs="+")
            s.add_argument("--why", required=True)
            s.add_argument("--agent", default="")
        if name == "touches":
            s.add_argument("--file")
            s.add_argument("--limit", type=int)
        if name == "query":
            s.add_argument("tool", choices=TOOLS)
            s.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("loomgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    tools = Tools(spark, a.root)
    if a.command == "serve":
        Server(tools).serve()
        return 0
    if a.command == "index":
        out = tools.index_project(a.force)
    elif a.command == "visualize":
        out = tools.visualize(a.output)
        if a.open:
            webbrowser.open(f"file://{out['path']}")
    elif a.command == "touch":
        out = tools.record_touch(a.files, a.why, a.agent)
    elif a.command == "touches":
        out = tools.recent_touches(a.file, a.limit)
    else:
        out = getattr(tools, a.tool)(**json.loads(a.arguments))
    print(json.dumps(out, indent=2, default=str))
    return 0
