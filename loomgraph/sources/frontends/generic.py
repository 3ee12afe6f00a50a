"""One lexer-based frontend for the brace languages, Ruby and shell.

Comments and string contents are blanked out first, with all offsets kept, so that patterns and
bracket matching only ever see code.  A language is a profile: its comment and string marks, how
functions and types begin, and how imports and decorations look.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from loomgraph.sources.frontends.record import TOPLEVEL, bump, new_file, new_function, simple_type, words_of

_ID = r"[A-Za-z_$][\w$]*"


@dataclass
class Profile:
    functions: list[str]
    types: str = ""
    imports: list[str] = field(default_factory=list)
    package: str = ""
    decorations: str = ""
    line_comments: tuple[str, ...] = ("//",)
    block_comments: bool = True
    quotes: str = "\"'"
    multiline: str = "`"
    fields: str = ""
    locals: str = ""
    consts: str = r"(?m)^\s*(?:export\s+)?(?:const|final|static|let|var|val|public|private|protected|internal|pub)\b[^=\n;(]*?\b(?P<name>[A-Za-z_$][\w$]*)(?:\s*:\s*[^=\n]+)?\s*=\s*(?P<value>[\"'`])"
    exported: str = r"\b(?:public|export|pub|open)\b"
    ends: str = "brace"
    class_prefix: str = ""


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|native|default|suspend|inline|open|operator|infix|tailrec|external|readonly|partial|extern|unsafe|new|inout|mutating|class|convenience|required|fileprivate|nonisolated|@objc)\s+)*"
_RET = r"[\w$.<>\[\],?&*: ]+?"
_JAVA_TYPES = r"\b(?:class|interface|enum|record|struct|trait|object|protocol|extension)\s+(?P<name>[A-Za-z_]\w*)(?P<head>[^{;]*)\{"

PROFILES: dict[str, Profile] = {
    "c": Profile([r"(?m)^(?!\s*(?:return|else|if|for|while|switch|typedef)\b)[\w*\s]*?\b(?P<name>[A-Za-z_]\w*)\s*(?P<params>\((?:[^(){};]|\([^()]*\))*\))\s*\{"], r"\bstruct\s+(?P<name>\w+)(?P<head>[^{;()]*)\{", [r'(?m)^\s*#\s*include\s*(?P<path>"[^"\n]*"|<[^>\n]*>)'], exported=r"\bextern\b"),
    "java": Profile([rf"(?P<name>(?!if|for|while|switch|catch|return|new|else|synchronized|try)\b[A-Za-z_]\w*)\s*(?P<params>\((?:[^(){{}};]|\([^()]*\))*\))\s*(?:throws\s+[\w.,\s]+)?(?P<open>\{{|;)"], _JAVA_TYPES, [r"(?m)^\s*import\s+(?:static\s+)?(?P<path>[\w.*]+)\s*;"], r"(?m)^\s*package\s+(?P<name>[\w.]+)", r"@(?P<name>[A-Z][\w.]*)", fields=r"(?m)^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:private|protected|public|final|static)\s+)+(?P<type>[A-Z]\w*)\s+(?P<name>\w+)\s*[;=]", locals=r"\b(?P<type>[A-Z]\w*)\s+(?P<name>[a-z_]\w*)\s*(?=[,)=;:])"),
    "go": Profile([r"(?m)^func\s+(?:\(\s*(?P<recv>\w+)\s+\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?(?P<params>\((?:[^()]|\([^()]*\))*\))[^{\n]*\{"], r"\btype\s+(?P<name>\w+)(?P<head>)\s+(?:struct|interface)\s*\{", [r'(?m)^\s*import\s+(?P<alias>[\w.]+\s+)?(?P<path>"[^"\n]*")', r'(?ms)^\s*import\s*\((?P<group>.*?)\)'], r"(?m)^package\s+(?P<name>\w+)", quotes="\"'", fields=r"(?m)^\s*(?P<name>[A-Za-z]\w*)\s+\*?(?P<type>[A-Za-z]\w*)\s*(?:`.*)?$", locals=r"\b(?P<name>[a-z]\w*)\s+\*?(?P<type>[A-Z]\w*)\s*(?=[,)])|\b(?P<name2>[a-z]\w*)\s*:=\s*&?(?P<type2>[A-Z]\w*)\s*\{"),
    "rust": Profile([r"\bfn\s+(?P<name>[a-z_A-Z]\w*)\s*(?:<[^(){}]*>)?\s*(?P<params>\((?:[^(){}]|\([^()]*\))*\))[^{;]*(?P<open>\{|;)"], r"\b(?:struct|enum|trait)\s+(?P<name>\w+)(?P<head>[^{;]*)\{|\bimpl(?:\s*<[^{]*?>)?\s+(?:(?P<base>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<name2>\w+)(?P<head2>[^{;]*)\{", [r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[^;]+);"], "", r"#\[(?P<name>[\w:]+)", quotes='"', fields=r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?P<name>[a-z_]\w*)\s*:\s*(?P<type>[A-Z]\w*)\s*,?\s*$", locals=r"\b(?P<name>[a-z_]\w*)\s*:\s*&?(?:mut\s+)?(?P<type>[A-Z]\w*)\s*(?=[,)=;])|\blet\s+(?:mut\s+)?(?P<name2>\w+)\s*=\s*(?P<type2>[A-Z]\w*)::", exported=r"\bpub\b"),
    "kotlin": Profile([r"\bfun\s+(?:<[^>]*>\s*)?(?:(?P<owner>[A-Za-z_]\w*)\.)?(?P<name>`[^`]+`|[A-Za-z_]\w*)\s*(?P<params>\((?:[^(){}]|\([^()]*\))*\))\s*(?::\s*[\w<>?,. \[\]]+)?\s*(?P<open>\{|=|\n|$)"], _JAVA_TYPES.replace(r"(?P<head>[^{;]*)\{", r"(?P<head>[^{;]*?)\{"), [r"(?m)^\s*import\s+(?P<path>[\w.*]+)(?:\s+as\s+(?P<alias>\w+))?"], r"(?m)^\s*package\s+(?P<name>[\w.]+)", r"@(?P<name>[A-Za-z][\w.]*)", fields=r"\b(?:val|var)\s+(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)", locals=r"\b(?P<name>[a-z]\w*)\s*:\s*(?P<type>[A-Z]\w*)\s*(?=[,)=\n])|\bval\s+(?P<name2>\w+)\s*=\s*(?P<type2>[A-Z]\w*)\("),
    "php": Profile([r"\bfunction\s+&?(?P<name>\w+)\s*(?P<params>\((?:[^(){}]|\([^()]*\))*\))[^{;]*(?P<open>\{|;)"], r"\b(?:class|interface|trait|enum)\s+(?P<name>\w+)(?P<head>[^{;]*)\{", [r"(?m)^\s*use\s+(?:function\s+)?(?P<path>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?(?P<path>['\"][^'\"\n]*['\"])"], r"(?m)^\s*namespace\s+(?P<name>[\w\\]+)", r"#\[(?P<name>[\w\\]+)", line_comments=("//", "#(?!\\[)"), fields=r"(?:private|protected|public|readonly)\s+(?:readonly\s+)?\??(?P<type>[A-Z][\w\\]*)\s+\$(?P<name>\w+)", locals=r"\??(?P<type>[A-Z][\w\\]*)\s+\$(?P<name>\w+)|\$(?P<name2>\w+)\s*=\s*new\s+(?P<type2>[\w\\]+)", consts=r"(?m)\bconst\s+(?P<name>\w+)\s*=\s*(?P<value>['\"])"),
    "swift": Profile([r"\bfunc\s+(?P<name>[A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*(?P<params>\((?:[^(){}]|\([^()]*\))*\))[^{}\n]*(?P<open>\{|\n)", r"\b(?P<name>init)\s*\??(?P<params>\((?:[^(){}]|\([^()]*\))*\))[^{}\n]*(?P<open>\{)"], _JAVA_TYPES.replace("class|interface", "actor|class|interface"), [r"(?m)^\s*(?:@\w+\s+)?import\s+(?P<path>\w+)"], "", r"@(?P<name>[A-Za-z]\w*)", quotes='"', fields=r"\b(?:let|var)\s+(?P<name>\w+)\s*:\s*(?P<type>[A-Z]\w*)", locals=r"\b(?P<name>[a-z]\w*)\s*:\s*(?P<type>[A-Z]\w*)\s*(?=[,)=\n])|\blet\s+(?P<name2>\w+)\s*=\s*(?P<type2>[A-Z]\w*)\("),
    "objc": Profile([r"(?m)^[-+]\s*\([^)]*\)\s*(?P<name>\w+)(?P<params>[^{;\n]*)(?P<open>\{|;)", r"(?m)^(?!\s*(?:return|else|if|for|while|switch|typedef|@|[-+])\b)[\w*\s]+?\b(?P<name>[A-Za-z_]\w*)\s*(?P<params>\((?:[^(){};]|\([^()]*\))*\))\s*\{"], r"@(?:interface|implementation|protocol)\s+(?P<name>\w+)(?P<head>[^\n{]*)", [r'(?m)^\s*#\s*(?:include|import)\s*(?P<path>"[^"\n]*"|<[^>\n]*>)', r"(?m)^@import\s+(?P<path>[\w.]+)"]),
    "ruby": Profile([r"(?m)^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)(?P<params>\([^)\n]*\))?"], r"(?m)^[ \t]*(?:class|module)\s+(?P<name>[\w:]+)(?P<head>[^\n;]*)", [r"(?m)^\s*(?:require|require_relative|load)\s*\(?\s*(?P<path>['\"][^'\"\n]*['\"])"], line_comments=("#",), block_comments=False, ends="end", consts=r"(?m)^\s*(?P<name>[A-Z]\w*)\s*=\s*(?P<value>['\"])", locals=r"\b(?P<name>[a-z_]\w*)\s*=\s*(?P<type>[A-Z]\w*)\.new"),
    "bash": Profile([r"(?m)^[ \t]*(?:function\s+)?(?P<name>[\w:.-]+)\s*\(\s*\)\s*\{", r"(?m)^[ \t]*function\s+(?P<name>[\w:.-]+)\s*\{", r"(?m)^@test\s+(?P<qname>[\"'][^\n]*?[\"'])\s*\{"], "", [r"(?m)^\s*(?:source|\.)\s+(?P<path>[^\s;]+)"], line_comments=("#",), block_comments=False, consts=r"(?m)^\s*(?:readonly\s+|export\s+)?(?P<name>\w+)=(?P<value>['\"])"),
}
PROFILES["cpp"] = Profile(
    [r"(?P<owner>\w+)::(?P<name>~?\w+)\s*(?P<params>\((?:[^(){};]|\([^()]*\))*\))[^{};()]*(?P<open>\{)", PROFILES["java"].functions[0].replace("throws", "noexcept|throws")],
    r"\b(?:class|struct)\s+(?P<name>\w+)(?P<head>[^{;()]*)\{", PROFILES["c"].imports, fields=PROFILES["java"].fields, locals=PROFILES["java"].locals.replace("[A-Z]\\w*)\\s+", "[A-Z]\\w*)[&*\\s]+"), exported=r"\bextern\b",
)
PROFILES["csharp"] = Profile(
    [PROFILES["java"].functions[0].replace(r"(?:throws\s+[\w.,\s]+)?(?P<open>\{|;)", r"(?:where[^{]*)?(?P<open>\{|;|=>)")], _JAVA_TYPES,
    [r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<path>[\w.]+)\s*;"], r"(?m)^\s*namespace\s+(?P<name>[\w.]+)", r"(?<![\w\])])\[(?P<name>[A-Z][\w.]*)", fields=PROFILES["java"].fields.replace("final|", "readonly|"), locals=PROFILES["java"].locals,
)
_JS = Profile(
    [
        r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>)?\s*(?P<params>\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))[^{;]*(?P<open>\{)",
        r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\s*\*?\s*\w*\s*)?(?P<params>\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\]|., {}]+?)?\s*(?:=>\s*)?(?P<open>\{|(?<==>)\s*(?=[^\s{]))",
        r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\s*\$)[A-Za-z_$#][\w$]*)\s*(?:<[^(){}]*>)?\s*(?P<params>\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))\s*(?::\s*[^{};=\n]+)?\s*(?P<open>\{)",
        r"(?P<name>[A-Za-z_$][\w$]*)\s*:\s*(?:async\s*)?(?:function\s*)?(?P<params>\((?:[^()]|\([^()]*\))*\))\s*(?:=>\s*)?(?P<open>\{)",
    ],
    r"\b(?:class|interface|enum)\s+(?P<name>[A-Za-z_$][\w$]*)(?P<head>[^{;]*)\{",
    [r"(?m)^\s*import\s+(?:type\s+)?(?P<names>[^'\"\n;]*?(?:\{[^}]*\})?[^'\"\n;]*?)\s*(?:from\s*)?(?P<path>['\"][^'\"\n]+['\"])", r"\b(?:const|let|var)\s+(?P<names>[\w$]+|\{[^}]*\})\s*=\s*(?:await\s+)?(?:require|import)\s*\(\s*(?P<path>['\"][^'\"\n]+['\"])", r"(?m)^\s*export\s+(?P<names>\*|\{[^}]*\})\s*from\s*(?P<path>['\"][^'\"\n]+['\"])"],
    decorations=r"@(?P<name>[A-Za-z_$][\w$.]*)",
    fields=r"(?:private|public|protected|readonly)\s+(?:readonly\s+)?(?P<name>\w+)\s*[?!]?\s*:\s*(?P<type>[A-Z][\w.]*)",
    locals=r"\b(?P<name>[a-z_$][\w$]*)\s*[?]?\s*:\s*(?P<type>[A-Z][\w.]*)\s*(?=[,)=;])|\b(?:const|let|var)\s+(?P<name2>\w+)\s*=\s*new\s+(?P<type2>[A-Z][\w.]*)",
)
PROFILES |= {"javascript": _JS, "typescript": _JS, "tsx": _JS}

_KEYWORDS = set("if for while switch catch return function sizeof elif else do try new typeof await yield throw in instanceof def class module unless until when case and or not fn func fun match loop guard defer super import require_once use where let const var val async static public private protected void int".split())
_CALL = re.compile(r"(?P<recv>(?:[A-Za-z_$@][\w$]*(?:\([^()\n]*\))?(?:\?\.|\.|->|::))*)(?P<name>[A-Za-z_$][\w$]*[?!]?)\s*(?P<types><[\w., \[\]?:]+>)?\s*\(")
_BARE_RUBY = re.compile(r"(?m)(?:^|[;=]|\bdo\b|\|)[ \t]*(?P<recv>(?:[A-Za-z_@]\w*\.)*)(?P<name>[a-z_]\w*[?!]?)[ \t]+(?=[:'\"@A-Z\[])")
_BARE_SHELL = re.compile(r"(?m)(?:^|[;|&(]|\bthen\b|\bdo\b|\belse\b)[ \t]*(?P<name>[A-Za-z_][\w:.-]*)(?=[ \t;\n)|&]|$)")
_MESSAGE = re.compile(r"\[(?P<recv>[A-Za-z_]\w*)\s+(?P<name>[A-Za-z_]\w*)")


class _Text:
    """A text with comments and string contents blanked, and the strings by start."""

    def __init__(self, text: str, p: Profile):
        self.text, self.profile = text, p
        comments = [re.escape(c) if len(c) < 3 else c for c in p.line_comments]
        marks = [rf"(?P<c>(?:{'|'.join(comments)})[^\n]*)"] if comments else []
        if p.block_comments:
            marks.append(r"(?P<b>/\*.*?(?:\*/|\Z))")
        marks.append('(?P<t>"{3}.*?(?:"{3}|\\Z))')
        marks += [rf"(?P<s{i}>{q}(?:\\.|[^{q}\\\n])*{q})" for i, q in enumerate(p.quotes)]
        marks += [rf"(?P<m{i}>{q}(?:\\.|[^{q}\\])*{q})" for i, q in enumerate(p.multiline)]
        self.strings, self.comments, out, last = {}, [], [], 0
        for m in re.finditer("|".join(marks), text, re.S):
            out.append(text[last : m.start()])
            body, kind = m[0], m.lastgroup[0]
            if kind in "cb":
                self.comments.append((m.start(), body))
                out.append(re.sub(r"[^\n]", " ", body))
            else:
                n = 3 if kind == "t" else 1
                self.strings[m.start()] = body[n:-n] if len(body) >= 2 * n else ""
                out.append(body[0] + re.sub(r"[^\n]", "_", body[1:-1]) + body[-1])
            last = m.end()
        self.code = "".join([*out, text[last:]])
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def column(self, at: int) -> int:
        i = bisect.bisect_left(self.breaks, at)
        return at - (self.breaks[i - 1] + 1 if i else 0)

    def close(self, at: int, pair: str = "{}") -> int:
        """The end of the bracket that opens at a position, or of the text."""
        depth = 0
        for m in re.finditer(rf"[{re.escape(pair)}]", self.code[at:]):
            depth += 1 if m[0] == pair[0] else -1
            if depth == 0:
                return at + m.end()
        return len(self.code)

    def indent_end(self, at: int) -> int:
        """The ``end`` line that is indented as the line of a position."""
        start = self.code.rfind("\n", 0, at) + 1
        pad = re.match(r"[ \t]*", self.code[start:])[0]
        m = re.compile(rf"^{pad}end\b", re.M).search(self.code, at)
        return m.end() if m else len(self.code)

    def split(self, start: int, end: int, sep: str = ",") -> list[tuple[int, int]]:
        """Parts between top-level separators."""
        out, depth, last = [], 0, start
        for i in range(start, end):
            c = self.code[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == sep and depth == 0:
                out.append((last, i))
                last = i + 1
        out.append((last, end))
        return [(a, b) for a, b in out if self.code[a:b].strip()]

    def literals(self, start: int, end: int) -> list[dict]:
        out: list[dict] = []
        for i, (a, b) in enumerate(self.split(start, end)):
            self._literal(a, b, i, None, out, 0)
        return out

    def _literal(self, a: int, b: int, index: int, key: str | None, out: list, depth: int) -> None:
        while a < b and self.code[a].isspace():
            a += 1
        s = self.code[a:b].rstrip()
        if not s:
            return
        prefix = re.match(r"[a-zA-Z@$]{0,2}(?=[\"'`])", s)
        if prefix and a + prefix.end() in self.strings:
            # A string, or one followed by => or : as a key.
            at = a + prefix.end()
            text = self.strings[at]
            size = len(text) + 2
            rest = self.code[at + size : b]
            if k := re.match(r"\s*(?:=>|:(?!:))\s*", rest):
                self._literal(at + size + k.end(), b, index, text, out, depth)
            else:
                out.append({"index": index, "key": key, "kind": "str", "text": text})
            return
        if k := re.match(r"(?P<k>[A-Za-z_$][\w$-]*)\s*(?:=>|:(?!:)|=(?![=>]))\s*", s):
            self._literal(a + k.end(), b, index, k["k"], out, depth)
        elif k := re.match(r":(?P<k>\w+)\s*=>\s*", s):
            self._literal(a + k.end(), b, index, k["k"], out, depth)
        elif s[0] in "{[" and depth < 3:
            stop = self.close(a, "{}" if s[0] == "{" else "[]")
            for x, y in self.split(a + 1, stop - 1):
                self._literal(x, y, index, key, out, depth + 1)
        elif m := re.match(r"(?:new\s+|&|await\s+)?(?P<id>[:$@\\]*[A-Za-z_$][\w$]*(?:(?:\.|->|::|\\)[A-Za-z_$][\w$]*)*)", s):
            if not re.match(r"\s*(?:=>|\bfunction\b|[({])?", s[m.end() :])[0].strip().startswith("=>") and m["id"] not in ("function", "async", "true", "false", "null", "nil", "None"):
                out.append({"index": index, "key": key, "kind": "ident", "text": m["id"]})


def _strip(path: str) -> tuple[str, bool]:
    return path.strip().strip("\"'<>"), path.strip().startswith("<")


def _imports(t: _Text, language: str) -> list[dict]:
    out = []
    for pattern in t.profile.imports:
        # Paths are string contents, so they are sought in the text where the code agrees.
        for m in re.finditer(pattern, t.text):
            if t.code[m.start() : m.end()].strip() == "":
                continue
            g = m.groupdict()
            line = t.line(m.start() + len(m[0]) - len(m[0].lstrip()))
            if g.get("group"):
                for x in re.finditer(r'(?m)^\s*(?P<alias>[\w.]+\s+)?"(?P<path>[^"\n]+)"', m["group"]):
                    out.append({"path": x["path"], "names": [(x["alias"] or x["path"].rsplit("/", 1)[-1]).strip()], "line": t.line(m.start("group") + x.start("path")), "system": False})
                continue
            path, system = _strip(g["path"])
            names = []
            if g.get("names"):
                body = re.sub(r"\btype\b", "", g["names"])
                names = [re.split(r"\s+as\s+|\s*:\s*", n.strip())[-1].strip() for n in re.split(r"[{},]", body) if n.strip() and n.strip() != "*"]
                names = [n.removeprefix("* as ").strip() for n in names]
            elif g.get("alias"):
                names = [g["alias"].strip()]
            elif language == "rust":
                out += [{"path": p, "names": [n], "line": line, "system": False} for p, n in _use_paths(path)]
                continue
            elif language in ("java", "kotlin", "php", "go", "csharp"):
                last = re.split(r"[./\\]", path)[-1]
                names = [] if last == "*" else [last]
            elif language in ("swift", "objc"):
                names = [path] if language == "swift" else []
            out.append({"path": path, "names": names, "line": line, "system": system})
    out.sort(key=lambda i: i["line"])
    return out


def _use_paths(path: str) -> list[tuple[str, str]]:
    m = re.match(r"(?s)(?P<head>[\w:]*?)(?:::)?\{(?P<body>.*)\}\s*$", path)
    if not m:
        p, _, alias = path.partition(" as ")
        return [(p.strip(), (alias or p.split("::")[-1]).strip())]
    return [(f"{m['head']}::{p}".strip(":"), n) for part in re.split(r",(?![^{]*\})", m["body"]) if part.strip() for p, n in _use_paths(part.strip())]


def parse(language: str, text: str) -> dict:
    p = PROFILES[language]
    t, record = _Text(text, p), new_file()
    code = t.code
    record["imports"] = _imports(t, language)
    if p.package and (m := re.search(p.package, code)):
        record["package"] = m["name"]
    types = []
    if p.types:
        for m in re.finditer(p.types, code):
            g = m.groupdict()
            name, head = g.get("name") or g.get("name2"), g.get("head") or g.get("head2") or ""
            if p.ends == "end":
                end = t.indent_end(m.start("name"))
            elif language == "objc":
                end = code.find("@end", m.end())
                end = len(code) if end < 0 else end
            else:
                end = t.close(m.end() - 1)
            types.append((m.start(), end, name))
            bases = ([g["base"]] if g.get("base") else []) + re.findall(r"[A-Za-z_][\w.\\:]*", re.sub(r"<[^<>]*>|\([^()]*\)|\b(?:extends|implements|with|where|public|private|protected|virtual|final)\b", " ", head))
            record["hierarchy"] += [{"derived": name, "base": b} for x in bases if (b := simple_type(x)) and b[:1].isupper()]
    owner_of = lambda at: next((n for s, e, n in sorted(types, key=lambda x: x[1] - x[0]) if s < at < e), None)
    spans: dict[int, dict] = {}
    for pattern in p.functions:
        for m in re.finditer(pattern, code):
            g = m.groupdict()
            name = g.get("name") or (t.strings.get(m.start("qname"), "") if g.get("qname") else "")
            name = name.strip("`")
            where = m.start("name") if g.get("name") else m.start()
            if not name or name in _KEYWORDS or where in spans:
                continue
            opened = g.get("open", "{")
            inside = owner_of(m.start())
            if p.ends == "end":
                end = t.indent_end(m.start("name"))
            elif opened == "{" or (opened is None and code[m.end() - 1] == "{"):
                end = t.close(m.end() - 1)
            elif opened == ";":
                # Declarations without a body only count inside a type.
                if not inside or language in ("c", "cpp"):
                    continue
                before = code[max(0, m.start() - 40) : m.start()].rstrip()
                if not before or not re.search(r"[\w>\]?]$", before) or re.search(r"(?:\breturn|\bnew|\bthrow|=|\.)\s*$", before):
                    continue
                end = m.end()
            else:
                end = code.find("\n", m.end())
                end = len(code) if end < 0 else end
            if language in ("java", "csharp", "cpp") and opened != ";":
                before = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
                if re.search(r"(?:\bnew\s+[\w.<>]*|[=.(,]|\breturn)\s*$", before) or (not before.strip() and not inside):
                    continue
            first = code.rfind("\n", 0, where) + 1
            params = g.get("params") or ""
            at = m.start("params") if params else 0
            parts = t.split(at + 1, m.end("params") - 1) if params.startswith("(") else ([(0, 1)] if params and language in ("javascript", "typescript", "tsx") else [(0, 1)] * params.count(":"))
            parts = [x for x in parts if code[x[0] : x[1]].strip() not in ("void", "self", "&self", "&mut self", "mut self")]
            stop = text.find("\n", where)
            start = first + len(code[first:]) - len(code[first:].lstrip())
            spans[where] = new_function(
                name, start=min(start, where), end=end, start_line=t.line(where), end_line=t.line(max(end - 1, 0)),
                signature=text[first : stop if stop >= 0 else len(text)].strip().rstrip("{").strip(), containing_type=g.get("owner") or inside, param_count=len(parts),
            )
            spans[where]["is_exported"] = bool(p.exported and re.search(p.exported, spans[where]["signature"]))
            spans[where]["_args"], spans[where]["_at"] = (m.span("params") if params else (0, 0)), where
    functions = sorted(spans.values(), key=lambda f: (f["start"], -f["end"]))
    top = new_function(TOPLEVEL, is_toplevel=True, end=len(text))
    name_at = set(spans)
    starts = [f["start"] for f in functions]

    def innermost(at: int) -> dict:
        best = None
        for f in functions[: bisect.bisect_right(starts, at)]:
            if f["start"] <= at < f["end"] and (best is None or f["end"] - f["start"] <= best["end"] - best["start"]):
                best = f
        return best or top

    def add_call(name: str, recv: str | None, at: int, start: int, end: int, args: tuple[int, int] | None, type_args=()) -> None:
        if name in _KEYWORDS or at in name_at:
            return
        recv = re.sub(r"(\?\.|\.|->|::)$", "", recv) if recv else None
        if recv and (len(recv) > 48 or "(" in recv):
            recv = None
        lits = t.literals(*args) if args else []
        assigned = re.search(r"(?:\b(?:const|let|var|val|auto)\s+)?([$@]?[A-Za-z_][\w$.]*)\s*(?::[^=\n]+)?(?::=|=)\s*(?:await\s+|new\s+)?$", code[max(0, start - 80) : start])
        innermost(start)["calls"].append({
            "name": name, "receiver": recv or None, "line": t.line(start), "arg_count": len(t.split(*args)) if args else 0, "start": start, "end": end,
            "name_line": t.line(at), "name_col": t.column(at), "arg_lits": lits, "type_args": list(type_args), "assigned_to": assigned[1] if assigned else None,
        })

    decorated_spans = []
    if p.decorations:
        for m in re.finditer(p.decorations, code):
            if any(f["_args"][0] <= m.start() < f["_args"][1] for f in functions):
                continue  # of a parameter
            end, lits = m.end(), []
            after = re.match(r"\s*\(", code[m.end() :])
            if after:
                opened = m.end() + after.end() - 1
                end = t.close(opened, "()")
                lits = t.literals(opened + 1, end - 1)
            decorated_spans.append((m.start(), end))
            d = {"name": m["name"], "line": t.line(m.start()), "arg_lits": lits}
            nearest_type = min((x for x in types if x[0] >= end), default=None)
            following = min((f for f in functions if f["_at"] >= end), key=lambda f: f["_at"], default=None)
            if nearest_type and (following is None or nearest_type[0] < following["_at"]):
                record["type_decorations"].append({"type_name": nearest_type[2], **d})
            elif following is not None:
                following["decorations"].append(d)
            else:
                top["decorations"].append(d)
    for m in _CALL.finditer(code):
        if any(s <= m.start("name") < e for s, e in decorated_spans):
            continue
        end = t.close(m.end() - 1, "()")
        types_of = [x.strip() for x in (m["types"] or "").strip("<>").split(",") if re.fullmatch(r"\s*\w+\s*", x)]
        add_call(m["name"], m["recv"], m.start("name"), m.start(), end, (m.end(), max(m.end(), end - 1)), types_of)
    if language == "ruby":
        for m in _BARE_RUBY.finditer(code):
            stop = code.find("\n", m.end())
            stop = len(code) if stop < 0 else stop
            stop = m.end() + len(re.sub(r"\s+do\b.*$|\s*\{\s*\|.*$", "", code[m.end() : stop]))
            block = code[stop : code.find("\n", stop) if code.find("\n", stop) >= 0 else len(code)]
            end = t.indent_end(m.start("name")) if re.search(r"\bdo\b", block) else stop
            add_call(m["name"], m["recv"], m.start("name"), m.start("recv") if m["recv"] else m.start("name"), end, (m.end(), stop))
    if language == "bash":
        known = {f["name"] for f in functions}
        for m in _BARE_SHELL.finditer(code):
            if m["name"] in known or m["name"] not in ("fi", "done", "esac", "then", "do", "local", "export", "return", "echo", "else", "set", "readonly", "exit", "shift", "source"):
                stop = re.compile(r"[;\n|&)]|$").search(code, m.end()).start()
                add_call(m["name"], None, m.start("name"), m.start("name"), stop, None)
    if language == "objc":
        for m in _MESSAGE.finditer(code):
            end = t.close(m.start(), "[]")
            add_call(m["name"], m["recv"], m.start("name"), m.start(), end, None)
    if p.fields:
        for m in re.finditer(p.fields, code):
            owner = owner_of(m.start())
            if owner and (ty := simple_type(m["type"])):
                if innermost(m.start()) is top or "readonly" in m[0] or "private" in m[0] or language in ("kotlin",):
                    record["fields"].append({"owner": owner, "name": m["name"], "type_name": ty})
    if p.locals:
        for f in functions:
            a, b = f["_args"]
            for m in re.finditer(p.locals, code[a:b] + code[b : f["end"]] if b else code[f["start"] : f["end"]]):
                g = m.groupdict()
                name, ty = g.get("name") or g.get("name2"), simple_type(g.get("type") or g.get("type2"))
                if name and ty and all(x["name"] != name for x in f["locals"]):
                    f["locals"].append({"name": name, "type": ty})
            if language == "go" and (m := re.match(r"func\s+\(\s*(\w+)\s+\*?(\w+)", code[f["start"] :])):
                f["locals"].insert(0, {"name": m[1], "type": m[2]})
    values: dict[str, set] = {}
    for m in re.finditer(p.consts, code):
        if innermost(m.start()) is top and m.start("value") in t.strings and len(t.strings[m.start("value")]) <= 200:
            values.setdefault(m["name"], set()).add(t.strings[m.start("value")])
    record["consts"] = [{"name": k, "value": next(iter(v))} for k, v in values.items() if len(v) == 1]
    for f in functions:
        body = code[f["start"] : f["end"]]
        for m in re.finditer(r"\breturn\s+(?=[\"'`])", body):
            at = f["start"] + m.end()
            if at in t.strings and len(t.strings[at]) <= 64:
                f["ret_strs"].append(t.strings[at])
        feats = f["features"]
        for w in re.findall(_ID, re.sub(r"[\"'`]_*[\"'`]", " ", body)):
            if w not in _KEYWORDS:
                bump(feats, f"id:{w}")
        loops, branches = len(re.findall(r"\b(?:for|while|loop|until|each|foreach)\b", body)), len(re.findall(r"\b(?:if|switch|case|match|when|guard|elsif|elif)\b", body))
        if loops:
            feats["flow:loops"] = loops
        if branches:
            feats["flow:branches"] = branches
        depth = max((body[:i].count("{") - body[:i].count("}") for i in (m.start() for m in re.finditer(r"\{", body))), default=0)
        if depth:
            feats[f"flow:depth:{min(depth, 8)}"] = 1
        above = [c for at, c in t.comments if f["start"] - len(c) - 200 <= at < f["start"] and 0 <= t.line(f["start"]) - t.line(at + len(c)) <= 2][-3:]
        for n, w in enumerate(w for c in above for w in words_of(c)):
            if n < 40 and 3 <= len(w) <= 24 and not w.isdigit():
                feats[f"doc:{w}"] = 1
        for c in above:
            for m in list(re.finditer(r"@(?P<name>[A-Z]\w*)\((?P<args>[^)]*)\)|@(?P<tag>test)\b", c))[:8]:
                lits = [{"index": i, "key": k or None, "kind": "str", "text": v} for i, (k, v) in enumerate(re.findall(r"(?:(\w+)\s*=\s*)?[\"']([^\"']*)[\"']", m["args"] or ""))]
                f["decorations"].append({"name": m["name"] or "@test", "line": t.line(f["start"]), "arg_lits": lits})
        del f["_args"], f["_at"]
    record["functions"], record["top"] = functions, top
    return record

