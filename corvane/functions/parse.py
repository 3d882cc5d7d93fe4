"""Sources parsed to symbols, imports, calls and bases: Python by the standard library's own parser, languages with braces by `braces`."""

from __future__ import annotations

import ast
import hashlib
import itertools
import re
from array import array
from bisect import bisect_right
from collections import deque

from corvane.functions import braces

LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp"}
SCHEMA = (
    "path string, symbols array<struct<id:string,path:string,name:string,qualname:string,kind:string,start_line:int,end_line:int,start_byte:int,end_byte:int,signature:string,docstring:string,body:string,content_hash:string,parent_id:string,fingerprint:string>>, "
    "imports array<struct<module:string,name:string,alias:string,level:int,scope:string,line:int>>, calls array<struct<callee:string,scope:string,line:int>>, bases array<struct<class:string,base:string,position:int>>, "
    "bindings array<struct<scope:string,name:string,target:string>>, comprehensions array<struct<scope:string,start_line:int,end_line:int,source:string>>, diagnostics array<string>"
)


def symbol_id(path: str, kind: str, qualname: str) -> str:
    return hashlib.sha256(f"{path}:{kind}:{qualname}".encode()).hexdigest()


def module_name(path: str, text: str = "") -> str:
    """The scope of a file: its dotted path; of Go, its package, which is the directory; of Java, the package it declares and nothing of its name."""
    if path.endswith(".go"):
        found = re.search(r"(?m)^package\s+(\w+)", text)
        return path.rpartition("/")[0].replace("/", ".") or (found[1] if found else "main")
    if path.endswith(".java"):
        found = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", text)
        return found[1] if found else path.rpartition("/")[0].replace("/", ".") or "default"
    return re.sub(r"(/__init__)?\.(py|tsx?|c|h|cc|cpp|cxx|hpp)$", "", path).replace("/", ".")


def _braced(path: str, text: str, language: str, scope: str, module_id: str) -> dict[str, list]:
    """The rows of a file in a language with braces."""
    clean = braces.masked(text, language)
    found = braces.definitions(clean, language)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    size = range(len(text) + 1) if text.isascii() else array("q", itertools.accumulate((len(c.encode("utf-8", "replace")) for c in text), initial=0))
    out: dict[str, list] = {k: [] for k in ("symbols", "imports", "calls", "bases", "bindings", "comprehensions")}
    types = {d.name: d for d in found if d.kind == "class"}
    for d in found:
        inside = d.parent.qualname if d.parent else scope
        if d.owner and (language == "go" or d.owner.rpartition("::")[2] in types):
            owner = d.owner.rpartition("::")[2]
            inside = types[owner].qualname if owner in types else f"{scope}.{owner}"
        d.qualname = f"{inside}.{d.name}"
        of_class = d.owner is not None or (d.parent is not None and d.parent.kind == "class")
        kind = d.kind if d.kind == "class" else "method" if of_class else "function"
        parent = symbol_id(path, "class", inside) if d.owner else symbol_id(path, d.parent.kind if d.parent.kind == "class" else _kind(d.parent), d.parent.qualname) if d.parent else module_id
        body = text[d.start : d.end]
        data = body.encode("utf-8", "replace")
        shape = hashlib.sha256(re.sub(r"\s+", " ", clean[d.head_end : d.end]).encode()).hexdigest()
        out["symbols"].append((symbol_id(path, kind, d.qualname), path, d.name, d.qualname, kind, line(d.start), line(d.end - 1), size[d.start], size[d.end], text[d.start : d.head_end].strip(), None, body, hashlib.sha256(data).hexdigest(), parent, shape))
        out["bases"] += [(d.qualname, base, i) for i, base in enumerate(d.bases)]
        if d.kind == "function":
            out["bindings"] += [(d.qualname, name, target) for name, target in braces.locals_of(clean, d, language)]
    out["imports"] = [(module, name, alias, level, scope, line(at)) for module, name, alias, level, at in braces.imports(text, clean, language)]
    # calls come by place, and so do definitions: what has ended before a call holds none of those after it
    around, ahead = [], deque(d for d in found if d.kind == "function")
    for callee, at in braces.calls(clean, found, language):
        while ahead and ahead[0].start <= at:
            around.append(ahead.popleft())
        while around and around[-1].end <= at:
            around.pop()
        out["calls"].append((callee, around[-1].qualname if around else scope, line(at)))
    return out


def _kind(d: braces.Definition) -> str:
    return "method" if d.owner is not None or (d.parent is not None and d.parent.kind == "class") else "function"


def fingerprint(node: ast.AST) -> str:
    """The tree's shape and names, without the definition's own."""
    copy = ast.parse(ast.unparse(node)).body[0]
    copy.name = "_"  # type: ignore[attr-defined]
    return hashlib.sha256(ast.dump(copy).encode()).hexdigest()


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str, source: str) -> None:
        self.path, self.data = path, source.encode()
        self.lines = self.data.split(b"\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.out: dict[str, list] = {k: [] for k in ("symbols", "imports", "calls", "bases", "bindings", "comprehensions")}
        self.scopes = [(module_name(path), "module", symbol_id(path, "module", module_name(path)))]

    def _byte(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    @property
    def scope(self) -> str:
        return self.scopes[-1][0]

    def _definition(self, node, kind: str) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        begin = self._byte(first, min([node.col_offset, *(d.col_offset - 1 for d in node.decorator_list)]) if first != node.lineno else node.col_offset)
        end = self._byte(node.end_lineno, node.end_col_offset)
        body = self.data[begin:end]
        head = self.data[self._byte(node.lineno, node.col_offset) : self._byte(node.body[0].lineno, node.body[0].col_offset)].decode()
        qualname = f"{self.scope}.{node.name}"
        id = symbol_id(self.path, kind, qualname)
        self.out["symbols"].append((id, self.path, node.name, qualname, kind, first, node.end_lineno, begin, end, head.strip().rstrip(":").strip(), ast.get_docstring(node, clean=False), body.decode(), hashlib.sha256(body).hexdigest(), self.scopes[-1][2], fingerprint(node)))
        if kind != "class":
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]:
                self.out["bindings"].append((qualname, a.arg, None))
        self.scopes.append((qualname, kind, id))
        self.generic_visit(node)
        self.scopes.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for i, base in enumerate(node.bases):
            self.out["bases"].append((f"{self.scope}.{node.name}", ast.unparse(base), i))
        self._definition(node, "class")

    def visit_FunctionDef(self, node) -> None:
        self._definition(node, "method" if self.scopes[-1][1] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out["imports"].append((a.name, None, a.asname or a.name.split(".")[0], 0, self.scope, node.lineno))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.out["imports"].append((node.module or "", a.name, a.asname or a.name, node.level, self.scope, node.lineno))

    def visit_Call(self, node: ast.Call) -> None:
        self.out["calls"].append((ast.unparse(node.func), self.scope, node.lineno))
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            if isinstance(target, ast.Name):
                value = node.value
                # a name for a name, or for an instance of a class; anything else hides the outer name
                known = ast.unparse(value) if isinstance(value, ast.Name | ast.Attribute) else ast.unparse(value.func) + "()" if isinstance(value, ast.Call) else None
                self.out["bindings"].append((self.scope, target.id, known))
        self.generic_visit(node)

    def _comprehension(self, node) -> None:
        self.out["comprehensions"].append((self.scope, node.lineno, node.end_lineno, ast.unparse(node)))
        self.generic_visit(node)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension


def parse(path: str, content: bytes) -> dict:
    """The rows of one file; a file that can't be parsed keeps its module symbol and gives a diagnostic."""
    text = content.decode("utf-8", "replace")
    name = module_name(path, text)
    module = (symbol_id(path, "module", name), path, name.rsplit(".", 1)[-1], name, "module", 1, max(1, text.count("\n") + (not text.endswith("\n"))), 0, len(content), "", None, text, hashlib.sha256(content).hexdigest(), None, None)
    out = {"path": path, "symbols": [module], "imports": [], "calls": [], "bases": [], "bindings": [], "comprehensions": [], "diagnostics": []}
    suffix = "." + path.rsplit(".", 1)[-1] if "." in path else ""
    language = LANGUAGES.get(suffix)
    if language in braces.LANGUAGES:
        return out | {k: (v if k != "symbols" else [module, *v]) for k, v in _braced(path, text, language, name, module[0]).items()}
    if language != "python":
        out["diagnostics"].append(f"unsupported language: {language or suffix or 'none'}")
        return out
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as error:
        out["diagnostics"].append(f"{type(error).__name__} in line {getattr(error, 'lineno', 0)}")
        return out
    walk = _Walk(path, text)
    walk.visit(tree)
    out |= walk.out
    out["symbols"] = [module[:10] + (ast.get_docstring(tree, clean=False),) + module[11:], *walk.out["symbols"]]
    return out


def split_oversized(text: str, most_bytes: int) -> list[str]:
    """Pieces of at most so many bytes, of whole lines where they fit, cut between code points where not; joined, they are the text."""
    out, now, size = [], [], 0
    for line in text.splitlines(keepends=True):
        for c in _cut(line, most_bytes):
            n = len(c.encode())
            if size + n > most_bytes:
                out.append("".join(now))
                now, size = [], 0
            now.append(c)
            size += n
    return [*out, "".join(now)] if now else out


def _cut(line: str, most: int) -> list[str]:
    if len(line.encode()) <= most:
        return [line]
    out, start, size = [], 0, 0
    for i, c in enumerate(line):
        n = len(c.encode())
        if size + n > most and i > start:
            out.append(line[start:i])
            start, size = i, 0
        size += n
    return [*out, line[start:]]


def changed_lines(patch: str) -> list[tuple[str, int]]:
    """(path, line in the base) that a unified diff deletes or adds after."""
    out, path, line = [], None, 0
    for row in patch.splitlines():
        if row.startswith("--- "):
            path = row[4:].split("\t")[0].removeprefix("a/")
        elif row.startswith("+++ "):
            continue
        elif m := re.match(r"@@ -(\d+)", row):
            line = int(m[1])
        elif path and row.startswith("-"):
            out.append((path, line))
            line += 1
        elif path and row.startswith("+"):
            out.append((path, max(1, line - 1)))
        elif path and row.startswith(" "):
            line += 1
    return sorted(set(out))


def varbyte_encode(ids: list[int]) -> bytes:
    """Ascending ids as differences in groups of seven bits, low groups first; the last group of each has the high bit."""
    if any(b < a for a, b in zip([0, *ids], ids)):
        raise ValueError("ids must ascend from 0")
    out = bytearray()
    for n in (b - a for a, b in zip([0, *ids], ids)):
        groups = [n >> shift & 127 for shift in range(0, max(1, n.bit_length()), 7)]
        groups[-1] |= 128
        out += bytes(groups)
    return bytes(out)


def varbyte_decode(data: bytes) -> list[int]:
    if data and data[-1] < 128:
        raise ValueError("truncated")
    ends = [i + 1 for i, b in enumerate(data) if b & 128]
    steps = (sum((b & 127) << 7 * i for i, b in enumerate(data[start:end])) for start, end in zip([0, *ends], ends))
    return list(itertools.accumulate(steps))
