"""Symbols, imports, calls and bases of languages with braces, read from the text without a grammar.

Comments and the insides of literals become blanks of the same length, braces are paired, and definitions are told by the
words in front of an opening brace. What this can't tell (macros, overloads by type, templates of templates) is left out, not guessed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_COMMON = "if for while switch catch return else do try function new throw typeof sizeof case delete await async import yield synchronized using assert super in of instanceof"
_KEYWORDS = {k: frozenset((_COMMON + more).split()) for k, more in (("typescript", ""), ("java", ""), ("go", " go defer select func range"), ("c", ""), ("cpp", " decltype alignof static_cast"))}
_ARGS = r"\((?P<args>[^(){};]*(?:\([^(){};]*\)[^(){};]*)*)\)"
_CLASS = {
    "typescript": r"\b(?:class|interface|enum|namespace)\s+(?P<name>[\w$]+)(?P<rest>[^{};()]*)\{",
    "java": r"\b(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)(?P<rest>[^{};]*)\{",
    "go": r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)(?P<rest>)\s*\{",
    "c": r"\b(?:struct|union|enum)\s+(?P<name>\w+)(?P<rest>)\s*\{",
    "cpp": r"\b(?:struct|union|enum(?:\s+class)?|class|namespace)\s+(?P<name>\w+)(?:\s+final)?\s*(?P<rest>(?::[^{};:][^{};]*)?)\{",
}
_FUNCTION = {
    "typescript": [
        r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^<>{}()]*>)?\s*" + _ARGS + r"\s*(?::[^{};=]+)?\{",
        r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?" + _ARGS + r"\s*(?::[^=;{}]+)?=>\s*\{",
        r"(?:(?<=[;{}\n])|(?<=\*/))[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)\s+)*\*?(?P<name>[\w$]+)\s*(?:<[^<>{}()]*>)?\s*" + _ARGS + r"\s*(?::[^{};=]+)?\{",
    ],
    "java": [r"(?<![\w.$])(?:(?:[\w.]+(?:<[^{};()]*>)?(?:\[\])*\s+)*)(?P<name>\w+)\s*" + _ARGS + r"\s*(?:throws\s+[\w.,\s]+)?\{"],
    "go": [r"\bfunc\s*(?:\(\s*(?P<self>\w+)?\s*\*?\s*(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*" + _ARGS + r"(?P<out>[^{};]*)\{"],
    "c": [r"(?<![\w.])(?:[\w*]+[\s*]+)+(?P<name>\w+)\s*" + _ARGS + r"\s*\{"],
    "cpp": [r"(?<![\w.:])(?:[\w:<>,*&~]+[\s*&]+)*(?P<name>(?:\w+::)*~?\w+)\s*" + _ARGS + r"\s*(?:const|noexcept|override|final|\s)*(?::\s*\w[^{};]*)?\{"],
}
LANGUAGES = tuple(_CLASS)
_CALL = re.compile(r"(?<![\w$.:>])(?P<callee>[A-Za-z_$][\w$]*(?:\s*(?:\.|->|::)\s*[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,.<>\[\]]*>)?\(")
_LOCAL = {
    "typescript": r"\b(?:const|let|var)\s+([\w$]+)\s*(?:=\s*(?:new\s+([\w$]+)\s*\()?)?",
    "java": r"(?<![\w.])([A-Z]\w*)(?:<[^{};()]*>)?(?:\[\])*\s+(\w+)\s*(?==|;|:)",
    "go": r"\b(\w+)\s*:=\s*(?:&?(\w+)\{)?",
    "c": r"(?<![\w.])(?:struct\s+)?(?!return\b|goto\b|else\b)([A-Za-z_]\w*)[\s*]+(\w+)\s*(?==|;|\[)",
    "cpp": r"(?<![\w.:])(?:struct\s+)?(?!return\b|goto\b|else\b|new\b|delete\b)([A-Za-z_][\w:]*)[\s*&]+(\w+)\s*(?==|;|\[|\{)",
}


def masked(text: str, language: str) -> str:
    """The text with comments and the insides of literals blank; lines and lengths stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    raw = "|`(?:\\\\.|[^`\\\\])*`" if language in ("typescript", "go") else ""
    inside = lambda m: blank(m) if m[0][:2] in ("//", "/*") else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" + raw, inside, text, flags=re.S)


def pairs(text: str) -> dict[int, int]:
    """The closing brace of each opening one."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    head_end: int
    end: int
    args: str = ""
    owner: str | None = None
    own_name: str | None = None
    bases: list[str] = field(default_factory=list)
    parent: Definition | None = None
    qualname: str = ""


def _bases(rest: str, language: str) -> list[str]:
    rest = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", rest))
    if language == "cpp":
        return [re.sub(r"\b(?:public|private|protected|virtual)\b|\s", "", b) for b in rest.lstrip(": \n").split(",") if b.strip()] if rest.strip() else []
    rest = re.sub(r"\((?:[^()])*\)", "", rest)
    return [b.strip() for b in re.split(r"\bextends\b|\bimplements\b|,", rest) if b.strip() and re.match(r"^[\w$.]+$", b.strip())]


def definitions(text: str, language: str) -> list[Definition]:
    """All definitions with a body, by start; `text` is masked."""
    closing, found = pairs(text), {}
    for m in re.finditer(_CLASS[language], text):
        brace = m.end() - 1
        if brace in closing:
            found[brace] = Definition(m["name"], "class", _line_start(text, m.start()), brace, closing[brace] + 1, bases=_bases(m["rest"], language))
    for pattern in _FUNCTION[language]:
        for m in re.finditer(pattern, text):
            brace, name = m.end() - 1, m["name"]
            words = set(re.findall(r"\w+", text[m.start() : m.start("name")]))
            if brace not in closing or brace in found or name.rpartition("::")[2] in _KEYWORDS[language] or words & {"new", "return", "else", "throw", "class", "record"}:
                continue
            groups = m.groupdict()
            owner = groups.get("owner")
            if "::" in name:
                owner, _, name = name.rpartition("::")
            start = m.start() + len(re.match(r"\s*(?:(?:public|private|protected)\s*:\s*)*", m[0])[0])
            found[brace] = Definition(name, "function", _line_start(text, start), brace, closing[brace] + 1, m["args"], owner, groups.get("self"))
    out = sorted(found.values(), key=lambda d: (d.start, -d.end))
    open_: list[Definition] = []
    for d in out:
        while open_ and open_[-1].end <= d.start:
            open_.pop()
        d.parent = open_[-1] if open_ else None
        open_.append(d)
    return out


def _line_start(text: str, at: int) -> int:
    """Modifiers and annotations in front on the same line belong to the definition."""
    start = text.rfind("\n", 0, at) + 1
    head = text[start:at]
    return start + len(head) - len(head.lstrip()) if not re.search(r"[;{}()=]", head) else at


def imports(raw: str, text: str, language: str) -> list[tuple[str, str | None, str, int, int]]:
    """(module, name, alias, level, offset): level counts the directories that a relative path goes up, and one."""
    out = []
    if language == "typescript":
        for m in re.finditer(r"\bimport\s+(?:type\s+)?(?P<what>[^;'\"]*?)\s*(?:from\s*)?['\"]", text):
            spec = re.match(r"[^'\"]*", raw[m.end() :])[0]
            up = spec.count("../") + 1 if spec.startswith(".") else 0
            module = re.sub(r"^(\.\.?/)+", "", spec).replace("/", ".")
            for star in re.findall(r"\*\s*as\s+([\w$]+)", m["what"]):
                out.append((module, None, star, up, m.start()))
            for part in re.findall(r"[\w$]+(?:\s+as\s+[\w$]+)?", ",".join(re.findall(r"\{([^}]*)\}", m["what"]))):
                name, _, alias = re.sub(r"\s+", " ", part).partition(" as ")
                out.append((module, name, alias or name, up, m.start()))
            if default := re.match(r"[\w$]+", re.sub(r"\{[^}]*\}|\*\s*as\s+[\w$]+", "", m["what"]).strip(" ,\n")):
                out.append((module, "default", default[0], up, m.start()))
    elif language == "java":
        for m in re.finditer(r"\bimport\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", text):
            module, _, name = m[1].rpartition(".")
            out.append((m[1], None, "*", 0, m.start()) if m[2] else (module, name, name, 0, m.start()))
    elif language == "go":
        for block in re.finditer(r"\bimport\s*(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"\n]*\"))", text):
            span = block.span(1) if block[1] is not None else block.span(2)
            for m in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"", raw[span[0] : span[1]]):
                out.append((m[2].replace("/", "."), None, m[1] or m[2].rsplit("/", 1)[-1], 0, span[0] + m.start()))
    else:
        for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", raw):
            out.append((m[1], None, "*", 0, m.start()))
    return out


def calls(text: str, found: list[Definition], language: str) -> list[tuple[str, int]]:
    """(callee, offset), parts joined by dots; heads of definitions and, but in TypeScript, whatever is outside functions aren't calls."""
    out = []
    spans = [(d.start, d.head_end) for d in found if d.kind == "function"]
    starts = [s for s, _ in spans]
    inside: list[list[int]] = []  # where functions are, as spans that don't overlap
    for d in found:
        if d.kind == "function" and inside and d.start <= inside[-1][1]:
            inside[-1][1] = max(inside[-1][1], d.end)
        elif d.kind == "function":
            inside.append([d.start, d.end])
    for m in _CALL.finditer(text):
        callee = re.sub(r"\s*(?:->|::|\.)\s*", ".", m["callee"])
        i = bisect_right(starts, m.start()) - 1
        if callee.split(".")[0] in _KEYWORDS[language] - {"super"} or (i >= 0 and m.start() < spans[i][1]):
            continue
        k = bisect_right(inside, m.start(), key=lambda x: x[0]) - 1
        if language != "typescript" and (k < 0 or m.start() >= inside[k][1]):
            continue
        out.append((callee, m.start()))
    return out


def locals_of(text: str, d: Definition, language: str) -> list[tuple[str, str | None]]:
    """(name, what it is bound to): arguments and local variables of a function; a type with `()` where the text names it."""
    out: list[tuple[str, str | None]] = []
    for arg in re.split(r",(?![^<>]*>)", d.args):
        words = re.findall(r"[\w$]+", re.sub(r"=.*", "", arg, flags=re.S))
        if not words or words == ["void"]:
            continue
        if language == "typescript":
            kind = words[1] if ":" in arg and len(words) > 1 else None
            out.append((words[0], f"{kind}()" if kind and kind[:1].isupper() else None))
        elif language == "go":
            out.append((words[0], f"{words[-1]}()" if len(words) > 1 and words[-1][:1].isupper() else None))
        elif len(words) > 1:
            out.append((words[-1], f"{words[-2]}()" if words[-2][:1].isupper() else None))
    if d.own_name and d.owner:
        out.append((d.own_name, f"{d.owner}()"))
    for m in re.finditer(_LOCAL[language], text[d.head_end : d.end]):
        name, kind = (m[1], m[2]) if language in ("typescript", "go") else (m[2], m[1])
        if name not in _KEYWORDS[language]:
            out.append((name, f"{kind}()" if kind and kind[:1].isupper() else None))
    return sorted(set(out), key=str)
