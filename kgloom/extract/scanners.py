"""Other languages, by scanning: comments and strings are blanked out, declarations found by pattern, bodies by brackets.

A scanner sees what is declared, not every construct of a grammar; a file that it misreads yields fewer rows, never an error.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .base import Rows

_KEYWORDS = set("if for while switch return catch function sizeof else do try throw throws match when unless elif and or not in is as await yield super typeof delete using lock fixed foreach defer go select loop until case def fun fn func".split())
_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:<[\w\s,.<>?\[\]]*>)?\(")
_C_LIKE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


@dataclass
class Language:
    types: str | None = None  # group name
    functions: str | None = None  # groups name and, optionally, owner
    owners: str | None = None  # blocks that lend their members a parent without being contained: group name
    imports: list[tuple[str, str]] = field(default_factory=list)  # (pattern with group name, relation)
    blanks: re.Pattern = _C_LIKE
    last: str = r"[./\\]|::"  # imports are named by the part after the last of these
    whole: bool = False  # imports are named by all of it
    free: str | None = None  # pattern of functions outside types, where it differs
    ends: str = "brackets"


def _blank(text: str, pattern: re.Pattern, strings: bool = True) -> str:
    def gap(m: re.Match) -> str:
        s = m.group()
        if not strings and s[:1] in "\"'`":
            return s
        return re.sub(r"[^\n]", " ", s)

    return pattern.sub(gap, text)


def _close(text: str, at: int, pair: str = "{}") -> int:
    """Place after the bracket that closes the one at `at`; the text's end where none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


_RUBY_OPEN = re.compile(r"(?:^|;)[ \t]*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?=[ \t]*(?:\||$))|(?:=|<<)[ \t]*(?:if|unless|case|begin)\b|\bend\b", re.M)


def _ruby_close(text: str, at: int) -> int:
    depth = 0
    for m in _RUBY_OPEN.finditer(text, at):
        depth += -1 if m.group() == "end" else 1
        if depth == 0:
            return m.end()
    return len(text)


_NEXT = re.compile(r"^\s*(?:\w+\s+)*?(?:class|object|fun|def|interface|trait|enum|struct|fn|function|func|namespace)\b", re.M)


def _span(text: str, m: re.Match, lang: Language) -> tuple[int, int]:
    """Body of a declaration: between brackets if they open before a statement ends; else the rest of the line."""
    if lang.ends == "end":
        return m.start(), _ruby_close(text, m.start())
    for k in re.compile(r"[{;(=]").finditer(text, m.end("name")):
        if k.group() == "(":
            continue
        if _NEXT.search(text, m.end("name"), k.start()):  # it had no body, this is another's
            return m.end("name"), m.end("name")
        if k.group() == "{" and text.count("(", m.end("name"), k.start()) <= text.count(")", m.end("name"), k.start()):
            return k.start(), _close(text, k.start())
        if k.group() == "=" and text[k.start() : k.start() + 2] == "=>":
            continue
        if k.group() == "=" and text.count("(", m.end("name"), k.start()) > text.count(")", m.end("name"), k.start()):
            continue
        if k.group() == "=":
            rest = re.compile(r"=\s*(?:\([^()]*\)\s*=>\s*)?\{").match(text, k.start())
            if rest:
                return rest.end() - 1, _close(text, rest.end() - 1)
        if k.group() in ";=":
            end = text.find("\n", k.start())
            return m.end("name"), len(text) if end < 0 else end
    return m.end("name"), m.end("name")


def scan(path: str, text: str, lang: Language, by_path: bool = False) -> dict:
    rows = Rows(path, by_path)
    code = _blank(text, lang.blanks)
    with_strings = _blank(text, lang.blanks, strings=False)
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line = lambda at: bisect_right(starts, at)
    for pattern, relation in lang.imports:
        for m in re.finditer(pattern, with_strings, re.M):
            for name in re.split(r"[\s,;]+", m["name"]) if lang.whole and "," in m["name"] else [m["name"]]:
                name = name.split("{")[0].strip().rstrip(":;/.")
                name = name if lang.whole else re.split(lang.last, name)[-1]
                if name not in ("", "_", "*"):
                    rows.imported(name, relation, line(m.start("name")))
    spans: list[tuple[int, int, str]] = []
    if lang.types:
        for m in re.finditer(lang.types, code, re.M):
            a, b = _span(code, m, lang)
            spans.append((a, b, rows.type(m["name"], line(m.start("name")))))
    if lang.owners:
        for m in re.finditer(lang.owners, code, re.M):
            a, b = _span(code, m, lang)
            spans.append((a, b, rows.type(m["name"], line(m.start("name")), contained=False)))
    bodies: list[tuple[int, int, str]] = []
    found: list[tuple[re.Match, bool]] = []
    if lang.functions:
        found += [(m, True) for m in re.finditer(lang.functions, code, re.M)]
    if lang.free:
        found += [(m, False) for m in re.finditer(lang.free, code, re.M)]
    for m, member in sorted(found, key=lambda x: x[0].start("name")):
        if m["name"] in _KEYWORDS:
            continue
        inside = [s for s in spans if s[0] <= m.start("name") < s[1]]
        if lang.free and member != bool(inside):
            continue
        a, b = _span(code, m, lang)
        if any(x[0] < m.start("name") < x[1] for x in bodies):
            continue  # nested functions are no nodes
        owner = m.groupdict().get("owner")
        parent = rows.type(owner, line(m.start()), contained=False) if owner else max(inside)[2] if inside else None
        bodies.append((a, b, rows.function(m["name"], line(m.start("name")), parent)))
    sites = []
    for a, b, id_ in bodies:
        for m in _CALL.finditer(code, a, b):
            if m[1] not in _KEYWORDS:
                sites.append((id_, m[1], line(m.start(1))))
    rows.calls(sites)
    return rows.result()


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|override|virtual|async|open|data|inline|suspend|readonly|export|default|declare|implicit|lazy|case|operator|tailrec|unsafe|extern|synchronized|native|enum|inner|annotation|value|companion|external|const|pub(?:\([\w:]+\))?)\s+)*"
_TYPE = r"[\w$:<>\[\],.?*&~ \t]+?"
_ARROW = r"(?=[\w$]+\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+?)?=>)"
JS = Language(
    types=rf"^\s*{_MODS}class\s+(?P<name>[\w$]+)",
    functions=rf"^[ \t]*{_MODS}(?:get\s+|set\s+|\*\s*)?#?(?P<name>[\w$]+)\s*(?:<[^>(){{}}]*>)?\((?:[^(){{}}]|\([^()]*\)|\{{[^{{}}]*\}})*\)\s*(?::[^{{;=]+)?\{{",
    free=rf"^[ \t]*{_MODS}(?:function\s*\*?\s*|(?:const|let)\s+{_ARROW})(?P<name>[\w$]+)",
    imports=[(r"^\s*import\b[^'\";]*?['\"](?P<name>[^'\"]+)['\"]", "imports_from")],
    last=r"/",
)
GO = Language(
    types=r"^[ \t]*type\s+(?P<name>\w+)\s+\w",
    functions=r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(",
    imports=[(r"^\s*import\s+(?:[\w.]+\s+)?\"(?P<name>[^\"\n]+)\"", "imports_from")],
    last=r"/",
)
RUST = Language(
    types=rf"^\s*{_MODS}(?:struct|enum|trait)\s+(?P<name>\w+)",
    owners=r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>,' ]+?\s+for\s+)?(?P<name>\w+)",
    functions=rf"^\s*{_MODS}fn\s+(?P<name>\w+)",
    imports=[(r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+(?:::)?)", "imports_from")],
    last="::",
    blanks=re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S),
)
JAVA = Language(
    types=rf"^\s*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:class|interface)\s+(?P<name>\w+)",
    functions=rf"(?:^|(?<=[{{;}}]))[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*{_MODS}(?:<[^>]+>\s*)?(?:(?!return\b|new\b|else\b|throw\b){_TYPE}[ \t]+)?(?P<name>\w+)\s*\([^(){{}};]*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;]",
    imports=[(r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;", "imports")],
)
C = Language(
    functions=r"^[ \t]*(?!return\b|else\b|typedef\b)(?:[\w*]+[ \t*]+)+(?P<name>\w+)\s*\([^(){};]*\)\s*\{",
    imports=[(r"^\s*#\s*include\s*[<\"](?P<name>[^>\".\n]+)", "imports")],
    last=r"/",
)
CPP = Language(
    types=r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)(?=[^;{]*\{)",
    functions=r"^[ \t]*(?!return\b|else\b|typedef\b|class\b|struct\b)(?:(?:[\w:<>,&*~]+)[ \t&*]+)*(?P<name>~?\w+)\s*\([^(){};]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?\{",
    imports=C.imports,
    last=r"/",
)
RUBY = Language(
    types=r"^[ \t]*class\s+(?:\w+::)*(?P<name>[A-Z]\w*)",
    functions=r"^[ \t]*(?:private\s+|protected\s+)?def\s+(?:self\.|\w+\.)?(?P<name>\w+[?!=]?)",
    blanks=re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|^=begin.*?^=end", re.S | re.M),
    ends="end",
)
CSHARP = Language(
    types=rf"^\s*(?:\[[^\]]*\]\s*)*{_MODS}(?:class|interface|namespace)\s+(?P<name>[\w.]+)",
    functions=rf"(?:^|(?<=[{{;}}]))[ \t]*(?:\[[^\]]*\]\s*)*{_MODS}(?!return\b|new\b|else\b|throw\b|await\b|using\b){_TYPE}[ \t]+(?P<name>\w+)\s*(?:<[^>]+>)?\([^(){{}};]*\)\s*(?:where[^{{]+)?(?:[{{;]|=>)",
    imports=[(r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<name>[\w.]+)\s*;", "imports")],
)
KOTLIN = Language(
    types=rf"^\s*{_MODS}(?:class|object)\s+(?P<name>\w+)",
    functions=rf"^\s*{_MODS}fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\(",
    imports=[(r"^\s*import\s+(?P<name>[\w.]+)", "imports")],
    whole=True,
)
SCALA = Language(
    types=rf"^\s*{_MODS}(?:class|object)\s+(?P<name>\w+)",
    functions=rf"^\s*{_MODS}def\s+(?P<name>\w+)",
    imports=[(r"^\s*import\s+(?P<name>[\w.]+)", "imports")],
)
PHP = Language(
    types=rf"^\s*{_MODS}class\s+(?P<name>\w+)",
    functions=rf"^\s*{_MODS}function\s+&?(?P<name>\w+)\s*\(",
    imports=[(r"^\s*use\s+(?:function\s+|const\s+)?\\?(?P<name>[\w\\]+)", "imports")],
    last=r"\\",
    blanks=re.compile(r"#(?!\[)[^\n]*|//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S),
)


def _go(path: str, text: str, by_path: bool = False) -> dict:
    """Go, with the lines of an import block each turned into an import of its own."""

    def unfold(m: re.Match) -> str:
        return re.sub(r"^([ \t]*)(?=[\w.\"])", r"\1import ", m[1], flags=re.M) if "\n" in m[1] else "import " + m[1]

    return scan(path, re.sub(r"^import\s*\(([^)]*)\)", unfold, text, flags=re.M), GO, by_path)


def _of(lang: Language):
    return lambda path, text, by_path=False: scan(path, text, lang, by_path)


SCANNERS = {
    **dict.fromkeys(("js", "ts", "tsx"), _of(JS)), "go": _go, "rs": _of(RUST), "java": _of(JAVA), **dict.fromkeys(("c", "h"), _of(C)), **dict.fromkeys(("cpp", "cc", "cxx", "hpp"), _of(CPP)),
    "rb": _of(RUBY), "cs": _of(CSHARP), **dict.fromkeys(("kt", "kts"), _of(KOTLIN)), "scala": _of(SCALA), "php": _of(PHP),
}
