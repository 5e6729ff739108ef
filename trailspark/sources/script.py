"""Facts of JavaScript and TypeScript (SC9, SC14, SC15) by one pass over tokens: no parser is at hand, so what braces and names do not show is left out.

Comments, strings and regular expressions are blanked first, line breaks kept; text inside ${} of a template is code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .code import _rows_of

_WORD_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof")
_NO_CALL = frozenset("if for while switch catch with return function super import typeof await yield new async constructor".split())
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|=>|\?\.|\.\.\.|[^\s\w]|\d[\w.]*")


def blanked(text: str, literals: bool = True) -> str:
    """SC15: the text without comments (and without literals), of the same length and lines."""
    out, i, n, depth = list(text), 0, len(text), []

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] not in "\r\n":
                out[k] = " "

    last = ""  # what a slash follows says whether it divides
    while i < n:
        c, two = text[i], text[i : i + 2]
        if two in ("//", "/*"):
            end = text.find("\n" if two == "//" else "*/", i + 2)
            end = n if end < 0 else end + (2 if two == "/*" else 0)
            blank(i, end)
            i = end
            continue
        if c in "'\"":
            j = i + 1
            while j < n and text[j] not in (c, "\n"):
                j += 2 if text[j] == "\\" else 1
            if literals:
                blank(i + 1, j)
            i, last = j + 1, c
            continue
        if c == "`" or (c == "}" and depth and depth[-1] == 0):
            if c == "}":
                depth.pop()
            j = i + 1
            while j < n and text[j] != "`" and text[j : j + 2] != "${":
                j += 2 if text[j] == "\\" else 1
            if literals:
                blank(i + 1, j)
            if text[j : j + 2] == "${":
                depth.append(0)
                i, last = j + 2, "{"
            else:
                i, last = j + 1, "`"
            continue
        if c == "/" and (last in ("", *"(,=:[!&|?{};+-*%<>~^") or last in _WORD_BEFORE_REGEX):
            found = _REGEX.match(text, i)
            if found:
                if literals:
                    blank(i + 1, found.end() - 1)
                i, last = found.end(), "/x"
                continue
        if depth and c in "{}":
            depth[-1] += 1 if c == "{" else -1
        word = _NAME.match(text, i)
        if word:
            i, last = word.end(), word[0]
            continue
        if not c.isspace():
            last = c
        i += 1
    return "".join(out)


def _facts(path: str, text: str):
    """(kind, name, start, end, receiver) as for Python; unbalanced braces make the file unparsed."""
    bare = blanked(text)
    found = list(_TOKEN.finditer(bare))
    words, line, lines, at = [m[0] for m in found], 1, [], 0
    for m in found:
        line += bare.count("\n", at, m.start())
        at = m.start()
        lines.append(line)
    pair, open_, whole = {}, [], True
    for i, w in enumerate(words):
        if w in "([{" and len(w) == 1:
            open_.append(i)
        elif w in ")]}" and len(w) == 1:
            if not open_ or "([{".index(words[open_[-1]]) != ")]}".index(w):
                whole = False
                break
            pair[open_.pop()] = i
    if not whole or open_:
        yield "unparsed", "", 1, text.count("\n") + 1, None
        return
    word = lambda i: words[i] if 0 <= i < len(words) else ""
    is_name = lambda i: bool(re.match(r"[A-Za-z_$]", word(i)))

    def body_of(i: int) -> int | None:
        """The brace that opens the body after the parameters' closing one: a return type may stand between."""
        angle = 0
        while i < len(words) and word(i) not in (";", "}", ")", ",", "=", "=>"):
            if word(i) == "{" and angle == 0 and word(i - 1) not in (":", "|", "&"):
                return i
            angle += {"<": 1, ">": -1}.get(word(i), 0)
            i = pair[i] + 1 if word(i) in ("(", "[", "{") else i + 1
        return None

    def end_of_value(i: int) -> int:
        """The last token of an expression that starts at i."""
        while i < len(words) and word(i) not in (";", "}", ")", "]", ","):
            if word(i) in ("(", "[", "{"):
                i = pair[i]
                if word(i) == "}" and word(i + 1) not in (".", "(", "?.", "[", "=>"):
                    return i
            if i + 1 < len(words) and lines[i + 1] > lines[i] and (is_name(i) or word(i) in ("'", '"', "`", ")", "]")) and word(i + 1) not in (".", "?.", "?", ":", "=>", "+", "|", "&"):
                return i
            i += 1
        return i - 1

    classes, taken = [], set()
    for i, w in enumerate(words):
        if w == "class" and is_name(i + 1) and word(i - 1) not in (".", "?."):
            b = i + 2
            while b < len(words) and word(b) not in ("{", "}", ";"):
                b = pair[b] + 1 if word(b) in ("(", "[") else b + 1
            if word(b) == "{":
                classes.append((b, pair[b]))
                yield "class", word(i + 1), lines[i], lines[pair[b]], None
        elif w == "function" and word(i - 1) not in (".", "?."):
            j = i + 2 if word(i + 1) == "*" else i + 1
            if is_name(j):
                taken.add(j)
                p = next((k for k in range(j + 1, len(words)) if word(k) in ("(", "{", "}", ";")), None)
                p = p if p is not None and word(p) == "(" else None
                b = None if p is None else body_of(pair[p] + 1)
                if b is not None:
                    yield "function", word(j), lines[i], lines[pair[b]], None
        elif w in ("const", "let", "var") and is_name(i + 1):
            eq = i + 2
            while eq < len(words) and word(eq) not in ("=", ";", ",", "}", "of", "in"):
                eq = pair[eq] + 1 if word(eq) in ("(", "[", "{") else eq + 1
            v = eq + 1 + (word(eq + 1) == "async")
            if word(eq) != "=":
                continue
            arrow = pair[v] + 1 if word(v) == "(" else v + 1
            if word(arrow) == ":":
                while arrow < len(words) and word(arrow) not in ("=>", ";"):
                    arrow = pair[arrow] + 1 if word(arrow) in ("(", "[", "{") else arrow + 1
            if word(arrow) == "=>" or word(v) == "function":
                last = end_of_value(arrow + 1 if word(arrow) == "=>" else v)
                yield "function", word(i + 1), lines[i], lines[max(last, i)], None
    opens = {o: [] for o, _ in classes}
    for o, c in classes:  # members: names before a parameter list with a body, one level below the class
        k = o + 1
        while k < c:
            if word(k) == "(" and is_name(k - 1):
                b = body_of(pair[k] + 1)
                if b is not None and b < c:
                    opens[o].append(k - 1)
                    taken.add(k - 1)
                    first = k - 1
                    while word(first - 1) in ("static", "async", "get", "set", "public", "private", "protected", "override", "*"):
                        first -= 1
                    yield "function", word(k - 1), lines[first], lines[pair[b]], None
                    k = pair[b] + 1
                    continue
            k = pair[k] + 1 if word(k) in ("(", "[", "{") else k + 1
    for i in range(len(words)):
        if is_name(i) and word(i + 1) == "(" and i not in taken and word(i) not in _NO_CALL and word(i - 1) != "function":
            receiver = None
            if word(i - 1) in (".", "?."):
                j, parts = i - 1, []
                while word(j) in (".", "?.") and is_name(j - 1):
                    parts.append(word(j - 1))
                    j -= 2
                receiver = ".".join(reversed(parts)) if parts and word(j) not in (".", "?.") else "<expression>"
            yield "call", word(i), lines[i], lines[pair[i + 1]], receiver


def script_facts(files: DataFrame) -> DataFrame:
    """SC9 for scripts (path, text): (path, kind, name, start, end, receiver), like Python's facts without imports."""
    return _rows_of(files, _facts, {"kind": "string", "name": "string", "start": "int", "end": "int", "receiver": "string"})


_CLAUSE = re.compile(r"""\b(import|export)\b\s*(?:type\s+(?=[\w{*]))?([\w$*\s{},]*?)\bfrom\s*(['"])([^'"\n]+)\3""")
_REQUIRE = re.compile(r"""\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*(['"])([^'"\n]+)\2\s*\)""")


def _names(clause: str):
    """(exported, local) of what stands in braces."""
    for part in clause.split(","):
        sides = [s for s in re.split(r"\s+as\s+|:", re.sub(r"^\s*type\s+", "", part.strip())) if s]
        if sides:
            yield sides[0].strip(), sides[-1].strip()


def _imports(path: str, text: str):
    """(kind, spec, exported, local): kind is name, module or reexport; a null exported name is the default, or all of a module."""
    bare = blanked(text, literals=False)
    for verb, clause, _, spec in _CLAUSE.findall(bare):
        braces = re.search(r"\{([^}]*)\}", clause)
        named = list(_names(braces[1])) if braces else []
        rest = re.sub(r"\{[^}]*\}", "", clause)
        if verb == "export":
            if braces:
                yield from (("reexport", spec, e, local) for e, local in named)
            else:
                yield "reexport", spec, None, (re.findall(r"\*\s*as\s+([\w$]+)", rest) or [None])[0]
            continue
        yield from (("name", spec, None if e == "default" else e, local) for e, local in named)
        for star in re.findall(r"\*\s*as\s+([\w$]+)", rest):
            yield "module", spec, None, star
        for default in re.findall(r"^\s*([\w$]+)\s*(?:,|$)", rest):
            yield "name", spec, None, default
    for held, _, spec in _REQUIRE.findall(bare):
        if held.startswith("{"):
            yield from (("name", spec, e, local) for e, local in _names(held[1:-1]))
        else:
            yield "module", spec, None, held


def script_names(files: DataFrame) -> DataFrame:
    """SC14: (path, kind, spec, exported, local): names and modules that a script imports, and what it passes on."""
    return _rows_of(files, _imports, {"kind": "string", "spec": "string", "exported": "string", "local": "string"})


SUFFIXES = (".ts", ".tsx", ".d.ts", ".js", ".mjs", ".cjs", ".jsx")  # fixed values, in the order in which they are tried


def import_candidates(spec: Column, path: Column) -> Column:
    """JN11 for scripts: the files that a relative specifier may be, by priority; none for packages or above the root.

    A name with a script's suffix may be that of the source that it is built from.
    """
    empty = F.array().cast("array<string>")
    steps = F.concat(paths.folders_of(path), F.split(spec, "/"))
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    walked = F.aggregate(steps, empty, lambda done, s: F.when(s.isin(".", ""), done).when(s == "..", up(done)).otherwise(F.concat(done, F.array(s))))
    full = F.array_join(walked, "/")
    source = F.regexp_replace(full, r"\.[mc]?jsx?$", "")
    built = F.when(source != full, F.array(*[F.concat(source, F.lit(s)) for s in (".ts", ".tsx", ".d.ts")])).otherwise(empty)
    tried = F.concat(F.array(full), built, *[F.array(F.concat(full, F.lit(s))) for s in SUFFIXES], *[F.array(F.concat(full, F.lit("/index" + s))) for s in SUFFIXES])
    return F.when(spec.rlike(r"^\.\.?(/|$)") & walked.isNotNull(), tried).otherwise(empty)
