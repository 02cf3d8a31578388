"""Which engine can find a pattern in time that follows the line, and the pattern in that engine's words.

Three engines are at hand. Spark's own matcher backtracks: it is used for patterns
that it finds in one pass over a line, after they are rewritten so that it does. An
automaton (RE2, through Arrow) takes all other patterns that a regular language
can express. What needs more than that, look-around and back-references, is left
to engines that backtrack, and to none that can end a session.

In all of them an invalid byte is no character: nothing in a pattern stands for it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: A pattern without unbounded repeats may be tried in so many ways at one place for Spark's matcher to have it.
MOST_WAYS = 256
#: What the ``regex`` module may take for one line.
LINE_SECONDS = 10.0

# Characters of Unicode's word and white-space classes, by categories and the ranges beyond them.
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}\x{200C}\x{200D}"
SPACE = r"\t-\r\x{85}\p{Z}"
_RE2_CLASSES = {"w": f"[{WORD}]", "W": f"[^{WORD}]", "d": r"\p{Nd}", "D": r"\P{Nd}", "s": f"[{SPACE}]", "S": f"[^{SPACE}]"}
_IN_RE2_CLASS = {"w": WORD, "d": r"\p{Nd}", "D": r"\P{Nd}", "s": SPACE}


@dataclass(frozen=True)
class Token:
    """kind: char, any, class, edge (an anchor), word (a word boundary), open, close, alt, back (a back-reference) or odd."""

    kind: str
    text: str
    least: int = 1
    most: float = 1
    possessive: bool = False
    lazy: bool = False

    @property
    def repeat(self) -> str:
        if (self.least, self.most) == (1, 1):
            return ""
        short = {(0, float("inf")): "*", (1, float("inf")): "+", (0, 1): "?"}
        most = "" if self.most == float("inf") else int(self.most)
        return short.get((self.least, self.most), f"{{{self.least},{most}}}") + "+" * self.possessive + "?" * self.lazy


_ESCAPE = re.compile(
    r"\\(?:(?P<unicode>u[0-9A-Fa-f]{4})|(?P<hex>x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}))|(?P<prop>[pP](?:\{[^{}]*\}|[A-Za-z]))|(?P<set>[wWdDsS])"
    r"|(?P<word>[bB])|(?P<edge>[AzZ])|(?P<back>[1-9][0-9]*|k<[A-Za-z]\w*>)|(?P<control>[tnrfae])|(?P<quote>Q(?:.*?\\E|.*))|(?P<mark>[^A-Za-z0-9])|(?P<odd>.))", re.S
)
_QUANTIFIER = re.compile(r"(?:[*+?]|\{(\d+)(,?)(\d*)\})([?+]?)")
_OPEN = re.compile(r"\((?:\?(?:P?<(?P<name>[A-Za-z]\w*)>|(?P<plain>:)|(?P<look><?[=!])|(?P<atomic>>)|(?P<flags>[A-Za-z-]*[:)])))?")


def _bad(why: str, pattern: str) -> ValueError:
    return ValueError(f"Invalid regex pattern: {why} in {pattern!r}")


def _class_end(pattern: str, at: int) -> int:
    """Where the class that begins at ``at`` ends."""
    i = at + 1 + (pattern[at + 1 : at + 2] == "^")
    first, depth = i, 1
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[" and pattern[i + 1 : i + 2] == ":" and (end := pattern.find(":]", i)) > 0:
            i = end + 1
        elif c == "[":
            depth += 1
        elif c == "]" and i > first:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise _bad("a class without an end", pattern)


def tokens(pattern: str) -> list[Token]:
    """The pattern in pieces; a quantifier belongs to the piece before it, that of a group to the group's end."""
    out: list[Token] = []
    at = depth = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            found = _ESCAPE.match(pattern, at)
            if not found:
                raise _bad("a backslash at the end", pattern)
            kind, text = found.lastgroup, found[0]
            if kind == "quote":
                body = text[2:].removesuffix("\\E")
                out += [Token("char", re.sub(r"([!-/:-@\[-\^`{-~])", r"\\\1", x)) for x in body]
            else:
                kind = {"unicode": "char", "hex": "char", "control": "char", "mark": "char", "prop": "class", "set": "class"}.get(kind, kind)
                out.append(Token(kind, text))
            at = found.end()
        elif c == "[":
            end = _class_end(pattern, at)
            out.append(Token("class", pattern[at:end]))
            at = end
        elif c == "(":
            found = _OPEN.match(pattern, at)
            text = found[0]
            if pattern[at + 1 : at + 2] == "?" and text == "(":
                raise _bad("an unknown group", pattern)
            odd = found["look"] or found["atomic"] or found["flags"]
            if odd and text.endswith(")"):
                out.append(Token("odd", text))
            else:
                depth += 1
                out.append(Token("open", text))
            at += len(text)
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise _bad("a parenthesis too many", pattern)
            out.append(Token("close", c))
            at += 1
        elif c in "^$":
            out.append(Token("edge", c))
            at += 1
        elif c in "*+?" or (c == "{" and _QUANTIFIER.match(pattern, at)):
            raise _bad("nothing to repeat", pattern)
        else:
            out.append(Token({"|": "alt", ".": "any"}.get(c, "char"), c))
            at += 1
        if out and out[-1].kind not in ("open", "alt") and (found := _QUANTIFIER.match(pattern, at)):
            low, comma, high, mode = found.groups()
            sign = found[0][0]
            least, most = (int(low), float(high) if high else float("inf") if comma else int(low)) if sign == "{" else ({"*": 0, "+": 1, "?": 0}[sign], 1 if sign == "?" else float("inf"))
            if least > most:
                raise _bad("a repeat from more to fewer", pattern)
            out[-1] = Token(out[-1].kind, out[-1].text, least, most, mode == "+", mode == "?")
            at = found.end()
    if depth:
        raise _bad("a parenthesis without an end", pattern)
    return out


def alternatives(parts: list[Token]) -> list[list[Token]]:
    """The pattern's outermost alternatives."""
    out, depth = [[]], 0
    for t in parts:
        depth += (t.kind == "open") - (t.kind == "close")
        if t.kind == "alt" and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def ways(parts: list[Token]) -> float:
    """In how many ways the parts may be tried at one place, at most; infinite with an unbounded repeat or a repeated group."""
    total, now, stack = 0.0, 1.0, []  # of the alternatives before, and of this one
    for t in parts:
        if t.kind in ("odd", "back") or t.possessive or (t.kind == "open" and not re.fullmatch(r"\((\?:|\?P?<\w+>)?", t.text)):
            return float("inf")
        if t.kind == "open":
            stack.append((total, now))
            total, now = 0.0, 1.0
        elif t.kind == "alt":
            total, now = total + now, 1.0
        elif t.kind == "close":
            if t.most != 1:
                return float("inf")
            inside, (total, now) = total + now, stack.pop()
            now *= inside + (t.least == 0)
        else:
            now *= t.most - t.least + 1
    return total + now


def width(parts: list[Token]) -> int | None:
    """How many characters every match of the parts has; None if that differs."""
    total, stack = 0, []
    for t in parts:
        if t.least != t.most or t.kind in ("odd", "back"):
            return None
        if t.kind == "open":
            stack.append((total, None))
            total = 0
        elif t.kind in ("alt", "close"):
            before, known = stack[-1] if stack else (0, None)
            if known not in (None, total):
                return None
            if t.kind == "alt":
                stack[-1] = (before, total)
                total = 0
            else:
                stack.pop()
                total = before + total * t.least
        elif t.kind in ("char", "any", "class"):
            total += t.least
    return total


def trimmed(parts: list[Token]) -> list[Token]:
    """The parts without what may be absent at either end: whether a match exists does not depend on it."""
    parts = list(parts)
    single = ("char", "any", "class")
    for end in (0, -1):
        while parts and parts[end].kind in single and parts[end].least != parts[end].most and not parts[end].possessive:
            t = parts.pop(end)
            if t.least:
                parts.insert(0 if end == 0 else len(parts), Token(t.kind, t.text, t.least, t.least))
    return parts


def _by_lines(parts: list[Token]) -> bool:
    """Does a flag let the line's ends match inside the value?"""
    return any(re.match(r"\(\?[a-zA-Z]*m", t.text) for t in parts if t.kind in ("odd", "open"))


_REPLACEMENT = "\\uFFFD"
#: Classes of ASCII characters, and those that surely do not hold U+FFFD.
_NARROW = re.compile(r"\\[wds]|\[(?!\^)(?:[ !\"%',-Z_`a-z{-~]|\\[wds.+*/-])+\]")


def java_text(parts: list[Token], strict: bool = False) -> str:
    """The parts for Spark's matcher. ``strict``: nothing stands for U+FFFD, which is what it sees of an invalid byte."""
    out = []
    for t in parts:
        text = t.text
        if text in ("{", "}", "]"):
            text = f"\\{text}"
        elif strict and t.kind == "any":
            text = rf"[^\n{_REPLACEMENT}]"
        elif strict and t.kind == "class" and not _NARROW.fullmatch(text):
            text = f"[{text}&&[^{_REPLACEMENT}]]"
        out.append(text + t.repeat)
    return "".join(out)


def within_lines(parts: list[Token]) -> bool:
    """Can no match of the parts hold a newline?"""
    for t in parts:
        if t.kind == "char" and t.text in ("\n", r"\n") or t.kind == "char" and re.match(r"\\[xu]", t.text) and int(t.text[2:].strip("{}"), 16) == 10:
            return False
        if t.kind == "class" and t.text not in (r"\w", r"\d") and not re.fullmatch(r"\[(?!\^)([^\\\n&\[]|\\[wd.+*/-])+\]", t.text):
            return False
    return True


def one_pass(parts: list[Token]) -> list[tuple[str, list[Token]]] | None:
    """An alternative as steps of one pass over a line: (how, parts), or None if there is no such form.

    Without unbounded repeats there is one step, tried at every place. Pieces with
    anything between them are found one behind the other: if all matches of a piece
    are equally long, its first one leaves the most to those behind it. A pattern
    that begins at the line's start may hold one unbounded repeat.
    """
    parts = trimmed(parts)
    if ways(parts) <= MOST_WAYS:
        return [("find", parts)]
    pieces: list[list[Token]] = [[]]
    depth = 0
    for t in parts:
        depth += (t.kind == "open") - (t.kind == "close")
        if t.kind == "any" and t.most == float("inf") and not t.possessive and not depth:
            pieces[-1] += [Token("any", ".")] * t.least
            pieces.append([])
        else:
            pieces[-1].append(t)
    begins = bool(parts) and parts[0].kind == "edge" and parts[0].text in ("^", r"\A")
    inner = [p for p in pieces[:-1] if any(t.kind == "edge" for t in p[1 if p is pieces[0] and begins else 0 :])]
    sound = all(width(p) is not None and ways(p) <= MOST_WAYS and within_lines(p) for p in pieces[:-1]) and ways(pieces[-1]) <= MOST_WAYS
    if len(pieces) > 1 and sound and not inner and len(pieces[0]) > begins:
        return [("start" if begins else "first", pieces[0]), *(("next", p) for p in pieces[1:-1] if p), ("last", pieces[-1])]
    endless = [t for t in parts if t.most == float("inf")]
    rest = ways([t for t in parts if t.most != float("inf")])
    if begins and len(endless) == 1 and endless[0].kind in ("char", "any", "class") and rest <= MOST_WAYS and not endless[0].possessive:
        return [("find", parts)]
    return None


def java_form(steps: list[tuple[str, list[Token]]], strict: bool = False) -> str:
    """The steps as a pattern for Spark's matcher. A line of the value is taken at a time, since ``.`` is no newline."""
    marks = {"find": "{}", "start": "{}", "first": "(?m:^)(?>.*?{})", "next": "(?>.*?{})", "last": ".*{}"}
    between = ".*" if not strict else rf"[^\n{_REPLACEMENT}]*"
    return "".join(marks[how].replace(".*", between).replace("{}", java_text(p, strict)) for how, p in steps)


def re2_text(parts: list[Token], without_words: bool = False) -> str | None:
    """The parts for the automaton; None if it cannot express them."""
    out, by_lines = [], _by_lines(parts)
    for t in parts:
        text = t.text
        if t.possessive or t.kind == "back" or (t.kind == "open" and re.match(r"\(\?(<?[=!]|>)", text)):
            return None
        if t.kind == "odd" and not re.fullmatch(r"\(\?[imsU-]+\)", text):
            return None
        if t.kind == "char" and text.startswith(r"\u"):
            text = rf"\x{{{text[2:]}}}"
        elif text == r"\e":
            text = r"\x1B"
        elif t.kind == "char" and len(text) == 2 and text[0] == "\\" and (text[1] == "_" or text[1] > "\x7f"):
            text = text[1]
        elif t.kind == "edge":
            text = {"$": "$" if by_lines else r"(?:\n?\z)", r"\Z": r"(?:\n?\z)"}.get(text, text)
        elif t.kind == "word" and without_words:
            text = "(?:)"
        elif t.kind == "class" and text[0] == "\\":
            text = _RE2_CLASSES.get(text[1:], text)
        elif t.kind == "class" and (text := _re2_class(text)) is None:
            return None
        out.append(text + t.repeat)
    return "".join(out)


def _re2_class(text: str) -> str | None:
    if "&&" in text or re.search(r"(?<!\\)\[", re.sub(r"\[:\^?\w+:\]", "", text[1:])):
        return None
    out, at = [], 0
    while at < len(text):
        found = _ESCAPE.match(text, at) if text[at] == "\\" else None
        piece = found[0] if found else text[at]
        if found and found["set"]:
            if (piece := _IN_RE2_CLASS.get(piece[1:])) is None:
                return None
        elif found and found["unicode"]:
            piece = rf"\x{{{piece[2:]}}}"
        elif found and (found["quote"] or found["odd"] or found["back"] or found["edge"] or found["word"]):
            return None
        out.append(piece)
        at += len(found[0]) if found else 1
    return "".join(out)


#: How the ``regex`` module sees invalid bytes.
_ESCAPED_BYTE = "\udc80-\udcff"


def regex_text(parts: list[Token]) -> str:
    """The parts for the ``regex`` module, over text in which invalid bytes are lone surrogates."""
    out = []
    for t in parts:
        text = t.text
        if t.kind == "any":
            text = rf"[^\n{_ESCAPED_BYTE}]"
        elif t.kind == "class":
            text = f"(?:(?![{_ESCAPED_BYTE}]){text})"
        elif t.kind == "edge":
            text = {r"\z": r"\Z", r"\Z": r"(?:\n?\Z)"}.get(text, text)
        elif t.kind == "back" and text[1] == "k":
            text = f"(?P={text[3:-1]})"
        out.append(text + t.repeat)
    return "".join(out)


@dataclass(frozen=True)
class Plan:
    """engine ``jvm``: one of ``java`` is found (``strict``: the same for values with invalid bytes); ``re2``: ``re2``
    is found (``loose``: the same without word boundaries, and ``regex`` to tell where these matter); ``regex``."""

    engine: str
    java: tuple[str, ...] = ()
    strict: tuple[str, ...] = ()
    re2: str = ""
    loose: str = ""
    regex: str = ""


def _java_forms(own: list, flags: str, strict: bool) -> tuple[str, ...]:
    """A pattern for all alternatives that are tried at every place, where these are not too many, and one for each of the others."""
    plain = [a for a in own if a[0][0] == "find"]
    if sum(ways(a[0][1]) for a in plain) > MOST_WAYS or any(ways(a[0][1]) == float("inf") for a in plain):
        groups = [[a] for a in plain]
    else:
        groups = [plain] if plain else []
    groups += [[a] for a in own if a[0][0] != "find"]
    return tuple(flags + "|".join(java_form(a, strict) for a in g) for g in groups)


def _accepted(pattern: str) -> bool:
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


@lru_cache(maxsize=256)
def plan(pattern: str, ignore_case: bool = False) -> Plan:
    """How to find the pattern; ValueError if it is none."""
    fold = ignore_case
    if pattern.startswith("(?i)"):
        pattern, fold = pattern[4:], True
    parts = tokens(pattern)
    flags = "(?diuU)" if fold else "(?dU)"
    named = "\ufffd" in pattern or re.search(r"\\u[fF]{3}[dD]|\\x\{0*[fF]{3}[dD]\}", pattern)
    own = [one_pass(a) for a in alternatives(parts)]
    if all(own) and not named:
        return Plan("jvm", *(_java_forms(own, flags, strict) for strict in (False, True)))
    re2 = re2_text(parts)
    if re2 is not None:
        re2 = ("(?i)" if fold else "") + re2
        if _accepted(re2):
            if not any(t.kind == "word" for t in parts):
                return Plan("re2", re2=re2)
            return Plan("re2", re2=re2, loose=("(?i)" if fold else "") + re2_text(parts, True), regex=_checked_regex(parts, fold, pattern))
    repeated = any(t.kind == "close" and t.most > 1 for t in parts)
    if not repeated and not named:  # such a pattern may take its time, but no more of the stack than it is long
        return Plan("jvm", (flags + java_text(parts),), (flags + java_text(parts, True),))
    return Plan("regex", regex=_checked_regex(parts, fold, pattern))


def _checked_regex(parts: list[Token], fold: bool, pattern: str) -> str:
    import regex

    text = ("(?i)" if fold else "") + regex_text(parts)
    try:
        regex.compile(text)
    except regex.error as error:
        raise _bad(str(error), pattern) from None
    return text
