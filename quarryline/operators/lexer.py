"""A pushdown scanner for languages with braces.

It blanks what is no code (strings, comments, regular expressions, the text and
tags of markup) with spaces of the same length, finds the comments, and pairs
brackets.  Modes stand on a stack: code, a template's text, code inside a
template, a tag, the children of a tag, code inside these.  A template within
the code of a template within a tag is so many entries of the stack, at any
depth.

Whether a slash divides or opens a regular expression, and whether a less-than
sign compares or opens a tag, goes by what stands before it: where a value has
just ended, they are operators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PAIRS = {")": "(", "]": "[", "}": "{"}
# Words after which a value is still to come.
_BEFORE_VALUES = frozenset("return typeof case in of delete void throw new else do await yield instanceof default extends".split())
# Words whose parentheses hold a condition, so that no value ends with them.
_CONDITIONS = frozenset("if while for with".split())
_BEFORE_BLOCKS = frozenset("else do try finally".split())

_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$"
_NOT_LINE = re.compile(r"[^\n]")
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_TAG_OPENS = re.compile(r"<(?:(?=>)|(?P<name>[A-Za-z_$][\w$.:-]*)(?:\s*<[^<>]*>)?(?=[\s/>{]))")
_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|=|extends\b)|<\s*[\w$]+\s*>\s*\(")
_TAG = re.compile(r"\"[^\"]*\"|'[^']*'|//[^\n]*|/\*.*?\*/|\{|/>|>", re.S)
_CHILDREN = re.compile(r"\{|</[^>]*>|<")
_COMMENT = r"//[^\n]*|/\*"
_TOKENS = {
    "script": re.compile(_COMMENT + r"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[`/<(){}\[\]]", re.S),
    "go": re.compile(_COMMENT + r"|\"(?:\\.|[^\"\\\n])*\"?|`[^`]*`?|'(?:\\.|[^'\\\n])+'|[(){}\[\]]", re.S),
    "rust": re.compile(_COMMENT + r"|\br(?P<fence>#*)\".*?\"(?P=fence)|\bbr(?P<bytes>#*)\".*?\"(?P=bytes)|\"(?:\\.|[^\"\\])*\"?|'(?:\\(?:u\{[^}\n]*\}|x[0-9A-Fa-f]{2}|[^\n])|[^'\\\n])'|[(){}\[\]]", re.S),
}
_NESTED = re.compile(r"/\*|\*/")
_PLAIN_END = re.compile(r"\*/")

CODE, TEMPLATE, TAG, CHILDREN = range(4)


@dataclass
class Scanned:
    """``code`` is as long as the source; ``close`` maps an opening bracket to
    its closing one, and the first character of a template, a tag or another
    literal of several lines to its last."""

    code: str = ""
    comments: list[tuple[int, int]] = field(default_factory=list)
    close: dict[int, int] = field(default_factory=dict)
    errors: bool = False


@dataclass(slots=True)
class _Open:
    """An open bracket: what it is, and for code in a template or tag the
    mode that ends with it."""

    bracket: str
    at: int
    condition: bool = False
    block: bool = False
    inner: bool = False


def _blank(text: str) -> str:
    return _NOT_LINE.sub(" ", text)


class _Scanner:
    def __init__(self, source: str, lang: str):
        self.source, self.lang = source, lang
        self.tokens = _TOKENS.get(lang, _TOKENS["script"])
        self.script, self.markup = lang not in _TOKENS, lang in ("tsx", "javascript")
        self.out = Scanned()
        self.parts: list[str] = []
        self.modes, self.began = [CODE], [0]
        self.brackets: list[_Open] = []
        self.value = False  # a value has just ended
        self.last = ""  # the last word or sign of code

    def run(self) -> Scanned:
        at, n = 0, len(self.source)
        steps = (self._code, self._template, self._tag, self._children)
        while at < n:
            at = steps[self.modes[-1]](at)
        out = self.out
        out.code = "".join(self.parts)
        out.errors |= len(self.modes) > 1 or bool(self.brackets)
        for b in self.brackets:
            out.close[b.at] = n - 1
        return out

    def _hide(self, a: int, b: int) -> int:
        self.parts.append(_blank(self.source[a:b]))
        return b

    def _quoted(self, a: int, b: int) -> int:
        """A literal: its first and last characters stay as quotes."""
        text = self.source[a:b]
        end = text[-1] if len(text) > 1 and text[-1] in "\"'`#" else " "
        self.parts.append(text[0] + _blank(text[1:-1]) + end if len(text) > 1 else text)
        if "\n" in text:
            self.out.close[a] = b - 1
        self.value, self.last = True, '"'
        return b

    def _enter(self, mode: int, at: int) -> None:
        self.modes.append(mode)
        self.began.append(at)

    def _leave(self) -> int:
        self.modes.pop()
        return self.began.pop()

    def _show(self, a: int, b: int) -> None:
        text = self.source[a:b]
        self.parts.append(text)
        text = text.rstrip()
        if not text:
            return
        start = len(text.rstrip(_WORD))
        while start and (text[start - 1].isalnum() or text[start - 1] in "_$"):
            start -= 1
        if start < len(text):
            self.last = text[start:]
            self.value = self.last not in _BEFORE_VALUES or text[start - 1 : start] == "."
        else:
            self.last = text[-2:] if text[-2:] in ("=>", "++", "--") else text[-1]
            self.value = self.last in ("++", "--")

    # Modes

    def _code(self, at: int) -> int:
        source = self.source
        m = self.tokens.search(source, at)
        if m is None:
            self._show(at, len(source))
            return len(source)
        (a, b), text = m.span(), m[0]
        if a > at:
            self._show(at, a)
        if text in "([{":
            return self._opens(text, a)
        if text in ")]}":
            return self._closes(text, a)
        if text.startswith("//"):
            self.out.comments.append((a, b))
            return self._hide(a, b)
        if text == "/*":
            b = self._comment_end(b)
            self.out.comments.append((a, b))
            return self._hide(a, b)
        if text == "`" and self.script:
            self.parts.append(text)
            self._enter(TEMPLATE, a)
            return b
        if text == "/":
            found = None if self.value else _REGEX.match(source, a)
            if found:
                self.parts.append('"' + " " * (found.end() - a - 2) + '"')
                self.value, self.last = True, '"'
                return found.end()
        if text == "<":
            found = self._tag_at(a)
            if found:
                self.parts.append('"')
                self._enter(TAG, a)
                return self._hide(a + 1, found.end())
        if text in "/<":
            self.parts.append(text)
            self.value, self.last = False, text
            return b
        return self._quoted(a, b)

    def _comment_end(self, at: int) -> int:
        """Past a comment's end; in Rust comments nest."""
        depth = 1
        for m in (_NESTED if self.lang == "rust" else _PLAIN_END).finditer(self.source, at):
            depth += 1 if m[0] == "/*" else -1
            if depth == 0:
                return m.end()
        return len(self.source)

    def _opens(self, bracket: str, at: int) -> int:
        block = self.last in ("", ";", "{", "}", ")", "=>") or self.last in _BEFORE_BLOCKS or (self.value and self.last != '"')
        self.brackets.append(_Open(bracket, at, self.last in _CONDITIONS, block))
        self.parts.append(bracket)
        self.value, self.last = False, bracket
        return at + 1

    def _closes(self, bracket: str, at: int) -> int:
        stack, out = self.brackets, self.out
        self.parts.append(bracket)
        if bracket == "}" and len(self.modes) > 1 and (not stack or stack[-1].bracket != "{"):
            inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].inner), None)
            if inner is not None:  # what is open inside the inserted code ends with it
                out.errors = True
                for b in stack[inner + 1 :]:
                    out.close[b.at] = at
                del stack[inner + 1 :]
        if not stack or stack[-1].bracket != _PAIRS[bracket]:
            out.errors = True
            return at + 1
        opened = stack.pop()
        out.close[opened.at] = at
        self.last = bracket
        self.value = not (opened.condition if bracket == ")" else opened.block)
        if opened.inner:
            self._leave()
        return at + 1

    def _inserts(self, at: int) -> int:
        """Code in braces inside a template or a tag."""
        self.brackets.append(_Open("{", at, inner=True))
        self.parts.append("{")
        self._enter(CODE, at)
        self.value, self.last = False, "("
        return at + 1

    def _template(self, at: int) -> int:
        m = _TEMPLATE.search(self.source, at)
        if m is None:
            return self._hide(at, len(self.source))
        if m[0] == "${":
            self._hide(at, m.end() - 1)
            return self._inserts(m.end() - 1)
        if m[0] == "`":
            self._hide(at, m.start())
            self.parts.append("`")
            self.out.close[self._leave()] = m.start()
            self.value, self.last = True, '"'
            return m.end()
        return self._hide(at, m.end())

    def _tag_at(self, at: int) -> re.Match | None:
        """A tag that opens here, rather than a comparison or type parameters."""
        if not self.markup or self.value:
            return None
        found = _TAG_OPENS.match(self.source, at)
        if found is None:
            return None
        if _TYPE_PARAMETERS.match(self.source, at) and self.source.find(f"</{found['name']}", at) < 0:
            return None
        return found

    def _tag(self, at: int) -> int:
        m = _TAG.search(self.source, at)
        if m is None:
            return self._hide(at, len(self.source))
        if m[0] == "{":
            self._hide(at, m.start())
            return self._inserts(m.start())
        if m[0] == "/>":
            return self._markup_ends(at, m.end())
        if m[0] == ">":
            self.modes[-1] = CHILDREN
        return self._hide(at, m.end())

    def _children(self, at: int) -> int:
        m = _CHILDREN.search(self.source, at)
        if m is None:
            return self._hide(at, len(self.source))
        if m[0] == "{":
            self._hide(at, m.start())
            return self._inserts(m.start())
        if m[0] == "<":
            found = _TAG_OPENS.match(self.source, m.start())
            if found:
                self._enter(TAG, m.start())
                return self._hide(at, found.end())
            return self._hide(at, m.end())
        return self._markup_ends(at, m.end())

    def _markup_ends(self, at: int, end: int) -> int:
        """An element that stands in code ends like a literal."""
        began = self._leave()
        if self.modes[-1] != CODE:
            return self._hide(at, end)
        self._hide(at, end - 1)
        self.parts.append('"')
        self.out.close[began] = end - 1
        self.value, self.last = True, '"'
        return end


def scan(source: str, lang: str) -> Scanned:
    """The code of a source in one of TypeScript, JavaScript, Go and Rust."""
    return _Scanner(source, lang).run()
