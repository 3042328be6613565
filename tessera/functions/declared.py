"""What Python and TypeScript texts declare, broken ones too: small readers of one text, which tasks call for each file.

Declared are classes, functions, interfaces, type aliases and enums of a module, the members of classes, and exported
constants that hold a function; what stands within functions, blocks and namespaces is not.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

#: ``(name, qualified_name, kind, start_line, end_line)``
Found = tuple[str, str, str, int, int]


# --- Python: by its own grammar; a broken text by its indents ---------------------------------------------


def python_declarations(content: str) -> tuple[list[Found], bool]:
    """What a Python text declares, and whether it is broken."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return indented_declarations(content), True
    out: list[Found] = []
    scopes = [(tree.body, "")]
    while scopes:
        body, prefix = scopes.pop()
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if prefix else "function"
                start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                out.append((node.name, prefix + node.name, kind, start, node.end_lineno))
                if kind == "class":
                    scopes.append((node.body, f"{prefix}{node.name}."))
    return sorted(out, key=lambda d: (d[3], -d[4])), False


STRING = r"""(?:[rRbBuUfFtT]{0,2})(?:\"{3}(?:[^\\]|\\.)*?(?:\"{3}|\Z)|'{3}(?:[^\\]|\\.)*?(?:'{3}|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
PYTHON_TOKEN = re.compile(rf"(?s:{STRING})|\#[^\n]*|\\\n|\n|[()\[\]{{}}]|[^\W\d]\w*|[^\S\n]+|.")
PYTHON_HEAD = re.compile(r"(?:async\s+)?(class|def)\s+([^\W\d]\w*)")


def logical_lines(content: str) -> Iterator[tuple[int, int, int, str]]:
    """``(indent, first line, last line, code)`` of each line that goes on over brackets and strings; comments are left out.

    A ``class`` or ``def`` at the start of a line ends brackets that were never closed.
    """
    no, first, last, depth, code = 1, 1, 1, 0, ""
    for m in PYTHON_TOKEN.finditer(content):
        token = m[0]
        if token == "\n" and depth and PYTHON_HEAD.match(content[m.end() :].lstrip(" \t")):
            depth = 0
        if token == "\n" and not depth:
            if code.strip():
                yield len(code) - len(code.lstrip()), first, last, code
            no, first, code = no + 1, no + 1, ""
            continue
        if not code.strip() and not token.isspace():
            first = no
        no += token.count("\n")
        last = last if token.isspace() or token.startswith("#") else no
        depth += (token in "([{") - (token in ")]}") if len(token) == 1 and depth + (token in "([{") else 0
        code += "" if token.startswith("#") else " " if token.isspace() and code.strip() else token
    if code.strip():
        yield len(code) - len(code.lstrip()), first, last, code


def indented_declarations(content: str) -> list[Found]:
    """What can be told of a broken Python text: heads at the module's and the classes' indents, each to the last line below it."""
    out: list[list] = []
    open_: list[tuple[int, int | None]] = []  # indent of a head, and its place in out; None for a block that hides what it holds
    decorated = None
    for indent, first, last, code in logical_lines(content.expandtabs(8)):
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        for _, at in open_:
            if at is not None:
                out[at][4] = last
        head, body = PYTHON_HEAD.match(code.strip()), code.strip()
        if body.startswith("@"):
            decorated = first if decorated is None else decorated
            continue
        hidden = any(at is None or out[at][2] != "class" for _, at in open_)
        if head and not hidden:
            prefix = "".join(f"{out[at][0]}." for _, at in open_)
            kind = "class" if head[1] == "class" else "method" if prefix else "function"
            out.append([head[2], prefix + head[2], kind, decorated or first, last])
            open_.append((indent, len(out) - 1))
        elif body.endswith(":"):
            open_.append((indent, None))
        decorated = None
    return [tuple(x) for x in out]


# --- TypeScript: tokens, then statements --------------------------------------------------------------------


class Token(NamedTuple):
    kind: str  # name, string, number, regex or sign
    text: str
    line: int
    end: int  # its last line
    column: int


# fixed values: words and signs of the language
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
MODIFIERS = frozenset("public private protected static async override readonly abstract declare accessor get set".split())
STARTERS = frozenset("export import class function interface type enum const let var declare abstract async namespace module if for while switch try return throw".split())
OPERATORS = frozenset("+ - * / % = < > & | ^ ! ? : . , ( [ => extends implements in of as is keyof typeof infer satisfies".split())
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
PLAIN = re.compile(r"""\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|[^\W\d][\w$]*|[$#][\w$]*|\d[\w.]*|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|=>|.""", re.DOTALL)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)


def script_tokens(content: str, tsx: bool = False) -> tuple[list[Token], bool]:
    """The tokens of a script without comments, and whether a string or comment stays open. A template is one string with what stands within its braces."""
    out: list[Token] = []
    at, line, begun, broken = 0, 1, 0, False

    def template(at: int) -> tuple[int, bool]:
        """Where the template that starts at ``at`` ends; its braces hold code with strings and templates of its own."""
        at += 1
        while True:
            at = TEMPLATE.match(content, at).end()
            if at >= len(content):
                return at, True
            if content[at] == "`":
                return at + 1, False
            depth, at = 1, at + 2
            while depth and at < len(content):
                if content[at] == "`":
                    at, open_ = template(at)
                    if open_:
                        return at, True
                    continue
                text = PLAIN.match(content, at)[0]
                depth += (text == "{") - (text == "}")
                at += len(text)

    while at < len(content):
        text = PLAIN.match(content, at)[0]
        kind = "name" if text[0] in "$#_" or text[0].isalpha() else "number" if text[0].isdigit() else "string" if text[0] in "'\"" and len(text) > 1 else "sign"
        if text == "`":
            end, open_ = template(at)
            kind, text, broken = "string", content[at:end], broken or open_
        elif text == "/":
            last = out[-1] if out else None
            value = last and (last.kind in ("number", "string", "regex") or last.kind == "name" and last.text not in BEFORE_REGEX or last.text in (")", "]", "}") or last.text == "<")
            if not value and (m := REGEX.match(content, at)):
                kind, text = "regex", m[0]
        broken |= text.startswith("/*") and not text.endswith("*/") or text in ("'", '"') and not tsx
        if not text.isspace() and not text.startswith(("//", "/*")) and text not in ("'", '"'):
            out.append(Token(kind, text, line, line + text.count("\n"), at - begun))
        if "\n" in text:
            line, begun = line + text.count("\n"), at + text.rindex("\n") + 1
        at += len(text)
    return out, broken


def closings(tokens: list[Token], recover: bool = False) -> tuple[dict[int, int], bool]:
    """Where the bracket at each token closes, and whether any doesn't. To recover, a declaration at the first column closes what is open."""
    found, open_, broken = {}, [], False
    for i, t in enumerate(tokens):
        if recover and open_ and not t.column and t.kind == "name" and t.text in STARTERS:
            for k in open_:
                found[k] = i - 1
            open_ = []
        if t.kind != "sign":
            continue
        if t.text in OPENS:
            open_.append(i)
        elif t.text in CLOSES:
            fits = [n for n, k in enumerate(open_) if OPENS[tokens[k].text] == t.text]
            broken |= not fits or fits[-1] != len(open_) - 1
            if fits:
                for k in open_[fits[-1] :]:
                    found[k] = i
                del open_[fits[-1] :]
    for k in open_:
        found[k] = len(tokens) - 1
    return found, broken or bool(open_)


class Script:
    """A script's statements, read once from the first token to the last."""

    def __init__(self, content: str, tsx: bool):
        self.tokens, strings = script_tokens(content, tsx)
        self.close, brackets = closings(self.tokens)
        if brackets:
            self.close, _ = closings(self.tokens, True)
        self.broken, self.out = strings or brackets, []

    def text(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) and self.tokens[i].kind != "string" else ""

    def named(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "name"

    def after(self, i: int) -> int:
        """The token behind the one at ``i``, or behind what it opens."""
        return self.close[i] + 1 if i in self.close else i + 1

    def angles(self, i: int) -> int:
        """Behind type parameters, where some start."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            depth += (self.text(i) == "<") - (self.text(i) == ">")
            i = self.after(i)
            if not depth:
                break
        return i

    def ends(self, i: int) -> bool:
        """Whether a statement that nothing closed ends before token ``i``: on a new line, with no operator beside."""
        last, t = self.tokens[i - 1], self.tokens[i]
        if last.text == ">" and t.line > last.end and not t.column and t.text in STARTERS:  # an element ends there
            return True
        if t.text == "*" and t.line > last.end and last.kind != "sign" and self.named(i + 1) and self.tokens[i + 1].column == t.column + 1:  # a generator's name
            return True
        return t.line > last.end and not (last.kind != "string" and last.text in OPERATORS) and (t.kind != "sign" or t.text in "{@}#") and t.text not in OPERATORS

    def rest(self, i: int, stops: str = ";") -> int:
        """Behind the statement that goes on at ``i``; a stop stays, but a semicolon goes with it."""
        first = i
        while i < len(self.tokens):
            if self.text(i) == ";" and ";" in stops:
                return i + 1
            if self.text(i) in stops and self.text(i) or i > first and self.ends(i):
                return i
            i = self.after(i)
        return i

    def body(self, i: int) -> int | None:
        """The brace that opens a body behind parameters or a heritage; none where the statement ends without one."""
        first = i
        while i < len(self.tokens):
            if self.text(i) == "{" and (i == first or self.text(i - 1) not in (":", "|", "&", "=>", "<", ",", "?", "=", "is", "keyof", "typeof") and (self.text(i - 1) != "extends" or i == first)):
                return i
            if self.text(i) in (";", "}") or i > first and self.ends(i) and self.text(i) != "{":
                return None
            i = self.angles(i) if self.text(i) == "<" else self.after(i)
        return None

    def add(self, name: str, prefix: str, kind: str, first: int, last: int) -> None:
        last = max(first, min(last, len(self.tokens) - 1))
        self.out.append((name, prefix + name, kind, self.tokens[first].line, self.tokens[last].end))

    def module(self) -> list[Found]:
        i = 0
        while i < len(self.tokens):
            i = max(i + 1, self.statement(i))
        return sorted(self.out, key=lambda d: (d[3], -d[4]))

    def decorators(self, i: int) -> int:
        while self.text(i) == "@":
            i += 2
            while self.text(i) == "." and self.named(i + 1):
                i += 2
            if self.text(i) == "(":
                i = self.after(i)
        return i

    def statement(self, first: int) -> int:
        i, exported = self.decorators(first), False
        while self.text(i) in ("export", "default", "declare", "abstract", "async") and (self.named(i + 1) or self.text(i + 1) == "@"):
            exported |= self.text(i) == "export"
            i = self.decorators(i + 1)
        word = self.text(i)
        at = i + 1 + (word == "function" and self.text(i + 1) == "*")
        if word == "const" and self.text(i + 1) == "enum":
            word, at = "enum", i + 2
        if word == "const" and exported:
            return self.constants(i + 1)
        if word not in ("class", "function", "interface", "type", "enum") or not self.named(at):
            return self.rest(first) if self.text(first) != "{" else self.after(first)
        name, behind = self.tokens[at].text, self.angles(at + 1)
        if word == "type":
            if self.text(behind) != "=":
                return self.rest(first)
            end = self.rest(behind + 1)
            self.add(name, "", "type_alias", first, end - 1)
            return end
        if word == "function":
            if self.text(behind) != "(":
                return self.rest(first)
            behind = self.after(behind)
        brace = self.body(behind)
        if brace is None:
            self.broken |= word != "function"
            return self.rest(behind)
        self.add(name, "", word, first, self.close[brace])
        if word == "class":
            self.members(brace, f"{name}.")
        return self.after(brace)

    def constants(self, i: int) -> int:
        """``name = function`` or ``name = (...) => ...`` of an exported constant, name by name."""
        while self.named(i) or self.text(i) in ("{", "["):
            name = i
            i = self.after(i)
            if self.text(i) == ":":
                while i < len(self.tokens) and self.text(i) not in ("=", ";"):
                    i = self.after(i)
            value = i + 1 if self.text(i) == "=" else None
            end = self.rest(i, ",;")
            if value is not None and self.named(name) and self.function(value, end):
                self.add(self.tokens[name].text, "", "function", name, end - 1 - (self.text(end - 1) == ";"))
            if self.text(end) != ",":
                return end
            i = end + 1
        return self.rest(i)

    def function(self, i: int, end: int) -> bool:
        i += self.text(i) == "async" and self.text(i + 1) != "=>"
        if self.text(i) == "function":
            return True
        i = self.angles(i)
        if self.named(i):
            return self.text(i + 1) == "=>"
        if self.text(i) != "(":
            return False
        i = self.after(i)
        if self.text(i) == ":":
            while i < end and self.text(i) != "=>":
                i = self.after(i)
        return self.text(i) == "=>"

    def members(self, brace: int, prefix: str) -> None:
        i, last = brace + 1, self.close[brace]
        while i < last:
            first, i = i, self.decorators(i)
            while self.text(i) in MODIFIERS and self.text(i + 1) not in ("(", "<", "=", ";", "?", "!", ":", "}"):
                i += 1
            i += self.text(i) == "*"
            name, i = i, self.after(i)
            i += self.text(i) in ("?", "!")
            if self.text(self.angles(i)) == "(" and (self.tokens[name].kind != "sign" or self.text(name) == "["):
                behind = self.after(self.angles(i))
                body = self.body(behind) if behind < last else None
                if body is not None and body < last:
                    self.add("".join(t.text for t in self.tokens[name:i] if t.text not in "?!"), prefix, "method", first, self.close[body])
                    i = self.after(body)
                    continue
            i = max(min(self.rest(i), last), name + 1) if self.text(name) != ";" else name + 1


def script_declarations(content: str, tsx: bool = False) -> tuple[list[Found], bool]:
    """What a TypeScript text declares, and whether it is broken."""
    script = Script(content, tsx)
    return script.module(), script.broken
