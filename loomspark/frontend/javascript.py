"""A parser for JavaScript modules with JSX. Plain Python, no Spark.

Node types carry the usual names of JavaScript syntax trees, with separate literal types,
object and class methods and optional members. Offsets and columns count code points.
TypeScript and decorators are errors.
"""

from __future__ import annotations

import re
from bisect import bisect_right


class JavaScriptError(ValueError):
    """reason, line (from 1) and column (from 0)."""

    def __init__(self, reason: str, line: int, column: int):
        super().__init__(f"{reason} ({line}:{column})")
        self.reason, self.line, self.column = reason, line, column


class Node:
    __slots__ = ("type", "start", "end", "name", "op", "value", "kids", "flags")

    def __init__(self, type: str, start: int, end: int = -1, name: str | None = None, op: str | None = None, value: str | None = None):
        self.type, self.start, self.end, self.name, self.op, self.value = type, start, end, name, op, value
        self.kids: list[tuple[str, Node]] = []
        self.flags: set[str] = set()

    def add(self, role: str, *nodes: Node | None) -> Node:
        self.kids += [(role, n) for n in nodes if n is not None]
        return self

    def get(self, role: str) -> Node | None:
        return next((n for r, n in self.kids if r == role), None)

    def all(self, role: str) -> list[Node]:
        return [n for r, n in self.kids if r == role]


# The words and operators of the language, tightest binding last.
RESERVED = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
LEVELS = ["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"]
ASSIGN = set("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
UNARY = set("! ~ + - typeof void delete".split())
PRECEDENCE = {op: k for k, level in enumerate(LEVELS, 1) for op in level.split()}

_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/)*")
_LINE_END = re.compile(r"\r\n|[\n\r\u2028\u2029]")
_ESCAPED = r"\\u(?:\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4})"
_WORD = rf"(?:[$_]|[^\W\d]|{_ESCAPED})(?:[$\w\u200c\u200d]|{_ESCAPED})*"
_TOKEN = re.compile(
    rf"""(?P<id>{_WORD})|(?P<priv>\#{_WORD})
    |(?P<num>0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{{}}()\[\];,<>+\-*/%&|^!~?:=.`])""",
    re.X,
)
_NEXT = re.compile(f"{_SPACE.pattern}(?:{_TOKEN.pattern})?", re.X)
_REGEX = re.compile(r"/((?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([a-z]*)")
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*|[$_][\w$-]*")
_JSX_TEXT = re.compile(r"[^<{>}]+")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")


class Parser:
    def __init__(self, source: str):
        self.s = source
        self.lines = [0, *(m.end() for m in _LINE_END.finditer(source))]
        self.no_arrow: set[int] = set()
        self.seen: dict[int, tuple[int, bool, str, str, int]] = {}
        self.last = 0
        self.go(0)
        if source.startswith("#!"):
            self.go(_LINE_END.search(source).start() if _LINE_END.search(source) else len(source))

    # tokens: kind, text and bounds of the next one, nl: a line ends before it

    def go(self, at: int) -> None:
        self.start, self.nl, self.kind, self.text, self.end = self.seen.get(at) or self.token(at)

    def token(self, at: int) -> tuple[int, bool, str, str, int]:
        """start, nl, kind, text and end of the token at or after `at`; each place is looked at once, however often it is read."""
        m = _NEXT.match(self.s, at)
        kind = m.lastgroup
        start, end = m.span(kind) if kind else (m.end(), m.end())
        nl = start > at and _LINE_END.search(self.s, at, start) is not None
        if self.s.startswith("/*", start):
            self.start, self.nl = start, nl
            raise self.error("Unterminated comment")
        if kind:
            text = m.group(kind)
        elif start == len(self.s):
            kind, text = "eof", ""
        else:
            kind, text, end = "bad", self.s[start], start + 1
        self.seen[start] = start, False, kind, text, end
        self.seen[at] = out = start, nl, kind, text, end
        return out

    def position(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1]

    def error(self, reason: str | None = None) -> JavaScriptError:
        return JavaScriptError(reason or (f"Unexpected token {self.text!r}" if self.text else "Unexpected end of file"), *self.position(self.start))

    def next(self) -> str:
        text, self.last = self.text, self.end
        self.go(self.end)
        return text

    def at(self, *texts: str) -> bool:
        return self.kind in ("op", "id") and self.text in texts

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise self.error()

    def done(self, n: Node) -> Node:
        n.end = self.last
        return n

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.at("}") or self.kind == "eof" or self.nl):
            raise self.error()

    def state(self) -> tuple:
        return self.start, self.last, self.nl

    def back(self, state: tuple) -> None:
        self.go(state[0])
        self.last, self.nl = state[1], state[2]

    def follows(self) -> tuple[str, str, bool]:
        """kind, text and line end of the token after the next one."""
        _, nl, kind, text, _ = self.seen.get(self.end) or self.token(self.end)
        return kind, text, nl

    # statements

    def program(self) -> Node:
        n = Node("Program", 0)
        self.body(n, lambda: self.kind == "eof", module=True)
        n.end = len(self.s)
        return n

    def body(self, n: Node, stop, module: bool = False) -> None:
        plain = True
        while not stop():
            if self.kind == "eof":
                raise self.error()
            literal = self.kind == "str"
            s = self.statement(module)
            inner = s.get("expression")
            plain = plain and literal and s.type == "ExpressionStatement" and inner.type == "StringLiteral" and "paren" not in inner.flags
            if plain:
                d = Node("Directive", s.start, s.end, value=inner.value)
                n.add("directive", d)
            else:
                n.add("body", s)

    def block(self) -> Node:
        n = Node("BlockStatement", self.start)
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                raise self.error()
            n.add("body", self.statement())
        self.next()
        return self.done(n)

    def statement(self, module: bool = False) -> Node:
        t, start = self.text, self.start
        if self.kind == "op":
            if t == "{":
                return self.block()
            if t == ";":
                n = Node("EmptyStatement", start)
                self.next()
                return self.done(n)
        elif self.kind == "id":
            known = getattr(self, f"s_{t}", None) if t in RESERVED else None
            if t in ("import", "export"):
                ahead = self.follows()[1]
                if t == "export" or ahead not in ("(", "."):
                    if not module:
                        raise self.error("'import' and 'export' may only appear at the top level")
                    return known(Node("", start))
                known = None
            if known:
                return known(Node("", start))
            if t == "let" and self.follows()[0] in ("id",) and self.follows()[1] not in ("in", "instanceof", "of") or t == "let" and self.follows()[1] in ("[", "{"):
                return self.variables(Node("VariableDeclaration", start, op="let"), True)
            if t == "async":
                kind, text, nl = self.follows()
                if text == "function" and not nl:
                    return self.s_function(Node("", start))
            if t not in RESERVED and self.follows()[1] == ":":
                n = Node("LabeledStatement", start, name=self.next())
                self.next()
                return self.done(n.add("body", self.statement()))
        n = Node("ExpressionStatement", start).add("expression", self.expression())
        self.semicolon()
        return self.done(n)

    def s_function(self, n: Node) -> Node:
        return self.function(n, "FunctionDeclaration")

    def s_class(self, n: Node) -> Node:
        return self.klass(n, "ClassDeclaration")

    def s_var(self, n: Node) -> Node:
        n.type, n.op = "VariableDeclaration", self.text
        return self.variables(n, True)

    s_const = s_var

    def variables(self, n: Node, whole: bool, no_in: bool = False) -> Node:
        self.next()
        while True:
            d = Node("VariableDeclarator", self.start)
            d.add("id", self.binding())
            if self.eat("="):
                d.add("init", self.assignment(no_in))
            n.add("declaration", self.done(d))
            if not self.eat(","):
                break
        if whole:
            if any(d.get("init") is None and (n.op == "const" or d.get("id").type != "Identifier") for d in n.all("declaration")):
                raise self.error("Missing initializer")
            self.semicolon()
        return self.done(n)

    def test(self, n: Node, role: str = "test") -> Node:
        self.need("(")
        n.add(role, self.expression())
        self.need(")")
        return n

    def s_if(self, n: Node) -> Node:
        n.type = "IfStatement"
        self.next()
        self.test(n).add("consequent", self.statement())
        if self.eat("else"):
            n.add("alternate", self.statement())
        return self.done(n)

    def s_while(self, n: Node) -> Node:
        n.type = "WhileStatement"
        self.next()
        return self.done(self.test(n).add("body", self.statement()))

    def s_do(self, n: Node) -> Node:
        n.type = "DoWhileStatement"
        self.next()
        n.add("body", self.statement())
        self.need("while")
        self.test(n)
        self.eat(";")
        return self.done(n)

    def s_with(self, n: Node) -> Node:
        n.type = "WithStatement"
        self.next()
        return self.done(self.test(n, "object").add("body", self.statement()))

    def s_for(self, n: Node) -> Node:
        self.next()
        if self.eat("await"):
            n.flags.add("async")
        self.need("(")
        first = None
        if not self.at(";"):
            ahead = self.follows()
            if self.at("var", "const") or self.at("let") and (ahead[0] == "id" and ahead[1] not in ("in", "of") or ahead[1] in ("[", "{")):
                first = self.variables(Node("VariableDeclaration", self.start, op=self.text), False, True)
            else:
                first = self.expression(True)
        if first is not None and self.at("of", "in"):
            n.type = "ForOfStatement" if self.next() == "of" else "ForInStatement"
            if first.type != "VariableDeclaration":
                first = self.pattern(first)
            n.add("left", first).add("right", self.assignment() if n.type == "ForOfStatement" else self.expression())
        else:
            n.type = "ForStatement"
            n.add("init", first)
            self.need(";")
            n.add("test", None if self.at(";") else self.expression())
            self.need(";")
            n.add("update", None if self.at(")") else self.expression())
        self.need(")")
        return self.done(n.add("body", self.statement()))

    def leave(self, n: Node, type: str) -> Node:
        n.type = type
        self.next()
        if self.kind == "id" and self.text not in RESERVED and not self.nl:
            n.name = self.next()
        self.semicolon()
        return self.done(n)

    def s_break(self, n: Node) -> Node:
        return self.leave(n, "BreakStatement")

    def s_continue(self, n: Node) -> Node:
        return self.leave(n, "ContinueStatement")

    def s_debugger(self, n: Node) -> Node:
        return self.leave(n, "DebuggerStatement")

    def s_return(self, n: Node) -> Node:
        n.type = "ReturnStatement"
        self.next()
        if not (self.at(";", "}") or self.kind == "eof" or self.nl):
            n.add("argument", self.expression())
        self.semicolon()
        return self.done(n)

    def s_throw(self, n: Node) -> Node:
        n.type = "ThrowStatement"
        self.next()
        if self.nl:
            raise self.error("Illegal newline after throw")
        n.add("argument", self.expression())
        self.semicolon()
        return self.done(n)

    def s_try(self, n: Node) -> Node:
        n.type = "TryStatement"
        self.next()
        n.add("block", self.block())
        if self.at("catch"):
            c = Node("CatchClause", self.start)
            self.next()
            if self.eat("("):
                c.add("param", self.binding())
                self.need(")")
            n.add("handler", self.done(c.add("body", self.block())))
        if self.eat("finally"):
            n.add("finalizer", self.block())
        if len(n.kids) < 2:
            raise self.error("Missing catch or finally clause")
        return self.done(n)

    def s_switch(self, n: Node) -> Node:
        n.type = "SwitchStatement"
        self.next()
        self.test(n, "discriminant")
        self.need("{")
        while not self.eat("}"):
            c = Node("SwitchCase", self.start)
            if not self.eat("default"):
                self.need("case")
                c.add("test", self.expression())
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.kind == "eof":
                    raise self.error()
                c.add("consequent", self.statement())
            n.add("case", self.done(c))
        return self.done(n)

    def s_import(self, n: Node) -> Node:
        n.type = "ImportDeclaration"
        self.next()
        if self.kind != "str":
            if self.kind == "id":
                n.add("specifier", self.specifier("ImportDefaultSpecifier", local=self.identifier()))
                if not self.at("from"):
                    self.need(",")
            if self.at("*"):
                start = self.start
                self.next()
                self.need("as")
                n.add("specifier", self.specifier("ImportNamespaceSpecifier", start, local=self.identifier()))
            elif self.eat("{"):
                while not self.eat("}"):
                    start = self.start
                    known = self.module_name()
                    local = self.identifier() if self.eat("as") else Node("Identifier", known.start, known.end, name=known.name)
                    s = self.specifier("ImportSpecifier", start, local=local)
                    s.name = known.name
                    n.add("specifier", s)
                    if not self.at("}"):
                        self.need(",")
            self.need("from")
        n.value = self.string()
        self.attributes()
        self.semicolon()
        return self.done(n)

    def specifier(self, type: str, start: int | None = None, **parts: Node) -> Node:
        first = next(iter(parts.values()))
        n = Node(type, first.start if start is None else start)
        for role, part in parts.items():
            n.add(role, part)
        return self.done(n)

    def attributes(self) -> None:
        if self.at("with", "assert") and not (self.text == "assert" and self.nl):
            self.next()
            self.primary()

    def string(self) -> str:
        if self.kind != "str":
            raise self.error()
        return unquote(self.next())

    def module_name(self) -> Node:
        n = Node("Identifier", self.start)
        if self.kind == "str":
            n.name = self.string()
        elif self.kind == "id":
            n.name = self.next()
        else:
            raise self.error()
        return self.done(n)

    def s_export(self, n: Node) -> Node:
        self.next()
        if self.eat("default"):
            n.type = "ExportDefaultDeclaration"
            start = self.start
            if self.at("function") or self.at("async") and self.follows()[1] == "function" and not self.follows()[2]:
                return self.done(n.add("declaration", self.function(Node("", start), "FunctionDeclaration", named=False)))
            if self.at("class"):
                return self.done(n.add("declaration", self.klass(Node("", start), "ClassDeclaration", named=False)))
            n.add("declaration", self.assignment())
            self.semicolon()
            return self.done(n)
        if self.eat("*"):
            n.type = "ExportAllDeclaration"
            if self.eat("as"):
                n.type, n.name = "ExportNamedDeclaration", None
                known = self.module_name()
                s = Node("ExportNamespaceSpecifier", known.start, known.end, name=known.name)
                n.add("specifier", s)
            self.need("from")
            n.value = self.string()
            self.attributes()
            self.semicolon()
            return self.done(n)
        n.type = "ExportNamedDeclaration"
        if self.eat("{"):
            while not self.eat("}"):
                start = self.start
                local = self.module_name()
                known = self.module_name() if self.eat("as") else local
                s = self.specifier("ExportSpecifier", start, local=local)
                s.name = known.name
                n.add("specifier", s)
                if not self.at("}"):
                    self.need(",")
            if self.eat("from"):
                n.value = self.string()
                self.attributes()
            self.semicolon()
            return self.done(n)
        if not (self.at("var", "let", "const", "function", "class", "async")):
            raise self.error()
        return self.done(n.add("declaration", self.statement()))

    # functions and classes

    def function(self, n: Node, type: str, named: bool = True) -> Node:
        n.type = type
        if self.eat("async"):
            n.flags.add("async")
        self.need("function")
        if self.eat("*"):
            n.flags.add("generator")
        if self.kind == "id" and not self.at("("):
            n.add("id", self.identifier())
            n.name = n.get("id").name
        elif named and type == "FunctionDeclaration":
            raise self.error()
        return self.rest_of_function(n)

    def rest_of_function(self, n: Node) -> Node:
        self.need("(")
        self.params(n)
        return self.done(n.add("body", self.function_body()))

    def params(self, n: Node) -> None:
        """To the closing parenthesis, which is consumed."""
        while not self.eat(")"):
            if self.at("..."):
                r = Node("RestElement", self.start)
                self.next()
                n.add("param", self.done(r.add("argument", self.binding())))
            else:
                n.add("param", self.binding_or_default())
            if not self.at(")"):
                self.need(",")

    def function_body(self) -> Node:
        n = Node("BlockStatement", self.start)
        self.need("{")
        self.body(n, lambda: self.at("}"))
        self.next()
        return self.done(n)

    def identifier(self) -> Node:
        if self.kind != "id" or self.text in RESERVED:
            raise self.error()
        n = Node("Identifier", self.start, name=self.next())
        return self.done(n)

    def binding_or_default(self) -> Node:
        target = self.binding()
        if not self.at("="):
            return target
        self.next()
        return self.done(Node("AssignmentPattern", target.start).add("left", target).add("right", self.assignment()))

    def binding(self) -> Node:
        if self.at("["):
            n = Node("ArrayPattern", self.start)
            self.next()
            while not self.eat("]"):
                if self.at(","):
                    n.add("element", Node("Hole", self.start, self.start))
                elif self.at("..."):
                    r = Node("RestElement", self.start)
                    self.next()
                    n.add("element", self.done(r.add("argument", self.binding())))
                else:
                    n.add("element", self.binding_or_default())
                if not self.at("]"):
                    self.need(",")
            return self.done(n)
        if self.at("{"):
            n = Node("ObjectPattern", self.start)
            self.next()
            while not self.eat("}"):
                p = Node("ObjectProperty", self.start)
                if self.at("..."):
                    p.type = "RestElement"
                    self.next()
                    n.add("property", self.done(p.add("argument", self.binding())))
                else:
                    self.key(p)
                    if self.eat(":"):
                        p.add("value", self.binding_or_default())
                    else:
                        self.shorthand(p)
                    n.add("property", self.done(p))
                if not self.at("}"):
                    self.need(",")
            return self.done(n)
        return self.identifier()

    def shorthand(self, p: Node) -> None:
        k = p.get("key")
        if k.type != "Identifier" or k.name in RESERVED or "computed" in p.flags:
            raise self.error()
        p.flags.add("shorthand")
        v = Node("Identifier", k.start, k.end, name=k.name)
        if self.eat("="):
            v = self.done(Node("AssignmentPattern", v.start).add("left", v).add("right", self.assignment()))
        p.add("value", v)

    def key(self, p: Node) -> None:
        """The key of a property or method; p.name is its plain name, if it has one."""
        k = Node("Identifier", self.start)
        if self.eat("["):
            p.flags.add("computed")
            p.add("key", self.assignment())
            self.need("]")
            return
        if self.kind == "str":
            k.type, k.value = "StringLiteral", unquote(self.next())
        elif self.kind == "num":
            k.type, k.value = "NumericLiteral", self.next()
        elif self.kind == "priv":
            k.type, k.name = "PrivateName", self.next()
        elif self.kind == "id":
            k.name = self.next()
        else:
            raise self.error()
        p.name = k.name or k.value
        p.add("key", self.done(k))

    def modifiers(self, n: Node, words: tuple[str, ...]) -> None:
        """static, async, get, set and * before a key, into flags and op."""
        while self.kind == "id" and self.text in words and self.follows()[1] not in ("(", ",", "}", "=", ":", ";") and self.follows()[0] != "eof":
            if self.text == "async" and self.follows()[2]:
                break
            if self.text in ("get", "set"):
                if self.follows()[1] == "*":
                    break
                n.op = self.next()
                break
            word = self.next()
            n.flags.add(word)
            words = tuple(w for w in words if w != word and (w != "static"))
        if self.eat("*"):
            n.flags.add("generator")

    def klass(self, n: Node, type: str, named: bool = True) -> Node:
        n.type = type
        self.need("class")
        if self.kind == "id" and self.text != "extends":
            n.add("id", self.identifier())
            n.name = n.get("id").name
        elif named and type == "ClassDeclaration":
            raise self.error()
        if self.eat("extends"):
            n.add("superClass", self.unary_postfix())
        self.need("{")
        while not self.eat("}"):
            if self.eat(";"):
                continue
            m = Node("", self.start)
            if self.at("static") and self.follows()[1] == "{":
                self.next()
                b = self.block()
                n.add("member", Node("StaticBlock", m.start, b.end).add("body", *b.all("body")))
                continue
            self.modifiers(m, ("static", "async", "get", "set"))
            self.key(m)
            private = "Private" if m.get("key").type == "PrivateName" else ""
            if self.at("("):
                m.type = f"Class{private}Method"
                m.op = m.op or ("constructor" if m.name == "constructor" and "static" not in m.flags else "method")
                n.add("member", self.rest_of_function(m))
            else:
                if m.op or m.flags & {"async", "generator"}:
                    raise self.error()
                m.type = f"Class{private}Property"
                if self.eat("="):
                    m.add("value", self.assignment())
                self.semicolon()
                n.add("member", self.done(m))
        return self.done(n)

    # expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.at(","):
            return first
        n = Node("SequenceExpression", first.start).add("expression", first)
        while self.eat(","):
            n.add("expression", self.assignment(no_in))
        return self.done(n)

    def arrow(self, n: Node, no_in: bool) -> Node:
        """After the parameters."""
        if not self.at("=>") or self.nl:
            raise self.error()
        self.next()
        n.type = "ArrowFunctionExpression"
        return self.done(n.add("body", self.function_body() if self.at("{") else self.assignment(no_in)))

    def tried_arrow(self, no_in: bool) -> Node | None:
        start, held = self.start, self.state()
        n = Node("", start)
        plain_async = self.at("async") and not self.follows()[2]
        if plain_async and (self.follows()[0] == "id" and self.follows()[1] not in RESERVED or self.follows()[1] == "("):
            self.next()
            n.flags.add("async")
        if self.kind == "id" and self.text not in RESERVED:
            if self.follows()[1] == "=>":
                return self.arrow(n.add("param", self.identifier()), no_in)
        elif self.at("(") and start not in self.no_arrow:
            try:
                self.next()
                self.params(n)
                if self.at("=>") and not self.nl:
                    return self.arrow(n, no_in)
            except JavaScriptError:
                if self.start > start and n.type == "ArrowFunctionExpression":
                    raise
            self.no_arrow.add(start)
        self.back(held)
        return None

    def assignment(self, no_in: bool = False) -> Node:
        if self.kind == "id" and self.text not in RESERVED or self.at("("):
            found = self.tried_arrow(no_in)
            if found is not None:
                return found
        if self.at("yield") and self.follows()[1] not in ("=", ".", "=>"):
            n = Node("YieldExpression", self.start)
            self.next()
            if self.eat("*"):
                n.flags.add("generator")
            if not (self.nl or self.at(")", "]", "}", ",", ";", ":") or self.kind == "eof"):
                n.add("argument", self.assignment(no_in))
            return self.done(n)
        left = self.conditional(no_in)
        if self.kind == "op" and self.text in ASSIGN:
            n = Node("AssignmentExpression", left.start, op=self.text)
            left = self.pattern(left) if self.text == "=" else left
            if left.type not in ("Identifier", "MemberExpression", "ArrayPattern", "ObjectPattern"):
                raise self.error("Invalid left-hand side in assignment")
            self.next()
            return self.done(n.add("left", left).add("right", self.assignment(no_in)))
        return left

    def pattern(self, n: Node) -> Node:
        """An expression read again as the target of an assignment."""
        to = {"ArrayExpression": "ArrayPattern", "ObjectExpression": "ObjectPattern", "AssignmentExpression": "AssignmentPattern", "SpreadElement": "RestElement"}
        if n.type in to and "paren" not in n.flags:
            n.type = to[n.type]
            if n.type in ("ArrayPattern", "ObjectPattern", "RestElement"):
                for _, kid in n.kids:
                    self.pattern(kid.get("value") if kid.type == "ObjectProperty" else kid)
            elif n.type == "AssignmentPattern":
                n.op = None
        return n

    def conditional(self, no_in: bool) -> Node:
        test = self.binary(1, no_in)
        if not self.at("?"):
            return test
        n = Node("ConditionalExpression", test.start).add("test", test)
        self.next()
        n.add("consequent", self.assignment())
        self.need(":")
        return self.done(n.add("alternate", self.assignment(no_in)))

    def binary(self, least: int, no_in: bool) -> Node:
        if self.kind == "priv":
            left = Node("PrivateName", self.start, name=self.next())
            self.done(left)
            if not self.at("in"):
                raise self.error()
        else:
            left = self.unary()
        while self.kind in ("op", "id") and (level := PRECEDENCE.get(self.text, 0)) >= least and not (no_in and self.text == "in"):
            op = self.next()
            n = Node("LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression", left.start, op=op)
            if n.type == "LogicalExpression":
                for side in (left,):
                    if side.type == "LogicalExpression" and "paren" not in side.flags and ("??" in (op, side.op)) and side.op != op:
                        raise self.error("Mixing ?? with && or || needs parentheses")
            right = self.binary(level if op == "**" else level + 1, no_in)
            left = self.done(n.add("left", left).add("right", right))
        return left

    def unary(self) -> Node:
        start = self.start
        if self.kind in ("op", "id") and self.text in UNARY:
            n = Node("UnaryExpression", start, op=self.next())
            return self.done(n.add("argument", self.unary()))
        if self.at("++", "--"):
            n = Node("UpdateExpression", start, op=self.next())
            n.flags.add("prefix")
            return self.done(n.add("argument", self.unary()))
        if self.at("await"):
            kind, text, nl = self.follows()
            if kind in ("id", "num", "str", "priv") and text not in ("in", "instanceof", "of") and not nl or text in ("(", "[", "{", "`", "!", "-", "+", "/"):
                n = Node("AwaitExpression", start)
                self.next()
                return self.done(n.add("argument", self.unary()))
        e = self.unary_postfix()
        if self.at("++", "--") and not self.nl:
            n = Node("UpdateExpression", e.start, op=self.next())
            return self.done(n.add("argument", e))
        return e

    def unary_postfix(self) -> Node:
        start = self.start
        if self.at("new"):
            e = self.new()
        else:
            e = self.primary()
        return self.chain(e, start, True)

    def new(self) -> Node:
        start = self.start
        self.next()
        if self.eat("."):
            if not self.at("target"):
                raise self.error()
            self.next()
            return self.done(Node("MetaProperty", start, name="new.target"))
        n = Node("NewExpression", start)
        inner = self.start
        callee = self.new() if self.at("new") else self.primary()
        n.add("callee", self.chain(callee, inner, False))
        if self.eat("("):
            self.arguments(n)
        return self.done(n)

    def arguments(self, n: Node) -> None:
        while not self.eat(")"):
            n.add("argument", self.element())
            if not self.at(")"):
                self.need(",")

    def element(self) -> Node:
        if self.at("..."):
            n = Node("SpreadElement", self.start)
            self.next()
            return self.done(n.add("argument", self.assignment()))
        return self.assignment()

    def chain(self, e: Node, start: int, calls: bool) -> Node:
        optional = ""
        while True:
            if self.kind != "op":
                return e
            here = ""
            if self.at("?.") and calls:
                self.next()
                optional, here = "Optional", "optional"
                if not self.at("(", "["):
                    e = self.member(e, start, optional)
                    e.flags.add(here)
                    continue
            if not here and self.eat("."):
                e = self.member(e, start, optional)
            elif self.at("["):
                n = Node(f"{optional}MemberExpression", start).add("object", e)
                n.flags |= {"computed"} | ({here} if here else set())
                self.next()
                n.add("property", self.expression())
                self.need("]")
                e = self.done(n)
            elif calls and self.at("("):
                n = Node(f"{optional}CallExpression", start).add("callee", e)
                if here:
                    n.flags.add(here)
                self.next()
                self.arguments(n)
                e = self.done(n)
            elif self.at("`"):
                n = Node("TaggedTemplateExpression", start).add("tag", e)
                e = self.done(n.add("quasi", self.template()))
            else:
                return e

    def member(self, e: Node, start: int, optional: str) -> Node:
        if self.kind not in ("id", "priv"):
            raise self.error()
        p = Node("Identifier" if self.kind == "id" else "PrivateName", self.start, name=self.next())
        return self.done(Node(f"{optional}MemberExpression", start, name=p.name).add("object", e).add("property", self.done(p)))

    def template(self) -> Node:
        n = Node("TemplateLiteral", self.start)
        at = piece = self.start + 1
        while True:
            if at >= len(self.s):
                raise self.error("Unterminated template")
            c = self.s[at]
            if c == "\\":
                at += 2
            elif c == "`" or self.s.startswith("${", at):
                n.add("quasi", Node("TemplateElement", piece, at, value=self.s[piece:at]))
                if c == "`":
                    self.last = at + 1
                    self.go(at + 1)
                    return self.done(n)
                self.go(at + 2)
                n.add("expression", self.expression())
                if not self.at("}"):
                    raise self.error()
                at = piece = self.end
            else:
                at += 1

    def literal(self, type: str, value: str | None = None) -> Node:
        n = Node(type, self.start, value=self.text if value is None else value)
        self.next()
        return self.done(n)

    def primary(self) -> Node:
        start, t = self.start, self.text
        if self.kind == "num":
            return self.literal("BigIntLiteral" if t.endswith("n") and not t.lower().startswith("0x") or t.endswith("n") else "NumericLiteral")
        if self.kind == "str":
            return self.literal("StringLiteral", unquote(t))
        if self.kind == "id":
            if t in ("true", "false"):
                return self.literal("BooleanLiteral")
            if t == "null":
                return self.literal("NullLiteral")
            if t in ("this", "super"):
                return self.literal("ThisExpression" if t == "this" else "Super")
            if t == "function" or t == "async" and self.follows()[1] == "function" and not self.follows()[2]:
                return self.function(Node("", start), "FunctionExpression")
            if t == "class":
                return self.klass(Node("", start), "ClassExpression")
            if t == "import":
                self.next()
                if self.eat("."):
                    n = Node("MetaProperty", start, name=f"import.{self.next()}")
                    return self.done(n)
                if not self.at("("):
                    raise self.error()
                return self.done(Node("Import", start))
            return self.identifier()
        if t == "(" and self.kind == "op":
            self.next()
            e = self.expression()
            self.need(")")
            e.flags.add("paren")
            return e
        if t == "[":
            n = Node("ArrayExpression", start)
            self.next()
            while not self.eat("]"):
                n.add("element", Node("Hole", self.start, self.start) if self.at(",") else self.element())
                if not self.at("]"):
                    self.need(",")
            return self.done(n)
        if t == "{":
            return self.object()
        if t == "`":
            return self.template()
        if t in ("/", "/="):
            m = _REGEX.match(self.s, start)
            if m is None:
                raise self.error("Unterminated regular expression")
            self.last = m.end()
            self.go(m.end())
            return Node("RegExpLiteral", start, m.end(), value=m.group(1), op=m.group(2))
        if t == "<":
            return self.jsx()
        raise self.error()

    def object(self) -> Node:
        n = Node("ObjectExpression", self.start)
        self.next()
        while not self.eat("}"):
            if self.at("..."):
                n.add("property", self.element())
            else:
                p = Node("ObjectProperty", self.start)
                self.modifiers(p, ("async", "get", "set"))
                self.key(p)
                if self.at("("):
                    p.type, p.op = "ObjectMethod", p.op or "method"
                    n.add("property", self.rest_of_function(p))
                elif p.op or p.flags & {"async", "generator"}:
                    raise self.error()
                else:
                    if self.eat(":"):
                        p.add("value", self.assignment())
                    else:
                        self.shorthand(p)
                    n.add("property", self.done(p))
            if not self.at("}"):
                self.need(",")
        return self.done(n)

    # JSX: names, texts and strings are read from the source itself

    def jsx_name(self) -> str:
        m = _JSX_NAME.match(self.s, self.start)
        if m is None:
            raise self.error()
        self.last = m.end()
        self.go(m.end())
        return m.group()

    def jsx_element_name(self) -> str:
        name = self.jsx_name()
        while self.at(".", ":"):
            name += self.next() + self.jsx_name()
        return name

    def jsx(self) -> Node:
        """An element or fragment; the next token is '<'. Afterwards the token after it is read."""
        n = self.jsx_inner()
        self.go(n.end)
        self.last = n.end
        return n

    def jsx_inner(self) -> Node:
        start = self.start
        self.next()
        if self.at(">"):
            n, name = Node("JSXFragment", start), None
            return self.jsx_children(n, name)
        n, opening = Node("JSXElement", start), Node("JSXOpeningElement", start)
        at = self.start
        name = n.name = opening.name = self.jsx_element_name()
        opening.add("name", Node("JSXIdentifier", at, self.last, name=name.split(".")[0].split(":")[0]))
        n.add("openingElement", opening)
        while not self.at(">", "/"):
            a = Node("JSXAttribute", self.start)
            if self.eat("{"):
                a.type = "JSXSpreadAttribute"
                self.need("...")
                a.add("argument", self.assignment())
                self.need("}")
            else:
                a.name = self.jsx_name()
                if self.at(":"):
                    a.name += self.next() + self.jsx_name()
                if self.at("="):
                    at = _SPACE.match(self.s, self.end).end()
                    text = _JSX_STRING.match(self.s, at)
                    if text:
                        a.add("value", Node("StringLiteral", at, text.end(), value=text.group()[1:-1]))
                        self.last = text.end()
                        self.go(text.end())
                    else:
                        self.next()
                        if self.at("{"):
                            a.add("value", self.jsx_container(False))
                        elif self.at("<"):
                            a.add("value", self.jsx())
                        else:
                            raise self.error()
            opening.add("attribute", self.done(a))
        if self.eat("/"):
            if not self.at(">"):
                raise self.error()
            opening.end = n.end = self.end
            opening.flags.add("selfClosing")
            return n
        opening.end = self.end
        return self.jsx_children(n, name)

    def jsx_container(self, child: bool) -> Node:
        """{...}; the token after it is read only outside of an element's children."""
        n = Node("JSXExpressionContainer", self.start)
        self.next()
        if self.at("}"):
            n.add("expression", Node("JSXEmptyExpression", self.start, self.start))
        elif child and self.at("..."):
            n.type = "JSXSpreadChild"
            self.next()
            n.add("expression", self.expression())
        else:
            n.add("expression", self.expression())
        if not self.at("}"):
            raise self.error()
        n.end = self.end
        if not child:
            self.next()
        return n

    def jsx_children(self, n: Node, name: str | None) -> Node:
        at = self.end
        while True:
            text = _JSX_TEXT.match(self.s, at)
            if text:
                n.add("child", Node("JSXText", at, text.end(), value=text.group()))
                at = text.end()
            if at >= len(self.s) or self.s[at] in "}>":
                self.go(at)
                raise self.error()
            if self.s[at] == "{":
                self.go(at)
                n.add("child", self.jsx_container(True))
                at = self.end
                continue
            self.go(at)
            if self.follows()[1] == "/":
                self.next()
                self.next()
                closing = None if self.at(">") else self.jsx_element_name()
                if closing != name or not self.at(">"):
                    raise self.error(f"Expected the closing tag of <{name or ''}>")
                n.end = self.end
                return n
            kid = self.jsx_inner()
            n.add("child", kid)
            at = kid.end


_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}


def unquote(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m.group(1) or m.group(2) or m.group(3)
        if code is None:
            return _PLAIN.get(m.group(4), m.group(4))
        n = int(code, 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"

    return _ESCAPE.sub(one, text[1:-1]) if "\\" in text else text[1:-1]


def parse(source: str) -> tuple[Node, Parser]:
    """The tree and the parser, which knows positions. Raises JavaScriptError."""
    p = Parser(source)
    try:
        return p.program(), p
    except RecursionError:
        raise JavaScriptError("Nested too deeply", 1, 0) from None
