"""What only the tree and the source of a file tell: abrupt statements, faults of literals, line breaks between tokens. Each is a flag of its node."""

from __future__ import annotations

import re

from loomspark.frontend.javascript import _SPACE, Node

JUMPS = {"ReturnStatement", "ThrowStatement", "BreakStatement", "ContinueStatement"}
LOOPS = {"ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement"}
HOLDERS = {"FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "ObjectMethod", "ClassMethod", "ClassPrivateMethod", "ClassDeclaration", "ClassExpression"}
#: Types of which flags_of tells something, besides statements.
NOTED = {"RegExpLiteral", "NewExpression", "CallExpression", "NumericLiteral", "MemberExpression", "TaggedTemplateExpression", "BinaryExpression"}
_FALLS = re.compile(r"falls?\s?through", re.IGNORECASE)
_ONE_CHAR = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]+)\}|\\[\s\S]|[\x00-\x1f]")


def _left(n: Node, types: set[str], label: str | None, deep: bool = False) -> bool:
    """Whether a jump of the types leaves n itself, or the statement with this label; deep: inside another loop or switch that takes jumps without a label."""
    for _, k in n.kids:
        if k.type in types and (k.name == label if k.name else not deep):
            return True
        if k.type not in HOLDERS and _left(k, types, label, deep or k.type in LOOPS or k.type == "SwitchStatement" and types == {"BreakStatement"}):
            return True
    return False


def abrupt(n: Node, memo: dict[int, bool], label: str | None = None) -> bool:
    """Whether the statement never lets the next one begin."""
    known = memo.get(id(n))
    if known is None:
        known = memo[id(n)] = _abrupt(n, memo, label)
    return known


def _abrupt(n: Node, memo: dict[int, bool], label: str | None) -> bool:
    one = lambda role: (k := n.get(role)) is not None and abrupt(k, memo)
    if n.type in JUMPS:
        return True
    if n.type == "BlockStatement":
        return any(abrupt(k, memo) for k in n.all("body"))
    if n.type == "IfStatement":
        return one("consequent") and one("alternate")
    if n.type == "LabeledStatement":
        body = n.get("body")
        return body is not None and abrupt(body, memo, n.name) and not _left(n, {"BreakStatement"}, n.name, True)
    if n.type == "TryStatement":
        handler = n.get("handler")
        return one("finalizer") or one("block") and (handler is None or abrupt(handler.get("body") or handler, memo))
    if n.type in LOOPS:
        test = n.get("test")
        endless = n.type in ("WhileStatement", "DoWhileStatement") and test is not None and test.value in ("true", "1") or n.type == "ForStatement" and (test is None or test.value in ("true", "1"))
        if n.type == "DoWhileStatement" and one("body") and not _left(n, {"BreakStatement", "ContinueStatement"}, label):
            return True
        return endless and not _left(n, {"BreakStatement"}, label)
    if n.type == "SwitchStatement":
        cases = n.all("case")
        return bool(cases) and any(c.get("test") is None for c in cases) and any(abrupt(k, memo) for k in cases[-1].all("consequent")) and not _left(n, {"BreakStatement"}, label)
    return False


def regex_fault(pattern: str, flags: str = "") -> str | None:
    """Why the pattern or the flags make no regular expression, as far as structure tells; names and ranges of properties are not checked."""
    if len(set(flags)) < len(flags) or set(flags) - set("dgimsuyv") or {"u", "v"} <= set(flags):
        return f"Invalid flags supplied to RegExp constructor '{flags}'"
    fault = lambda why: f"Invalid regular expression: /{pattern}/{flags}: {why}"
    strict, depth, i, atom, names = bool(set(flags) & {"u", "v"}), 0, 0, False, set()
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "\\":
            if i == len(pattern):
                return fault("\\ at end of pattern")
            i, atom = i + 1, pattern[i] not in "bB"
        elif c == "[":
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            if i >= len(pattern):
                return fault("Unterminated character class")
            i, atom = i + 1, True
        elif c == "(":
            depth, atom = depth + 1, False
            if pattern.startswith("?", i):
                m = re.compile(r"\?(?::|=|!|<=|<!|<([^>=!][^>]*)>|[ims]*(?:-[ims]*)?:)").match(pattern, i)
                if not m:
                    return fault("Invalid group")
                if m.group(1):
                    if not re.fullmatch(r"[$_\w]+", m.group(1)) or m.group(1)[0].isdigit():
                        return fault("Invalid capture group name")
                    if m.group(1) in names and "|" not in pattern:
                        return fault("Duplicate capture group name")
                    names.add(m.group(1))
                i = m.end()
        elif c == ")":
            if not depth:
                return fault("Unmatched ')'")
            depth, atom = depth - 1, True
        elif c in "*+?" or c == "{" and re.compile(r"\d+(?:,\d*)?\}").match(pattern, i):
            if not atom:
                return fault("Nothing to repeat")
            if c == "{":
                low, _, high = pattern[i : pattern.index("}", i)].partition(",")
                if high and int(high) < int(low):
                    return fault("numbers out of order in {} quantifier")
                i = pattern.index("}", i) + 1
            i, atom = i + pattern.startswith("?", i), False
        elif c in "{}]" and strict:
            return fault("Lone quantifier brackets")
        else:
            atom = c not in "|^$"
    return fault("Unterminated group") if depth else None


def control_characters(pattern: str, flags: str = "") -> str:
    """Control characters that stand in the pattern or are written by number, each once, in order."""
    found = []
    for m in _ONE_CHAR.finditer(pattern):
        code = next((int(g, 16) for g in m.groups() if g), None) if m.lastindex else ord(m.group()) if len(m.group()) == 1 else None
        if code is not None and code < 32 and (not m.group(3) or set(flags) & {"u", "v"}):
            found.append(f"\\x{code:02x}")
    return ", ".join(dict.fromkeys(found))


def loses_precision(raw: str) -> bool:
    """Whether a number literal stands for another value than it says."""
    raw = raw.replace("_", "").lower()
    if raw[:2] in ("0x", "0o", "0b") or re.fullmatch(r"0[0-7]+", raw):
        value = int(raw, 0) if raw[1:2].isalpha() else int(raw, 8)
        return value.bit_length() > 1023 or int(float(value)) != value
    digits = raw.partition("e")[0]
    whole, _, part = digits.partition(".")
    said = (whole + part).lstrip("0")
    if not said.rstrip("0"):
        return False
    if "." not in digits:
        said = said.rstrip("0")
    value = float(raw)
    if value in (float("inf"), 0.0) or len(said) > 100:
        return True
    return f"{value:.{len(said) - 1}e}".split("e")[0].replace(".", "").rstrip("0") != said.rstrip("0")


def between(source: str, at: int, token: str) -> int:
    """Where the next such token stands after white space, comments and closing parentheses; -1 if another comes first."""
    while True:
        at = _SPACE.match(source, at).end()
        if source.startswith(token, at):
            return at
        if not source.startswith(")", at):
            return -1
        at += 1


def _breaks(source: str, end: int, token: str) -> bool:
    """Whether a line break stands between the token before, at end or a closing parenthesis after it, and the token."""
    at = between(source, end, token)
    if at < 0:
        return False
    before = source[end:at]
    return "\n" in before[before.rfind(")") + 1 :]


def flags_of(n: Node, parent: Node | None, source: str, memo: dict[int, bool]) -> set[str]:
    if n.type not in NOTED and not n.type.endswith("Statement"):
        return set()
    out = set()
    if n.type.endswith("Statement") and abrupt(n, memo):
        out.add("abrupt")
    if n.type == "SwitchStatement":
        cases = n.all("case")
        for c, following in zip(cases, cases[1:], strict=False):
            body = c.all("consequent")
            tail = body[-1].end if body else c.end
            inner = source[max(tail - 200, body[-1].start) : tail] if body and body[-1].type == "BlockStatement" else ""
            if body and not any(abrupt(k, memo) for k in body) and not _FALLS.search(source[tail : following.start]) and not _FALLS.search(inner.rpartition(";")[2]):
                following.flags.add("fallen-into")
    if n.type == "RegExpLiteral":
        found = control_characters(n.value or "", n.op or "")
        out |= {f"control:{found}"} if found else set()
    if n.type in ("NewExpression", "CallExpression") and (callee := n.get("callee")) is not None and callee.type == "Identifier" and callee.name == "RegExp":
        given = n.all("argument")
        if given and given[0].type == "StringLiteral":
            flags = given[1].value if len(given) > 1 and given[1].type == "StringLiteral" else ""
            why = regex_fault(given[0].value or "", flags or "")
            found = control_characters(given[0].value or "", flags or "")
            out |= ({f"regex:{why}"} if why else set()) | ({f"control:{found}"} if found else set())
    if n.type == "NumericLiteral" and loses_precision(n.value or "0"):
        out.add("imprecise")
    if n.type == "CallExpression" and n.all("argument") and _breaks(source, n.get("callee").end, "("):
        out.add("newline:between function and ( of function call")
    if n.type == "MemberExpression" and "computed" in n.flags and _breaks(source, n.get("object").end, "["):
        out.add("newline:between object and [ of property access")
    if n.type == "TaggedTemplateExpression" and "\n" in source[n.get("tag").end : n.get("quasi").start]:
        out.add("newline:between template tag and template literal")
    if n.type == "BinaryExpression" and n.op == "/" and (left := n.get("left")) is not None and left.type == "BinaryExpression" and left.op == "/":
        numerator, right = left.get("left"), n.get("right")
        if re.match(r"[gimsuy]+\b", source[right.start : right.start + 8]) and source[right.start - 1] == "/" and _breaks(source, numerator.end, "/"):
            out.add("newline:between numerator and division operator")
    return out
