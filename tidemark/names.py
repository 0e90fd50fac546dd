"""View names with column lists, such as `mv(a, "B c")`."""

from __future__ import annotations

import re

from .errors import EngineError

TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")+)"|([^\W\d][\w$]*)|(.))', re.S)


def parse(text: str) -> tuple[str, list[str]]:
    """The name (schema-qualified names keep their dot) and the listed columns, none if no list."""
    tokens = [(m[1].replace('""', '"') if m[1] else m[2] and m[2].lower(), m[3]) for m in TOKEN.finditer(text.strip())]
    at = 0

    def name() -> str:
        nonlocal at
        if at >= len(tokens) or tokens[at][0] is None:
            raise EngineError("invalid name syntax")
        at += 1
        return tokens[at - 1][0]

    def sign(x: str) -> bool:
        nonlocal at
        if at < len(tokens) and tokens[at][1] == x:
            at += 1
            return True
        return False

    full = [name()]
    while sign("."):
        full.append(name())
    columns: list[str] = []
    if sign("("):
        if sign(")"):
            raise EngineError("must specify at least one column name")
        columns.append(name())
        while sign(","):
            columns.append(name())
        if not sign(")"):
            raise EngineError("expected a right parenthesis")
    if at < len(tokens):
        raise EngineError("invalid name syntax")
    return ".".join(full), columns


def quoted(x: str) -> str:
    """x as parse() reads it back."""
    return x if re.fullmatch(r"[a-z_][a-z0-9_$]*", x) else '"' + x.replace('"', '""') + '"'


CALL = re.compile(r"\s*select\s+(?:\w+\.)?(\w+)\s*\((.*)\)\s*;?\s*", re.I | re.S)
ARGUMENT = re.compile(r"\s*(?:'((?:[^']|'')*)'|(true|false))\s*(,|$)", re.I)


def call(command: str) -> tuple[str, list]:
    """The function and arguments (strings, true, false) of `SELECT f('a', true);`."""
    m = CALL.fullmatch(command)
    if not m:
        raise EngineError("no command")
    args, at, text = [], 0, m[2]
    while at < len(text):
        a = ARGUMENT.match(text, at)
        if not a:
            raise EngineError("no command")
        args.append(a[2].lower() == "true" if a[2] else a[1].replace("''", "'"))
        at = a.end()
    return m[1].lower(), args
