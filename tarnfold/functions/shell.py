"""Shell lines as the commands that they run, and forms that run what is not written as a command."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms that are never approved without asking.
DANGEROUS = {
    "a parameter expanded by an operator that may evaluate it": r"\$\{[^}]*@[PQEAa][^}]*\}",
    "a default or an assignment with an octal escape": r"\$\{[^}]*[=+\-?][^}]*\\[0-7]{3}[^}]*\}",
    "a default or an assignment with a hexadecimal escape": r"\$\{[^}]*[=+\-?][^}]*\\x[0-9a-fA-F]{2}[^}]*\}",
    "a default or an assignment with a Unicode escape": r"\$\{[^}]*[=+\-?][^}]*\\u[0-9a-fA-F]{4}[^}]*\}",
    "a parameter named by another": r"\$\{![^}]+\}",
    "a here-string with a substitution": r"<<<\s*(\$\(|`)",
    "a process as a file, but no array": r"(?:^|[\s;|&(<])=\([^)]+\)",
    "a glob with code": r"[*?+@!]\(e:[^:]+:\)",
}
REDIRECTION = r"[0-9]*>&[0-9]*"


def dangerous(command: Column) -> Column:
    """Whether any of the forms stands in a command line."""
    out = F.lit(False)
    for pattern in DANGEROUS.values():
        out = out | command.rlike(pattern)
    return out


def closing(line: str, start: int, opened: str, closed: str) -> int:
    """Where the bracket that is open before start ends; the end of the line if it does not. Quotes and escapes are skipped."""
    depth, i, quote = 1, start, ""
    while i < len(line):
        c = line[i]
        if c == "\\" and quote != "'":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == opened:
            depth += 1
        elif c == closed:
            depth -= 1
            if not depth:
                return i
        i += 1
    return i


def commands_of_line(line: str) -> list[str]:
    """The commands that one line runs, those inside substitutions too, each as it is written.

    `&&`, `||`, `;`, `|` and `&` part commands outside of quotes, brackets of expansions and arithmetic; what stands in
    `$( )`, backticks, `<( )` and `>( )` is a command of its own, also within double quotes, and parts those around it
    where it stands outside of them.
    """
    out: list[str] = []
    inner: list[str] = []
    own, quote, i = "", "", 0

    def flush() -> None:
        nonlocal own
        if own.strip():
            out.append(own.strip())
        out.extend(inner)
        inner.clear()
        own = ""

    while i < len(line):
        c, two = line[i], line[i : i + 2]
        end = None
        if quote == "'":
            quote = "" if c == "'" else quote
        elif c == "\\":
            own, i = own + c, i + 1
            c = line[i : i + 1]
        elif line.startswith("$((", i):
            end = closing(line, i + 2, "(", ")")
            own, i = own + line[i : end + 1], end + 1
            continue
        elif two == "$(" or two in ("<(", ">(") and not quote:
            end = closing(line, i + 2, "(", ")")
            inside = line[i + 2 : end]
        elif c == "`":
            end = line.find("`", i + 1)
            end = len(line) if end < 0 else end
            inside = line[i + 1 : end]
        elif two in ("${", "$["):
            end = closing(line, i + 2, two[1], "}" if two[1] == "{" else "]")
            own, i = own + line[i : end + 1], end + 1
            continue
        elif quote:
            quote = "" if c == '"' else quote
        elif c in "'\"":
            quote = c
        elif m := re.compile(REDIRECTION).match(line, i):
            own, i = own + m[0], m.end()
            continue
        elif c in ";|&":
            flush()
            i += 2 if two in ("&&", "||") else 1
            continue
        if end is not None:
            inner += commands_of_line(inside)
            if quote:
                own += line[i : end + 1]
            else:
                flush()
            i = end + 1
            continue
        own += c
        i += 1
    flush()
    return out


def commands(text: str) -> list[str]:
    """The commands of all lines."""
    return [c for line in re.split(r"\r\n|\r|\n", text) for c in commands_of_line(line)]
