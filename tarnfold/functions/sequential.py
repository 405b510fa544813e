"""Algorithms over one text that go step by step: small helpers for Arrow-batched functions."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F


def text_udf(f, returns: str = "string"):
    """A column function from one of plain Python values; null in, null out."""

    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def carriage_returns(text: str) -> str:
    """What a terminal shows: after a carriage return, characters are written over those of the line."""
    out = []
    for line in text.split("\n"):
        shown: list[str] = []
        for part in line.split("\r"):
            shown[: len(part)] = part
        out.append("".join(shown))
    return "\n".join(out)


def backspaces(text: str) -> str:
    out: list[str] = []
    for c in text:
        if c != "\b":
            out.append(c)
        elif out:
            out.pop()
    return "".join(out)


def run_lengths(text: str) -> str:
    """Repeated lines as one and a note, where that is shorter."""
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        n = 1
        while i + n < len(lines) and lines[i + n] == lines[i]:
            n += 1
        note, last = f"<previous line repeated {n - 1} additional times>", i + n == len(lines)
        saved = len(lines[i]) + (0 if last else 1)
        out += [lines[i], note] if n > 1 and len(note) < saved * (n - 1 if last else n) else [lines[i]] * n
        i += n
    return "\n".join(out)


def unified(s: str) -> str:
    for c, to in {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " "}.items():
        s = s.replace(c, to)
    return s.strip()


def seek(lines: list[str], pattern: list[str], start: int = 0, eof: bool = False) -> int | None:
    """Where the pattern's lines begin: exactly, then without trailing space, trimmed, and with plain characters."""
    if not pattern:
        return start
    if len(pattern) > len(lines):
        return None
    first = len(lines) - len(pattern) if eof else start
    for same in (lambda a: a, str.rstrip, str.strip, unified):
        want = [same(p) for p in pattern]
        for i in range(first, len(lines) - len(pattern) + 1):
            if [same(x) for x in lines[i : i + len(pattern)]] == want:
                return i
    return None


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two texts: a column of the table at a time, as the bits of numbers.

    A bit says whether the table rises (up) or falls (down) from one row to the next in the column.
    """
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    last, up, down, out = 1 << (len(a) - 1), full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        flat = ((((same & up) + up) ^ up) | same | down) & full
        higher, lower = down | ~(flat | up) & full, up & flat
        out += bool(higher & last) - bool(lower & last)
        higher = (higher << 1 | 1) & full
        lower = lower << 1 & full
        up, down = lower | ~(same | down | higher) & full, higher & (same | down)
    return out


def plain(text: str) -> str:
    return re.sub(r"\s+", " ", unified(text))


def likeness(a: str, b: str) -> float:
    if not b:
        return 0.0
    a, b = plain(a), plain(b)
    return 1.0 if a == b else 1 - edit_distance(a, b) / max(len(a), len(b))


def letters(text: str) -> Counter:
    return Counter("".join(unified(text).split()))


def most_alike(lines: list[str], n: int, chunk: str) -> list[float]:
    """For every start of a window of n lines, or what is left of them, a bound that its likeness to the chunk does not exceed.

    What one side has more of a letter than the other takes at least as many edits; white space is left out, which
    takes none more. Letters of windows are kept up from one to the next.
    """
    short, size = letters(chunk), len(plain(chunk))
    each = [letters(x) for x in lines]
    longest, out = [len(x) + 1 for x in lines], []
    more = Counter(short)  # what the chunk has more than the window; below 0: less
    for x in each[:n]:
        more.subtract(x)
    lacks, has = sum(v for v in more.values() if v > 0), -sum(v for v in more.values() if v < 0)
    total = sum(longest[:n])

    def move(x: Counter, sign: int) -> None:
        nonlocal lacks, has
        for c, k in x.items():
            old = more[c]
            new = more[c] = old + sign * k
            lacks += max(new, 0) - max(old, 0)
            has += max(-new, 0) - max(-old, 0)

    for i in range(len(lines)):
        out.append(1 - max(lacks, has) / max(total, size, 1))
        move(each[i], 1)
        total -= longest[i]
        if i + n < len(lines):
            move(each[i + n], -1)
            total += longest[i + n]
    return out


def middle_out(lines: list[str], chunk: list[str], first: int = 0, last: int | None = None) -> tuple[float, int]:
    """(best likeness, where) of a chunk's window between first and last; -1 where nothing is alike at all.

    Of equal windows the one counts that comes first from the middle outwards, the earlier side before the later. The
    middle is that of the lines, so on the earlier side windows may reach over the end, with fewer lines.

    Windows are compared in the order of a bound on their likeness, until it is under the best one found.
    """
    last, n, text = len(lines) if last is None else last, len(chunk), "\n".join(chunk)
    if not text:
        return 0.0, -1
    middle = (first + last) // 2
    turn = {i: 2 * (middle - i) if i <= middle else 2 * (i - middle) - 1 for i in [*range(first, min(middle + 1, len(lines))), *range(middle + 1, last - n + 1)]}
    bound, best, where = most_alike(lines, n, text), 0.0, -1
    for i in sorted(turn, key=lambda i: -bound[i]):
        if bound[i] < best - 1e-12:
            break
        score = likeness("\n".join(lines[i : i + n]), text)
        if score > best or score == best > 0 and turn[i] < turn[where]:
            best, where = score, i
    return best, where


def shell_parts(command: str) -> list[str]:
    """Commands of a shell line, split at && || ; | & and line breaks outside quotes, brackets and substitutions."""
    out, own, depth, quote, i = [], "", 0, "", 0
    while i < len(command):
        c = command[i]
        if quote:
            own += c
            if c == "\\" and quote == '"' and i + 1 < len(command):
                own, i = own + command[i + 1], i + 1
            elif c == quote:
                quote = ""
        elif c == "\\" and i + 1 < len(command):
            own, i = own + c + command[i + 1], i + 1
        elif c in "'\"`":
            quote, own = c, own + c
        elif c in "({":
            depth, own = depth + 1, own + c
        elif c in ")}":
            depth, own = max(0, depth - 1), own + c
        elif depth == 0 and c in ";|&\n" and not (c == "&" and (own.endswith(">") or command[i + 1 : i + 2] == ">")):
            out.append(own.strip())
            own = ""
        else:
            own += c
        i += 1
    return [x for x in [*out, own.strip()] if x]


def command_patterns(command: str) -> list[str]:
    """First words of each part, with up to two further ones that are no options, paths or numbers."""
    found = set()
    for part in shell_parts(command):
        words = part.split()
        if not words or words[0].isdigit():
            continue
        found.add(words[0])
        for n, w in enumerate(words[1:3], 2):
            if not re.fullmatch(r"[A-Za-z][\w:-]*", w):
                break
            found.add(" ".join(words[:n]))
    return sorted(found)


def with_indentation(lines: list[str], anchor: int, levels: int, size: int = 4) -> tuple[int, int]:
    """Rows [first, last] around an anchor (from 0) whose indentation is at most `levels` less than the anchor's; blank
    rows have the level of the row before."""
    level, last = [], 0
    for line in lines:
        if line.strip():
            last = (len(line.expandtabs(size)) - len(line.expandtabs(size).lstrip())) // size
        level.append(last)
    least = max(0, level[anchor] - levels)
    a = b = anchor
    while a > 0 and level[a - 1] >= least:
        a -= 1
    while b + 1 < len(lines) and level[b + 1] >= least:
        b += 1
    return a, b


def delta(old: str, new: str) -> str:
    """The new text's part after the common start and before the common end, if nothing else changed; else all of it."""
    a = 0
    while a < min(len(old), len(new)) and old[a] == new[a]:
        a += 1
    b = 0
    while b < min(len(old), len(new)) - a and old[-1 - b] == new[-1 - b]:
        b += 1
    return new[a : len(new) - b] if a + b == len(old) else new


def apply_replacements(lines: list[str], changes: list[tuple[int, int, list[str]]]) -> list[str]:
    """Changes (first row from 0, rows, new lines) in the order of their rows, each moved by what those before added."""
    out, moved = list(lines), 0
    for start, n, new in sorted(changes, key=lambda c: c[0]):
        out[start + moved : start + moved + n] = new
        moved += len(new) - n
    return out


class CachePoints:
    """Rows of users up to which a growing conversation is cached: at most `most`, each for `least` tokens or more.

    Earlier points stay where they are, as what they cover is cached. New rows get a point of their own while there are
    points left; then the two neighbouring stretches with the fewest tokens become one, if the new rows have 1.2 times
    their tokens.
    """

    GAIN = 1.2

    def __init__(self, tokens: list[int], roles: list[str], most: int, least: int):
        self.roles, self.most, self.least = roles, most, least
        self.sums = [0, *itertools.accumulate(tokens)]

    def tokens(self, first: int, end: int) -> int:
        """Of the rows first to end - 1."""
        return self.sums[end] - self.sums[first] if end > first else 0

    def point(self, first: int, last: int, before: list[int]) -> list[int]:
        """The last user's row from first to last, if what it covers after the point before is enough; of one row alone none."""
        users = [i for i in range(first, last + 1) if self.roles[i] == "user"] if first < last else []
        start = max((p for p in before if p < first), default=-1) + 1
        return users[-1:] if users and self.tokens(start, users[-1] + 1) >= self.least else []

    def place(self, before: list[int]) -> list[int]:
        """The points after those of the last time (none: the first time)."""
        n = len(self.roles)
        if n < 2:
            return []
        if not before:
            return self.point(0, n - 1, [])[: self.most]  # after the last user's row no other user comes
        rest, fresh = [p for p in before if p < n], self.tokens(before[-1] + 1, n)
        if fresh < self.least:
            return rest
        new = self.point(before[-1] + 1, n - 1, before)
        if self.most > len(before):
            return rest + new
        stretches = [self.tokens(a + 1, b + 1) for a, b in itertools.pairwise([-1, *before])]
        pairs = [a + b for a, b in itertools.pairwise(stretches)]
        if not pairs or fresh < self.GAIN * min(pairs):
            return rest
        k = pairs.index(min(pairs))
        joined = self.point(before[k - 1] + 1 if k else 0, before[k + 1], before)
        out = [p for p in before[:k] if p < n] + joined + [p for p in before[k + 2 :] if p < n]
        return out + new if len(out) < self.most else out


def cache_points(tokens: list[int], roles: list[str], most: int, least: int, before: list[int] | None = None) -> list[int]:
    return CachePoints(tokens, roles, most, least).place(before or [])
