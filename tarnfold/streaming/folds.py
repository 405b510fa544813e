"""Folds over ordered events of a key, for logs (replay) and for streams (follow) alike.

A fold is a function (state, event) -> (state, outputs), with a JSON-like state, events as dicts and outputs as tuples.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnfold.functions.sequential import delta

Fold = Callable[[Any, dict], tuple[Any, list[tuple]]]


def replay(log: DataFrame, keys: list[str], fold: Fold, schema: str, start: Any = None, order: str = "seq") -> DataFrame:
    """The fold's outputs over a whole log, key by key: keys, then the schema's columns.

    A key's events stream in order through one task, which holds its state and a batch of events, however many there are.
    """
    names = keys + [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for event in b.to_dict("records"):
                key = tuple(None if pd.isna(event[k]) else event[k] for k in keys)
                if key != last:
                    last, state = key, json.loads(json.dumps(start))
                state, rows = fold(state, event)
                out += [(*key, *r) for r in rows]
            yield pd.DataFrame(out, columns=names)

    types = dict(log.dtypes)
    ordered = log.repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last())
    return ordered.mapInPandas(run, ", ".join([f"{k} {types[k]}" for k in keys]) + ", " + schema)


def follow(stream: DataFrame, keys: list[str], fold: Fold, schema: str, start: Any = None, order: str = "seq", idle_ms: int | None = None) -> DataFrame:
    """The same over a stream, its state kept between batches; with idle_ms, a key's state goes after so long without events."""
    names = keys + [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(start))
        events = pd.concat(list(batches)).sort_values(order).to_dict("records")
        out = []
        for event in events:
            now, rows = fold(now, event)
            out += [(*key, *r) for r in rows]
        state.update((json.dumps(now),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    types = dict(stream.dtypes)
    full = ", ".join([f"{k} {types[k]}" for k in keys]) + ", " + schema
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, full, "state string", "append", timeout)


def lifecycle(state: Any, e: dict) -> tuple[Any, list[tuple]]:
    """Task states from started, aborted, completed and timeout events; a final state stays. Output: seq, state."""
    final = {"taskAborted": "aborted", "taskCompleted": "finished", "timeout": "timed out"}
    old = state
    if state not in final.values():
        state = final.get(e["event_name"], "running" if e["event_name"] == "taskStarted" else state)
    return state, [(e["seq"], state)] if state != old else []


def deduper(most: int = 10_000) -> Fold:
    """Passes a message (ts, payload) unless it is the last payload of its ts; the oldest of too many ts are forgotten."""

    def fold(state: Any, e: dict) -> tuple[Any, list[tuple]]:
        seen = state or {}
        key = str(e["ts"])
        if seen.get(key) == e["payload"]:
            return seen, [(e["seq"], False)]
        seen.pop(key, None)
        seen[key] = e["payload"]
        while len(seen) > most:
            del seen[next(iter(seen))]
        return seen, [(e["seq"], True)]

    return fold


def throttle(gap_ms: int) -> Fold:
    """The first value at once, then changed values at most every gap; a held one comes with the next event past the gap."""

    def fold(state: Any, e: dict) -> tuple[Any, list[tuple]]:
        s = state or {"at": None, "sent": None, "held": None}
        out = []
        if s["held"] is not None and e["ts"] >= s["at"] + gap_ms:
            if s["held"] != s["sent"]:
                out.append((s["at"] + gap_ms, s["held"]))
            s = {"at": s["at"] + gap_ms, "sent": s["held"], "held": None}
        if s["at"] is None or e["ts"] >= s["at"] + gap_ms:
            if e["payload"] != s["sent"]:
                out.append((e["ts"], e["payload"]))
                s = {"at": e["ts"], "sent": e["payload"], "held": None}
        else:
            s["held"] = e["payload"]
        return s, out

    return fold


def text_delta(state: Any, e: dict) -> tuple[Any, list[tuple]]:
    """What a growing text adds: the rest after the old text, or all of it if it does not begin with that."""
    old, new = state or "", e["payload"] or ""
    return new, [(e["seq"], new[len(old) :] if new.startswith(old) else new)]


def structured_delta(state: Any, e: dict) -> tuple[Any, list[tuple]]:
    old, new = state or "", e["payload"] or ""
    return new, [(e["seq"], delta(old, new))]


def lines(state: Any, e: dict) -> tuple[Any, list[tuple]]:
    """Whole lines of chunks; what has no line break yet waits. An event whose payload is null ends the text."""
    if e["payload"] is None:
        return "", [(e["seq"], state)] if state else []
    *full, rest = ((state or "") + e["payload"]).split("\n")
    return rest, [(e["seq"], x) for x in full]


def tool_calls(state: Any, e: dict) -> tuple[Any, list[tuple]]:
    """Streamed tool calls of one index (id, name, arguments, done): start once the name is known, then arguments, then end."""
    s = state or {"id": None, "name": None, "held": "", "open": False}
    s["id"], s["name"] = s["id"] or e["id"], s["name"] or e["name"]
    out, args = [], e["arguments"] or ""
    if not s["open"] and s["id"] and s["name"]:
        out.append((e["seq"], "start", s["name"]))
        s["open"], args, s["held"] = True, s["held"] + args, ""
    if args and s["open"]:
        out.append((e["seq"], "delta", args))
    elif args:
        s["held"] += args
    if e["done"]:
        if s["open"]:
            out.append((e["seq"], "end", s["name"]))
        s = None
    return s, out


def tagged(tag: str) -> Fold:
    """Text chunks as stretches inside and outside a tag; a mark may be cut anywhere. Output: seq, inside, text."""
    marks = (f"<{tag}>", f"</{tag}>")

    def fold(state: Any, e: dict) -> tuple[Any, list[tuple]]:
        s = state or {"inside": False, "held": ""}
        text, out = s["held"] + (e["payload"] or ""), []
        while True:
            mark = marks[s["inside"]]
            before, found, after = text.partition(mark)
            if not found:
                break
            if before:
                out.append((e["seq"], s["inside"], before))
            s["inside"], text = not s["inside"], after
        keep = next((n for n in range(min(len(mark) - 1, len(text)), 0, -1) if mark.startswith(text[-n:])), 0)
        if e["payload"] is None:
            keep = 0
        if text[: len(text) - keep]:
            out.append((e["seq"], s["inside"], text[: len(text) - keep]))
        s["held"] = text[len(text) - keep :]
        return s, out

    return fold


def tagged_in_lines(tag: str) -> Fold:
    """Stretches that are closed in the line in which they begin; any other mark is text like the rest. Output: seq, inside, text.

    What may still become a stretch waits, until its line ends. An event whose payload is null ends the text.
    """
    begin, end = f"<{tag}>", f"</{tag}>"

    def fold(state: Any, e: dict) -> tuple[Any, list[tuple]]:
        text, out = (state or "") + (e["payload"] or ""), []
        plain, at = "", 0  # text[at:] is to be read
        while (found := text.find(begin, at)) >= 0:
            plain, at = plain + text[at:found], found
            line = text.find("\n", at)
            close = text.find(end, at + len(begin), line if line >= 0 else len(text))
            if close >= 0:
                out += [(e["seq"], False, plain), (e["seq"], True, text[at + len(begin) : close])]
                plain, at = "", close + len(end)
            elif line >= 0:
                plain, at = plain + text[at : line + 1], line + 1
            else:
                break
        if e["payload"] is None:
            keep = 0
        elif found >= 0:
            keep = len(text) - at
        else:
            keep = next((n for n in range(min(len(begin) - 1, len(text) - at), 0, -1) if begin.startswith(text[-n:])), 0)
        out.append((e["seq"], False, plain + text[at : len(text) - keep]))
        return text[len(text) - keep :], [x for x in out if x[2]]

    return fold


def preview(budget: int) -> Fold:
    """After each chunk: head, omitted characters and tail of all output, half of the budget each."""
    head_most = budget // 2
    tail_most = budget - head_most

    def fold(state: Any, e: dict) -> tuple[Any, list[tuple]]:
        s = state or {"head": "", "tail": "", "total": 0}
        text = e["payload"] or ""
        room = head_most - len(s["head"])
        s["head"] += text[:room]
        s["tail"] = (s["tail"] + text[room:])[-tail_most:] if tail_most else ""
        s["total"] += len(text)
        return s, [(e["seq"], s["head"], s["total"] - len(s["head"]) - len(s["tail"]), s["tail"])]

    return fold


def cut_bytes(text: str, most: int) -> str:
    """The longest beginning of at most so many bytes, in whole characters."""
    return text.encode()[:most].decode(errors="ignore")


def last_bytes(text: str, most: int) -> str:
    """The longest end of at most so many bytes, in whole characters."""
    return text.encode()[-most:].decode(errors="ignore") if most else ""


def spilling(threshold: int, shown: int) -> Fold:
    """Output of a command in chunks (payload) that is kept until it is over `threshold` bytes, and then goes to a file as a whole.

    Output: seq, at (bytes of the stream before data), data (what is to be written now, or null), head, omitted (bytes), tail:
    what is shown, of `shown` bytes at most, half of them each. The state holds no more than both bounds.
    """
    head_most = shown // 2
    tail_most = shown - head_most

    def fold(state: Any, e: dict) -> tuple[Any, list[tuple]]:
        s = state or {"total": 0, "held": "", "open": False, "head": "", "tail": ""}
        text = e["payload"] or ""
        before, total = s["total"], s["total"] + len(text.encode())
        if len(s["head"].encode()) == before:  # nothing has been left out so far
            joined = s["head"] + text
            s["head"] = cut_bytes(joined, head_most)
            rest = joined[len(s["head"]) :]
        else:
            rest = s["tail"] + text
        s["tail"] = last_bytes(rest, tail_most)
        s["total"], at, data = total, before, None
        if s["open"]:
            data = text
        elif total > threshold:
            s["open"], at, data, s["held"] = True, 0, s["held"] + text, ""
        else:
            s["held"] += text
        omitted = total - len(s["head"].encode()) - len(s["tail"].encode())
        return s, [(e["seq"], at, data or None, s["head"], omitted, s["tail"])]

    return fold


SPILLED = "seq long, at long, data string, head string, omitted long, tail string"


def retry_queue(most: int = 100, retries: int = 0) -> Fold:
    """A queue of requests: `add` (dropping the oldest beyond the bound), then `attempt` events with a status for its head.

    2xx done, 429 pauses all (stays first), 5xx and 0 retry at the end until `retries` (0: no bound), other 4xx drop.
    Output: seq, request, what happened.
    """

    def fold(state: Any, e: dict) -> tuple[Any, list[tuple]]:
        queue, out = state or [], []
        if e["op"] == "add":
            queue.append([e["request"], 0])
            if len(queue) > most:
                out.append((e["seq"], queue.pop(0)[0], "dropped"))
        elif queue:
            (request, n), status = queue[0], int(e["status"])
            if 200 <= status < 300:
                queue.pop(0)
                out.append((e["seq"], request, "sent"))
            elif status == 429:
                out.append((e["seq"], request, "paused"))
            elif status == 0 or status >= 500:
                queue.pop(0)
                if retries and n + 1 >= retries:
                    out.append((e["seq"], request, "failed"))
                else:
                    queue.append([request, n + 1])
                    out.append((e["seq"], request, "retried"))
            else:
                queue.pop(0)
                out.append((e["seq"], request, "refused"))
        return queue, out

    return fold


def message_queue(state: Any, e: dict) -> tuple[Any, list[tuple]]:
    """A queue of messages by add, update, remove and dequeue events (op, id, payload). Output: seq, id, payload of what leaves."""
    queue, out = state or [], []
    if e["op"] == "add":
        queue.append([e["id"], e["payload"]])
    elif e["op"] == "update":
        queue = [[i, e["payload"] if i == e["id"] else p] for i, p in queue]
    elif e["op"] == "remove":
        queue = [x for x in queue if x[0] != e["id"]]
    elif queue:
        i, p = queue.pop(0)
        out.append((e["seq"], i, p))
    return queue, out
