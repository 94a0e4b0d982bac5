"""Secret scans with one combined deterministic automaton.

Each rule's regular expression becomes a nondeterministic automaton, and by subset construction a scanner of its
own: its states are ordered lists of threads, leftmost first, so that it follows the leftmost non-overlapping
matches. The scanners of all rules run side by side in one product automaton, which is minimised to an array of
transitions over byte classes; a transition also says which rules' matches end before its byte. One pass over the bytes
thus gives the ends of all matches of all rules. A match's start is where the reversed rule, run back from the
end by a transition array too, accepts furthest; it never runs back over the match before, so that the work is
linear in the text.

Texts are cut into lanes at pairs of bytes after which the automaton is in one and the same state wherever it was
before; all lanes of a window step through the array together in numpy, and the longest few are finished alone.

Null texts are empty; a text without secrets has empty results. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_windows, map_texts, text_buffer


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; one whose ``group`` is shorter than ``least``
    is dropped. Patterns are of literals, classes, groups, ``(?i:...)``, ``|`` and repeats, and once they match must
    go on matching until they end; other patterns are an error."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules, and two that the automaton carries along.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

_TOKEN = re.compile(r"\\x([0-9a-fA-F]{2})|\\(\W)|(\(\?i:|\(\?:|[()|\[\]*+?]|\{(\d+)(,?)(\d*)\})|([\x20-\x7e])", re.S)


class _Pattern:
    """A rule as a nondeterministic automaton: every state has one move (byte set, target, inside the group)
    or free moves in order of preference."""

    def __init__(self, rule: Rule):
        self.moves: list[tuple[int, int, bool] | None] = []
        self.free: list[list[int]] = []
        self.group, self.least, self.groups, self.at = rule.group, rule.least, 0, 0
        self.tokens = [m for m in _TOKEN.finditer(rule.pattern)]
        if "".join(m[0] for m in self.tokens) != rule.pattern:
            raise ValueError(f"not supported in a rule: {rule.pattern}")
        tree = self._either(False)
        if self.at < len(self.tokens):
            raise ValueError(f"not supported in a rule: {rule.pattern}")
        self.start = self._state()
        self.end = self._lay(tree, self.start, not rule.group)

    # the expression as a tree

    def _next(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def _either(self, fold: bool):
        branches = [self._sequence(fold)]
        while self._next() == "|":
            self.at += 1
            branches.append(self._sequence(fold))
        return ("either", branches) if len(branches) > 1 else branches[0]

    def _sequence(self, fold: bool):
        items = []
        while self._next() not in ("", "|", ")"):
            item, m = self._item(fold), self.tokens[self.at] if self.at < len(self.tokens) else None
            if m and m[3] and (m[3] in "*+?" or m[4]):
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[3]) or (int(m[4]), int(m[6]) if m[6] else None if m[5] else int(m[4]))
                self.at += 1
                item = ("repeat", item, low, high)
            items.append(item)
        return ("all", items)

    def _char(self) -> int:
        m = self.tokens[self.at]
        self.at += 1
        return int(m[1], 16) if m[1] else ord(m[2] or m[0][0])

    def _item(self, fold: bool):
        m = self.tokens[self.at]
        if m[3] and m[3][0] == "(":
            self.at += 1
            self.groups += m[3] == "("
            number = self.groups if m[3] == "(" else -1
            inner = self._either(fold or m[3] == "(?i:")
            if self._next() != ")":
                raise ValueError("a group is not closed")
            self.at += 1
            return ("group", inner, number)
        chars = set()
        if m[3] == "[":
            self.at += 1
            if self._next() == "^":
                raise ValueError("not supported here: ^")
            while self._next() != "]":
                first = last = self._char()
                if self._next() == "-" and self.tokens[self.at + 1][0] != "]":
                    self.at += 1
                    last = self._char()
                chars |= set(range(first, last + 1))
            self.at += 1
        elif m[3] or m[0] in ".^$":
            raise ValueError(f"not supported here: {m[0]}")
        else:
            chars = {self._char()}
        if fold:
            chars |= {ord(chr(c).swapcase()) for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return ("chars", sum(1 << c for c in chars))

    # the tree as states

    def _state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def _lay(self, node, at: int, inside: bool) -> int:
        kind = node[0]
        if kind == "chars":
            to = self._state()
            self.moves[at] = (node[1], to, inside)
            return to
        if kind == "group":
            return self._lay(node[1], at, inside or node[2] == self.group)
        if kind == "all":
            for item in node[1]:
                at = self._lay(item, at, inside)
            return at
        if kind == "either":
            to = self._state()
            for branch in node[1]:
                self.free[at].append(own := self._state())
                self.free[self._lay(branch, own, inside)].append(to)
            return to
        _, body, low, high = node
        for _ in range(low):
            at = self._lay(body, at, inside)
        to = self._state()
        if high is None:
            loop, own = self._state(), self._state()
            self.free[at].append(loop)
            self.free[loop] += [own, to]
            self.free[self._lay(body, own, inside)].append(loop)
            return to
        for _ in range(high - low):
            own = self._state()
            self.free[at] += [own, to]
            at = self._lay(body, own, inside)
        self.free[at].append(to)
        return to

    # ordered threads: (state, bytes inside the group so far, as many as matter)

    def closed(self, threads) -> tuple[tuple, int]:
        """The threads after free moves, and whether the first one at the end is long enough (2), short (1) or
        none is (0); those after it are cut."""
        out, seen = [], set()
        for s, n in threads:
            todo = [s]
            while todo:
                x = todo.pop()
                if x in seen:
                    continue
                seen.add(x)
                if x == self.end:
                    return tuple(out), 2 if n >= self.least else 1
                if self.moves[x]:
                    out.append((x, n))
                todo += reversed(self.free[x])
        return tuple(out), 0

    def stepped(self, threads, byte: int) -> tuple[tuple, int]:
        moves = ((self.moves[s], n) for s, n in threads)
        return self.closed([(m[1], min(n + m[2], self.least)) for m, n in moves if m[0] >> byte & 1])

    def scanner(self, bytes_: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Deterministic: target and what ends before the byte (2: a match, 1: a short one), by state and class;
        what ends with the text, by state."""
        first, found = self.closed([(self.start, 0)])
        if found:
            raise ValueError("a rule must not match the empty text")
        states, order, targets, ends = {(first, 0): 0}, [(first, 0)], [], []
        for threads, flag in order:
            row, gone = [], []
            for b in bytes_:
                after, now = self.stepped(threads, b)
                ended = flag if flag and not now else 0
                if ended:
                    if after:
                        raise ValueError("a rule must go on matching until it ends")
                    after, now = self.stepped(first, b)
                if not now:
                    seen = {s for s, _ in after}
                    after += tuple(x for x in first if x[0] not in seen)
                if (after, now) not in states:
                    states[after, now] = len(order)
                    order.append((after, now))
                row.append(states[after, now])
                gone.append(ended)
            targets.append(row)
            ends.append(gone)
        return np.array(targets), np.array(ends), np.array([flag for _, flag in order])

    def backwards(self, bytes_: list[int]) -> tuple[list[list[int]], list[bool]]:
        """Deterministic, for the reversed rule: targets by state and class (-1: none), and whether accepted."""
        back: dict[int, list] = {}
        for s, m in enumerate(self.moves):
            if m:
                back.setdefault(m[1], []).append((m[0], s))
        unfree: dict[int, list] = {}
        for s, targets in enumerate(self.free):
            for t in targets:
                unfree.setdefault(t, []).append(s)

        def closed(states):
            todo, seen = list(states), set(states)
            while todo:
                new = [x for x in unfree.get(todo.pop(), ()) if x not in seen]
                seen.update(new)
                todo += new
            return frozenset(seen)

        order = [closed({self.end})]
        number, rows = {order[0]: 0}, []
        for live in order:
            row = []
            for b in bytes_:
                to = closed({s for x in live for mask, s in back.get(x, ()) if mask >> b & 1})
                if to and to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to] if to else -1)
            rows.append(row)
        return rows, [self.start in x for x in order]


def _uniques(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct rows, and each row's number among them."""
    _, first, number = np.unique(np.ascontiguousarray(rows).view([("", rows.dtype)] * rows.shape[1]).reshape(-1), return_index=True, return_inverse=True)
    return first, number.reshape(-1)


class Automaton:
    """The minimal automaton of all rules.

    ``next[state, class]`` and ``ends[state, class]``: bit r is set if a match of rule r ends before the byte, bit
    r + rules if one ends that is too short (for rules whose minimum is on a group, because no match may start
    before its end). ``last[state]``: the same at the end of the text.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        patterns = [_Pattern(r) for r in rules]
        masks = {m[0] for p in patterns for m in p.moves if m}
        groups: dict[tuple, int] = {}
        self.of_byte = np.array([groups.setdefault(tuple(m >> b & 1 for m in masks), len(groups)) for b in range(256)], np.uint8)
        sample = [int(np.flatnonzero(self.of_byte == k)[0]) for k in range(len(groups))]
        self.rules, self.classes = len(rules), len(groups)
        own = [p.scanner(sample) for p in patterns]
        self.back = [p.backwards(sample) for p in patterns]
        bits = [np.array([0, (r.group > 0) << (i + self.rules), 1 << i], np.int32) for i, r in enumerate(rules)]
        radix = np.cumprod([1, *(len(t) for t, _, _ in own)])
        known = np.zeros(1, np.int64)  # the product's states, each a number made of its parts
        targets, at = [], 0
        while at < len(known):
            parts = [known[at:] // radix[i] % len(t) for i, (t, _, _) in enumerate(own)]
            to = sum(t[p] * radix[i] for i, ((t, _, _), p) in enumerate(zip(own, parts, strict=True)))
            targets.append(to)
            at = len(known)
            known = np.r_[known, np.setdiff1d(to, known)]
        order = np.argsort(known)
        self.next = order[np.searchsorted(known[order], np.concatenate(targets))]
        parts = [known // radix[i] % len(t) for i, (t, _, _) in enumerate(own)]
        self.ends = sum(b[e[p]] for b, (_, e, _), p in zip(bits, own, parts, strict=True))
        self.last = sum(b[f[p]] for b, (_, _, f), p in zip(bits, own, parts, strict=True))
        self.built = len(known)
        self._minimise()
        self._synchronise()
        self.packed = (self.next << 2 * self.rules | self.ends).astype(np.int32).reshape(-1)

    def _minimise(self) -> None:
        """Split blocks of states until all states of a block move alike."""
        _, block = _uniques(np.c_[self.ends, self.last])
        while True:
            first, finer = _uniques(np.c_[block, block[self.next]])
            if finer.max() == block.max():
                break
            block = finer
        self.start, self.next = int(block[0]), block[self.next[first]]
        self.ends, self.last = self.ends[first], self.last[first]
        # number the blocks as their first states are
        number = np.empty(len(first), np.int64)
        number[block[first]] = np.arange(len(first))
        self.start, self.next = int(number[self.start]), number[self.next]

    def _synchronise(self) -> None:
        """``meets[a, b]``: the state after the classes a and b, if it is the same from every state, else -1."""
        self.meets = np.full((self.classes, self.classes), -1, np.int32)
        for a in range(self.classes):
            after = self.next[np.unique(self.next[:, a])]
            same = (after == after[0]).all(axis=0)
            self.meets[a, same] = after[0, same]


#: Lanes as few as this are finished one by one.
_FEW = 24


class _Scan:
    def __init__(self, auto: Automaton, lane: int):
        self.auto, self.lane, self.flat = auto, lane, None

    def ends(self, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where matches end in the texts that begin at ``starts``, and the bits of their rules."""
        auto, n = self.auto, len(classes)
        shift, mask = 2 * auto.rules, (1 << 2 * auto.rules) - 1
        cuts = np.flatnonzero(auto.meets[classes[:-1], classes[1:]] >= 0) + 2
        if len(cuts):
            cuts = cuts[np.searchsorted(cuts, np.arange(0, cuts[-1], self.lane))]
        cuts = cuts[~np.isin(cuts - 1, starts) & (cuts < n)]
        lanes = np.unique(np.r_[starts[starts < n], cuts])
        ends = np.r_[lanes[1:], n]
        state = np.full(len(lanes), auto.start, np.int32)
        inner = np.flatnonzero(~np.isin(lanes, starts))
        state[inner] = auto.meets[classes[lanes[inner] - 2], classes[lanes[inner] - 1]]
        order = np.argsort(lanes - ends, kind="stable")
        lanes, ends, state = lanes[order], ends[order], state[order]
        where, what = [], []
        still = np.searchsorted(-(ends - lanes), -np.arange(1, (ends - lanes)[0] + 1), "right") if len(lanes) else np.zeros(0, int)
        for j, m in enumerate(still.tolist()):
            if m <= _FEW:
                break
            got = auto.packed[state[:m] * auto.classes + classes[lanes[:m] + j]]
            state[:m] = got >> shift
            got &= mask
            hit = np.flatnonzero(got)
            if len(hit):
                where.append(lanes[hit] + j)
                what.append(got[hit])
        else:
            m, j = 0, 0
        for k in range(m):
            if self.flat is None:
                self.flat = auto.packed.tolist()
            flat, width, s = self.flat, auto.classes, int(state[k])
            for at, c in enumerate(classes[lanes[k] + j : ends[k]].tobytes(), int(lanes[k]) + j):
                got = flat[s * width + c]
                s = got >> shift
                if got & mask:
                    where.append([at])
                    what.append([got & mask])
            state[k] = s
        final = np.flatnonzero((auto.last[state] > 0) & np.isin(ends, np.r_[starts, n]))
        where.append(ends[final])
        what.append(auto.last[state[final]])
        return np.concatenate(where).astype(np.int64), np.concatenate(what).astype(np.int64)

    def spans(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``text, start, rule, end`` of all matches, as bytes from the beginning of ``data``."""
        auto = self.auto
        classes = auto.of_byte[data]
        where, what = self.ends(classes, starts)
        out, before, text_before = [], [0] * auto.rules, -1
        raw = classes.tobytes() if len(where) else b""
        order = np.argsort(where, kind="stable")
        # an end at a text's end belongs to that text
        for text, end, bits in zip((np.searchsorted(starts, where[order], "left") - 1).tolist(), where[order].tolist(), what[order].tolist(), strict=True):
            if text != text_before:
                before, text_before = [int(starts[text])] * auto.rules, text
            for r in range(auto.rules):
                if bits >> r & 1:
                    rows, accepted = auto.back[r]
                    s, at, start = 0, end, end
                    while at > before[r]:
                        s = rows[s][raw[at - 1]]
                        if s < 0:
                            break
                        at -= 1
                        if accepted[s]:
                            start = at
                    out.append((text, start, r, end))
                if (bits >> r | bits >> r + auto.rules) & 1:
                    before[r] = end
        return out


def _digest(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE, lane: int = 1024) -> DataFrame:
    """Scan every whole text: per row ``keep``, ``n_<kind>`` of the base kinds, ``base_sha256`` and ``spans``.

    The automaton is built once on the driver and broadcast (its size depends on the rules alone). Rows are
    independent; there is no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(Automaton(rules))

    def scan():
        scanner = _Scan(shared.value, lane)

        def run(column: pa.Array) -> list:
            offsets, data = text_buffer(column)
            found: list[list] = [[] for _ in range(len(column))]
            for a, b in byte_windows(offsets, 4 << 20):
                begin = int(offsets[a])
                part = data[begin : int(offsets[b])]
                full = a + np.flatnonzero(offsets[a + 1 : b + 1] > offsets[a:b])  # texts that aren't empty
                spans = scanner.spans(part, offsets[full] - begin) if len(full) else []
                if spans:
                    points = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
                for k, x, r, y in spans:
                    zero = points[offsets[full[k]] - begin]
                    found[full[k]].append((int(points[x] - zero), r, rules[r].kind, int(points[y] - zero)))
            own = [[s for s in spans if s[2] in base] for spans in found]
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in own], pa.int64()) for kind in base]
            return [*counts, pa.array([hashlib.sha256(_digest(s).encode()).hexdigest() for s in own], pa.string()), pa.array([_digest(s) for s in found], pa.string())]

        return run

    return map_texts(df, text, list(keep), ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string", scan)
