"""Secret scan with one combined deterministic automaton.

Every rule is parsed into a Thompson automaton; ordered subset construction gives each rule a leftmost-longest
search automaton, all of them are run in step as one product, and the product is minimised into one transition
array over bytes. A text is read once for all rules. The array is applied to many stretches of text at a time:
texts are cut only after bytes that bring every state to the same one, so each stretch starts in a known state.

An ending match is told by the state that the next byte leads to; its start comes from running the rule's
reversed automaton back from the end, no further than the end of the rule's match before. Matches of one rule
don't overlap; matches that fail a rule's length are dropped without another try.

Null texts are empty and have no spans. Very long texts are scanned whole. Equal starts of different rules are all
kept, in the rules' order. Repeated rows are scanned each for itself; an empty table gives no rows; other columns
are kept, but for one named like the result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import add_columns, count_of, table


@dataclass(frozen=True)
class Rule:
    """A byte pattern: literals, [classes], (a|b), ?, *, +, {n,}.

    A match counts if it has `least` bytes and the value behind its first : or = has `value_least`, where given.
    """

    name: str
    pattern: str
    least: int = 0
    value_least: int = 0


_VALUE = "[A-Za-z0-9+/_.=-]"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


#: The base rules, then those that the method adds.
RULES = (
    Rule(
        "assign",
        "("
        + "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
        + f""")["']?\x20*[:=]\x20*["']?{_VALUE}+""",
        value_least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least=20),
)
BASE = ("assign", "access", "hex")
#: Stands between texts in a buffer; no UTF-8 text holds it.
GAP = 0xFF


class _Parser:
    """Thompson construction; nodes are numbered so that lower targets of `eps` come first in priority."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.eps: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def node(self) -> int:
        self.eps.append([])
        self.on.append(None)
        return len(self.eps) - 1

    def parse(self) -> tuple[int, int]:
        start, end = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"stray {self.p[self.i]!r} in {self.p!r}")
        return start, end

    def alternatives(self) -> tuple[int, int]:
        start, end = self.node(), self.node()
        while True:
            a, b = self.sequence()
            self.eps[start].append(a)
            self.eps[b].append(end)
            if self.i < len(self.p) and self.p[self.i] == "|":
                self.i += 1
                continue
            return start, end

    def sequence(self) -> tuple[int, int]:
        start = at = self.node()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            begin = self.i
            a, b = self.atom()
            past = self.i
            sign = self.p[self.i] if self.i < len(self.p) else ""
            if sign == "{":
                stop = self.p.index("}", self.i)
                n = int(self.p[self.i + 1 : stop].rstrip(","))
                if not self.p[self.i + 1 : stop].endswith(","):
                    raise ValueError("only {n,} counts are known")
                for _ in range(n - 1):
                    self.i = begin
                    c, d = self.atom()
                    self.eps[b].append(c)
                    b, last = d, c
                self.eps[b].append(last if n > 1 else a)
                self.i = stop + 1
            elif sign and sign in "?*+":
                first, out = self.node(), self.node()
                self.eps[first].append(a)
                if sign in "?*":
                    self.eps[first].append(out)
                if sign in "*+":
                    self.eps[b].append(a)
                self.eps[b].append(out)
                a, b = first, out
                self.i = past + 1
            self.eps[at].append(a)
            at = b
        return start, at

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            a, b = self.alternatives()
            if self.i >= len(self.p) or self.p[self.i] != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return a, b
        if c == "[":
            stop = self.p.index("]", self.i)
            allowed = members(self.p[self.i : stop])
            self.i = stop + 1
        else:
            allowed = frozenset([ord(c)])
        a, b = self.node(), self.node()
        self.on[a] = (allowed, b)
        return a, b


def members(inside: str) -> frozenset[int]:
    """Bytes of a class body such as A-Za-z0-9+/_.=- (a final or first - stands for itself)."""
    out: set[int] = set()
    i = 0
    while i < len(inside):
        if i + 2 < len(inside) and inside[i + 1] == "-":
            out.update(range(ord(inside[i]), ord(inside[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(inside[i]))
            i += 1
    return frozenset(out)


class _Subsets:
    """Subset construction of one rule; sets are ordered by start of match, earliest first."""

    def __init__(self, rule: Rule):
        self.nfa = _Parser(rule.pattern)
        self.first, self.final = self.nfa.parse()

    def close(self, nodes: list[int]) -> tuple[int, ...]:
        seen: dict[int, None] = {}
        stack = list(reversed(nodes))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = None
                stack.extend(reversed(self.nfa.eps[x]))
        return tuple(seen)

    def step(self, nodes: tuple[int, ...], byte: int) -> list[int]:
        return [self.nfa.on[x][1] for x in nodes if self.nfa.on[x] and byte in self.nfa.on[x][0]]

    def search(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state of a search and whether a match ended before this byte.

        A state is a tuple of generations, each the node set of one start of match, earliest first; once a
        generation holds the final node, later ones are cut.
        """
        alive = [g for g in (self.close(self.step(g, byte)) for g in state) if g]
        matching = any(self.final in g for g in state)
        ended = matching and not alive
        if alive and matching:
            if self.final not in alive[0]:
                raise ValueError("a match must keep accepting until it ends")
            return (alive[0],), False
        fresh = self.close(self.step(self.close([self.first]), byte))
        gens: list[tuple] = []
        seen: set[int] = set()
        for g in [*alive, *([fresh] if fresh else [])]:
            own = tuple(sorted(x for x in g if x not in seen))
            seen.update(own)
            if any(self.nfa.on[x] or x == self.final for x in own):
                gens.append(own)
            if self.final in own:
                break
        return tuple(gens), ended

    def reversed_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Transitions and accepting states of the reversed rule, anchored at a match's end; state 0 is dead."""
        back_eps: dict[int, list[int]] = {}
        back_on: list[tuple[int, frozenset[int], int]] = []
        for x, ys in enumerate(self.nfa.eps):
            for y in ys:
                back_eps.setdefault(y, []).append(x)
        for x, on in enumerate(self.nfa.on):
            if on:
                back_on.append((on[1], on[0], x))

        def close(nodes: set[int]) -> frozenset[int]:
            seen, stack = set(), list(nodes)
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack.extend(back_eps.get(x, ()))
            return frozenset(seen)

        names = {frozenset(): 0, close({self.final}): 1}
        rows, todo = [np.zeros(256, np.int32)], [close({self.final})]
        while todo:
            s = todo.pop(0)
            row = np.zeros(256, np.int32)
            for byte in range(256):
                t = close({x for y, allowed, x in back_on if y in s and byte in allowed})
                if t not in names:
                    names[t] = len(names)
                    todo.append(t)
                row[byte] = names[t]
            rows.append(row)
        return np.array(rows), np.array([self.first in s for s in names])


class Automaton:
    """The minimised product of all rules' searches.

    next: int32 array of 256 entries for each state; ended: for each state, a bit for each rule whose match
    ended before the byte that led there. State 0 is the state after GAP with nothing ended.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        parts = [_Subsets(r) for r in rules]
        self.back = [p.reversed_table() for p in parts]
        classes = self._byte_classes(parts)
        begin = (tuple(() for _ in parts), 0)
        names, todo, rows = {begin: 0}, [begin], []
        memo: dict[tuple, tuple] = {}
        while todo:
            state, _ = todo.pop(0)
            row = np.zeros(256, np.int32)
            for group in classes:
                after, ended = [], 0
                for k, (p, s) in enumerate(zip(parts, state, strict=True)):
                    if (k, s, group[0]) not in memo:
                        memo[k, s, group[0]] = p.search(s, group[0])
                    t, over = memo[k, s, group[0]]
                    after.append(t)
                    ended |= over << k
                target = (tuple(after), ended)
                if target not in names:
                    names[target] = len(names)
                    todo.append(target)
                row[group] = names[target]
            rows.append(row)
        self.subset_states = len(names)
        self.next, self.ended = self._minimised(np.array(rows), np.array([e for _, e in names], np.int32))
        # A byte after which every state is the same one but for what it tells: texts may be cut behind it.
        plain = self._plain()
        self.resets = np.array([len(set(plain[self.next[:, b]])) == 1 for b in range(256)])

    @staticmethod
    def _byte_classes(parts: list[_Subsets]) -> list[list[int]]:
        """Bytes that no rule tells apart."""
        kinds = sorted({on[0] for p in parts for on in p.nfa.on if on}, key=sorted)
        found: dict[tuple, list[int]] = {}
        for b in range(256):
            found.setdefault(tuple(b in k for k in kinds), []).append(b)
        return list(found.values())

    @staticmethod
    def _refined(label: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The coarsest refinement of the labels that the transitions respect."""
        while True:
            keys = np.concatenate([label[:, None], label[rows]], axis=1)
            _, finer = np.unique(keys, axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == label.max():
                return finer
            label = finer

    def _minimised(self, rows: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first = np.unique(ended, return_inverse=True)
        label = self._refined(first.reshape(-1), rows)
        order = {}
        for x in label.tolist():
            order.setdefault(x, len(order))
        label = np.array([order[x] for x in label.tolist()])
        _, one = np.unique(label, return_index=True)
        return label[rows[one]].astype(np.int32), ended[one]

    def _plain(self) -> np.ndarray:
        """Labels of states that behave alike from here on, whatever they tell on arrival."""
        keys = np.concatenate([self.next, self.ended[self.next]], axis=1)
        _, label = np.unique(keys, axis=0, return_inverse=True)
        return label.reshape(-1)

    def ends(self, buffer: np.ndarray, stretch: int | None = None) -> list[tuple[int, int]]:
        """(position after the match, bits of rules) in order; buffer: bytes that end with GAP."""
        n = len(buffer)
        stretch = stretch or min(max(n // 2048, 256), 8192)
        cuts = np.flatnonzero(self.resets[buffer]) + 1
        want = np.arange(stretch, n, stretch)
        at = cuts[np.minimum(np.searchsorted(cuts, want), len(cuts) - 1)]
        starts = np.unique(np.concatenate(([0], at[at < n])))
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        pos, left = starts[order].astype(np.int64), lengths[order]
        # A stretch starts in the plain state of the reset byte before it: state 0's continuation.
        state = np.zeros(len(pos), np.int32)
        flat, tells = self.next.reshape(-1), self.ended > 0
        found_at, found_state = [], []
        for active in np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right"):
            state = flat[(state[:active] << 8) + buffer[pos[:active]]]
            hit = np.flatnonzero(tells[state])
            if len(hit):
                found_at.append(pos[hit])
                found_state.append(state[hit])
            pos = pos[:active] + 1
        if not found_at:
            return []
        where, bits = np.concatenate(found_at), self.ended[np.concatenate(found_state)]
        by = np.argsort(where, kind="stable")
        return list(zip(where[by].tolist(), bits[by].tolist(), strict=True))

    def start(self, rule: int, data: bytes, end: int, floor: int) -> int:
        """Where the longest match of the rule that ends at `end` begins, not before `floor`."""
        table, accepts = self.back[rule]
        state, best, i = 1, end, end
        while i > floor:
            i -= 1
            state = int(table[state, data[i]])
            if not state:
                break
            if accepts[state]:
                best = i
        return best

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(rule, start, end) in code points of every text's matches, by start, then by rule order."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = bytes([GAP]).join([*raw, b""]) if raw else b""
        out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        prior = [0] * len(self.rules)
        for end, bits in self.ends(np.frombuffer(data, np.uint8)) if data else ():
            doc = int(np.searchsorted(begins, end, side="right")) - 1
            base = int(begins[doc])
            for k, rule in enumerate(self.rules):
                if not bits >> k & 1:
                    continue
                start = self.start(k, data, end, max(base, prior[k]))
                prior[k] = end
                if end - start < rule.least:
                    continue
                if rule.value_least and len(self._value(data[start:end])) < rule.value_least:
                    continue
                out[doc].append((start - base, k, end - base))
        return [self._as_points(r, found) for r, found in zip(raw, out, strict=True)]

    @staticmethod
    def _value(match: bytes) -> bytes:
        """What stands behind the first separator, its blanks and one quote."""
        behind = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
        return behind[1:] if behind[:1] in (b'"', b"'") else behind

    def _as_points(self, raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
        found.sort()
        if not found:
            return []
        if raw.isascii():
            return [(self.rules[k].name, a, b) for a, k, b in found]
        lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        return [(self.rules[k].name, int(lead[a]), int(lead[b])) for a, k, b in found]


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with spans array<struct<kind,start,end>> of its whole texts; null and empty texts have none.

    Every other column is kept. The automaton is compiled once, on the driver, and sent to the tasks; its size
    depends on the rules alone.
    """
    held = df.sparkSession.sparkContext.broadcast(Automaton(rules))

    def run(texts: list) -> tuple[list]:
        return ([[{"kind": k, "start": a, "end": b} for k, a, b in found] for found in held.value.scan(texts)],)

    return add_columns(df, [text], "spans array<struct<kind:string,start:long,end:long>>", run)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base rules, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(
        F.filter("spans", lambda s: s["kind"].isin(*BASE)),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]),
    )
    return found.select(
        "doc_id",
        *(count_of(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(said, ",").alias("spans"),
    )


def digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of spans that are in order."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE).encode()).hexdigest()
