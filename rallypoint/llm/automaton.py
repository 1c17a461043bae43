"""Byte automata: rules to positions, subsets, minimal transition arrays."""

from __future__ import annotations

import numpy as np


class Positions:
    """A pattern's byte positions: what each may read, and which may follow.

    Patterns hold literals, \\xNN, classes, groups, `|`, `?`, `*`, `+`, `{n}`
    and `{n,}`.
    """

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0
        self.reads: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.empty, self.first, self.last = self._either()
        if self.at != len(pattern):
            raise ValueError(f"pattern not understood at {self.at}: {pattern}")

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self):
        out = self._chain()
        while self._peek() == "|":
            self.at += 1
            more = self._chain()
            out = (out[0] or more[0], out[1] | more[1], out[2] | more[2])
        return out

    def _then(self, a, b):
        for p in a[2]:
            self.follow[p] |= b[1]
        return (a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2])

    def _chain(self):
        out = (True, set(), set())
        while self._peek() not in ("", "|", ")"):
            out = self._then(out, self._repeated())
        return out

    def _loop(self, part):
        for p in part[2]:
            self.follow[p] |= part[1]
        return part

    def _repeated(self):
        begin = self.at
        part = self._one()
        sign = self._peek()
        if sign in ("?", "*", "+") and sign:
            self.at += 1
            if sign != "?":
                part = self._loop(part)
            return (part[0] or sign != "+", part[1], part[2])
        if sign == "{":
            end = self.text.index("}", self.at)
            least, _, rest = self.text[self.at + 1 : end].partition(",")
            endless = self.text[end - 1] == ","
            stop = self.at
            for _ in range(int(least) - 1):
                self.at = begin
                part = self._then(part, last := self._one())
            if endless:
                self._loop(last if int(least) > 1 else part)
            self.at = end + 1
            assert self.text[stop] == "{" and not rest
        return part

    def _byte(self) -> int:
        c = self.text[self.at]
        if c == "\\":
            c = self.text[self.at + 1]
            if c == "x":
                self.at += 4
                return int(self.text[self.at - 2 : self.at], 16)
            self.at += 1
        self.at += 1
        return ord(c)

    def _one(self):
        c = self._peek()
        if c == "(":
            self.at += 1
            out = self._either()
            self.at += 1
            return out
        if c == "[":
            self.at += 1
            reads = set()
            while self._peek() != "]":
                low = high = self._byte()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._byte()
                reads |= set(range(low, high + 1))
            self.at += 1
        else:
            reads = {self._byte()}
        p = len(self.reads)
        self.reads.append(frozenset(reads))
        self.follow.append(set())
        return (False, {p}, {p})


class Automaton:
    """Minimal deterministic automaton of several rules.

    `next[state * n_kinds + kind[byte]]` is the next state, times n_kinds; state
    0 is the start. `accepts[state]` has a bit for each rule that may end here.
    An unanchored automaton begins every rule anew at every byte. A backward
    automaton reads rules from their ends to their beginnings.
    """

    def __init__(self, patterns: list[str], anchored: bool = False, backward: bool = False) -> None:
        rules = [Positions(p) for p in patterns]
        reads, follow, starts, ends, nullable = [], [], set(), {}, 0
        for i, rule in enumerate(rules):
            base = len(reads)
            reads += rule.reads
            begin, end, after_each = rule.first, rule.last, rule.follow
            if backward:
                begin, end, after_each = end, begin, [set() for _ in rule.reads]
                for p, then in enumerate(rule.follow):
                    for q in then:
                        after_each[q].add(p)
            follow += [{base + q for q in x} for x in after_each]
            starts |= {base + q for q in begin}
            for p in end:
                ends[base + p] = 1 << i
            nullable |= int(rule.empty) << i
        signs = [frozenset(p for p, x in enumerate(reads) if byte in x) for byte in range(256)]
        kinds = list(dict.fromkeys(signs))
        self.kind = np.array([kinds.index(x) for x in signs], np.uint8)
        seen: dict[frozenset[int], int] = {frozenset(): 0}
        todo, rows, masks = [frozenset()], [], []
        for here in todo:
            after = set(starts) if not anchored or here == frozenset() else set()
            mask = nullable if here == frozenset() else 0
            for p in here:
                after |= follow[p]
                mask |= ends.get(p, 0)
            row = []
            for may in kinds:
                then = frozenset(after & may)
                if anchored and not then:
                    row.append(-1)
                    continue
                if then not in seen:
                    seen[then] = len(seen)
                    todo.append(then)
                row.append(seen[then])
            rows.append(row)
            masks.append(mask)
        self._minimise(np.array(rows, np.int64), np.array(masks, np.int64))

    def _minimise(self, table: np.ndarray, masks: np.ndarray) -> None:
        part = np.unique(masks, return_inverse=True)[1].reshape(-1)
        while True:
            signed = np.column_stack([part, np.where(table < 0, -1, part[table])])
            finer = np.unique(signed, axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        # the start first, accepting states last
        _, sample = np.unique(part, return_index=True)
        order = np.lexsort((masks[sample] != 0, np.arange(len(sample)) != part[0]))
        order = np.array(sorted(order.tolist(), key=lambda x: (x != part[0], bool(masks[sample[x]]))))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        states = sample[order]
        self.n_kinds = table.shape[1]
        self.accepts = masks[states]
        small = np.where(table[states] < 0, -1, rank[part[table[states]]])
        self.table = small
        self.next = (small * self.n_kinds).astype(np.int32).reshape(-1)
        found = np.flatnonzero(self.accepts)
        self.first_accepting = int(found[0]) * self.n_kinds if len(found) else self.next.max() + 1
        #: Bytes after which every state is the start.
        self.resets = (small == 0).all(axis=0)[self.kind]

    def longest(self, text: bytes, at: int, end: int) -> int:
        """Where the longest match from `at` ends, or -1 (anchored automata)."""
        table, kind, accepts = self.rows, self.kinds, self.accepted
        state, found = 0, at if accepts[0] else -1
        while at < end:
            state = table[state][kind[text[at]]]
            if state < 0:
                break
            at += 1
            if accepts[state]:
                found = at
        return found

    def begins(self, text: bytes, at: int, end: int) -> list[int]:
        """Where matches within text[at:end] begin, in order, whichever their ends (backward, unanchored automata)."""
        table, kind, accepts, state, out = self.rows, self.kinds, self.accepted, 0, []
        for i in range(end - 1, at - 1, -1):
            state = table[state][kind[text[i]]]
            if accepts[state]:
                out.append(i)
        return out[::-1]

    def for_bytes(self) -> Automaton:
        """Plain lists beside the arrays, for walking single bytes."""
        self.rows, self.kinds, self.accepted = self.table.tolist(), self.kind.tolist(), (self.accepts != 0).tolist()
        return self

    #: With fewer lanes left than this, stepping each by itself is faster than stepping all together.
    FEW = 64

    def scan(self, raw: np.ndarray, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends (exclusive) and rule bits of all accepting steps, and the places of reset bytes.

        One pass: the text is cut behind reset bytes into lanes, which all step
        together through the transition array, the last few one by one, so that a
        long stretch without reset bytes costs no more than its bytes.
        """
        kinds, resets = self.kind[raw], np.flatnonzero(self.resets[raw])
        n = len(raw)
        wanted = np.arange(0, n, max(256, n // lanes))
        behind = np.searchsorted(resets, wanted[1:] - 1)
        starts = np.unique(np.concatenate(([0], resets[behind[behind < len(resets)]] + 1)))
        starts = starts[starts < n]
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        active = len(starts) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(lengths) else 0), "right")
        state = np.zeros(len(starts), np.int32)
        ends, bits = [], []
        together = int((active >= self.FEW).sum())
        for t, k in enumerate(active[:together].tolist()):
            now = self.next[state[:k] + kinds[starts[:k] + t]]
            state[:k] = now
            hit = np.flatnonzero(now >= self.first_accepting)
            if len(hit):
                ends.append(starts[hit] + (t + 1))
                bits.append(self.accepts[now[hit] // self.n_kinds])
        step, kind, least = self.next.tolist(), self.kind.tolist(), self.first_accepting
        own_ends, own_bits = [], []
        for i in range(int(active[together]) if together < len(active) else 0):
            now, at = int(state[i]), int(starts[i]) + together
            for at, byte in enumerate(raw[at : int(starts[i] + lengths[i])].tobytes(), at + 1):
                now = step[now + kind[byte]]
                if now >= least:
                    own_ends.append(at)
                    own_bits.append(now // self.n_kinds)
        if own_ends:
            ends.append(np.array(own_ends, np.int64))
            bits.append(self.accepts[own_bits])
        none = np.zeros(0, np.int64)
        return np.concatenate(ends) if ends else none, np.concatenate(bits) if bits else none, resets
