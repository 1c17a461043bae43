"""Secret scans with one combined automaton.

All rules are compiled into one minimal automaton. A single pass over a batch's
bytes finds the stretches (between bytes that no rule reads) in which a rule
ends; in these few, the rule's own small automata of the same making settle
its leftmost, non-overlapping spans: one reads the stretch once from its end and
tells where matches begin, two more how far each runs, and spans that are too
short are dropped. So no text takes more than linear time. A private key's span runs on
over the lines of its block, whatever its lines end with.

Defined results for unusual input: a null or empty text has no spans; positions
count code points, so long and non-ASCII texts need no prefix; repeated rows are
scanned one by one; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallypoint.llm.automaton import Automaton, Positions
from rallypoint.llm.common import by_bytes, free_name


def either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """head, then the longest run of tail; shorter matches are passed over and dropped."""

    kind: str
    head: str
    tail: str
    least: int = 1
    least_tail: int = 1
    #: For the combined pass, a pattern that every long enough span holds; short ones keep the automaton small.
    trigger: str = ""
    #: What may follow the span and belongs to it; alone of all patterns it may read line ends.
    body: str = ""

    @property
    def pattern(self) -> str:
        return self.trigger or f"({self.head})({self.tail})"


# A line end, in quoted texts also the written-out \\n, and whole lines of a key.
_EOL = "[\\x20\\x09]*(\\x0d|\\\\r)?(\\x0a|\\\\n)[\\x20\\x09>]*"
_KEY = "[A-Za-z0-9+/=]"
#: Up to the END line, with anything but another "--" before it; without an END
#: line (a key cut short), the header fields and the lines of a key that follow.
PEM_BODY = (
    "((-?[\\x00-,.-\\xff])*-----END ([A-Z]+ )*PRIVATE KEY-----)"
    f"|(({_EOL}((Proc-Type|DEK-Info):[\\x20A-Za-z0-9,-]*)?)*{_EOL}{_KEY}{{32,}}({_EOL}{_KEY}{{32,}})*({_EOL}{_KEY}+[\\x20\\x09\\x0d]*\\x0a)?)"
)

BASE = ("assign", "access", "hex")
# The patterns that count as secrets.
RULES = (
    Rule("assign", either_case("(password|passwd|secret|token|api_?key)") + "[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", least_tail=12),
    Rule("access", "AKIA", "[A-Z0-9]+", least=18),
    Rule("hex", "", "[0-9a-f]+", least=16, trigger="[0-9a-f]{16,}"),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", least=20),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]+", least=30, trigger="\\.eyJ[A-Za-z0-9_-]"),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", least=39, trigger="AIza[A-Za-z0-9_-]"),
    Rule("stripe", "[sr]k_(live|test)_", "[A-Za-z0-9]+", least_tail=16, trigger="[sr]k_(live|test)_[A-Za-z0-9]"),
    Rule("gitlab", "glpat-", "[A-Za-z0-9_-]+", least_tail=20, trigger="glpat-[A-Za-z0-9_-]"),
    Rule("npm", "npm_", "[A-Za-z0-9]+", least=40, trigger="npm_[A-Za-z0-9]"),
    Rule("url", "://[A-Za-z0-9._%+-]+:", "[A-Za-z0-9._%+~!*-]+@", trigger="://[A-Za-z0-9._%+-]"),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY", "-----", body=PEM_BODY),
)


@functools.cache
def body_of(rule: Rule) -> Automaton | None:
    return Automaton([rule.body], True).for_bytes() if rule.body else None


@functools.cache
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[tuple[Automaton, Automaton, Automaton]]]:
    """The combined automaton, and each rule's own ones: head, tail, and both backward."""
    whole = Automaton([r.pattern for r in rules])
    # A stretch holds whole spans, triggers or not.
    for r in rules:
        for part in (r.head, r.tail):
            for reads in Positions(part).reads:
                whole.resets[list(reads)] = False
    if not whole.resets[ord("\n")]:
        raise ValueError("no rule may read a line end")
    own = []
    for r in rules:
        head, tail = Automaton([r.head], True).for_bytes(), Automaton([r.tail], True).for_bytes()
        own.append((head, tail, Automaton([f"({r.head})({r.tail})"], backward=True).for_bytes()))
    return whole, own


def rule_spans(rule: Rule, own: tuple[Automaton, Automaton, Automaton], text: bytes, at: int, end: int, last: int) -> list[tuple[int, int]]:
    """The rule's leftmost non-overlapping spans that begin in text[at:end]; text[end] is no rule's byte.

    A body may run on to `last`, the line end behind the document.
    """
    head, tail, both = own
    body = body_of(rule)
    out, behind = [], at
    for at in both.begins(text, at, end):
        if at < behind:
            continue
        middle = head.longest(text, at, end)
        stop = tail.longest(text, middle, end) if middle >= 0 else -1
        if stop <= at:
            continue
        if body:
            stop = max(stop, body.longest(text, stop, last + 1))
            while text[stop - 1] in b" \t\r\n":
                stop -= 1
        if stop - at >= rule.least and stop - middle >= rule.least_tail:
            out.append((at, stop))
        behind = stop
    return out


def find_spans(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, rule, end) in code points, in order."""
    whole, own = compiled(rules)
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends, bits, resets = whole.scan(raw)
    if not len(ends):
        return out
    stretches, nth = np.unique(np.searchsorted(resets, ends - 1), return_inverse=True)
    ended = np.zeros(len(stretches), np.int64)
    np.bitwise_or.at(ended, nth, bits)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    for s, rule_bits in zip(stretches.tolist(), ended.tolist(), strict=True):
        a, b = (int(resets[s - 1]) + 1 if s else 0), int(resets[s])
        doc = int(np.searchsorted(begins, a, "right")) - 1
        zero = int(chars[begins[doc]])
        for i, rule in enumerate(rules):
            if rule_bits >> i & 1:
                out[doc] += [(int(chars[x]) - zero, i, int(chars[y]) - zero) for x, y in rule_spans(rule, own[i], joined, a, b, int(begins[doc + 1]) - 1)]
    return [sorted(x) for x in out]


def _texts(array: pa.Array):
    for part in by_bytes(array):
        yield pc.fill_null(part, b"").to_pylist()


def _written(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[i].kind}:{a}:{b}" for a, i, b in spans)


_REPORT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


@F.arrow_udf(_REPORT)
def secret_report(texts: pa.Array) -> pa.Array:
    rows = []
    for part in _texts(texts):
        for spans in find_spans(part):
            base = [x for x in spans if RULES[x[1]].kind in BASE]
            row = {f"n_{k}": sum(RULES[i].kind == k for _, i, _ in base) for k in BASE}
            row["base_sha256"] = hashlib.sha256(_written(base, RULES).encode()).hexdigest()
            row["spans"] = _written(spans, RULES)
            rows.append(row)
    kinds = [pa.field(f"n_{k}", pa.int64()) for k in BASE] + [pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]
    return pa.array(rows, pa.struct(kinds))


def masked(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each run of overlapping spans replaced by [kind] of its first."""
    out, at = [], 0
    for a, i, b in spans:
        if a >= at:
            out += [text[at:a], f"[{rules[i].kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


@F.arrow_udf(T.StringType())
def mask_secrets(texts: pa.Array) -> pa.Array:
    out = []
    for part in _texts(texts):
        for text, spans in zip(part, find_spans(part), strict=True):
            out.append(masked(text.decode(), spans) if spans else text.decode())
    return pa.array(out, pa.string())


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    found = docs.select(F.col(doc_id).alias("doc_id"), secret_report(F.col(text)).alias("found"))
    return found.select("doc_id", "found.*")


def mask(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of docs with secrets masked in text, and n_chars (if there) counted anew; null texts stay null."""
    new = free_name(docs, "masked_text")
    out = docs.withColumn(new, F.when(F.col(text).isNotNull(), mask_secrets(F.col(text))))
    columns = {text: F.col(new), n_chars: F.length(new).cast("bigint")}
    changed = [F.when(F.col(new).eqNullSafe(F.col(text)), F.col(c)).otherwise(columns[c]).alias(c) if c in columns else F.col(c) for c in docs.columns]
    return out.select(*changed)
