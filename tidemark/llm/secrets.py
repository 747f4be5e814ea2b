"""Secret scans: all rules in one deterministic automaton, run over bytes.

The rules are compiled together: a parser for the small regex dialect they use gives one
nondeterministic automaton with a loop before it (a match may begin anywhere), subset
construction makes it deterministic, minimisation merges equal states, and the result is a
transition array over classes of bytes. Texts are cut into lanes of equal length which step
through the array together; every lane first guesses that it begins in the start state, and
lanes whose predecessor ended elsewhere are run again until their states agree with the
guess. That is exact, because from an agreeing state on both runs are the same.

A match of a rule ends with a greedy run of one class, so consecutive accepting bytes are one
match. Its start is found by walking a reversed automaton back from the first of them.

The rule of private keys matches the line a key begins with; the key itself is found from there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, in_arrow, map_texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `pattern` ends in a repeated class; shorter matches are dropped.

    `least` counts the characters of the closing run if `tail` is true, else of the match. `opens`:
    the match is the line that a private key begins with, and the secret goes on through the key.
    """

    kind: str
    pattern: str
    least: int
    tail: bool = False
    opens: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORDS = "(password|passwd|secret|token|api_?key)"


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


# The first three are the base kinds; then kinds that the method adds, in their order.
RULES = (
    Rule("assign", either_case(KEYWORDS) + f"""["']?\\x20*[:=]\\x20*["']?{VALUE}+""", 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]+", 32),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", "AIza[0-9A-Za-z_-]+", 39),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]+", 15),
    Rule("pem", "-----BEGIN[A-Z ]*PRIVATE KEY( BLOCK)?[-]+", 25, opens=True),
)
BASE_KINDS = 3


# ---- patterns to a nondeterministic automaton ------------------------------------------------


class _Parser:
    """Sequences, alternatives in groups, classes, `?`, `*`, `+` and `\\x20`."""

    def __init__(self, pattern: str):
        self.rest = pattern

    def take(self) -> str:
        c, self.rest = self.rest[0], self.rest[1:]
        if c == "\\":
            code, self.rest = self.rest[1:3], self.rest[3:]
            return chr(int(code, 16))
        return c

    def alternatives(self):
        parts = [self.sequence()]
        while self.rest[:1] == "|":
            self.take()
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.rest and self.rest[0] not in "|)":
            part = self.atom()
            while self.rest[:1] and self.rest[0] in "?*+":
                part = (self.take(), part)
            parts.append(part)
        return ("then", parts)

    def atom(self):
        if self.rest[0] == "(":
            self.take()
            inside = self.alternatives()
            self.take()
            return inside
        if self.rest[0] == "[":
            return ("set", self.members())
        return ("set", frozenset([ord(self.take())]))

    def members(self) -> frozenset[int]:
        self.take()
        found: set[int] = set()
        while self.rest[0] != "]":
            low = high = self.take()
            if self.rest[0] == "-" and self.rest[1] != "]":
                self.take()
                high = self.take()
            found.update(range(ord(low), ord(high) + 1))
        self.take()
        return frozenset(found)


def parse(pattern: str):
    return _Parser(pattern).alternatives()


def mirrored(tree):
    kind, inside = tree
    if kind == "set":
        return tree
    if kind in ("then", "or"):
        parts = [mirrored(x) for x in inside]
        return kind, parts[::-1] if kind == "then" else parts
    return kind, mirrored(inside)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.by_set: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.by_set.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        """Append `tree` after state `at`; returns the state behind it."""
        kind, inside = tree
        if kind == "set":
            self.by_set[at].append((inside, end := self.state()))
            return end
        if kind == "then":
            for part in inside:
                at = self.add(part, at)
            return at
        end = self.state()
        if kind == "or":
            for part in inside:
                self.empty[at].append(begin := self.state())
                self.empty[self.add(part, begin)].append(end)
            return end
        self.empty[at].append(begin := self.state())
        last = self.add(inside, begin)
        self.empty[last].append(end)
        if kind in "?*":
            self.empty[at].append(end)
        if kind in "*+":
            self.empty[last].append(begin)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


# ---- deterministic automaton ------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """`step[state * classes + byte_class[byte]]` is the next state times `classes`.

    State 0 is the start. States from `accepting` on accept; `kinds` has a bit per rule.
    """

    byte_class: np.ndarray
    step: np.ndarray
    classes: int
    accepting: int
    kinds: np.ndarray


def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    """Bytes that no transition tells apart share a class; an example byte for each class."""
    sets = list(dict.fromkeys(s for edges in nfa.by_set for s, _ in edges))
    keys: dict[tuple, int] = {}
    of, example = np.zeros(256, np.uint8), []
    for byte in range(256):
        key = tuple(byte in s for s in sets)
        if key not in keys:
            keys[key] = len(keys)
            example.append(byte)
        of[byte] = keys[key]
    return of, example


def _minimised(step: list[list[int]], marks: list[int]) -> list[int]:
    """The class of every state: refine by marks and successors until nothing splits."""
    classes = [sorted(set(marks)).index(m) for m in marks]
    while True:
        keys: dict[tuple, int] = {}
        refined = [keys.setdefault((classes[s], *(classes[t] for t in row)), len(keys))
                   for s, row in enumerate(step)]
        if len(keys) == len(set(classes)):
            return refined
        classes = refined


def build(trees: list, anywhere: bool) -> Automaton:
    """One automaton for all trees; `anywhere`: matches may begin at every byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        nfa.empty[start].append(begin := nfa.state())
        ends[nfa.add(tree, begin)] = rule
    of, example = _byte_classes(nfa)
    begin = nfa.closed([start])
    found, order, step = {begin: 0}, [begin], []
    for states in order:  # grows while it is read
        row = []
        for byte in example:
            reached = nfa.closed(
                [t for s in states for allowed, t in nfa.by_set[s] if byte in allowed]
                + ([start] if anywhere else [])
            )
            if reached not in found:
                found[reached] = len(order)
                order.append(reached)
            row.append(found[reached])
        step.append(row)
    marks = [sum(1 << ends[s] for s in states if s in ends) for states in order]
    merged = _minimised(step, marks)
    mark_of, row_of = {}, {}
    for s, m in enumerate(merged):
        mark_of[m], row_of[m] = marks[s], step[s]
    # the start first, then other states that do not accept, then those that do
    by_rank = sorted(mark_of, key=lambda m: (m != merged[0], mark_of[m] != 0, m))
    rank = {m: i for i, m in enumerate(by_rank)}
    table = np.array([[rank[merged[t]] for t in row_of[m]] for m in by_rank], np.int32)
    kinds = np.array([mark_of[m] for m in by_rank], np.int64)
    return Automaton(of, (table * len(example)).ravel(), len(example),
                     int((kinds == 0).sum()), kinds)


def _before_tail(tree):
    """A rule's tree without its closing run, mirrored, to be walked from right to left."""
    kind, parts = tree
    return mirrored((kind, parts[:-1]))


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]):
    trees = [parse(r.pattern) for r in rules]
    backward = [build([_before_tail(t)], anywhere=False) if len(t[1]) > 1 else None for t in trees]
    return build(trees, anywhere=True), backward


# ---- running it ---------------------------------------------------------------------------------

LANE, BLOCK = 512, 1 << 18  # a step takes all lanes of a block


def states_of(data: np.ndarray, auto: Automaton, lane: int = LANE) -> np.ndarray:
    """The state after every byte, for all bytes in one run from the start state."""
    lanes = -(-len(data) // lane)
    padded = np.zeros(lanes * lane, np.uint8)
    padded[: len(data)] = data
    columns = np.ascontiguousarray(auto.byte_class[padded].reshape(lanes, lane).T).astype(np.int32)
    states = np.empty((lane, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for i in range(lane):
        state = auto.step[state + columns[i]]
        states[i] = state
    begun = np.zeros(lanes, np.int32)
    while True:
        given = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
        todo = np.flatnonzero(given != begun)
        if not len(todo):
            return states.T.ravel()[: len(data)] // auto.classes
        begun[todo] = given[todo]
        state = given[todo]
        for i in range(lane):
            state = auto.step[state + columns[i, todo]]
            wrong = state != states[i, todo]
            if not wrong.any():
                break
            todo, state = todo[wrong], state[wrong]
            states[i, todo] = state


def _start(data: np.ndarray, at: int, low: int, auto: Automaton | None) -> int:
    """Where the match whose closing run begins at `at` starts, not before `low`."""
    if auto is None:
        return at
    state, best, dead = 0, at, _dead(auto)
    while at > low:
        at -= 1
        state = int(auto.step[state + int(auto.byte_class[data[at]])])
        if dead[state // auto.classes]:
            break
        if state // auto.classes >= auto.accepting:
            best = at
    return best


@lru_cache(maxsize=64)
def _dead_of(key: bytes, classes: int, accepting: int) -> np.ndarray:
    table = np.frombuffer(key, np.int32).reshape(-1, classes) // classes
    return np.array([i < accepting and (row == i).all() for i, row in enumerate(table)])


def _dead(auto: Automaton) -> np.ndarray:
    return _dead_of(auto.step.tobytes(), auto.classes, auto.accepting)


def _first_accept(data: np.ndarray, at: int, end: int, auto: Automaton, rule: int) -> int | None:
    """The first byte in [at, end) that ends a match of the rule which begins at `at` or later."""
    state = 0
    for i in range(at, end):
        state = int(auto.step[state + int(auto.byte_class[data[i]])])
        if auto.kinds[state // auto.classes] >> rule & 1:
            return i
    return None


def find(data: np.ndarray, bounds: np.ndarray, rules: tuple[Rule, ...]):
    """Secrets in texts laid end to end, each followed by a byte that no rule knows.

    `bounds`: where each text starts (plus the end). Returns (text, rule, start, end) in bytes,
    leftmost and without overlaps within a rule, too short ones left out.
    """
    auto, backward = compiled(rules)
    states = states_of(data, auto)
    hits = np.flatnonzero(states >= auto.accepting)
    marks = auto.kinds[states[hits]]
    found = []
    for number, rule in enumerate(rules):
        at = hits[(marks >> number) & 1 == 1]
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        begins = at[first]
        ends = at[np.append(first[1:], len(at)) - 1] + 1
        if backward[number] is None:  # the run is the match
            long_enough = ends - begins >= rule.least
            begins, ends = begins[long_enough], ends[long_enough]
        text = np.searchsorted(bounds, begins, "right") - 1
        last_text, last_end = -1, 0
        for t, tail, end in zip(text.tolist(), begins.tolist(), ends.tolist()):
            low = int(bounds[t])
            start = _start(data, tail, low, backward[number])
            if t == last_text and start < last_end:
                # the match before has used up this one's beginning: is there another within?
                tail = _first_accept(data, last_end, end, auto, number)
                if tail is None:
                    continue
                start = _start(data, tail, last_end, backward[number])
            last_text, last_end = t, end
            if end - (tail if rule.tail else start) >= rule.least:
                found.append((t, number, start, end))
    return found


def spans_in(texts: list[str], rules: tuple[Rule, ...] = RULES) -> dict[int, list]:
    """For each text with secrets its (rule number, start, end) in code points, by start, rule."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    spans = defaultdict(list)
    for t, number, start, end in find(data, bounds, rules):
        spans[t].append((number, start, end))
    out = {}
    for t, own in spans.items():
        low = int(bounds[t])
        heads = np.concatenate([[0], np.cumsum((data[low: int(bounds[t + 1])] & 0xC0) != 0x80)])
        out[t] = sorted(
            ((n, int(heads[s - low]), int(heads[e - low])) for n, s, e in own),
            key=lambda x: (x[1], x[0]),
        )
    return out


# ---- private keys -------------------------------------------------------------------------------

KEY_LABEL = re.compile("BEGIN([A-Z ]*PRIVATE KEY(?: BLOCK)?)-+")
# What may stand between the lines of a key: breaks, also escaped ones, indents, quotes, comment marks.
_BETWEEN = r"(?:\\+[nrt]|[^A-Za-z0-9+/=-]|(?<=\s)\+(?=\s)){0,32}+"
KEY_FIELDS = re.compile(rf"(?:{_BETWEEN}[A-Z][A-Za-z-]+: [^\n\\]*+(?=\n|\\+n|\Z))*+")
KEY_LINE = re.compile(rf"{_BETWEEN}([A-Za-z0-9+/=]++)")
LINE_END = re.compile(r"""[ \t]*(?:\Z|[\r\n"'\\])""")
# Characters that a line of base64 has at least if it is not a key's last, and at most if it was wrapped.
LEAST_LINE, MOST_LINE = 16, 76


@lru_cache(maxsize=64)
def _closing(label: str) -> re.Pattern:
    return re.compile(rf"{_BETWEEN}-----END{re.escape(label)}-+")


def key_end(text: str, start: int, at: int, stop: int) -> int:
    """Where the private key ends whose first line is [start, at); `stop`: where the next one begins.

    A key's body is fields such as DEK-Info and lines of base64, of at least LEAST_LINE characters
    but for the last. If the END marker with the same label follows, the key ends behind it. A
    body without one may have a short last line if the key was wrapped or the text is cut in it. What
    is no such body is left as it is, even if a marker comes later: then the first line is all.
    """
    closing = _closing(KEY_LABEL.search(text, start, at)[1])
    here = KEY_FIELDS.match(text, at, stop).end()
    if marker := closing.match(text, here, stop):
        return marker.end()
    first, full, end = 0, True, at
    while line := KEY_LINE.match(text, here, stop):
        if marker := closing.match(text, line.end(), stop):
            return marker.end()
        size = len(line[1])
        first = first or size
        last = full and first <= MOST_LINE and (end > at or line.end() == len(text))
        # among lines of their own, a short one is one too: a word of a sentence is not
        if "n" in text[end: line.start(1)] or "\n" in text[end: line.start(1)]:
            last = last and LINE_END.match(text, line.end(), stop)
        if size < LEAST_LINE and not last:
            break
        here = end = line.end()
        full = size == first
        if size < LEAST_LINE:
            break
    return end


def secrets_in(texts: list[str], rules: tuple[Rule, ...] = RULES) -> dict[int, list]:
    """`spans_in` with whole private keys: the span of an opening line goes on through the key."""
    found = spans_in(texts, rules)
    for t, spans in found.items():
        stop = len(texts[t])
        for i in reversed(range(len(spans))):
            number, start, end = spans[i]
            if rules[number].opens:
                spans[i] = (number, start, key_end(texts[t], start, end, stop))
                stop = start
    return found


SPAN_SCHEMA = "doc_id long, text_chars long, spans array<struct<kind:int,start:long,end:long>>"


def find_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per document: doc_id, text_chars and its spans (rule number, start, end).

    Offsets are code points, the end exclusive. Spans of one rule do not overlap; spans of
    different rules may. The span of a private key is the whole key. A null or empty text has no spans; ids may be null or repeated, each
    row is scanned by itself. Other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(ids, texts):
        found = secrets_in(texts, rules)
        rows = [[{"kind": n, "start": s, "end": e} for n, s, e in found.get(i, ())]
                for i in range(len(texts))]
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(rows, kind)],
            names=["doc_id", "text_chars", "spans"],
        )

    return map_texts(docs, id_column, text_column, SPAN_SCHEMA, work, BLOCK)


def joined(spans, names: list[str]):
    """`kind:start:end` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(kind: int):
    """How many of a row's spans are of the kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the base kinds, and all spans as text."""
    names = [r.kind for r in rules]
    found = find_secrets(docs, rules=rules)
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    counts = [number_of(n).cast("long").alias(f"n_{names[n]}") for n in range(BASE_KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base, names), 256).alias("base_sha256"),
        joined(F.col("spans"), names).alias("spans"),
    )


def masked(text: str, spans: list, names: list[str]) -> str:
    """The text with every secret replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    for number, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{names[number].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def masked_documents(
    docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The same rows and columns, every secret in the text replaced by its kind in brackets.

    All rows stay, n_chars (if there) follows the new text; null texts stay null and texts
    without a secret are not touched.
    """
    names = [r.kind for r in rules]
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            out = batch.column(place).to_pylist()
            for first, block in blocks(batch.column(place), BLOCK):
                for row, spans in secrets_in(block, rules).items():
                    out[first + row] = masked(block[row], spans, names)
            columns = [pa.array(out, pa.string()) if i == place else c
                       for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    clean = in_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length(text_column).cast(kind))
    return clean
