"""Secret scans: all rules in one pass over the bytes of a text.

The rules are compiled into one minimal automaton (:mod:`automaton`). Where it reports the end of a
rule, that rule's backward automaton gives the start and its forward one the longest end. Matches
of a kind do not overlap; matches that are too short are dropped but still use up their text.
Every rule here begins to match, at the latest, where any later start of it would. After a match the
common automaton may still follow a beginning inside that match; until it has let go of everything,
the rule's own searching automaton, started at the match's end, speaks for it. So no byte is looked
at more than a few times.

Null text counts as empty and has no spans. Repeated rows are scanned alike, each on its own row.
Texts of any length are scanned whole, with memory in proportion to the text. An empty table gives
an empty result. :func:`find_secrets` reads doc_id and text only; :func:`redact` keeps all columns,
whatever their names, and changes ``text`` and, where it is there, ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methylspark.llm.automaton import Dfa, forward_and_back, parse


def _value(match: bytes) -> bytes:
    """What is assigned: after the first : or =, blanks and one quote."""
    at = min(k for k in (match.find(b":"), match.find(b"=")) if k >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return rest[1:] if rest[:1] in (b'"', b"'") else rest


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    either_case: str = ""
    enough: Callable[[bytes], bool] = bool


#: Fixed values. The first three are the base rules.
RULES = [
    Rule("assign", r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         "(password|passwd|secret|token|api_?key)", lambda m: len(_value(m)) >= 6),
    Rule("access", "AKIA[A-Z0-9]+", enough=lambda m: len(m) >= 20),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", enough=lambda m: len(m) >= 40),
]
BASE = 3

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64())]))


def _linked(dfa: Dfa) -> list[list]:
    """The states as lists: of each the 256 following ones, then the rules that end in it."""
    rows = [[None] * 257 for _ in dfa.accepts]
    for s, row in enumerate(rows):
        row[:256] = [rows[t] for t in dfa.next[s].tolist()]
        row[256] = dfa.accepts[s]
    return rows


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        trees = [parse(r.pattern, r.either_case) for r in rules]
        search, self._forward, self._back = forward_and_back(trees)
        self._rows = _linked(search)
        self._own = [_linked(Dfa([tree], True)) for tree in trees]

    def __reduce__(self):
        return scanner, ()

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule."""
        found = []
        used = [0] * len(self.rules)
        row = start_row = self._rows[0]
        own: dict[int, list] = {}  # rules with a match, until the common automaton is at its start

        def report(rule: int, i: int) -> None:
            start = self._start(rule, data, i, used[rule])
            if start is not None:
                end = used[rule] = self._end(rule, data, start)
                own[rule] = self._own[rule][0]
                if self.rules[rule].enough(data[start:end]):
                    found.append((start, rule, end))

        for i, byte in enumerate(data, 1):
            row = row[byte]
            if row[256]:
                for rule in row[256]:
                    if rule not in own:
                        report(rule, i)
            if own:
                for rule in list(own):
                    if i > used[rule]:
                        own[rule] = mine = own[rule][byte]
                        if mine[256]:
                            report(rule, i)
                    if row is start_row and i >= used[rule]:
                        del own[rule]
        return sorted(found)

    def _start(self, rule: int, data: bytes, end: int, floor: int) -> int | None:
        dfa, state, best = self._back[rule], 0, None
        for i in range(end - 1, floor - 1, -1):
            state = dfa.next[state, data[i]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                best = i
        return best

    def _end(self, rule: int, data: bytes, start: int) -> int:
        dfa, state, best = self._forward[rule], 0, start
        for i in range(start, len(data)):
            state = dfa.next[state, data[i]]
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                best = i + 1
        return best

    def spans(self, text: str | None) -> list[dict]:
        """Spans of a text in code points."""
        data = (text or "").encode()
        found = self.scan(data)
        if len(data) != len(text or ""):
            points: dict[int, int] = {}
            at = count = 0
            for cut in sorted({x for s, _, e in found for x in (s, e)}):
                count += len(data[at:cut].decode())
                points[cut], at = count, cut
            found = [(points[s], k, points[e]) for s, k, e in found]
        return [{"kind": self.rules[k].kind, "start": s, "end": e} for s, k, e in found]


_ready: list[Scanner] = []


def scanner() -> Scanner:
    """The scanner of this process, compiled once."""
    if not _ready:
        _ready.append(Scanner(RULES))
    return _ready[0]


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` of every row; spans by start, then in the order of the rules."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().spans
        for batch in batches:
            spans = pa.array([scan(x) for x in batch.column(1).to_pylist()], _ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["doc_id", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"],
                                              T.StructField("spans", SPANS)]))


def _without(text: str, spans: list[dict]) -> str:
    """The text with every stretch of spans replaced by the kind of its first one."""
    out, at = [], 0
    for k, span in enumerate(spans):
        if span["start"] >= at or not k:
            out += [text[at:span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with secrets replaced by their kind in brackets."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().spans
        for batch in batches:
            texts = [_without(x, found) if x and (found := scan(x)) else x
                     for x in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.types[place])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(
        docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
