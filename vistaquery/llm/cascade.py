"""Quality rules as a short-circuit cascade.

Each rule rejects a document by counts of its text.  On a sample (SAMPLE rows at most, drawn
from the whole table) every rule is timed and its rejections counted; then rules are ordered
greedily by rejections per second among the documents that those before leave over.  Over the
whole table a document's rules run in that order up to the first that rejects it.  The order
changes cost alone: a document is kept if and only if no rule rejects it.  As times vary, so may
the order of rules that are nearly equal, and with it rejected_by where several rules reject.

Words are [^\\x20\\x09-\\x0D]+.  Null text: no words.  Texts of any length are whole.  Nulls elsewhere, repeated rows and ties
matter to no rule.  Empty table: no rows, and the order as listed.  Further columns stay;
columns that the operator adds replace columns of their names.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SAMPLE = 2000
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_LETTER = re.compile(r"[^\W\d_]")
_UPPER = re.compile(rb"[A-Z]")


class Measures:
    """Counts of a text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often, total, end = Counter(windows), 0, 0
        for k, x in enumerate(windows):
            if often[x] > 1:
                total += k + 3 - max(k, end)
                end = k + 3
        return total

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for x in self.text.split(" ") if x and _LETTER.search(x)) if not any(c in self.text for c in _SPACE[1:]) else sum(1 for x in self.words if _LETTER.search(x.decode()))

    @cached_property
    def n_upper(self) -> int:
        return len(_UPPER.findall(self.text.encode()))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


BASE_RULES = [
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
]
RULES = [
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("word_length", lambda m: 2 * m.word_chars < 5 * m.n_words or m.word_chars > 12 * m.n_words),
    Rule("words_without_letters", lambda m: 10 * m.n_letter_words < 8 * m.n_words),
    Rule("capitals", lambda m: 10 * m.n_upper > 3 * m.word_chars),
]


def order_rules(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE, rows: int | None = None, counted: tuple[str, ...] = ()) -> list[Rule]:
    """By rejections per second on a sample, each among what the rules before it leave.

    counted: measures that every document has anyway, which are no cost of any rule.  The sampled
    texts are judged where they are; the driver gets a verdict and a time for each rule and row."""
    rows = docs.count() if rows is None else rows

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            hits, cost = [], []
            for rule in rules:
                fresh = [Measures(t) for t in texts]
                for m in fresh:
                    for name in counted:
                        getattr(m, name)
                began = time.thread_time()
                hits.append([rule.rejects(m) for m in fresh])
                cost.append((time.thread_time() - began) / max(len(texts), 1))
            by_text = [list(x) for x in zip(*hits)] if rules else [[] for _ in texts]
            yield pa.RecordBatch.from_arrays([pa.array(by_text, pa.list_(pa.bool_())), pa.array([cost] * len(texts), pa.list_(pa.float64()))], names=["hits", "cost"])

    taken = docs.select("text").sample(min(1.0, sample / max(rows, 1)), seed=8).limit(sample)
    judged = taken.mapInArrow(run, "hits array<boolean>, cost array<double>").collect()
    hits = [{i for i, r in enumerate(judged) if r.hits[k]} for k in range(len(rules))]
    cost = [sum(r.cost[k] for r in judged) + 1e-9 for k in range(len(rules))]
    out, left, rest = [], set(range(len(judged))), list(range(len(rules)))
    while rest:
        best = max(rest, key=lambda k: len(hits[k] & left) / cost[k])
        out.append(rules[best])
        rest.remove(best)
        left -= hits[best]
    return out if judged else list(rules)


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def judge(docs: DataFrame, rules: list[Rule] | None = None, measures: bool = False, base: list[Rule] = BASE_RULES) -> DataFrame:
    """docs with kept and rejected_by (the first rule in the cascade's order that rejects; null: none).

    measures: and with the counts of ADDED and base_failed (whether a rule of base rejects), which
    then are computed for every document; all rules are still ordered, by what they cost beyond
    those counts, and stop at the first that rejects."""
    rules = RULES if rules is None else rules
    names = [x.split()[0] for x in ADDED.split(", ")] if measures else []
    ordered = order_rules(docs, rules, counted=tuple(names))
    new = [*names, *(["base_failed"] if measures else []), "kept", "rejected_by"]
    own = [f for f in docs.schema.fields if f.name not in new]
    fields = [*own, *(T.StructField(n, T.LongType()) for n in names), *([T.StructField("base_failed", T.BooleanType())] if measures else []), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]

    def run(batches):
        for b in batches:
            counts, by, failed = [[] for _ in names], [], []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                m = Measures(text)
                if measures:
                    failed.append(any(r.rejects(m) for r in base))
                by.append(next((r.name for r in ordered if r.rejects(m)), None))
                for x, n in zip(counts, names):
                    x.append(getattr(m, n))
            extra = [pa.array(x, pa.int64()) for x in counts]
            if measures:
                extra.append(pa.array(failed, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in own), *extra, pa.array([x is None for x in by]), pa.array(by, pa.string())], names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))
