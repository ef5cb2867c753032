"""Secret scans by a trigram inverted index.

Documents are written as parts of a set size, and with each part its index: for every trigram of
the UTF-8 bytes (A-Z lower-cased) the ascending numbers of the part's documents that hold it,
sorted by trigram, in Parquet with delta encoding and small row groups.  From each rule's regex
follows a Boolean query of trigrams that every match must hold; a scan reads the postings that
the queries name, intersects and unites them, and runs the regex over the candidates alone.  A
rule whose regex needs no trigram runs over every text.  Parts are searched one by one, so a
trigram that all documents share is a list of one part's length.

A query is True (no condition), a trigram, or ("and" / "or", queries).  It is derived from
Python's parse of the regex by sets of what a match of each piece may be, begin with and end
with; sets that grow beyond SET strings are cut to shorter affixes, which only loosens the query.

Null text: empty.  Texts of any length are whole.  Null or repeated doc_ids and repeated rows:
each row has its own spans.  Empty table: no rows.  Further columns stay; one named spans is
replaced.  Of matches of one rule that overlap the leftmost counts, also if it then is dropped
as too short; rules don't see each other's matches.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import cache, reduce
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import BATCH_ROWS, PARTS, Staged, batch_rows, give_back, locate, part_tables, work_dir, write_parquet

#: Strings in a set of what a piece may be, or begin or end with; characters of a class that counts as a set.
SET, CLASS = 64, 16
#: Trigrams of a row group, bytes of text that are cut into trigrams at a time.
GROUP, SLICE = 2048, 1 << 20


@dataclass(frozen=True)
class Rule:
    """A match of pattern counts if its group has at least `least` characters; the span is the whole match's."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = [
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are maximal, so this finds what [0-9a-f]+ does, but for the short ones
]
RULES = [
    *BASE_RULES,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
]

Query = bool | int | tuple


def join(kind: str, *queries: Query) -> Query:
    """Of queries that are not False: True is neutral for "and", and absorbs the others for "or"."""
    if kind == "or" and True in [q is True for q in queries]:
        return True
    parts = {p for q in queries if q is not True for p in (q[1] if isinstance(q, tuple) and q[0] == kind else [q])}
    return True if not parts else parts.pop() if len(parts) == 1 else (kind, frozenset(parts))


@dataclass(frozen=True)
class Piece:
    """What matches of a piece of a regex are (None: not known), begin with and end with, and what they must hold."""

    exact: frozenset[bytes] | None
    prefix: frozenset[bytes]
    suffix: frozenset[bytes]
    query: Query = True


def _of(strings: set[bytes] | frozenset[bytes], query: Query = True) -> Piece:
    """A piece that is one of strings; too many: only their ends are kept, and what they must hold."""
    strings = frozenset(strings)
    if len(strings) <= SET:
        return Piece(strings, strings, strings, query)
    return Piece(None, _heads(strings), _tails(strings), join("and", query, _holds(strings)))


def _heads(strings) -> frozenset[bytes]:
    """At most SET strings that one of strings begins with; two bytes are all that a trigram across pieces can use."""
    return next(x for n in (2, 1, 0) if len(x := frozenset(s[:n] for s in strings)) <= SET)


def _tails(strings) -> frozenset[bytes]:
    return frozenset(s[::-1] for s in _heads([s[::-1] for s in strings]))


def _holds(strings) -> Query:
    """One of strings is in the text."""
    grams = lambda s: [s[i] << 16 | s[i + 1] << 8 | s[i + 2] for i in range(len(s) - 2)]
    return join("or", *(join("and", *grams(s)) for s in strings))


_EMPTY, _ANY = _of({b""}), Piece(None, frozenset([b""]), frozenset([b""]))


def _then(a: Piece, b: Piece) -> Piece:
    if a.exact is not None and b.exact is not None:
        return _of({x + y for x, y in product(a.exact, b.exact)}, join("and", a.query, b.query))
    prefix = {x + y for x, y in product(a.exact, b.prefix)} if a.exact is not None else a.prefix
    suffix = {x + y for x, y in product(a.suffix, b.exact)} if b.exact is not None else b.suffix
    between = _holds({x[-2:] + y[:2] for x, y in product(a.suffix, b.prefix)}) if a.exact is None or b.exact is None else True
    known = join("and", a.query, b.query, _holds(a.exact or a.prefix), _holds(b.exact or b.suffix), between)
    return Piece(None, _heads(prefix), _tails(suffix), known)


def _either(a: Piece, b: Piece) -> Piece:
    if a.exact is not None and b.exact is not None:
        return _of(a.exact | b.exact, join("or", a.query, b.query))
    known = [join("and", x.query, _holds(x.exact)) if x.exact is not None else x.query for x in (a, b)]
    return Piece(None, _heads(a.prefix | b.prefix), _tails(a.suffix | b.suffix), join("or", *known))


def _character(code: int, flags: int) -> Piece:
    """Other cases of a character are one piece in the lower-cased index only if all are ASCII."""
    if flags & re.IGNORECASE and (code > 127 or (not flags & re.ASCII and chr(code) in "iIkKsS")):
        return _ANY
    return _of({chr(code).encode().lower()})


def _class(items: list, flags: int) -> Piece:
    codes: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes.add(value)
        elif kind is op.RANGE and value[1] - value[0] < 2 * CLASS:
            codes.update(range(value[0], value[1] + 1))
        else:
            return _ANY
    pieces = [_character(c, flags) for c in codes]
    if any(p.exact is None for p in pieces):
        return _ANY
    strings = frozenset().union(*(p.exact for p in pieces))
    return _of(strings) if len(strings) <= CLASS else _ANY


def _sequence(items, flags: int) -> Piece:
    return reduce(_then, (_piece(kind, value, flags) for kind, value in items), _EMPTY)


def _piece(kind, value, flags: int) -> Piece:
    if kind is op.LITERAL:
        return _character(value, flags)
    if kind is op.IN:
        return _class(value, flags)
    if kind is op.BRANCH:
        return reduce(_either, (_sequence(x, flags) for x in value[1]))
    if kind is op.SUBPATTERN:
        _, add, drop, items = value
        return _sequence(items, (flags | add) & ~drop)
    if kind is op.ATOMIC_GROUP:
        return _sequence(value, flags)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, items = value
        one = _sequence(items, flags)
        if least == 0:
            return _either(_EMPTY, one) if most == 1 else _ANY
        some = reduce(_then, [one] * min(int(least), 3))
        if most == least <= 3:
            return some
        known = join("and", some.query, _holds(some.exact)) if some.exact is not None else some.query
        return Piece(None, some.prefix, some.suffix, known)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # no character is taken
        return _EMPTY
    return _ANY


@cache
def trigram_query(pattern: str) -> Query:
    """What the trigrams of a text (A-Z lower-cased) must hold for pattern to match in it."""
    tree = _parser.parse(pattern)
    whole = _sequence(tree, tree.state.flags)
    return join("and", whole.query, _holds(whole.exact) if whole.exact is not None else join("and", _holds(whole.prefix), _holds(whole.suffix)))


def trigrams_of(query: Query) -> set[int]:
    return set() if query is True else {query} if isinstance(query, int) else set().union(*map(trigrams_of, query[1]))


_LOWER = bytes(range(256)).lower()


def postings(texts: pa.Array) -> pa.Table:
    """trigram and docs, the numbers of the texts that hold it; both ascending."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held, found = texts.buffers()[2], []
    raw = memoryview(held) if held is not None else memoryview(b"")
    for i in range(int(offsets[0]), int(offsets[-1]) - 2, SLICE):
        j = min(i + SLICE + 2, int(offsets[-1]))
        b = np.frombuffer(bytes(raw[i:j]).translate(_LOWER), dtype=np.uint8).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(i, j - 2), side="right") - 1
        inside = np.arange(i, j - 2) + 2 < offsets[doc + 1]
        found.append(np.unique((doc << 24 | b[:-2] << 16 | b[1:-1] << 8 | b[2:])[inside]))
    key = np.concatenate(found) if found else np.zeros(0, np.int64)
    key = np.unique((key & 0xFFFFFF) << 32 | key >> 24)  # a text may end in the next slice
    trigram, at = np.unique(key >> 32, return_index=True)
    docs = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)))
    return pa.table({"trigram": pa.array(trigram.astype(np.int32)), "docs": docs})


def _index_file(part: str) -> str:
    return f"{part}.trigrams"


@dataclass(frozen=True)
class TrigramIndex:
    """Parts of documents, each with its postings."""

    parts: Staged
    schema: T.StructType

    def scan(self, rules: list[Rule] = RULES, columns: list[str] | None = None) -> DataFrame:
        """The documents' columns (columns: those only) and spans, an array of kind, start and end in code points, the
        end exclusive, by start and order of the rules."""
        queries = {r.kind: trigram_query(r.pattern) for r in rules}
        wanted = sorted(set().union(*map(trigrams_of, queries.values()), {-1}))
        full = any(q is True for q in queries.values())
        fields = [f for f in self.schema.fields if f.name != "spans" and (columns is None or f.name in columns)]
        schema = T.StructType([*fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
        names, parts = [f.name for f in fields], self.parts

        def run(part: str):
            compiled = [re.compile(r.pattern) for r in rules]
            docs = parts.read(part, list(dict.fromkeys([*names, *(["text"] if full else [])])) or ["text"])
            fs, path = locate(f"{parts.folder}/{_index_file(part)}")
            with fs.open_input_file(path) as f:
                index = pq.read_table(f, filters=[("trigram", "in", wanted)])
            at = dict(zip(index["trigram"].to_pylist(), index["docs"].combine_chunks()))
            every = np.arange(docs.num_rows, dtype=np.int32)

            def candidates(query: Query) -> np.ndarray:
                if query is True:
                    return every
                if isinstance(query, int):
                    return at[query].values.to_numpy() if query in at else every[:0]
                found = sorted((candidates(q) for q in query[1]), key=len)
                return reduce((lambda a, b: np.intersect1d(a, b, assume_unique=True)) if query[0] == "and" else np.union1d, found)

            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(docs.num_rows)]
            maybe = [candidates(queries[r.kind]) for r in rules]
            some = every if full else reduce(np.union1d, maybe, every[:0])
            texts = docs["text"] if full else parts.read(part, ["text"])["text"] if len(some) else []
            for k, (rule, pattern, rows) in enumerate(zip(rules, compiled, maybe)):
                for row in rows.tolist():
                    for m in pattern.finditer(texts[row].as_py() or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[row].append((m.start(), k, m.end()))
            found = [[{"kind": rules[k].kind, "start": start, "end": end} for start, k, end in sorted(x)] for x in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            for i in range(0, len(found), BATCH_ROWS):
                own = docs.slice(i, BATCH_ROWS).select(names).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in own.columns), pa.array(found[i : i + BATCH_ROWS], kind)], names=[*names, "spans"])

        return self.parts.each(run, schema)


def build_index(docs: DataFrame, folder: str | None = None) -> TrigramIndex:
    """Writes the parts of docs and their postings, in one pass over docs."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "trigrams")

    def run(batches):
        give_back(forget=True)
        for t in part_tables(batches):
            t = t.combine_chunks()
            part = f"index.{uuid.uuid4().hex}"
            write_parquet(f"{folder}/{part}", t)
            size = t.nbytes
            index = postings(t["text"].combine_chunks() if t["text"].num_chunks != 1 else t["text"].chunk(0))
            write_parquet(f"{folder}/{_index_file(part)}", index, row_group_size=GROUP, use_dictionary=False, column_encoding={"trigram": "DELTA_BINARY_PACKED", "docs.list.element": "DELTA_BINARY_PACKED"}, write_page_index=True)
            yield pa.RecordBatch.from_pydict({"part": [part], "rows": [t.num_rows], "bytes": [size]})
            del t, index
            give_back()

    with batch_rows(spark, BATCH_ROWS):
        docs.mapInArrow(run, PARTS).write.parquet(f"{folder}/index")
    n, rows, size = spark.read.schema(PARTS).parquet(f"{folder}/index").agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return TrigramIndex(Staged(spark, folder, "index", n, rows, size), docs.schema)
