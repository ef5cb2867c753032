"""Query specifications: texts are flattened, normalized, freed of dates and tokenized when a plan is made."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.masks import DateFilter, extract_filters
from ..functions.text import STOPWORDS


@dataclass(frozen=True)
class QuerySpec:
    query_id: str
    text: str
    clean_text: str
    tokens: tuple[str, ...]
    filters: tuple[DateFilter, ...]
    vector: tuple[float, ...] | None = field(default=None, compare=False)

    @property
    def token_string(self) -> str:
        return " ".join(self.tokens)


def normalize(query):
    """Stripped and lower-cased texts, lists by element; None for anything else."""
    if isinstance(query, str):
        return query.strip().lower()
    if isinstance(query, (list, tuple)):
        return [normalize(x) for x in query]
    return None


def flatten(queries) -> Iterable[str]:
    """The texts of nested lists, in order."""
    for q in [queries] if isinstance(queries, str) else queries:
        if isinstance(q, str):
            yield q
        elif isinstance(q, (list, tuple)):
            yield from flatten(q)


def tokens_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return [w for w in words if len(w) > 1 and w not in STOPWORDS]


def specify(queries, vectors: dict[str, list[float]] | None = None) -> list[QuerySpec]:
    """A specification for each distinct query; the id is the normalized text."""
    out = []
    for text in dict.fromkeys(filter(None, map(normalize, flatten(queries)))):
        filters, clean = extract_filters(text)
        vector = (vectors or {}).get(text)
        out.append(QuerySpec(text, text, clean, tuple(tokens_of(clean)), tuple(filters), tuple(vector) if vector else None))
    return out
