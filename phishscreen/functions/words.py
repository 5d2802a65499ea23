"""Many words at once (F18, F19, F27): all words of a list are one automaton, which a task builds once, so that a text is read
once however many words there are. Texts are compared as they are; callers lower them where case is to be left aside."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import Brand, Dictionaries
from .rows import by_row

#: Bytes of all words of a list, which go to each task; Spark broadcasts them.
MOST_BYTES = 64 << 20
HITS = pa.struct([(c, pa.list_(pa.string())) for c in ("brands", "brands_in_display", "brand_domains", "urgency_hits")])
_LETTERS_AND_DIGITS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def check_size(words: Iterable[str]) -> None:
    size = sum(len(w.encode()) for w in words)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of words; {MOST_BYTES} at most")


class Finder:
    """Which lists of words a text holds one of. Empty words are in no text. Where edges matter, words in ASCII count only
    between neighbours that are no lower-case letters or digits."""

    def __init__(self, lists: Iterable[Iterable[str]], edges: bool):
        import ahocorasick

        owners: dict[str, list[int]] = {}
        for i, words in enumerate(lists):
            for word in words:
                if word:
                    owners.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, own in owners.items():
            self.automaton.add_word(word, (len(word), edges and word.isascii(), tuple(own)))
        self.automaton.make_automaton()
        self.empty = not owners

    def __call__(self, text: str | None) -> list[int]:
        """Places of the lists in order, each once."""
        if not text or self.empty:
            return []
        found: set[int] = set()
        for end, (size, apart, own) in self.automaton.iter(text):
            before, after = text[end - size : end - size + 1] if end >= size else "", text[end + 1 : end + 2]
            if not apart or (before not in _LETTERS_AND_DIGITS and after not in _LETTERS_AND_DIGITS):
                found.update(own)
        return sorted(found)


def brand_words(brands: Iterable[Brand]) -> list[list[str]]:
    return [[k.lower() for k in b.keywords] for b in brands]


def find_brands(value: Column, dicts: Dictionaries) -> Column:
    """names of the brands that the text names, in dictionary order; none for null."""
    names, words = [b.name for b in dicts.brands], brand_words(dicts.brands)
    check_size(w for own in words for w in own)

    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(words, edges=True)
        for texts in batches:
            yield by_row(lambda x: [names[i] for i in finder(x)], [texts], pa.list_(pa.string()))

    return find(F.lower(value))


def word_hits(display: Column, subject: Column, body: Column, dicts: Dictionaries) -> Column:
    """STRUCT<brands, brands_in_display, brand_domains, urgency_hits>, each in the order of its list."""
    names, words, domains = [b.name for b in dicts.brands], brand_words(dicts.brands), [list(b.domains) for b in dicts.brands]
    phrases = list(dicts.urgency)
    check_size([*(w for own in words for w in own), *(d for own in domains for d in own), *phrases])

    @F.arrow_udf("brands array<string>, brands_in_display array<string>, brand_domains array<string>, urgency_hits array<string>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        brand, haste = Finder(words, edges=True), Finder([[p] for p in phrases], edges=False)

        def hits(both, shown, title, text):
            named = brand(both)
            urgent = sorted({*haste(title), *haste(text)})
            return {"brands": [names[i] for i in named], "brands_in_display": [names[i] for i in brand(shown)], "brand_domains": [d for i in named for d in domains[i]], "urgency_hits": [phrases[i] for i in urgent]}

        for batch in batches:
            yield by_row(hits, batch, HITS)

    return find(F.lower(F.concat_ws(" ", display, subject)), F.lower(display), subject, body)
