"""Documents that hold a test item, exactly or up to a few edits.

An item of n characters may differ from a passage by budget(n) edits. It is cut into one piece more than
that; so at least one piece stands unchanged in any such passage. All pieces are searched at once with an
Aho-Corasick automaton, and the text around each hit is checked with Myers' bit-parallel distance, which
lets the passage begin and end anywhere. Texts and items are compared in lower case, with runs of white
space as one space.

The items go to the executors in blocks of BLOCK_CHARS characters at most, one pass over the documents
for each block, so what is broadcast is bounded whatever the number of items.

An item of under CHARS_PER_EDIT characters may have no edit, and must stand as whole words. It still counts: an item
"the" is in every text that has that word, so leave such items out of the table if they aren't meant.

Null and empty texts hold no item; null and empty items are in no text. An item without id is
searched for as any other and reported with a null id. Items with equal text are
reported each under its own id, repeated documents each in their own row. Of several passages of an item
in a document the one with the least distance is reported, then the first. Empty tables give no rows.
Other columns are kept or left unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: One edit for so many characters of an item.
CHARS_PER_EDIT = 12
BLOCK_CHARS = 4_000_000
HITS = T.ArrayType(C.struct(item_id=C.LONG, distance=C.INT))


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def budget(n: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return n // chars_per_edit


def pieces_of(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def best_distance(masks: dict[str, int], size: int, text: str) -> int:
    """Least edit distance between the item and any part of the text (Myers 1999, bit-parallel)."""
    ones, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = ones, 0, size, size
    get = masks.get
    for c in text:
        equal = get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        plus = down | ~(across | up) & ones
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus = plus << 1 & ones
        minus = minus << 1 & ones
        along = equal | down
        down = plus & along
        up = minus | ~(along | plus) & ones
    return best


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond either end."""
    goes_on = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not goes_on(start) and not goes_on(end)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        import ahocorasick

        self.ids: dict[str, list[int]] = {}
        for i, text in items:
            if text := plain(text or ""):
                self.ids.setdefault(text, []).append(i)
        self.items = [(text, budget(len(text), chars_per_edit)) for text in self.ids]
        self.masks: list[dict[str, int] | None] = [None] * len(self.items)
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (text, edits) in enumerate(self.items):
            for at, piece in pieces_of(text, edits):
                places.setdefault(piece, []).append((k, at))
        self.trie = ahocorasick.Automaton()
        for piece, where in places.items():
            self.trie.add_word(piece, (len(piece), where))
        if places:
            self.trie.make_automaton()

    def hits(self, text: str) -> list[dict[str, int]]:
        text = plain(text)
        if not text or not self.items:
            return []
        best: dict[int, int] = {}
        seen: dict[int, tuple[int, int]] = {}
        for last, (size, where) in self.trie.iter(text):
            for k, at in where:
                if best.get(k) == 0:
                    continue
                item, edits = self.items[k]
                start = last - size + 1 - at
                if not edits:
                    if start >= 0 and text.startswith(item, start) and whole_words(text, start, start + len(item)):
                        best[k] = 0
                    continue
                if start >= 0 and text.startswith(item, start):
                    best[k] = 0
                    continue
                low, high = max(0, start - edits), start + len(item) + edits
                if k in seen and seen[k][0] <= low and high <= seen[k][1]:
                    continue
                seen[k] = low, high
                masks = self.masks[k]
                if masks is None:
                    masks = self.masks[k] = peq(item)
                d = best_distance(masks, len(item), text[low:high])
                if d <= edits and d < best.get(k, edits + 1):
                    best[k] = d
        return sorted(({"item_id": i, "distance": d} for k, d in best.items() for i in self.ids[self.items[k][0]]), key=lambda h: (h["item_id"] is None, h["item_id"] or 0, h["distance"]))


def blocks(items: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for row in items.select(F.col(item_id), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def with_hits(docs: DataFrame, carry: list[str], found: str, block, text: str, chars_per_edit: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def make() -> Callable[[list[str]], dict[str, list]]:
        m = Matcher(sent.value, chars_per_edit)
        return lambda texts: {found: [m.hits(t) for t in texts]}

    return C.map_texts(docs, carry, text, make, T.StructType([T.StructField(found, HITS)]))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
            chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance: a row for each item that a document holds."""
    parts = []
    for block in blocks(items, item_id, item_text, block_chars):
        hits = with_hits(docs, [doc_id], "hits", block, text, chars_per_edit)
        parts.append(hits.where(F.size("hits") > 0).select(F.col(doc_id), F.inline("hits")))
    if not parts:
        return docs.select(F.col(doc_id), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("distance")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, as they are, that hold no item. Nothing is shuffled."""
    for block in blocks(items, item_id, item_text, block_chars):
        found = C.fresh(docs, "hits")
        docs = with_hits(docs, docs.columns, found, block, text, chars_per_edit).where(F.size(found) == 0).drop(found)
    return docs
