"""Token counts (operator 8): edit-aware counting with a segment tree over each document's pre-tokens.

A leaf is a run of whole pre-tokens; it starts at a blank between two letters or digits, where every
pre-tokenisation begins a new pre-token, whatever stands further away. Nodes hold the characters and
tokens below them. An edit is located by descending the character sums; only the leaves that it
touches, and one character of context on either side, are encoded again, and their sums are updated
up to the root. What an edit leaves is cut into leaves again, so no leaf grows with the edits.

``count`` builds the trees; they are plain arrays, stored beside the texts. ``resume`` takes stored trees and
edits and encodes nothing but what the edits touch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import slices
from readloom.llm.packing import VOCABULARY, encoder

#: Characters of a leaf, at least (the last one may have fewer).
LEAF = 256
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def leaf_sizes(text: str, leaf: int = LEAF) -> list[int]:
    """Characters of each leaf of a text; an empty text has one empty leaf."""
    out, start = [], 0
    while found := _CUT.search(text, start + leaf):
        out.append(found.start() - start)
        start = found.start()
    return [*out, len(text) - start]


class TokenTree:
    """Heap-ordered sums: node i has children 2i and 2i+1; the leaves are the upper half."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.half = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, text: str, count, leaf: int = LEAF) -> TokenTree:
        sizes, at, counts = leaf_sizes(text, leaf), 0, []
        for n in sizes:
            counts.append(count(text[at : at + n]))
            at += n
        return cls(*laid_out(sizes, counts))

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character ``place``, and where it starts."""
        node, start = 1, 0
        while node < self.half:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node, start

    def set(self, node: int, chars: int, tokens: int) -> None:
        self.chars[node], self.tokens[node] = chars, tokens
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that aren't empty (of an empty text: of its one leaf)."""
        full = [i for i in range(self.half, 2 * self.half) if self.chars[i]] or [self.half]
        return [self.chars[i] for i in full], [self.tokens[i] for i in full]

    def edit(self, text: str, start: int, removed: int, inserted: str, count, leaf: int = LEAF) -> tuple[str, int]:
        """The edited text and how many characters were encoded again; the sums follow."""
        n = len(text)
        start = min(max(start, 0), n)
        end = min(start + max(removed, 0), n)
        # a leaf's start is safe if the characters around it, one on either side, aren't edited
        first, low = self.leaf_at(max(start - 2, 0))
        last, at = self.leaf_at(min(end, max(n - 1, 0)))
        high = at + self.chars[last]
        if high == end and high < n:  # its end is another leaf's start, which the edit adjoins
            last, at = self.leaf_at(high)
            high = at + self.chars[last]
        new = text[:start] + inserted + text[end:]
        region = new[low : len(new) - (n - high)]
        sizes, at, tokens = leaf_sizes(region, leaf) if region else [0], 0, []
        for size in sizes:
            tokens.append(count(region[at : at + size]))
            at += size
        slots = last - first + 1
        if len(sizes) <= slots:  # in place, each sum updated up to the root
            for i in range(slots):
                own = (sizes[i], tokens[i]) if i < len(sizes) else (0, 0)
                if own != (self.chars[first + i], self.tokens[first + i]):
                    self.set(first + i, *own)
        else:  # more leaves than before: the tree is laid out anew, no other leaf is encoded
            chars = [*self.chars[self.half : first], *sizes, *self.chars[last + 1 :]]
            counts = [*self.tokens[self.half : first], *tokens, *self.tokens[last + 1 :]]
            full = [i for i, c in enumerate(chars) if c]
            self.__init__(*laid_out([chars[i] for i in full], [counts[i] for i in full]))
        return new, len(region)


def laid_out(sizes: list[int], counts: list[int]) -> tuple[list[int], list[int]]:
    """Heap-ordered sums over leaves of these characters and tokens."""
    half = 1 << (len(sizes) - 1).bit_length()
    chars, tokens = [0] * 2 * half, [0] * 2 * half
    chars[half : half + len(sizes)], tokens[half : half + len(sizes)] = sizes, counts
    for i in range(half - 1, 0, -1):
        chars[i], tokens[i] = chars[2 * i] + chars[2 * i + 1], tokens[2 * i] + tokens[2 * i + 1]
    return chars, tokens


def _counter(vocabulary: str, folder: str | None):
    encode = encoder(vocabulary, folder)
    return lambda part: len(encode(part)) if part else 0


def count(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, vocabulary: str = VOCABULARY, folder: str | None = None
) -> DataFrame:
    """(id, text, n_tokens, tree_chars, tree_tokens) of each row: its text's token count and tree, to be stored.

    Null texts count as empty. Repeated rows stay; an empty table gives no rows; other columns are
    ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counter(vocabulary, folder)
        for batch in slices(batches, "text", 4 << 20):
            trees = [TokenTree.build(t, counted, leaf) for t in batch.column("text").to_pylist()]
            columns = [
                pa.array([t.tokens[1] for t in trees], pa.int64()),
                pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                pa.array([t.tokens for t in trees], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *columns], names)

    names = ["id", "text", "n_tokens", "tree_chars", "tree_tokens"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, text string, n_tokens long, tree_chars array<int>, tree_tokens array<int>")
    return out.withColumnRenamed("id", id_col)


def resume(
    trees: DataFrame,
    id_col: str = "doc_id",
    edits_col: str = "edits",
    leaf: int = LEAF,
    vocabulary: str = VOCABULARY,
    folder: str | None = None,
) -> DataFrame:
    """What ``count`` returned, after the edits of each row, and what they cost.

    ``trees`` has the columns that ``count`` returns and ``edits_col``: an array of structs (start, removed,
    inserted), applied in order, each to the text that the one before it left; places are code points and
    are clipped to the text. Returns id, text (edited), n_tokens (before), edited_tokens, edited_chars,
    recoded_chars (encoded again, over all edits), tree_chars and tree_tokens (after; they can be resumed
    again). Null edits and null parts of one count as none. A tree that doesn't fit its text is refused.
    Repeated rows stay; an empty table gives no rows; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counter(vocabulary, folder)
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for text, chars, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "tree_chars", "tree_tokens", "edits"))):
                text = text or ""
                tree, recoded = TokenTree(chars, tokens), 0
                if chars[1] != len(text):
                    raise ValueError(f"a stored tree of {chars[1]} characters for a text of {len(text)}")
                before = tree.tokens[1]
                for e in edits or []:
                    if e is not None:
                        text, n = tree.edit(text, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", counted, leaf)
                        recoded += n
                out.append((text, before, tree.tokens[1], len(text), recoded, tree.chars, tree.tokens))
            kinds = [pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names)

    names = ["id", "text", "n_tokens", "edited_tokens", "edited_chars", "recoded_chars", "tree_chars", "tree_tokens"]
    kind = trees.schema[id_col].dataType.simpleString()
    rows = trees.select(F.col(id_col).alias("id"), "text", "tree_chars", "tree_tokens", F.col(edits_col).alias("edits"))
    return rows.mapInArrow(
        run,
        f"id {kind}, text string, n_tokens long, edited_tokens long, edited_chars long, recoded_chars long, "
        "tree_chars array<int>, tree_tokens array<int>",
    ).withColumnRenamed("id", id_col)
