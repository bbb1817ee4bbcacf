"""Edit-aware token counts (operator 8): a segment tree over each document's pieces.

A text is cut into pieces that the tokenizer never joins (``tokens.cuts``).
Blocks of pieces are the leaves of a segment tree whose nodes hold the sums of
characters and tokens below them. Pieces are the tokenizer's own pre-tokens, or a few
of them, in any script. An edit finds its pieces by walking down the
character sums, re-cuts the touched pieces with one more on either side (a cut
depends on the neighbouring characters only), encodes just those, and updates
the sums on the way up.

Trees are kept as a table (``built``) and edited by tables of edits
(``edited``). An edit encodes the pieces it touches and one more on either side, and
nothing else; a single pre-token of any length, such as a run of letters without a sign or
a space, is one piece, because its tokens depend on all of it.

Strings of special tokens are counted as ordinary text. Defined cases: null and
empty texts have one empty piece and 0 tokens; an edit's range is cut to the
text, a null start or insertion is 0 or empty; edits of a document apply in
order of ``edit_no`` (nulls first), each to the text that the ones before left;
edits of unknown documents do nothing; of rows with the same id each gets the
edits; a document with a null id gets none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import by_doc, ship
from millrun.llm.tokens import PieceEncoder, encoder

#: Pieces of a new leaf block; a block that grows to four times as many is split by a rebuild.
BLOCK = 64


class TokenTree:
    """Sums of characters and tokens over blocks of pieces."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, enc: PieceEncoder):
        """A tree over counted pieces; nothing is encoded."""
        self.enc, self.encoded, self.chars_encoded = enc, 0, 0
        self._build(text, chars, tokens)

    @classmethod
    def of(cls, text: str, enc: PieceEncoder) -> "TokenTree":
        return cls(text, *enc.counted(text), enc)

    def _build(self, text, chars, tokens):
        starts = np.arange(0, len(chars), BLOCK)
        in_block = np.add.reduceat(chars, starts, dtype=np.int64)
        ends = np.cumsum(in_block).tolist()
        self.texts = [text[a:b] for a, b in zip([0, *ends], ends)]
        self.piece_chars = [chars[i:i + BLOCK] for i in starts.tolist()]
        self.piece_tokens = [tokens[i:i + BLOCK] for i in starts.tolist()]
        self.size = 1 << (len(starts) - 1).bit_length()
        rest = [0] * (self.size - len(starts))
        self.chars = [0] * self.size + in_block.tolist() + rest
        self.tokens = [0] * self.size + np.add.reduceat(tokens, starts, dtype=np.int64).tolist() + rest
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _set(self, block: int, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Replace a block and update the sums above it."""
        self.texts[block], self.piece_chars[block], self.piece_tokens[block] = text, chars, tokens
        i = self.size + block
        self.chars[i], self.tokens[i] = len(text), int(tokens.sum())
        while i > 1:
            i //= 2
            self._sum(i)

    def _find(self, at: int) -> tuple[int, int]:
        """Block and piece that hold character ``at`` (or the last ones), down the sums."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        ends = np.cumsum(self.piece_chars[i - self.size])
        return i - self.size, max(min(int(np.searchsorted(ends, at - start, side="right")), len(ends) - 1), 0)

    def _step(self, block: int, k: int, by: int) -> tuple[int, int]:
        """The neighbouring piece, or the same one at an end."""
        was = block, k
        k += by
        while not 0 <= k < len(self.piece_chars[block]):
            block += by
            if not 0 <= block < len(self.texts):
                return was
            k = 0 if by > 0 else len(self.piece_chars[block]) - 1
        return block, k

    def _before(self, block: int) -> int:
        """Characters before a block, from the sums left of the way up."""
        i, n = self.size + block, 0
        while i > 1:
            if i % 2:
                n += self.chars[i - 1]
            i //= 2
        return n

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters at ``start`` by ``inserted``."""
        start = min(max(start, 0), self.chars[1])
        end = min(start + max(removed, 0), self.chars[1])
        b1, k1 = self._step(*self._find(start), -1)
        b2, k2 = self._step(*self._find(end), 1)
        c1, t1 = self.piece_chars[b1], self.piece_tokens[b1]
        c2, t2 = self.piece_chars[b2], self.piece_tokens[b2]
        left, right = int(c1[:k1].sum()), int(c2[k2 + 1:].sum())
        tail = self.texts[b2][len(self.texts[b2]) - right:]
        head = self.texts[b1][:left]
        region = "".join(self.texts[b1:b2 + 1])
        region = region[left:len(region) - right]
        at = self._before(b1) + left
        region = region[:start - at] + inserted + region[end - at:]
        chars, tokens = self.enc.counted(region) if region else (c1[:0], t1[:0])
        self.encoded += len(chars)
        self.chars_encoded += len(region)
        last = b1 == b2
        self._set(b1, head + region + (tail if last else ""), np.concatenate([c1[:k1], chars, c2[k2 + 1:] if last else c1[:0]]),
                  np.concatenate([t1[:k1], tokens, t2[k2 + 1:] if last else t1[:0]]))
        for b in range(b1 + 1, b2):
            self._set(b, "", c1[:0], t1[:0])
        if not last:
            self._set(b2, tail, c2[k2 + 1:], t2[k2 + 1:])
        if len(self.piece_chars[b1]) > 4 * BLOCK:
            self._build(self.text(), *self.leaves())

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of all pieces."""
        return np.concatenate(self.piece_chars), np.concatenate(self.piece_tokens)


def _listed(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def built(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text, n_tokens, piece_chars, piece_tokens``: every document's tree leaves."""
    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in by_doc(batch, 64):
                texts = [t or "" for t in part.column(1).to_pylist()]
                trees = [TokenTree.of(t, enc) for t in texts]
                leaves = [t.leaves() for t in trees]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array([t.total() for t in trees], pa.int64()),
                     _listed([x for x, _ in leaves]), _listed([x for _, x in leaves])],
                    ["doc_id", "text", "n_tokens", "piece_chars", "piece_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, text string, n_tokens long, piece_chars array<int>, piece_tokens array<int>")


def _apply(trees: DataFrame, path: str | None) -> DataFrame:
    """``trees`` with a column ``edits`` (an ordered array, or null) become edited trees."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in by_doc(batch, 64):
                ids, texts, before, chars, tokens, changes = part.columns
                trees, n_edits = [], []
                for i, (text, edits) in enumerate(zip(texts.to_pylist(), changes.to_pylist())):
                    tree = TokenTree(text, chars[i].values.to_numpy(), tokens[i].values.to_numpy(), enc)
                    for e in edits or []:
                        tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                    trees.append(tree)
                    n_edits.append(len(edits or []))
                leaves = [t.leaves() for t in trees]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([t.text() for t in trees], pa.string()), pa.array([t.total() for t in trees], pa.int64()),
                     _listed([x for x, _ in leaves]), _listed([x for _, x in leaves]), before, pa.array(n_edits, pa.int64()),
                     pa.array([t.encoded for t in trees], pa.int64()), pa.array([t.chars_encoded for t in trees], pa.int64())],
                    ["doc_id", "text", "n_tokens", "piece_chars", "piece_tokens", "n_before", "n_edits", "n_encoded",
                     "n_chars_encoded"])

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.select("doc_id", "text", "n_tokens", "piece_chars", "piece_tokens", "edits").mapInArrow(
        run, f"doc_id {kind}, text string, n_tokens long, piece_chars array<int>, piece_tokens array<int>, "
             "n_before long, n_edits long, n_encoded long, n_chars_encoded long")


def edited(trees: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Apply ``edits`` (``doc_id, edit_no, start, removed, inserted``) to kept trees.

    The new trees, with ``n_before``, ``n_edits``, ``n_encoded`` and ``n_chars_encoded`` (pieces
    and characters encoded anew)."""
    ship(trees.sparkSession)
    by = edits.groupBy(F.col("doc_id").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("edit_no", "start", "removed", "inserted"))).alias("edits"))
    return _apply(trees.join(by, F.col("doc_id") == F.col("of"), "left"), path)


def edited_in_place(trees: DataFrame, path: str | None = None) -> DataFrame:
    """As ``edited`` for trees that already carry their ordered ``edits``; nothing is shuffled."""
    ship(trees.sparkSession)
    return _apply(trees, path)
