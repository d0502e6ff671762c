"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree (in blocks) whose nodes hold sums of characters and tokens. An
edit finds its leaves by descending on characters, re-encodes from two pre-tokens before the edit until the new cuts
meet the old ones again, and updates the sums on the way up. Counts equal those of encoding the edited text anew.

Edits (start, length, put) are code-point spans of the text as it is after the edits before it, cut to the text's ends.
Null texts are empty, null lengths 0, null replacements empty. Rows are independent; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored. Whole texts are counted, in memory of one text at a time.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import kept

BLOCK, MOST, CONTEXT, CACHE_PARTS = 64, 256, 3, 400_000  # leaves a block at first and at most, leaves before an edit; bound of memory alone
OUT = "doc_id long, tokens_before long, tokens_after long, chars_after long, reencoded long"


class Counter:
    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.cache = regex.compile(pattern), {}

    def tokens(self, part: str) -> int:
        if (n := self.cache.get(part)) is None:
            n = len(self.encoding.encode_ordinary(part))
            if len(part) <= 64:
                if len(self.cache) >= CACHE_PARTS:
                    self.cache.clear()
                self.cache[part] = n
        return n


class Tree:
    """Leaves in blocks; `sums` holds (characters, tokens) of every node of a binary tree over the blocks. Blocks have room for
    leaves that edits add, spread evenly over those that an edit touches; only when they are full is the tree built anew."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.text, self.reencoded, self.built = counter, text, 0, 0
        parts = counter.pattern.findall(text)
        get, new = counter.cache.get, counter.tokens
        leaves = [(len(p), get(p) or new(p)) for p in parts]
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self._build()

    def _build(self) -> None:
        self.built += 1
        self.size = 1 << max(0, (len(self.blocks) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(self.blocks)] = [(sum(c for c, _ in b), sum(t for _, t in b)) for b in self.blocks]
        level = self.size
        while level > 1:
            half = level >> 1
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, char: int) -> tuple[int, int]:
        """The block that holds a character, and the characters before that block."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, len(self.blocks) - 1), before

    def edit(self, start: int, length: int, put: str) -> None:
        start = max(0, min(start, len(self.text)))
        stop = min(len(self.text), start + max(0, length))
        text = self.text[:start] + put + self.text[stop:]
        hit, at = self._find(max(0, start - 1))
        first, before = hit, 0
        while first and before < CONTEXT:  # blocks before give the context that the edit's own block may lack
            first -= 1
            at -= int(self.sums[self.size + first, 0])
            before += len(self.blocks[first])
        span = [leaf for block in self.blocks[first : hit + 1] for leaf in block]
        cuts, n = [], at
        for k, (c, _) in enumerate(span):
            if n >= start:
                break
            cuts.append((n, k))
            n += c
        n, k = cuts[max(0, len(cuts) - CONTEXT)] if cuts else (at, 0)
        head = span[:k]
        shift = len(text) - len(self.text)
        old_block, old_leaf, old_at = first, 0, at
        new, pos, met = [], n, False
        for m in self.counter.pattern.finditer(text, n):
            pos = m.end()
            new.append((pos - m.start(), self.counter.tokens(m.group())))
            self.reencoded += 1
            if pos < start + len(put) + 1:
                continue
            while old_block < len(self.blocks) and old_at + shift < pos:
                if old_leaf >= len(self.blocks[old_block]):
                    old_block, old_leaf = old_block + 1, 0
                    continue
                old_at += self.blocks[old_block][old_leaf][0]
                old_leaf += 1
            if old_at + shift == pos and old_at >= stop:
                met = True
                break
        tail = self.blocks[old_block][old_leaf:] if met and old_block < len(self.blocks) else []
        last = old_block if met else len(self.blocks) - 1
        leaves = head + new + tail
        self.text = text
        held = last - first + 1
        if len(leaves) <= held * MOST:  # only these blocks' paths change
            each = max(1, -(-len(leaves) // held))
            for b in range(held):
                self.blocks[first + b] = own = leaves[b * each : (b + 1) * each]
                node = self.size + first + b
                self.sums[node] = (sum(c for c, _ in own), sum(t for _, t in own))
                while node > 1:
                    node >>= 1
                    self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
        else:
            self.blocks[first : last + 1] = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)]
            self._build()


def counter_of(ranks_path: str, pattern: str) -> Counter:
    """One counter a Python worker: its cache serves all tasks that the worker runs."""
    return kept(("counts", ranks_path, pattern), lambda: Counter(ranks_path, pattern))


def counted(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts before and after the edits of each row of docs (doc_id, text, edits: array of (start, length, put))."""

    def run(batches):
        counter = counter_of(ranks_path, pattern)
        for b in batches:
            out = []
            for i, text, edits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "edits"))):
                tree = Tree(text or "", counter)
                before = tree.total
                for e in edits or []:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["put"] or "")
                out.append((i, before, tree.total, len(tree.text), tree.reencoded))
            c = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], [x.split()[0] for x in OUT.split(", ")])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, OUT)


def own_edits(docs: DataFrame) -> DataFrame:
    """Three edits a text, made from the text itself: a replacement, an insertion and a deletion."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda start, length, put: F.struct(F.floor(start).cast("int").alias("start"), F.lit(length).cast("int").alias("length"), put.alias("put"))
    return docs.select("doc_id", "text", F.array(edit(n / 3, 12, F.substring("text", -7, 7)), edit(2 * n / 3, 0, F.substring("text", 1, 20)), edit(n / 2, 5, F.lit(""))).alias("edits"))


def query(docs: DataFrame, ranks_path: str) -> DataFrame:
    import public_tokenizers

    return counted(own_edits(docs), ranks_path, public_tokenizers.PATTERN)
