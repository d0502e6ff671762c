"""Cross-tokenizer alignment of a byte-level BPE (A) with a SentencePiece model (B), in Arrow batches.

A block of documents is encoded by both tokenizers; lists are flattened with their parent indices, token lengths are summed
within each document, and the ends of A and B meet in an Acero hash join on (document, end). Shared ends cut the tokens into
groups; each stretch between two neighbouring ends of either side is one overlapping pair. Table.group_by counts pairs within
a document and documents within a block; Spark adds up the blocks' counts, finds each A id's highest one, and returns the
counts to the blocks that hold the pairs.

A encodes a space and the text, B the text (it adds the space itself); both must give the bytes of space and text back, else
the document has no tokens, as null and empty texts have none: numbers are 0 and the digest is ''. Every row is a document of
its own, so repeated rows and ids count each; a null doc_id stays null; other columns are ignored; an empty table gives an
empty result. Texts are whole whatever their length; memory: one block, `BLOCK` bytes of text or one document.

Both encoders treat a text cut before a single space and a character that isn't blank as the sum of its parts: A starts a
pre-token there, no piece of B holds a space after another character (checked when the model is loaded). Parts that were
encoded before are taken from a cache (`CACHE` characters, then emptied). A's ids come from the rank file of the same
vocabulary, which encodes faster (tests hold the two equal); parts with very long runs of blanks, which that library can't
take, go to the JSON file's own library.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import freed, kept, sliced, written

BLOCK = 1_500_000  # bytes of text
CACHE = 5_000_000  # characters of encoded parts that a worker keeps; a bound on memory alone
CUT, BLANKS = re.compile(r"(?<! ) (?=\S)"), re.compile(r"\s{20000}")
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
SCHEMA = f"block long, kind int, {DOC}, at array<int>, times array<int>, pos int, a int, b int, docs long"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both tokenizers and what each id stands for in bytes."""

    def __init__(self, a_json: str, a_ranks: str, pattern: str, b_model: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a_own = Tokenizer.from_file(a_json)
        self.a_own.encode_special_tokens = True
        with open(a_ranks, "rb") as f:
            ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
        self.a_fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        size = self.a_own.get_vocab_size()
        byte = {c: n for n, c in enumerate(_shown())}
        said = [self.a_own.id_to_token(i) or "" for i in range(size)]
        a = [bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x in said]
        b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = [pa.array(a, pa.binary()), pa.array(b, pa.binary())]
        self.length = [np.array([len(x) for x in t], np.int64) for t in (a, b)]
        # what a token shows in a group's text: its id and what follows it
        self.text = pa.array([f"{i}{c}" for n in (len(a), len(b)) for i in range(n) for c in (",", "|", ";")])
        self.shift = 3 * len(a)
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size())):
            raise ValueError("a piece holds a space after another character; texts can't be cut at spaces")
        self._empty()

    def encoded(self, texts: list[str]) -> list[pa.ListArray]:
        """The ids of A and of B, a list a text."""
        if self.held > CACHE:
            self._empty()
        flat, ends = [], [0]
        for t in texts:
            first, *rest = CUT.split(" " + t)
            flat += [first[1:], *rest] if first else rest  # the space before a part is left out
            ends.append(len(flat))
        new = [x for x in dict.fromkeys(flat) if x not in self.known]
        if new:
            self.held += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            for n, ids in enumerate(([self._a(" " + x) for x in new], self.b.encode(new, num_threads=1))):
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                self.tables[n] = pa.concat_arrays([self.tables[n], ids])
        at = pa.array(np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)))
        parts = [x.take(at) for x in self.tables]
        return [pa.ListArray.from_arrays(x.offsets.take(pa.array(ends)), x.values) for x in parts]

    def _empty(self) -> None:
        self.known, self.held, self.tables = {}, 0, [pa.array([], pa.list_(pa.int32()))] * 2

    def _a(self, part: str):
        if BLANKS.search(part):
            return self.a_own.encode(part, add_special_tokens=False).ids
        return self.a_fast.encode_ordinary(part)


def _shown() -> str:
    """The characters that byte-level vocabularies write bytes 0 to 255 as: printable ones stand for themselves, the others
    follow from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(n if n in own else next(rest)) for n in range(256))


def _pair_of(*args) -> Pair:
    return kept(("alignment", *args), lambda: Pair(*args))


def _ends(ids: pa.ListArray, length: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Flattened ids, their documents, and the keys (document, end within it) of their ends."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).to_numpy()
    total = pc.cumulative_sum(pa.array(length[flat.to_numpy()])).to_numpy()
    starts = ids.offsets.to_numpy()
    base = np.concatenate([[0], total])[starts[:-1]]
    return flat, parent, (parent.astype(np.int64) << 40) + total - base[parent]


def aligned(pair: Pair, texts: list[str | None]) -> tuple[pa.Table, pa.Table]:
    """For a block's texts: a row a document (numbers, digest, its pairs as places in the second table and how often it holds
    each) and a row a distinct id pair (a, b, docs: the documents that hold it)."""
    whole = [t or "" for t in texts]
    ids = pair.encoded(whole)
    said = pa.array([b" " + t.encode() for t in whole], pa.binary())
    same = np.array([bool(t) for t in whole], bool)
    for x, table in zip(ids, pair.bytes):
        joined = pc.binary_join(pa.ListArray.from_arrays(x.offsets, table.take(pc.list_flatten(x))), pa.scalar(b"", pa.binary()))
        same &= pc.fill_null(pc.equal(joined, said), False).to_numpy(zero_copy_only=False)
    kept_rows = pa.array(np.flatnonzero(same))
    ids = [x.take(kept_rows) for x in ids]
    n = len(kept_rows)
    (fa, pa_, ka), (fb, pb, kb) = (_ends(x, size) for x, size in zip(ids, pair.length))
    fa, fb = fa.to_numpy(), fb.to_numpy()
    shared = pa.table({"k": ka}).join(pa.table({"k": kb}), "k", join_type="inner", use_threads=False)["k"].to_numpy()
    shared = np.sort(shared)
    # groups as text: a document's tokens in the order of groups, A before B, each with what follows it
    edge = np.append(shared, -1)
    last_a, last_b = (edge[np.searchsorted(shared, k)] == k for k in (ka, kb))
    ga, gb = (np.cumsum(x) - x for x in (last_a, last_b))
    before_b = np.searchsorted(gb, ga)  # B tokens of earlier groups
    before_a = np.searchsorted(ga, gb, side="right")  # A tokens of this and earlier groups
    order = np.empty(len(ka) + len(kb), np.int64)
    order[np.arange(len(ka)) + before_b] = 3 * fa.astype(np.int64) + last_a
    order[np.arange(len(kb)) + before_a] = pair.shift + 3 * fb.astype(np.int64) + 2 * last_b
    counts = np.bincount(pa_, minlength=n) + np.bincount(pb, minlength=n)
    shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pair.text.take(pa.array(order))), "")
    digest = [hashlib.sha256(x[:-1].encode()).hexdigest() for x in shown.to_pylist()]
    # links: one a stretch between neighbouring ends
    cuts = np.sort(np.concatenate([ka, kb]), kind="stable")
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])[: len(cuts)]]
    doc = (cuts >> 40).astype(np.int32)
    link = fa[np.searchsorted(ka, cuts)].astype(np.int64) * len(pair.bytes[1]) + fb[np.searchsorted(kb, cuts)]
    each = pa.table({"doc": doc, "pair": link}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    pairs = each.group_by("pair", use_threads=False).aggregate([([], "count_all")])
    by_doc = np.argsort(each["doc"].to_numpy(), kind="stable")
    at = pc.index_in(each["pair"].combine_chunks(), pairs["pair"].combine_chunks()).to_numpy()[by_doc]
    of = np.cumsum([0, *np.bincount(each["doc"].to_numpy(), minlength=n)])
    lists = [pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(x.astype(np.int32))) for x in (at, each["count_all"].to_numpy()[by_doc])]
    back = np.full(len(texts), -1)
    back[np.flatnonzero(same)] = np.arange(n)
    back = pa.array(back, mask=back < 0)
    number = lambda x: pc.fill_null(pa.array(np.asarray(x, np.int64)).take(back), 0)
    docs = {
        "n_a": number(np.bincount(pa_, minlength=n)), "n_b": number(np.bincount(pb, minlength=n)), "n_groups": number(np.bincount(shared >> 40, minlength=n)),
        "n_links": number(np.bincount(doc, minlength=n)), "groups_sha256": pc.fill_null(pa.array(digest, pa.string()).take(back), ""), "at": lists[0].take(back), "times": lists[1].take(back),
    }
    p = pairs["pair"].to_numpy()
    size = len(pair.bytes[1])
    return pa.table(docs), pa.table({"a": (p // size).astype(np.int32), "b": (p % size).astype(np.int32), "docs": pairs["count_all"].to_numpy()})


def blocks(docs: DataFrame, *args) -> DataFrame:
    """Rows of kind 0 (a document) and 1 (an id pair of a block)."""
    names = [x.split()[0] for x in SCHEMA.replace(", ", ",").split(",")]
    kinds = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pos", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])

    def run(batches):
        pair, block = _pair_of(*args), TaskContext.get().partitionId() << 32

        def filled(n: int, **have):
            return pa.RecordBatch.from_arrays([have[k].cast(kinds.field(k).type) if k in have else pa.nulls(n, kinds.field(k).type) for k in names], schema=kinds)

        for part in sliced(batches, BLOCK):
            block += 1
            rows, pairs = aligned(pair, part.column("text").to_pylist())
            n, m = rows.num_rows, pairs.num_rows
            full = lambda v, k: pa.array(np.full(k, v))
            yield filled(n, block=full(block, n), kind=full(0, n), doc_id=part.column("doc_id"), **{k: rows[k].combine_chunks() for k in rows.column_names})
            yield filled(m, block=full(block, m), kind=full(1, m), pos=pa.array(np.arange(m)), **{k: pairs[k].combine_chunks() for k in pairs.column_names})
        freed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def alignment(docs: DataFrame, *args) -> DataFrame:
    """A row a document with the numbers of tokens, groups, links, of links that are their A id's most frequent ones, and the
    sum of the links' document counts. args: as of `Pair`."""
    rows = written(blocks(docs, *args))
    pairs = rows.filter("kind = 1").select("block", "pos", "a", "b", "docs")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("n")))
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))  # a row an id of A's vocabulary at most
    known = pairs.join(counts.join(best, "a"), ["a", "b"]).select(F.col("block").alias("of"), "pos", "n", (F.col("n") == F.col("most")).alias("best"))
    found = rows.filter("kind = 0").select("block", *[x.split()[0] for x in DOC.split(", ")], "at", "times")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, np.int64)
        pos = right["pos"].to_numpy()
        n[pos], best[pos] = right["n"].to_numpy(), right["best"].to_numpy()
        at, times = (left[c].combine_chunks() for c in ("at", "times"))
        place, often = pc.list_flatten(at).to_numpy(), pc.list_flatten(times).to_numpy()
        parent = pc.list_parent_indices(at).to_numpy()
        add = lambda x: pa.array(np.bincount(parent, x[place] * often, left.num_rows).astype(np.int64))  # noqa: E731  sums stay under 2^53
        out = {c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": add(best), "count_sum": add(n), "groups_sha256": left["groups_sha256"]}
        return pa.table(out)

    return found.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(summed, OUT)


def query(docs: DataFrame, path) -> DataFrame:
    """path(name) gives the place of a public tokenizer's file."""
    import public_tokenizers

    return alignment(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))
