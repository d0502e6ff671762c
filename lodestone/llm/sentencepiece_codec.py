"""SentencePiece BPE encoding and decoding by backtracking over longest vocabulary matches.

A text is cut before each space run, around line breaks and characters that no piece holds, and between a letter and a
mark where no piece has the two side by side; no merge crosses such a cut (checked when the model is loaded). Each part is encoded left to right: take the
longest piece that the vocabulary's Aho-Corasick automaton matches at the position, accept it if re-merging it with its left neighbour
gives the same two pieces, else try the next shorter one; when none is left, drop the last piece and mark its end in a
bitfield so that no other path tries that position again. A sequence whose pieces all agree with their neighbours is
the merge order's own result. Characters outside the vocabulary become UTF-8 byte pieces.

Null and empty texts give no ids and an empty text. Rows are independent, so order, ties, repeated rows and empty tables
need no rule; texts of any length are processed whole (memory: one text and its ids). Parts that were encoded before are kept
in two generations of at most `CACHE_BYTES` each, whatever their number.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import kept

SPACE = "▁"
LAST = float("inf")
CACHE_BYTES, AGREE, ENTRY = 100_000_000, 120_000, 240  # bounds on memory alone: parts beyond them are encoded anew
ROWS = 500  # texts that are Python strings at once
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    def __init__(self, model_path: str, cache_bytes: int = CACHE_BYTES):
        import ahocorasick
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.cache_bytes = cache_bytes

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        assert model.trainer_spec.model_type == 2 and model.normalizer_spec.name == "identity", sp.__version__
        self.rank, self.ids, self.pieces, self.byte = {}, {}, [], {}
        for i, p in enumerate(model.pieces):
            self.pieces.append(p.piece)
            if p.type == 1:
                self.rank[p.piece], self.ids[p.piece] = -p.score, i
            elif p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
        self.byte_of = {i: b for b, i in self.byte.items()}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("a piece holds a space after another character; texts can't be cut at spaces")
        self.trie = ahocorasick.Automaton()
        for p in self.rank:
            self.trie.add_word(p, p)
        self.trie.make_automaton()
        self.longest = max(map(len, self.rank))
        self.shown = [None if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.shorter: dict = {}
        # marks that no piece holds right after a letter: no merge joins a word to them. The expression's class also takes
        # numeric characters such as superscripts; no cut is made after those that a piece joins to a mark
        letter = re.compile(r"[^\W\d_]")
        pairs = {(a, b) for p in self.rank for a, b in zip(p, p[1:]) if b in ".,;:!?" and letter.match(a)}
        marks = "".join(c for c in ".,;:!?" if not any(a.isalpha() and b == c for a, b in pairs))
        joined = "".join(sorted({re.escape(a) for a, b in pairs if b in marks}))
        word = f"{SPACE}*[^\\W\\d_]+(?=[{marks}]){f'(?<![{joined}])' if joined else ''}|" if marks else ""
        self.part = re.compile(f"\n|{word}{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        held = "".join(re.escape(c) for c in self.rank if len(c) == 1)
        self.unknown = re.compile(f"([^{held}]+)")
        self.agree: dict = {}
        self.told = 0
        self.cache: dict = {}
        self.older: dict = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """text by its merge rules alone: the lowest rank first, of equal ranks the leftmost."""
        parts, rank = list(text), self.rank
        if len(parts) > 40:
            return self._merged_long(parts)
        pairs = [rank.get(parts[i] + parts[i + 1], LAST) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == LAST:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], LAST)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], LAST)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        todo: list = []

        def offer(i: int) -> None:
            if 0 <= i and (j := nxt[i]) < len(parts) and (r := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(todo, (r, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while todo:
            _, i, a, b = heapq.heappop(todo)
            j = nxt[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], nxt[i] = a + b, "", nxt[j]
            if nxt[i] < len(parts):
                prv[nxt[i]] = i
            offer(prv[i])
            offer(i)
        return [p for p in parts if p]

    def fits(self, a: str | None, b: str) -> bool:
        known = self.merged(b if a is None else a + b) == ([b] if a is None else [a, b])
        if self.told >= AGREE:
            self.agree.clear()
            self.told = 0
        self.agree.setdefault(a, {})[b] = known
        self.told += 1
        return known

    def _shorter(self, piece: str) -> str:
        """The next shorter piece that a piece starts with; empty if none."""
        if (known := self.shorter.get(piece)) is None:
            known = piece[:-1]
            while known and known not in self.rank:
                known = known[:-1]
            self.shorter[piece] = known
        return known

    def _known(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary. The automaton sees no more of it at a place than the longest
        piece has characters, so a place costs the same in texts of any length; each character is a piece, so one is found."""
        n, at = len(text), 0
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        agree, fits, shorter = self.agree, self.fits, self._shorter
        longest, long = self.trie.iter_long, self.longest
        last, piece = None, next(longest(text[:long]))[1]
        while True:
            after = agree.get(last) or {}
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = after.get(piece)
                    if ok or ok is None and fits(last, piece):
                        break
                piece = shorter(piece)
            if piece:
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece, next(longest(text[end : end + long]))[1]
            else:
                if not out:
                    raise ValueError("no encoding found")
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                last, piece = out[-1] if out else None, shorter(piece)

    def encode_part(self, part: str) -> list[int]:
        ids, of = [], self.ids
        for run in self.unknown.split(part):
            if not run:
                continue
            if run[0] in of:
                ids += [of[p] for p in self._known(run)]
            else:
                ids += [self.byte[b] for b in run.encode()]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space put before the first word is taken away again."""
        text = self._joined(ids)
        return text[1:] if text.startswith(" ") else text

    def _joined(self, ids: list[int]) -> str:
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out, raw = [], bytearray()
        for i, x in zip(ids, shown):
            if x is None:
                raw.append(self.byte_of[i])
                continue
            out.append(raw.decode(errors="replace"))
            raw.clear()
            out.append(x)
        return "".join(out) + raw.decode(errors="replace")

    def known(self, part: str) -> str | tuple[str, str]:
        """A part's ids joined by commas, and their text where it isn't the part's own; parts that come up again outlive others."""
        if (value := self.older.get(part)) is None:
            ids = self.encode_part(part)
            value, text = ",".join(map(str, ids)), self._joined(ids)
            if text != part.replace(SPACE, " "):
                value = (value, text)
        if len(part) <= 64:
            if self.held >= self.cache_bytes:
                self.older, self.cache, self.held = self.cache, {}, 0
            self.cache[part] = value
            self.held += ENTRY + 2 * len(part) + 6 * len(part)  # the ids' text: up to six places a character
        return value

    def both(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, their number, the decoded text) of a whole text."""
        if not text:
            return "", 0, ""
        get, known = self.cache.get, self.known
        parts = self.part.findall(SPACE + text.replace(" ", SPACE))
        got = [get(p) or known(p) for p in parts]
        if tuple in set(map(type, got)):
            decoded = "".join([p.replace(SPACE, " ") if type(g) is str else g[1] for p, g in zip(parts, got)])
            got = [g if type(g) is str else g[0] for g in got]
        else:
            decoded = "".join(parts).replace(SPACE, " ")
        ids = ",".join(got)
        return ids, ids.count(",") + 1, decoded[1:] if decoded.startswith(" ") else decoded

    def encode(self, text: str | None) -> list[int]:
        joined = self.both(text)[0]
        return [int(x) for x in joined.split(",")] if joined else []


def codec_of(model_path: str, cache_bytes: int = CACHE_BYTES) -> Codec:
    """One codec a Python worker: its caches serve all tasks that the worker runs."""
    return kept(("sentencepiece", model_path, cache_bytes), lambda: Codec(model_path, cache_bytes))


def encoded(docs: DataFrame, model_path: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, number of ids and digests of ids and decoded text of every whole text; `cache_bytes` bounds memory alone."""

    def run(batches):
        codec, sha = codec_of(model_path, cache_bytes), hashlib.sha256

        def digests(text):
            ids, n, decoded = codec.both(text)
            return n, sha(ids.encode()).hexdigest(), sha(decoded.encode()).hexdigest()

        for b in batches:
            for start in range(0, b.num_rows, ROWS):  # a few texts at a time are Python's
                part = b.slice(start, ROWS)
                n, ids, decoded = zip(*map(digests, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
