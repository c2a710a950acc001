"""Byte-level BPE encoding and decoding with an existing public vocabulary."""

from __future__ import annotations

import hashlib
import json
from array import array
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vertebra.llm.common import lean, slices, with_fields

# Fixed value: the pre-tokenizer's pattern, with white space as the tokenizer's regex engine knows it.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: its own if printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Tokenizer:
    """Exact BPE in time linear in the text.

    An Aho-Corasick automaton gives the longest token at each place of a piece. The encoder goes on with the longest
    token that is compatible with the one before, takes the next shorter one if none is, and steps back when a place has
    none left; a place once left is not tried again. Two tokens are compatible if no merge crosses between them, which a
    table remembers. Decoding copies the ids' bytes by an offset table.

    Every Python worker has one, so tables are arrays by token id where they can be, and what is remembered of pieces and
    of pairs is bounded (most_pieces of each, results don't depend on it): when half of that is new, what wasn't met
    since then goes.
    """

    def __init__(self, path: str, most_pieces: int = 160_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {x: b for b, x in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.half = max(1, most_pieces // 2)
        self.forget()
        size = self.size = max([*vocab.values(), *self.added.values()]) + 1
        # by token: the merge that makes it (-1 for none) and its two parts, its length, the next shorter token it starts with
        self.rank, self.left, self.right, self.length, self.shorter = (array("i", [-1]) * size for _ in range(5))
        self.merge_rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[x * size + y] = rank
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)  # a character stands for the byte of its number
        usable = {t: i for t, i in vocab.items() if t not in self.added and (len(t) == 1 or self.rank[i] >= 0)}
        for t, i in usable.items():
            self.automaton.add_word("".join(chr(back[x]) for x in t), i)
            self.length[i] = len(t)
            self.shorter[i] = next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1)
        self.automaton.make_automaton()
        raw = [b""] * size
        for t, i in {**vocab, **self.added}.items():
            raw[i] = bytes(back[x] for x in t) if all(x in back for x in t) else t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart when their bytes are merged together.

        Undoes the merges inside the two, latest first. Whenever the tokens that then meet could be merged before either
        is used up by its own next merge, they would be; of equal ranks the leftmost merge comes first.
        """
        key = a * self.size + b
        known = self.fits.get(key)
        if known is None:
            known = self.old_fits.get(key)
            if known is None:
                known = self._apart(a, b)
            if len(self.fits) >= self.half:
                self.old_fits, self.fits = self.fits, {}
            self.fits[key] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        size, none = self.size, 1 << 40
        used_a = used_b = none
        while True:
            rank = self.merge_rank.get(a * size + b, none)
            if rank < used_a and rank <= used_b and rank != none:
                return False
            made_a, made_b = self.rank[a], self.rank[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                used_a, a = made_a, self.right[a]
            else:
                used_b, b = made_b, self.left[b]

    def piece(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of one piece of text between the pre-tokenizer's cuts."""
        s = text.encode().decode("latin-1")
        size, length, compatible = len(s), self.length, self.compatible
        longest = [-1] * size
        for end, token in self.automaton.iter(s):
            longest[end - length[token] + 1] = token
        token = longest[0]
        if token >= 0 and length[token] == size:
            return token.to_bytes(4, "little")
        out, open_, at = [], [True] * (size + 1), 0
        while at < size:
            while token >= 0:
                to = at + length[token]
                if open_[to] and (not out or compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < size else -1
            else:
                open_[at] = False
                last = out.pop()
                at -= length[last]
                token = self.shorter[last]
        return pack(f"<{len(out)}I", *out)

    def _plain(self, text: str, ids: list[bytes]) -> None:
        known, old = self.pieces, self.old_pieces
        for p in PIECE.findall(text):
            got = known.get(p)
            if got is None:
                got = old.get(p) or self.piece(p)
                if len(p) <= 64:
                    if len(known) >= self.half:
                        old, known = self.old_pieces, self.pieces = known, {}
                    known[p] = got
            ids.append(got)

    def encode(self, text: str) -> np.ndarray:
        ids: list[bytes] = []
        at = 0
        if self.added_pattern is not None:
            for m in self.added_pattern.finditer(text):
                self._plain(text[at : m.start()], ids)
                ids.append(self.added[m[0]].to_bytes(4, "little"))
                at = m.end()
        self._plain(text[at:] if at else text, ids)
        return np.frombuffer(b"".join(ids), dtype="<u4")

    def forget(self) -> None:
        """Drops what has been remembered of texts; the vocabulary's tables stay."""
        self.pieces: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.old_pieces, self.old_fits = {}, {}

    def decode(self, ids: np.ndarray, most: int = 1 << 14) -> str:
        """most: ids that are copied at once."""
        out = []
        for i in range(0, len(ids), most):
            part = ids[i : i + most].astype(np.int64)
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes())
        return b"".join(out).decode("utf-8", errors="replace")


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per Python worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Adds ids (array of int), n_tokens, ids_sha256 and decoded_sha256 to every row; columns so named are replaced.

    path: a tokenizer.json with a byte-level BPE vocabulary, at the same place on every executor. A null text counts as
    empty: no ids. Added tokens' strings in a text become those tokens. Whole texts are encoded, whatever their length.
    with_ids False leaves the ids out, with_text False the text, which then isn't sent back from Python.
    """
    ours = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    docs = docs.select(*[c for c in docs.columns if c not in (*ours, "ids")])
    columns = docs.columns
    back_too = [c for c in columns if with_text or c != "text"]
    schema = with_fields(docs.select(*back_too), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def run(batches):
        t, at = tokenizer(path), columns.index("text")
        try:
            for part in slices(batches, at, 1 << 20):
                n, sha, back, ids = [], [], [], []
                for x in part.column(at).to_pylist():
                    got = t.encode(x or "")
                    n.append(len(got))
                    sha.append(hashlib.sha256(got.tobytes()).hexdigest())
                    back.append(hashlib.sha256(t.decode(got).encode()).hexdigest())
                    if with_ids:
                        ids.append(got.astype(np.int32))
                arrays = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in back_too), *arrays], names=[*back_too, *ours])
        finally:
            t.forget()  # workers outlive their tasks, and later stages need the memory

    return docs.mapInArrow(lean(run), schema)
