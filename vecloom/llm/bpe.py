"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token at each place of a word.  The
encoder takes the longest token, or the next shorter one, that is compatible with the token before
it; two tokens are compatible if merging their joined text gives back just these two.  Places from
which the rest can't be encoded are marked and never tried again, so time is linear.  Since the
encoding by merges is the only one whose neighbours are all compatible, the result is exact.

Decoding joins slices of one string of all tokens, found by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import batches, small_batches

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def newer_lower_case() -> dict[int, str]:
    """Letters that the tokenizers library lower-cases otherwise than Python, whose Unicode tables are older."""
    from tokenizers.normalizers import Lowercase

    own, out = Lowercase(), {}
    for at in [*range(0, 0xD800, 256), *range(0xE000, 0x110000, 256)]:
        block = "".join(map(chr, range(at, at + 256))).replace("Σ", "σ")
        if own.normalize_str(block) != block.lower():
            out |= {ord(c): low for c in block if (low := own.normalize_str(c)) != c.lower()}
    return out


class Encoder:
    """For files of word-level BPE: lower case, white space dropped, an end-of-word suffix; others are refused."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = (
            [(x["type"], x.get("pattern"), x.get("content")) for x in normal] == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and (before[0]["behavior"], before[0]["invert"]) == ("Removed", True)
            and "Regex" in before[0]["pattern"]
            and not before[1].get("add_prefix_space")
            and not before[1].get("use_regex", True)
            and spec["decoder"] is None
            and model["type"] == "BPE"
            and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not any(t[x] for t in spec["added_tokens"] for x in ("lstrip", "rstrip", "single_word", "normalized"))
        )
        if not known:
            raise ValueError("the file must be word-level BPE with lower case, an end-of-word suffix and no decoder")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.gaps = regex.compile(f"[{SPACE}]+")
        self.letters = byte_letters()
        # the last letter of a word, with the suffix, is one symbol
        self.ends = {c: chr(0xE000 + i) for i, c in enumerate(self.letters)}
        names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        self.symbols = ["" if n in self.special else self._symbol(n) for n in names]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            i = vocab[a + b]
            if i in self.parts:
                raise ValueError(f"two merges give {a + b!r}: the token before a place isn't unique")
            self.rank[vocab[a], vocab[b]] = r
            self.parts[i] = (vocab[a], vocab[b], r)
        for i, (a, b, r) in self.parts.items():
            if max(self.parts.get(x, (0, 0, -1))[2] for x in (a, b)) >= r:
                raise ValueError(f"token {names[i]!r} is merged before its parts")
        self.id_of = {s: i for i, s in enumerate(self.symbols) if s and (i in self.parts or len(s) == 1)}
        self.match = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.match.add_word(s, i)
        self.match.make_automaton()
        self.size = [len(s) for s in self.symbols]
        self.shorter: dict[int, int] = {}  # the longest token that a token begins with
        for s, i in self.id_of.items():
            for k in range(len(s) - 1, 0, -1):
                if s[:k] in self.id_of:
                    self.shorter[i] = self.id_of[s[:k]]
                    break
        self.right, self.left = lru_cache(None)(self._right), lru_cache(None)(self._left)
        self.fits: dict[tuple[int, int], bool] = {}
        text = [n.encode() for n in names]
        self.table, self.offsets = b"".join(text), np.concatenate([[0], np.cumsum([len(t) for t in text])]).tolist()
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.newer = newer_lower_case()

    def _symbol(self, name: str) -> str:
        if self.suffix and name.endswith(self.suffix) and len(name) > len(self.suffix):
            body = name[: -len(self.suffix)]
            return body[:-1] + self.ends[body[-1]]
        return name

    def _right(self, i: int) -> list[tuple[int, int]]:
        """Tokens along the right edge of a token, each with the merge that takes it up."""
        out, taken = [], 1 << 60
        while True:
            out.append((i, taken))
            if i not in self.parts:
                return out
            _, i, taken = self.parts[i]

    def _left(self, i: int) -> list[tuple[int, int]]:
        out, taken = [], 1 << 60
        while True:
            out.append((i, taken))
            if i not in self.parts:
                return out
            i, _, taken = self.parts[i]

    def compatible(self, a: int, b: int) -> bool:
        """No merge across the border comes before the merges that take up what it would join.

        A merge goes from left to right, so of equal ranks the left one is first.
        """
        known = self.fits.get((a, b))
        if known is None:
            known = True
            for x, until in self.right(a):
                for y, till in self.left(b):
                    r = self.rank.get((x, y))
                    if r is not None and r < until and r <= till:
                        known = False
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def merge(self, symbols: str) -> list[int]:
        """Token ids of one word's symbols."""
        n = len(symbols)
        longest = [-1] * n
        for end, i in self.match.iter(symbols):
            at = end + 1 - self.size[i]
            if longest[at] < 0 or self.size[longest[at]] < self.size[i]:
                longest[at] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + self.size[token]] or out and not self.compatible(out[-1], token)):
                token = self.shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                at += self.size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not out:
                    raise AssertionError("no encoding")
                token = out.pop()
                at -= self.size[token]
                token = self.shorter.get(token, -1)
        return out

    def word(self, chunk: str) -> list[int]:
        """Ids of a run of normalised text without white space."""
        ids: list[int] = []
        for piece in self.pattern.findall(chunk.translate(self.newer)):
            letters = "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])
            if self.suffix:
                letters = letters[:-1] + self.ends[letters[-1]]
            ids += self.merge(letters)
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        """These files name no decoder, so tokens are joined by spaces."""
        return b" ".join([self.table[self.offsets[i] : self.offsets[i + 1]] for i in ids])

    def _parts(self, text: str) -> Iterator[tuple[int, bytes, bytes]]:
        if self.split_special is not None and any(s in text for s in self.special):
            pieces = self.split_special.split(text)
        else:
            pieces = [text]
        for piece in pieces:
            if piece in self.special:
                i = self.special[piece]
                yield 1, b"%d" % i, self.decode_bytes([i])
                continue
            # small letters are taken one by one, so a sigma at the end of a word is like any other
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            chunks = [c for c in self.gaps.split(piece) if c] if any(c in piece for c in "\x1c\x1d\x1e\x1f") else piece.split()
            for c in chunks:
                got = self.words.get(c)
                if got is None:
                    ids = self.word(c)
                    got = len(ids), b" ".join([b"%d" % i for i in ids]), self.decode_bytes(ids)
                    if len(c) <= 64:
                        if len(self.words) >= CACHE:
                            self.words.clear()
                        self.words[c] = got
                yield got

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids in decimal joined by spaces, SHA-256 of the decoded text."""
        got = list(self._parts(text))
        if not got:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        n, ids, back = zip(*got, strict=True)
        return sum(n), hashlib.sha256(b" ".join(ids)).hexdigest(), hashlib.sha256(b" ".join(back)).hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._parts(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; a null text is empty.

    Every row counts, repeated or not.  An empty table gives an empty result.  Other columns are
    ignored.  A task holds one text and its words at a time, some 20 times a text's size.  path: the tokenizer's file, at the same place on every executor.
    """

    small_batches(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches(rows):
            got = [own.digest(t or "") for t in b.column("text").to_pylist()]
            n, ids, back = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the token ids themselves and the text that they give back."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches(rows):
            ids = [own.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids])], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
