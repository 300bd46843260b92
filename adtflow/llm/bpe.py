"""Operator 4: byte-level BPE by depth-first traversal of a trie of distinct words.

The encoding of a prefix ends in exactly one token, and without that token it is the encoding of a shorter prefix. So a node of
the trie needs only its last token and how far that reaches back; words that share a prefix share these states. A token may end a
prefix if it and the token before it would not merge over their seam, which the two tokens' merge histories decide.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from adtflow.llm.shared import map_arrow

#: Fixed value: how this vocabulary's pre-tokeniser splits text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text of ASCII alone, where white space, letters and digits are these; Python's own engine is faster there.
ASCII_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Words kept between batches in a Python worker; beyond it the memory is emptied, which costs time only.
KEPT_WORDS = 500_000
#: Pairs of tokens whose seam is remembered.
KEPT_PAIRS = 400_000
#: Longer words, in characters, are encoded but not kept.
KEPT_LENGTH = 48


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return out


class Codec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        model, to_byte = d["model"], _byte_characters()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", ())}
        self.bytes_of = {i: raw(s) for s, i in model["vocab"].items() if s not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            key = (self.id_of[a], self.id_of[b])
            self.rank.setdefault(key, n)
            parts.setdefault(self.id_of[a + b], (*key, n))
        never = len(model["merges"])
        self._right, self._left = {}, {}
        for t in self.bytes_of:
            for edges, side in ((self._right, 1), (self._left, 0)):
                chain, x, until = [(t, never)], t, never
                while x in parts:
                    x, until = parts[x][side], parts[x][2]
                    chain.append((x, until))
                edges[t] = chain
        self._apart: dict[int, bool] = {}
        # a token that its own bytes don't encode to can never be made
        self.id_of = {b: i for b, i in self.id_of.items() if self.merge(b) == [i]}
        self._ends = self._token_ends()
        self._split, self._ascii_split = regex.compile(SPLIT), re.compile(ASCII_SPLIT)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._special_bytes = {i: s.encode() for s, i in self.special.items()}
        self._ids: dict[str, str] = {}
        #: words that decode to something else than themselves
        self._back: dict[str, bytes] = {}

    def _token_ends(self) -> dict[bytes, tuple[tuple[int, int], ...]]:
        """By each token's prefix: the tokens that it ends with and their lengths, longest first."""
        out: dict[bytes, tuple[tuple[int, int], ...]] = {b"": ()}
        for p in sorted({b[:i] for b in self.id_of for i in range(1, len(b) + 1)}, key=len):
            shorter = next(out[p[i:]] for i in range(1, len(p) + 1) if p[i:] in out)
            out[p] = ((self.id_of[p], len(p)), *shorter) if p in self.id_of else shorter
        return out

    def merge(self, word: bytes) -> list[int]:
        """The definition itself: merges the pair of the lowest rank, leftmost first. For the few bytes of one token only."""
        ids = [self._byte_id(b) for b in word]
        while len(ids) > 1:
            n, at = min((self.rank.get((a, b), len(self.rank)), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if n == len(self.rank):
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids

    @lru_cache(256)  # noqa: B019
    def _byte_id(self, b: int) -> int:
        return self.id_of[bytes([b])]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay as they are.

        At each moment of merging, the seam has one piece of a on its left and one piece of b on its right; each lasts until the
        merge that takes it up. The seam breaks if some such pieces have a merge that comes before the left one's end and not
        after the right one's (of equal pairs the leftmost merges first).
        """
        key = a << 32 | b
        known = self._apart.get(key)
        if known is None:
            rank = self.rank.get
            known = not any((n := rank((x, y))) is not None and n < x_until and n <= y_until for x, x_until in self._right[a] for y, y_until in self._left[b])
            if len(self._apart) > KEPT_PAIRS:
                self._apart.clear()
            self._apart[key] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Distinct words to ids. Sorted, they are the trie in depth-first order; the stacks hold the states on the path.

        Beside its last token, a node has the length of the longest token's prefix that its path ends with: the tokens that may end
        there are those which that prefix ends with.
        """
        ends, apart, look = self._ends.get, self._apart.get, self.stay_apart
        out: dict[bytes, list[int]] = {}
        last, back, size, path = [-1], [0], [0], b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(path), len(word))
            if word[:most] == path[:most]:
                shared = most
            else:
                while word[shared] == path[shared]:
                    shared += 1
            del last[shared + 1 :], back[shared + 1 :], size[shared + 1 :]
            n = size[shared]
            for end in range(shared + 1, len(word) + 1):
                n += 1
                while (tokens := ends(word[end - n : end])) is None:
                    n -= 1
                for t, length in tokens:
                    start = end - length
                    if start == 0:
                        break
                    before = last[start]
                    if (known := apart(before << 32 | t)) or (known is None and look(before, t)):
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                last.append(t)
                back.append(start)
                size.append(n)
            path, ids, end = word, [], len(word)
            while end:
                ids.append(last[end])
                end = back[end]
            out[word] = ids[::-1]
        return out

    def pieces(self, text: str) -> list[list[str]]:
        """Words between special tokens: even places hold words, odd ones a single special token."""
        split = (self._ascii_split if text.isascii() else self._split).findall
        if self._specials is None or not any(s in text for s in self.special):
            return [split(text)]
        return [[x] if i % 2 else split(x) for i, x in enumerate(self._specials.split(text))]

    def encode(self, text: str) -> list[int]:
        out = []
        for i, words in enumerate(self.pieces(text)):
            if i % 2:
                out.append(self.special[words[0]])
            else:
                known = self.encode_words(w.encode() for w in words)
                for w in words:
                    out += known[w.encode()]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of[i] if i in self.bytes_of else self._special_bytes[i] for i in ids).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids in decimal and commas, SHA-256 of the decoded text.

        Each distinct word is encoded, and decoded from its ids, once; a word that decodes to itself, as all should, needs no copy.
        """
        split = [self.pieces(t) for t in texts]
        if len(self._ids) > KEPT_WORDS:
            self._ids.clear()
            self._back.clear()
        known, changed = self._ids, self._back
        new = set().union(*(words for pieces in split for words in pieces[::2])).difference(known)
        raw = {w.encode(): w for w in new}
        for b, ids in self.encode_words(raw).items():
            w = raw[b]
            known[w] = ",".join(map(str, ids))
            if (decoded := b"".join(map(self.bytes_of.__getitem__, ids))) != b:
                changed[w] = decoded
        out = []
        for pieces in split:
            text, back = [], []
            for i, words in enumerate(pieces):
                if i % 2:
                    text.append(str(self.special[words[0]]))
                    back.append(words[0].encode())
                elif words:
                    text.append(",".join(map(known.__getitem__, words)))
                    back.append(b"".join(changed[w] if w in changed else w.encode() for w in words) if changed else "".join(words).encode())
            ids = ",".join(text)
            decoded = b"".join(back).decode("utf-8", "replace").encode()
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        for w in new:
            if len(w) > KEPT_LENGTH:
                del known[w]
                changed.pop(w, None)
        return out


@lru_cache(4)
def codec(definition: str) -> Codec:
    return Codec(definition)


def bpe_round_trip(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded again.

    Nulls and empty texts have no tokens; equal texts have equal rows; other columns are not read. The vocabulary file, which has
    a fixed size, is read on the driver and sent to the executors.
    """
    spark: SparkSession = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = codec(definition.value).digests([x or "" for x in batch.column(1).to_pylist()])
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return map_arrow(slim, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
