"""Byte-pair encoding with forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be joined by a
merge, so the text is cut between them, inside words as well as between them.  Two kinds of
such pairs are left alone, because there the pre-tokeniser would read the rest of the text
differently: those after white space (a run of it is read up to what follows) and those
before an apostrophe (it may begin a contraction).  The fragments are then encoded
independently, each distinct one once in a worker's bounded memory, and the ids are
concatenated.  Only whole fragments are cut, so a text is never truncated.

Defined cases: a null or empty text has no tokens (the hash of an empty string); the
special token's own string in a text is that token, as in the library; a text without any
certain cut is one fragment; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import bytekit as bk

#: Bounds of the memory of encoded fragments in one Python worker.
CACHE_FRAGMENTS, CACHED_FRAGMENT_BYTES = 150_000, 64
#: Fixed value: the pattern that a byte-level vocabulary of this family is pre-tokenised by.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> tuple[dict[int, bytes], set[int]]:
    """The bytes of every token, and the ids of added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_of_letter()
    out = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return out | added, set(added)


def certain_cuts(tokens: dict[int, bytes]) -> np.ndarray:
    """For each pair of bytes: whether it occurs inside no token, added tokens included, and may be cut."""
    never = np.ones((256, 256), bool)
    for t in tokens.values():
        if len(t) > 1:
            b = np.frombuffer(t, np.uint8)
            never[b[:-1], b[1:]] = False
    never[:, 0x80:0xC0] = False  # inside a character
    never[bk.SPACE, :] = False
    never[:, 0x27] = False
    return never


def cut_positions(buf: np.ndarray, never: np.ndarray) -> np.ndarray:
    """Where ``buf`` is cut: at the pairs of ``never``, but not after white space beyond ASCII."""
    if len(buf) < 2:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(never.reshape(-1)[buf[:-1].astype(np.uint16) << 8 | buf[1:]]) + 1
    # U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000.
    last = at[buf[at - 1] >= 0x80]
    one, two, three = buf[last - 1], buf[np.maximum(last - 2, 0)], buf[np.maximum(last - 3, 0)]
    general = (three == 0xE2) & (two == 0x80) & (((one >= 0x80) & (one <= 0x8A)) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    other = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return np.setdiff1d(at, last[general | other], assume_unique=True) if (general | other).any() else at


def _parts(fragments: list[bytes], size: int = 1000) -> Iterator[list[bytes]]:
    for i in range(0, len(fragments), size):
        yield fragments[i : i + size]


class Encoder:
    """Encodes fragments, each distinct one once; what it remembers is bounded.

    Fragments of characters below U+0380 go together through a rank-based merger of the
    same vocabulary, whose classes of characters agree with the library's there; all other
    fragments, and those that may hold a special token, go through the library itself."""

    def __init__(self, path: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokens, added = token_bytes(path)
        self.never = certain_cuts(self.tokens)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters, known = byte_of_letter(), {t: i for i, t in self.tokens.items() if i not in added}
        joined = [bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(joined)}
        self.merger = tiktoken.Encoding("forced", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        size = 256 + len(joined)
        self.rank_id = np.zeros(size, np.int64)
        self.rank_bytes = np.zeros(size, np.int64)
        for t, r in ranks.items():
            self.rank_id[r], self.rank_bytes[r] = known[t], len(t)
        self.rank_ids = self.rank_id.tolist()
        self.names = [str(i) for i in range(max(self.tokens) + 1)]
        self.text_ids: dict[bytes, str] = {}
        #: Fragments whose tokens do not give their bytes back (none, for a byte-level vocabulary).
        self.odd: dict[bytes, bytes] = {}

    def fragments(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """All fragments of a group of documents, and each document's first fragment."""
        mark = np.zeros(len(buf) + 1, bool)
        mark[cut_positions(buf, self.never)] = True
        mark[offs] = True
        cuts = np.flatnonzero(mark)
        data = buf.tobytes()
        edges = cuts.tolist()
        self.longest = int(np.diff(cuts).max(initial=0))
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], np.searchsorted(cuts, offs)

    def learn(self, pieces: list[bytes]) -> None:
        wanted = set(pieces)
        missing = wanted - self.text_ids.keys()
        if len(self.text_ids) + len(missing) > CACHE_FRAGMENTS:
            self.text_ids.clear()
            self.odd.clear()
            missing = wanted
        runs, alone = [], []
        for p in missing:
            if max(p) >= 0xCE or b"<|" in p:
                alone.append(p)
            elif p[0] in (0x20, 0x0A) and p[-1] > 0x20 and p[-1] not in (0x85, 0xA0):
                runs.append(p)  # certain cuts between the fragments of a run
            else:
                self.remember(p, [self.rank_ids[r] for r in self.merger.encode_ordinary(p.decode())])
        for part in _parts(runs):
            got = np.array(self.merger.encode_ordinary(b"".join(part).decode()), np.int64)
            ends = np.searchsorted(np.cumsum(self.rank_bytes[got]), np.cumsum([len(p) for p in part])) + 1
            ids, start = self.rank_id[got].tolist(), 0
            for p, end in zip(part, ends.tolist(), strict=True):
                self.remember(p, ids[start:end])
                start = end
        for part in _parts(alone):
            for p, e in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                self.remember(p, e.ids)

    def remember(self, piece: bytes, ids: list[int]) -> None:
        self.text_ids[piece] = ",".join([self.names[i] for i in ids])
        if (back := b"".join([self.tokens[i] for i in ids])) != piece:
            self.odd[piece] = back

    def forget_long(self, pieces: list[bytes]) -> None:
        for p in pieces if self.longest > CACHED_FRAGMENT_BYTES else ():
            if len(p) > CACHED_FRAGMENT_BYTES:
                self.text_ids.pop(p, None)
                self.odd.pop(p, None)

    def encode_group(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], list[bytes]]:
        """For each document its ids as text, and the bytes that they decode to."""
        pieces, first = self.fragments(buf, offs)
        self.learn(pieces)
        texts = list(map(self.text_ids.__getitem__, pieces))
        backs = [self.odd.get(p, p) for p in pieces] if self.odd else pieces
        edges = first.tolist()
        out = [",".join(texts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], [b"".join(backs[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.forget_long(pieces)
        return out

    def encode(self, text: str) -> list[int]:
        raw = text.encode()
        ids = self.encode_group(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _forget() -> None:
    for e in _encoders.values():
        e.text_ids, e.odd = {}, {}


bk.at_task_end(_forget)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids``: the token ids of every whole text."""
    docs = bk.bounded_batches(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                ids = [list(map(int, x.split(","))) if x else [] for x in e.encode_group(buf, offs)[0]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return bk.map_arrow(docs, run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` from ``ids``; bytes that are no UTF-8 become U+FFFD, as in the library."""
    encoded = encoded.select("doc_id", "ids")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return bk.map_arrow(encoded, run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The round trip of every whole text as digests: ids are those of ``encode``, the text that of ``decode``."""
    docs = bk.bounded_batches(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        sha = hashlib.sha256
        for batch in batches:
            for part, buf, offs in bk.groups(batch, "text"):
                rows = [(ids.count(",") + 1 if ids else 0, sha(ids.encode()).hexdigest(), sha(back.decode("utf-8", "replace").encode()).hexdigest()) for ids, back in zip(*e.encode_group(buf, offs), strict=True)]
                n, ids, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bk.map_arrow(docs, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
