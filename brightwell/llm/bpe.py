"""BPE encoding and decoding (operator 5).

Method: *backtracking encoder*.  All tokens that occur in a word are found in one Aho-Corasick
pass; the encoder takes the longest token at each position and steps back to shorter ones until
each neighbouring pair is *compatible* - that is, until byte-pair merging of the two tokens' text
would give exactly these two tokens.  The sequence that results is unique and equals the merge
order's result, in time linear in the word.  Decoding gathers bytes through an offset table.

The vocabulary file is a parameter; nothing is trained and nothing copied.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Words in each of a worker's two cache generations; the older is dropped when the newer is full.
CACHE_WORDS = 100_000
#: Longer words are not cached.
CACHE_CHARS = 64
END = "</w>"
#: The last symbol of a word is moved to this plane, so that every symbol is one character.
FINAL = 0x10000
#: Beyond these characters Unicode versions differ, so the library's tables are asked.
FAR = re.compile("[^\\u0000-\\u024f]")
SEPARATORS = re.compile("[\\x1c-\\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def check(spec: dict) -> None:
    """Refuse a vocabulary file whose rules are not those that the encoder follows."""
    model = spec["model"]
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [n.get("type") for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    fits = model.get("type") == "BPE" and model.get("end_of_word_suffix") == END and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not fits or steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec.get("decoder"):
        raise ValueError("the vocabulary's normaliser, splitter or model is of another kind")
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in pairwise(made)):
        raise ValueError("ids don't ascend in the order of the merges")


class BacktrackingBPE:
    """Encoder and decoder for a word-final BPE vocabulary in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.inverse = {ord(c): b for b, c in self.alphabet.items()}
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            names[i] = s
        self.surface: list[str] = [self._symbols(s) for s in names]
        self.by_surface: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.split = {i: (i, i) for i in vocab.values()}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right], self.split[whole] = whole, (left, right)
        for s, i in vocab.items():
            if s not in self.special:
                self.by_surface[self.surface[i]] = i
                self.automaton.add_word(self.surface[i], i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.piece_cache: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        # decoding: the tokens' texts, each with the blank that joins them, in one blob with offsets
        texts = [s.encode() + b" " for s in names]
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))

    @cached_property
    def library(self) -> object:
        """For its Unicode tables, loaded when a text needs them; it doesn't encode here."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _symbols(token: str) -> str:
        return token[: -len(END) - 1] + chr(ord(token[-len(END) - 1]) + FINAL) if token.endswith(END) and len(token) > len(END) else token

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if none."""
        found = self.shorter.get(token)
        if found is None:
            s = self.surface[token]
            found = next((self.by_surface[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.by_surface), -1)
            self.shorter[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave these two tokens side by side as they are.

        Merges are numbered in their order.  The boundary between the two tokens survives if no
        merge across it would have come before the merge that built the token on either side.
        """
        built = 1 << 62
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < built:
                return False
            if left > right:
                built = left
                left = self.split[left][1]
                if left == built:
                    built, right = right + 1, self.split[right][0]
                    if right + 1 == built:
                        return True
            else:
                built, right = right + 1, self.split[right][0]
                if right + 1 == built:
                    built = left
                    left = self.split[left][1]
                    if left == built:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one pre-token."""
        raw = piece.encode().decode("latin-1").translate(self.alphabet)
        word = raw[:-1] + chr(ord(raw[-1]) + FINAL)
        n = len(word)
        longest = [-1] * n
        for end, token in self.automaton.iter(word):
            longest[end + 1 - len(self.surface[token])] = token  # ends ascend, so the longest stays
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.surface[token])
                if open_at[end]:
                    if not out:
                        break
                    pair = out[-1], token
                    fits = self.pairs.get(pair)
                    if fits is None:
                        if len(self.pairs) >= CACHE_WORDS:
                            self.pairs.clear()
                        fits = self.pairs[pair] = self.compatible(*pair)
                    if fits:
                        break
                token = self._prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(self.surface[token])
                token = self._prefix(token)
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.specials is not None and "<" in text:
            parts = self.specials.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._ordinary(p) for p in parts if p)
        return self._ordinary(text)

    def _piece_bytes(self, piece: str) -> bytes:
        ids = self.piece_cache.get(piece)
        if ids is None:
            ids = array("I", self.encode_piece(piece)).tobytes()
            if len(piece) <= CACHE_CHARS:
                if len(self.piece_cache) >= CACHE_WORDS:
                    self.piece_cache.clear()
                self.piece_cache[piece] = ids
        return ids

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens.  Beyond the Latin blocks the library's own tables decide what is a letter."""
        if FAR.search(chunk) is None:
            return self.pieces.findall(chunk)
        inverse = self.inverse
        return [p.translate(inverse).encode("latin-1").decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def _ordinary(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif FAR.search(text) is None:
            text = unicodedata.normalize("NFC", text).lower()
        else:
            text = self.library.normalizer.normalize_str(text)
        # the pattern never crosses white space; the four separators are that to str.split only
        chunks = [text] if SEPARATORS.search(text) else text.split()
        cache, older, out = self.cache, self.older, []
        for chunk in chunks:
            ids = cache.get(chunk)
            if ids is None:
                ids = older.get(chunk)
                if ids is None:
                    ids = b"".join([self._piece_bytes(p) for p in self._split(chunk)])
                if len(chunk) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        self.older, self.cache = cache, {}
                        cache, older = self.cache, self.older
                    cache[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode_bytes(self, ids: bytes | np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens' texts with a blank between them."""
        i = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        if not len(i):
            return b""
        start, size = self.offsets[i], self.offsets[i.astype(np.int64) + 1] - self.offsets[i]
        before = np.cumsum(size) - size
        return self.blob[np.repeat(start - before, size) + np.arange(size.sum())].tobytes()[:-1]


def encoder(path: str) -> BacktrackingBPE:
    """One encoder per worker process."""
    return common.model(("bpe", path), lambda: BacktrackingBPE(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, ids (binary, little-endian uint32), n_tokens, decoded`` for each row.

    Null and empty texts give no tokens and an empty decoded text.  Rows are handled one by one:
    repeated rows repeat, an empty table gives an empty result, other columns are ignored, and a
    null id is passed on.  One document is held in memory at a time besides its Arrow batch.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[dict]) -> Iterator[list]:
        bpe = encoder(path)
        for b in batches:
            ids = [bpe.encode_bytes(t or "") for t in b["text"]]
            yield [b["doc_id"], ids, [len(i) // 4 for i in ids], [bpe.decode_bytes(i).decode() for i in ids]]

    from pyspark.sql import functions as F

    return common.map_rows(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, ids binary, n_tokens bigint, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the encoder's output, digested where it is made."""
    path = path or default_vocabulary()

    def run(batches: Iterator[dict]) -> Iterator[list]:
        bpe = encoder(path)
        for b in batches:
            out: list[list] = [[], [], []]
            for t in b["text"]:
                ids = bpe.encode_bytes(t or "")
                out[0].append(len(ids) // 4)
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield [b["doc_id"], *out]

    return common.map_rows(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
