"""Exact BPE encoding by backtracking, and decoding by an offset table.

A word's BPE split is the one sequence of tokens whose neighbours are all compatible: two
tokens are when no merge would have joined them across their border before each was whole.
The encoder takes from every place the longest token that an Aho-Corasick automaton has
matched there, checks it against the compatibility table, falls back to shorter tokens, and
takes back the token before when none fits; places that failed are marked and never tried
again, so the time is linear in the word. Nothing is merged.

Decoding reads token strings from one byte table by offsets; this vocabulary has no decoder,
so the library's decode puts one space between token strings, and so does this one.

Words repeat, so each Python worker keeps the codes of up to CACHED of them; the texts are
split at ASCII white space, which no token spans, and whole texts are encoded.

Defined results: null and blank texts have no ids and decode to the empty string; special
strings in a text become their ids as in the library; an empty table gives no rows; repeated
rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm.common import shown_bytes, slices

#: Words that a worker remembers, and the longest of them.
CACHED, LONGEST = 400_000, 64
END = "</w>"


class WordBpe:
    """The encoder and decoder of a tokenizer file of lower-cased words with an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = {c[0] for c in self.special}
        self.pieces = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normaliser, self.splitter = library.normalizer, library.pre_tokenizer

        strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            strings[i] = s
        blobs = [s.encode() for s in strings]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).tolist()
        self.table = b"".join(blobs)

        self.shown = {chr(b): c for b, c in shown_bytes().items()}
        ids = {self._symbols(s): i for s, i in vocab.items()}
        self.id_of = ids
        self.length = [0] * len(strings)
        for s, i in ids.items():
            self.length[i] = len(s)
        #: A token's rank of birth and its two halves; single symbols have none.
        self.rank, self.halves, self.join = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            x, y = ids[self._symbols(a, a.endswith(END))], ids[self._symbols(b)]
            both = ids[self._symbols(a) + self._symbols(b)]
            self.join[x, y] = rank
            if both not in self.rank:
                self.rank[both], self.halves[both] = rank, (x, y)
        self.shorter: dict[int, int] = {}
        for s, i in ids.items():
            for k in range(len(s) - 1, 0, -1):
                if (j := ids.get(s[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.right, self.left = {}, {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.known_pieces: dict[str, list[int]] = {}

    def _symbols(self, token: str, last: bool = False) -> str:
        """A token as one character a symbol; a symbol with the end mark is one of its own."""
        if token.endswith(END):
            return token[: -len(END) - 1] + chr(0x1000 + ord(token[-len(END) - 1]))
        return token

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token's symbols along one edge, each with the rank at which it is merged away."""
        memo = (self.left, self.right)[side]
        if token not in memo:
            out, until = [], float("inf")
            while True:
                out.append((token, until))
                if token not in self.halves:
                    break
                until, token = self.rank[token], self.halves[token][side]
            memo[out[0][0]] = out
            return out
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across the border comes before both are whole.
        Of equal ranks the left place is merged first."""
        known = self.fits.get((a, b))
        if known is None:
            known = not any((rank := self.join.get((x, y))) is not None and rank < x_until and rank <= y_until for x, x_until in self._spine(a, 1) for y, y_until in self._spine(b, 0))
            if len(self.fits) < 2_000_000:
                self.fits[a, b] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, whose bytes are shown as characters."""
        s = piece
        s = s[:-1] + chr(0x1000 + ord(s[-1]))
        whole = self.id_of.get(s)
        if whole is not None:
            return [whole]
        longest = [-1] * (len(s) + 1)
        for end, (n, i) in self.automaton.iter(s):  # ends rise, so the longest comes last
            longest[end - n + 1] = i
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        at, token, length, shorter, fits, size = 0, longest[0], self.length, self.shorter, self.fits, len(s)
        while at < size:
            while token is not None:
                end = at + length[token]
                if not dead[end]:
                    if not out:
                        break
                    good = fits.get((out[-1], token))
                    if self.compatible(out[-1], token) if good is None else good:
                        break
                token = shorter.get(token)
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter.get(token)
            else:
                out.append(token)
                at = end
                token = longest[at]
        return out

    def split(self, part: str) -> list[str]:
        """Pre-tokens of a run without special strings. What counts as white space, letter or
        number and what is its lower case differs between Unicode tables, so the library's own
        normaliser and splitter tell for text beyond ASCII."""
        if not part.isascii():
            return [p for p, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(part))]
        part = part.lower()
        if part.isalpha():
            return [part]
        if part[:-1].isalpha() and part[-1] in ",.":
            return [part[:-1], part[-1]]
        pieces = self.pieces.findall(part)
        return pieces if part.isprintable() else ["".join([self.shown[c] for c in p]) for p in pieces]

    def encode(self, text: str) -> list[int]:
        """Ids of a text: specials, then normalised pre-tokens."""
        out: list[int] = []
        for part in self.cut.split(text) if any(c in text for c in self.marks) else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.split(part) if part else ():
                found = self.known_pieces.get(piece)
                if found is None:
                    found = self.encode_piece(piece)
                    if len(self.known_pieces) < CACHED and len(piece) <= LONGEST:
                        self.known_pieces[piece] = found
                out += found
        return out

    def decode(self, ids: list[int]) -> str:
        table, at = self.table, self.offsets
        return b" ".join([table[at[i] : at[i + 1]] for i in ids]).decode()

    def codes(self, word: str) -> tuple[str, str]:
        """Ids in decimal, and the decoded text, of a run without ASCII white space."""
        found = self.known.get(word)
        if found is None:
            ids = self.encode(word)
            if -1 in ids:
                raise ValueError(f"a symbol of {word[:80]!r} is not in the vocabulary")
            found = " ".join(map(str, ids)), self.decode(ids)
            if len(self.known) < CACHED and len(word) <= LONGEST:
                self.known[word] = found
        return found


#: Characters at which str.split() parts and the library doesn't.
ODD = re.compile("[\x1c-\x1f]")
ASCII_WHITE = re.compile("[ \t\n\r\x0b\x0c]+")
_MADE: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """The worker's codec of that file."""
    if path not in _MADE:
        _MADE[path] = WordBpe(path)
    return _MADE[path]


def code_text(bpe: WordBpe, text: str) -> tuple[str, str]:
    """A whole text's ids in decimal joined by spaces, and its decoding."""
    words = ASCII_WHITE.split(text) if ODD.search(text) else text.split()
    known = bpe.known
    try:
        pairs = [known[w] for w in words]
    except KeyError:
        pairs = [known.get(w) or bpe.codes(w) for w in words]
    return " ".join([p[0] for p in pairs if p[0]]), " ".join([p[1] for p in pairs if p[0]])


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, ids (array<int>) and decoded text of every row; with digests, their number and
    SHA-256 instead, so that no ids leave the worker."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for part in slices(batch):
                n, ids, decoded = [], [], []
                for text in part.column(1).to_pylist():
                    a, b = code_text(bpe, text or "")
                    n.append(a.count(" ") + 1 if a else 0)
                    ids.append(hashlib.sha256(a.encode()).hexdigest() if digests else a)
                    decoded.append(hashlib.sha256(b.encode()).hexdigest() if digests else b)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, ids string, decoded string")
    if digests:
        return out
    return out.select("id", F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>")).alias("ids"), "decoded")


def per_document(docs: DataFrame, path: str) -> DataFrame:
    out = bpe_round_trip(docs, path, digests=True)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
