"""Token counts of whole texts for a SentencePiece BPE model, by a whole-token shortcut.

Two facts about the model's vocabulary are worked out once, on the driver, and sent to the
tasks; their size is that of the vocabulary:

* Which characters stand in pieces of several characters. Any other character is never merged,
  and a piece has the space mark at its start only. So a text falls apart, exactly, into single
  characters and pre-tokens: a run of space marks with the joinable characters after it.
* Which vocabulary strings encode alone as one token: each is merged from its own characters,
  and those that come out whole are the shortcut. (A string in the vocabulary may be out of
  reach, as other merges come first.)

A pre-token that is such a string counts one, without a merge. Only the rest is merged, by
the scores of pairs, the leftmost of equal ones first; a character without a piece counts the
bytes that stand for it.

Defined results: null and empty texts have no bytes and no tokens; the strings of special tokens
in a text are ordinary text, as by the library's default; a text of any length is counted
whole; repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from eventloom.llm.common import released, slices

#: The mark that stands for a space.
SPACE = "▁"
#: Merged pre-tokens that a worker remembers, and the longest of them.
CACHED, LONGEST = 400_000, 64


def pieces_of(path: str) -> tuple[dict[str, float], bool]:
    """The ordinary pieces of a model with their scores, and whether a space is put before a text."""
    model = SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            scores[model.id_to_piece(i)] = model.get_score(i)
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError(f"{path} has pieces that go on over a space")
    if model.normalize("ﬁ  x ").strip(SPACE) != f"ﬁ{SPACE * 2}x":
        raise ValueError(f"{path} rewrites texts before it encodes them")
    return scores, model.normalize("x").startswith(SPACE)


def merged_count(text: str, scores: dict[str, float]) -> int:
    """Tokens of one pre-token: the pair of the highest score, the leftmost of equal ones, is
    joined until none is left. Linked symbols and a heap: n log n for any length."""
    size = len(text)
    stop = list(range(1, size + 1))  # where the symbol that begins here ends; 0 once it is joined to another
    before = list(range(-1, size - 1))
    heap = []
    for at in range(size - 1):
        score = scores.get(text[at : at + 2])
        if score is not None:
            heap.append((-score, at, at + 1, at + 2))
    heapq.heapify(heap)
    while heap:
        _, left, middle, end = heapq.heappop(heap)
        if stop[left] != middle or stop[middle] != end:
            continue  # one of the two has changed since
        stop[left], stop[middle] = end, 0
        if end < size:
            before[end] = left
            score = scores.get(text[left : stop[end]])
            if score is not None:
                heapq.heappush(heap, (-score, left, end, stop[end]))
        if left and (first := before[left]) >= 0:
            score = scores.get(text[first:end])
            if score is not None:
                heapq.heappush(heap, (-score, first, left, end))
    total, at = 0, 0
    while at < size:
        end = stop[at]
        total += 1 if end - at > 1 or text[at] in scores else len(text[at].encode())
        at = end
    return total


class Counter:
    """What the tasks need of a model: the shortcut, the rest's scores, and where texts fall apart."""

    def __init__(self, scores: dict[str, float], spaced: bool):
        self.scores, self.spaced = scores, spaced
        self.whole = {p for p in scores if merged_count(p, scores) == 1}
        self.joinable = "".join(sorted({c for p in scores if len(p) > 1 for c in p} - {SPACE}))
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def ready(self) -> Counter:
        """Set up what isn't sent."""
        kind = f"[{re.escape(self.joinable)}]"
        self.cut = re.compile(f"{SPACE}+{kind}*|{kind}+|.", re.DOTALL)
        #: Counts of pre-tokens, and of words with a space before them.
        self.known = dict.fromkeys(self.whole, 1)
        self.words = {p[1:]: 1 for p in self.whole if p[:1] == SPACE}
        self.room = CACHED + len(self.whole)
        return self

    def piece(self, piece: str) -> int:
        """Tokens of a pre-token."""
        count = self.known.get(piece)
        if count is None:
            count = merged_count(piece, self.scores)
            if len(self.known) < self.room and len(piece) <= LONGEST:
                self.known[piece] = count
        return count

    def word(self, word: str) -> int:
        """Tokens of a word with a space before it; the word has none inside."""
        count = self.words.get(word)
        if count is None:
            count = sum(map(self.piece, self.cut.findall(SPACE + word)))
            if len(self.words) < self.room and len(word) <= LONGEST:
                self.words[word] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if not self.spaced or text[0] == SPACE or text[-1] == SPACE or SPACE * 2 in text:  # runs of spaces
            return sum(map(self.piece, self.cut.findall(SPACE + text if self.spaced else text)))
        words, known = text.split(SPACE), self.words
        try:
            return sum([known[w] for w in words])
        except KeyError:
            return sum(map(self.word, words))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row. path names the model on the driver only."""
    counter = docs.sparkSession.sparkContext.broadcast(Counter(*pieces_of(path)))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        model = counter.value.ready()
        for batch in batches:
            for part in slices(batch):
                text = part.column(1)
                tokens = [model.count(t) if t else 0 for t in text.to_pylist()]
                n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(np.array(tokens, dtype=np.int64))], schema=schema)
        model.known.clear()
        model.words.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "id long, n_bytes long, n_tokens long")


def per_document(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    out = token_counts(docs, path)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
