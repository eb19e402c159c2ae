"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton lists every piece that ends at each character; a
forward pass carries the best score and the number of pieces to get there.
Ties as in the tokenizer: of equal scores the piece that starts first wins, so
the longest; a character that is no piece costs the lowest score less 10 and
counts one per UTF-8 byte, if the vocabulary has byte pieces, else one per run."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import batch, ddl, ready

SPACE = "▁"
#: Words whose counts a worker remembers before it starts anew.
KNOWN = 500_000
UNKNOWN_COST = 10.0
#: BPE files mark pieces never merged to with scores near -1e9, beside which single precision
#: cannot tell the others apart; they are read as this score.
FLOOR = -1e5

_COUNTS = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_bytes": pa.int64()}
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Counter:
    """Counts for a list of ``(piece, score)``; ``normalize`` gives the text as the vocabulary spells it."""

    _made: dict[str, Counter] = {}

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool, normalize=None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.bytes, self.normalize = byte_pieces, normalize or (lambda t: t)
        # where no piece has a space mark behind another sign, words can be counted apart
        self.apart = byte_pieces and not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        """A SentencePiece file's pieces and scores, read as a unigram vocabulary."""
        if path not in cls._made:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
            cls._made[path] = cls([(sp.id_to_piece(i), sp.get_score(i) if sp.get_score(i) > -1e6 else FLOOR) for i in plain],
                                  any(sp.is_byte(i) for i in range(sp.get_piece_size())), sp.normalize)
        return cls._made[path]

    def path(self, text: str) -> int:
        """The number of pieces on the best path through ``text``."""
        n = len(text)
        if not n:
            return 0
        score, count = [-math.inf] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        if self.single.issuperset(text):
            for end, (length, s) in self.automaton.iter(text):  # by end, the longest first
                total = score[end + 1 - length] + s
                if total > score[end + 1]:
                    score[end + 1], count[end + 1] = total, count[end + 1 - length] + 1
            return count[n]
        unk = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        for end in range(n):
            for length, s in ends[end]:
                total = score[end + 1 - length] + s
                if total > score[end + 1]:
                    score[end + 1], count[end + 1] = total, count[end + 1 - length] + 1
            if text[end] not in self.single and score[end] + self.unknown > score[end + 1]:
                score[end + 1], unk[end + 1] = score[end] + self.unknown, True
                count[end + 1] = count[end] + (len(text[end].encode("utf-8", "surrogatepass")) if self.bytes else not unk[end])
        return count[n]

    def __call__(self, text: str) -> int:
        text = self.normalize(text)
        if not self.apart:
            return self.path(text)
        known, total = self.known, 0
        for word in _WORD.findall(text):
            n = known.get(word)
            if n is None:
                if len(known) >= KNOWN:
                    known.clear()
                n = known[word] = self.path(word)
            total += n
        return total


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_bytes``; null counts as empty, with no tokens.

    Null and repeated ids are counted row by row.  Scores are added in double
    precision, word by word where the vocabulary allows it."""
    ready(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter.of(vocabulary)
        for b in it:
            texts = [t.as_py() or "" for t in b.column("text")]
            yield batch(_COUNTS, b.column("doc_id"), [count(t) for t in texts], [len(t.encode("utf-8", "surrogatepass")) for t in texts])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl(_COUNTS))
