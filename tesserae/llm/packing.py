"""Order-preserving packing of tokenised documents into windows of ``SIZE`` tokens.

A stretch of documents, in input order, is one line of tokens.  Windows may
end at its nodes: document ends (no penalty), sentence ends and every
``GRID``-th token (a cut within a sentence).  A window from node i to node j
costs its padding plus the penalty of cutting at j, so

    best[j] = SIZE - at[j] + penalty[j] + min(best[i] + at[i]),  at[j] - at[i] <= SIZE,

a sliding minimum kept in a monotone queue: each node enters and leaves once.
The last window of a stretch, which no document follows, is cut into powers
of two, which need no padding.  Input partitions are packed apart, without a
shuffle; a task holds one stretch at a time."""

from __future__ import annotations

import json
import re
import string
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import KEPT, batch, ddl, let_go, ready, tidy

SIZE = 2048
#: Penalties, in tokens of padding, and the step of the spare nodes.
SENTENCE, WITHIN, GRID = 2, 8, 32
#: Tokens packed as one line (more if a single document has more).
STRETCH = 1 << 19
#: Words and signs whose ids a worker remembers before it starts anew.
KNOWN = 700_000
#: Characters of text whose parts are looked up at once.
TOGETHER = 1 << 21
#: The id that ends each document.
END = 1

_LETTERS = "".join(c for c in map(chr, range(0x100)) if re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ]", c))
#: ASCII's, without the apostrophe, which may begin a word.
_SIGNS = "".join(c for c in string.punctuation if c != "'")
_WORD = re.compile(f"[{_LETTERS}]+").fullmatch
_PLAIN = re.compile(f"[{_LETTERS}]*[{re.escape(_SIGNS)}]*").fullmatch

#: A tokenizer's rules by which letters, in lower case, and signs are words of their own.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}

_PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(),
           "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes seven times as long


def _spread(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the items ``at`` in a line, and where each one's end there; ``ends``: where each item's end in ``ids``."""
    size = np.diff(ends, prepend=0)[at]
    upto = np.cumsum(size)
    place = np.repeat(ends[at] - upto, size)
    place += np.arange(len(place))
    return ids[place], upto


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    For tokenizers that split at white space and drop it: a text's ids are
    those of its parts between spaces and newlines, each encoded once.  With
    the rules of ``_RULES``, the ids of letters and then signs are those of the
    lower-cased letters and those of the signs, and letters need no rules."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        names = [(self.tokenizer.id_to_token(i) or "").removesuffix("</w>") for i in range(size)]
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.ends_sentence = np.array([n.endswith((".", "!", "?")) for n in names])
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.parted = all(rules.get(k) == v for k, v in _RULES.items()) and not any(
            _PLAIN(t["content"]) for t in rules["added_tokens"])
        #: For words of ASCII letters and for others.
        self.words = [self.tokenizer, self.tokenizer]
        if self.parted:
            space, as_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.words = [Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)]
            self.words[0].pre_tokenizer, self.words[1].pre_tokenizer = space, pre_tokenizers.Sequence([space, as_bytes])

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in KEPT:
            KEPT[path] = cls(path)
        return KEPT[path]

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; the parts of about TOGETHER characters of text are looked up at once."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text) + 1
            if size >= TOGETHER:
                yield from self._ids(held)
                held, size = [], 0
        if held:
            yield from self._ids(held)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = parts.values.dictionary_encode()
        ids, ends = _spread(*self._of_parts(coded.dictionary), coded.indices.to_numpy())
        stop = ends[parts.offsets.to_numpy()[1:] - 1].tolist()
        del parts, coded, ends
        for a, z in zip([0, *stop], stop, strict=False):
            yield ids[a:z].tobytes()

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts in a line, and where each one's end."""
        if not self.parted:
            return self._look_up(_strings(parts))
        signs = pc.utf8_ltrim(parts, _LETTERS)
        plain = pc.and_(pc.equal(pc.utf8_rtrim(signs, _SIGNS), ""), pc.less(pc.binary_length(signs), pc.binary_length(parts)))
        word = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(parts, _SIGNS)), parts).dictionary_encode()
        rest = pc.if_else(plain, signs, "").dictionary_encode()
        at = np.stack([word.indices.to_numpy(), rest.indices.to_numpy() + len(word.dictionary)], axis=1)
        ids, ends = _spread(*self._look_up(_strings(word.dictionary) + _strings(rest.dictionary)), at.ravel())
        return ids, ends[1::2]

    def _look_up(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        ids = list(map(known.get, strings))
        new = list(dict.fromkeys(s for s, found in zip(strings, ids, strict=True) if found is None))
        if new:
            if len(new) + len(known) > KNOWN:
                known.clear()
            self._learn(new)
            ids = [known[s] if found is None else found for s, found in zip(strings, ids, strict=True)]
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)

    def _learn(self, new: list[str]) -> None:
        """Encode strings not yet known: words of letters together, which is faster, the others one by one."""
        words = [s for s in new if _WORD(s)]
        for some, tokenizer in zip(([w for w in words if w.isascii()], [w for w in words if not w.isascii()]), self.words, strict=True):
            if some:
                ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                stop = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
                if len(stop) == len(some):
                    line = ids.tobytes()
                    self.known.update(zip(some, (line[a:z] for a, z in zip([0, *stop], stop, strict=False)), strict=True))
        new = [s for s in new if s not in self.known]
        for s, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[s] = array("I", e.ids).tobytes()


def nodes(doc_ends: np.ndarray, sentence_ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions, from 0, and the penalties of cutting there; each place has the lowest of its penalties."""
    spare = np.arange(0, int(doc_ends[-1]) + 1, grid)
    at = np.concatenate([doc_ends, sentence_ends, spare])
    cost = np.repeat([0.0, SENTENCE, WITHIN], [len(doc_ends), len(sentence_ends), len(spare)])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.r_[True, at[1:] != at[:-1]]
    return at[first], cost[first]


def cuts(position: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Window ends of a cheapest packing; ``position`` starts at 0 and has gaps of at most ``size``."""
    at, cost = position.tolist(), penalty.tolist()
    via = [0] * len(at)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # best + at, at, node; rising
    for j in range(1, len(at)):
        here = at[j]
        while here - queue[0][1] > size:
            queue.popleft()
        key, _, via[j] = queue[0]
        key += size + cost[j]  # = best[j] + at[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    ends, j = [], len(at) - 1
    while j > 0:
        ends.append(at[j])
        j = via[j]
    return ends[::-1]


def powers(start: int, end: int) -> list[int]:
    """Ends of windows of falling powers of two that fill ``start`` to ``end``."""
    out = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        out.append(start)
    return out


def _pieces(doc_ids: list, ids: list[bytes], sequence: int, ends_sentence: np.ndarray, size: int):
    """The rows of a stretch, and how many sequences it has."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    doc_end = np.cumsum(lengths)
    line = b"".join(ids)
    sentence_end = np.flatnonzero(ends_sentence[np.frombuffer(line, "<u4")]) + 1
    ends = cuts(*nodes(doc_end, sentence_end, min(GRID, size)), size)
    last = ends[-2] if len(ends) > 1 else 0
    window_end = np.array(ends[:-1] + powers(last, ends[-1]), np.int64)
    end = np.union1d(doc_end, window_end)
    start = np.r_[0, end[:-1]]
    doc, window = np.searchsorted(doc_end, start, "right"), np.searchsorted(window_end, start, "right")
    window_start = np.r_[0, window_end[:-1]]
    rows = batch(_PIECES, [doc_ids[d] for d in doc], start - (doc_end - lengths)[doc], end - start,
                 [line[4 * s:4 * e] for s, e in zip(start, end, strict=True)], lengths[doc], sequence + window,
                 start - window_start[window])
    return rows, len(window_end)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END, id_col: str = "doc_id",
         text_col: str = "text", order_by: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit bytes;
    a document's ids are its text's and then ``end_id``.  Documents follow
    each other as in the input's partitions, or, with ``order_by``, in the
    order of that column (a range shuffle).  ``sequence_id`` is the partition's
    number times 2**40 plus a count, so it is the same when a task is run anew.
    Null and empty texts are one ``end_id``; null and repeated ids are packed
    like any other; an empty table gives no rows."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *([F.col(order_by).alias("by")] if order_by else []))
    if order_by:
        rows = rows.repartitionByRange("by").sortWithinPartitions("by", "id").drop("by")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder.of(tokenizer), array("I", [end_id]).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        names: list = []  # of the texts read, from the first that is not yet packed
        ids: list[bytes] = []
        held = 0

        def texts() -> Iterator[str]:
            for b in it:
                names.extend(b.column("id").to_pylist())
                yield from (text.as_py() for text in b.column("text"))

        for found in encode.many(texts()):
            ids.append(found + tail)
            held += len(ids[-1]) // 4
            if held >= STRETCH:
                out, n = _pieces(names, ids, sequence, encode.ends_sentence, size)
                yield out
                del names[:len(ids)]
                sequence, ids, held = sequence + n, [], 0
                let_go()
        if ids:
            yield _pieces(names, ids, sequence, encode.ends_sentence, size)[0]

    return rows.mapInArrow(tidy(run, keep=True), ddl(_PIECES))
