"""Token-array expressions.

The tokenizer is pluggable: any ``Column(text) -> Column(array<int>)``.  The
built-in default splits on whitespace and hashes each word into a fixed
vocabulary, so every operator runs and can be checked without model files.
:func:`arrow_tokenizer` makes one of any library that encodes lists of texts;
it runs on Arrow batches, once per text.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import hex_prefix_int, py_split

IGNORE_INDEX = -100
PAD_ID = 0

Tokenizer = Callable[[Column], Column]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_tokenizer(vocab_size: int = 32000) -> Tokenizer:
    """Words -> ids in ``[1, vocab_size)`` by md5 (0 is the pad id)."""
    def tok(text: Column) -> Column:
        return F.transform(py_split(text),
                           lambda w: (F.lit(1) + F.pmod(hex_prefix_int(F.md5(w)), F.lit(vocab_size - 1)))
                           .cast("int"))
    return tok


DEFAULT_TOKENIZER = whitespace_tokenizer()


#: ``() -> fn(texts) -> lists of ids``: loaded once per Python worker, called once per Arrow batch.
EncoderFactory = Callable[[], Callable[[list], list]]

_ENCODERS: dict[str, Callable[[list], list]] = {}


def arrow_tokenizer(factory: EncoderFactory, key: str) -> Tokenizer:
    """A tokenizer that encodes Arrow batches of texts; null stays null.

    ``key`` names what ``factory`` loads: workers keep it between tasks."""
    @F.pandas_udf("array<int>")
    def encode_batches(texts: pd.Series) -> pd.Series:
        fn = _ENCODERS.get(key) or _ENCODERS.setdefault(key, factory())
        known = texts.notna().to_numpy()
        ids = iter(fn(texts[known].tolist()))
        return pd.Series([next(ids) if k else None for k in known], dtype=object)

    return lambda text: encode_batches(text)


def subword_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """The subword vocabulary of a ``tokenizer.json`` file, without special tokens.

    The file (a few MB) is read once, here, and broadcast; no executor opens it."""
    import hashlib

    from tesserae.session import ship_package

    ship_package(spark)
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    shared = spark.sparkContext.broadcast(text)

    def factory():
        from tokenizers import Tokenizer as Vocabulary

        vocabulary = Vocabulary.from_str(shared.value)
        return lambda texts: [e.ids for e in vocabulary.encode_batch(texts, add_special_tokens=False)]

    return arrow_tokenizer(factory, hashlib.md5(text.encode()).hexdigest())


def encode(text, max_length: int | None = None, tokenizer: Tokenizer = DEFAULT_TOKENIZER) -> Column:
    """Ids, truncated on the right to ``max_length``."""
    ids = tokenizer(_col(text))
    return ids if max_length is None else F.slice(ids, 1, max_length)


def mask_prompt(ids, prompt_len) -> Column:
    """labels = ids with the first ``min(prompt_len, len)`` set to -100."""
    n = prompt_len if isinstance(prompt_len, Column) else F.lit(prompt_len)
    return F.transform(_col(ids), lambda x, i: F.when(i < n, F.lit(IGNORE_INDEX)).otherwise(x))


def ones_like(ids) -> Column:
    return F.transform(_col(ids), lambda x: F.lit(1))


def pad_to(arr, width, value: int) -> Column:
    """Right-pad an int array to ``width`` with ``value``."""
    a = _col(arr)
    w = width if isinstance(width, Column) else F.lit(width)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(w - F.size(a), F.lit(0))))


def true_length(mask) -> Column:
    """Sum of the attention mask."""
    return F.aggregate(_col(mask), F.lit(0), lambda acc, x: acc + x)


def cut_to(arr, n) -> Column:
    """Slice an array back to the true length."""
    return F.slice(_col(arr), 1, n if isinstance(n, Column) else F.lit(n))


def valid_positions(labels, attention_mask) -> Column:
    """``label != -100 AND attention_mask`` per position (array<boolean>)."""
    return F.zip_with(_col(labels), _col(attention_mask),
                      lambda lab, m: (lab != F.lit(IGNORE_INDEX)) & (m != F.lit(0)))
