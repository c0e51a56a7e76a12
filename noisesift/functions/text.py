"""Text encoding as corpus jobs.

The vocabulary is built from the whole corpus (every token of every text) by
a distributed count; it is bounded by ``vocab_size`` and therefore broadcast.
Texts are then encoded in place, batch by batch, by that vocabulary or by any
tokenizer given as a callable: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisesift.session import staged

# Special token ids (begin, pad, end, unknown) and the first ordinary id.
BOS_ID = 0
PAD_ID = 1
EOS_ID = 2
UNK_ID = 3
FIRST_ID = 4
TOKEN_PATTERN = r"\s+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: str | Column) -> Column:
    """Whitespace tokens, empty strings removed."""
    return F.filter(F.split(_c(text), TOKEN_PATTERN), lambda t: t != F.lit(""))


def build_vocab(corpus: DataFrame, text: str = "text", vocab_size: int = 50_000) -> DataFrame:
    """Token -> id for the ``vocab_size`` most frequent tokens (ties by token); ids start at 4.

    Counting is a partial+final aggregate over all tokens; only the top
    ``vocab_size`` rows survive (a bounded ``WindowGroupLimit``-free ``orderBy.limit``, i.e. TakeOrdered).
    """
    words = corpus.select(F.explode(F.split(_c(text), TOKEN_PATTERN)).alias("token")).where(F.col("token") != F.lit(""))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("token").asc()).limit(vocab_size)
    w = Window.orderBy(F.col("n").desc(), F.col("token").asc())
    return top.select("token", (F.row_number().over(w) + F.lit(FIRST_ID - 1)).cast("int").alias("id"))


def fit_length(ids: str | Column, n: int, pad: int = PAD_ID) -> Column:
    """F3. Cut to ``n`` and right-pad with ``pad`` (always the pad id, X3)."""
    return F.slice(F.concat(_c(ids), F.array_repeat(F.lit(pad), n)), 1, n)


def attention_mask(ids: str | Column) -> Column:
    """F4. 0 where the id is the pad id, else 1."""
    return F.transform(_c(ids), lambda x: F.when(x == F.lit(PAD_ID), F.lit(0)).otherwise(F.lit(1)))


def splice_separator(ids: str | Column) -> Column:
    """F5. Replace the first id 0 after position 0 by ``[2, 2]``."""
    a = _c(ids)
    p = F.array_position(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))), F.lit(BOS_ID))  # 1-based inside the tail
    head = F.slice(a, 1, p.cast("int"))
    tail = F.slice(a, (p + 2).cast("int"), F.greatest(F.size(a) - p - 1, F.lit(0)).cast("int"))
    return F.when(p > 0, F.concat(head, F.array(F.lit(EOS_ID), F.lit(EOS_ID)), tail)).otherwise(a)


Tokenizer = Callable[[list[str]], list[list[int]]]


class VocabTokenizer:
    """Ids of the white-space tokens by a vocabulary, unknown -> 3."""

    def __init__(self, shared):
        self.shared = shared  # a broadcast {token in UTF-8: id}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.ids(t.encode()) for t in texts]

    def ids(self, raw: bytes, keep: int | None = None) -> list[int]:
        """Of the first ``keep`` tokens of a text in UTF-8; ``bytes.split`` cuts where ``TOKEN_PATTERN`` does."""
        get = self.shared.value.get
        words = raw.split() if keep is None else raw.split(None, keep)[:keep]
        return [get(t, UNK_ID) for t in words]


def vocab_tokenizer(vocab: DataFrame) -> Tokenizer:
    """A tokenizer from a vocabulary table (bounded by its ``vocab_size``): ids of the white-space tokens, unknown -> 3."""
    ids = {r["token"].encode(): r["id"] for r in vocab.collect()}
    return VocabTokenizer(vocab.sparkSession.sparkContext.broadcast(ids))


SLICE_BYTES = 2_000_000  # of text that a tokenizer gets at once


def _slices(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Cut a batch where its texts reach ``SLICE_BYTES``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= SLICE_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _ids_column(text: str | Column, tokenizer: Tokenizer, keep: int) -> Column:
    """One Arrow pass; of a batch only a slice of texts and the kept ids stand in Python."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        done = []
        for a, b in _slices(sizes):
            part = texts.slice(a, b - a)
            if isinstance(tokenizer, VocabTokenizer):
                ids = [tokenizer.ids(t or b"", keep) for t in part.cast(pa.binary()).to_pylist()]
            else:
                ids = [list(x[:keep]) for x in tokenizer(["" if t is None else t for t in part.to_pylist()])]
            done.append(pa.array(ids, pa.list_(pa.int32())))
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return run(_c(text))


def multi_token_ids(df: DataFrame, vocab: DataFrame | Tokenizer, fields: dict[str, tuple[str, int]], id_col: str,
                    carry: Sequence[str] = ()) -> DataFrame:
    """Ids of the first ``keep`` tokens of several text columns, in order.

    ``fields``: ``out column -> (text column, keep)``. ``vocab`` is a vocabulary table
    (see ``build_vocab``; unknown -> 3) or any callable from texts to id lists, such as a
    pretrained tokenizer. Texts are encoded in place, batch by batch: nothing is shuffled
    and rows that repeat an id stay apart.
    Returns ``id_col, *carry, *fields`` (an empty list for an empty or null text).
    """
    tokenizer = vocab if callable(vocab) else vocab_tokenizer(vocab)
    return df.select(id_col, *carry, *[_ids_column(text, tokenizer, keep).alias(out) for out, (text, keep) in fields.items()])


def token_ids(df: DataFrame, vocab: DataFrame | Tokenizer, text: str, id_col: str, keep: int, out: str = "ids",
              carry: Sequence[str] = ()) -> DataFrame:
    """Ids of the first ``keep`` tokens of one text column (unknown -> 3); no markers."""
    return multi_token_ids(df, vocab, {out: (text, keep)}, id_col, carry)


def encode_text(df: DataFrame, vocab: DataFrame | Tokenizer, text: str = "text", id_col: str = "index", max_len: int = 128,
                out: str = "encode", carry: Sequence[str] = ()) -> DataFrame:
    """F1. ``[0] + ids[:max_len-2] + [2]`` padded with 1 to ``max_len``; rows ``(id, *carry, encode)``."""
    x = token_ids(df, vocab, text, id_col, max_len - 2, "__ids", carry)
    enc = F.concat(F.array(F.lit(BOS_ID)), F.col("__ids"), F.array(F.lit(EOS_ID)))
    return x.withColumn(out, fit_length(enc, max_len)).drop("__ids")


def encode_pair(df: DataFrame, vocab: DataFrame | Tokenizer, a: str, b: str, id_col: str = "index", max_len: int = 256,
                out: str = "encode", carry: Sequence[str] = ()) -> DataFrame:
    """F2. Side 1 with begin marker and a ``[2, 2]`` separator but no end marker,
    then side 2 (not side 1 again, X2) with end marker but no begin marker;
    padded to ``max_len``. Side 1 keeps at most ``max_len/2 - 3`` tokens, side 2
    ``max_len/2 - 2``. Both sides are tokenised in one pass."""
    half = max_len // 2
    x = multi_token_ids(df, vocab, {"__a": (a, half - 3), "__b": (b, half - 2)}, id_col, carry)
    enc = F.concat(F.array(F.lit(BOS_ID)), F.col("__a"), F.array(F.lit(EOS_ID), F.lit(EOS_ID)), F.col("__b"), F.array(F.lit(EOS_ID)))
    return x.withColumn(out, fit_length(enc, max_len)).drop("__a", "__b")


def length_stats(frames: dict[str, DataFrame], col: str = "encode") -> DataFrame:
    """Per table name the least and greatest encoded length and the rows. The tables are encoded once, in one job
    that writes a row a table."""
    own = [f.agg(F.min(F.size(col)).alias("min_len"), F.max(F.size(col)).alias("max_len"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "*")
           for name, f in frames.items()]
    return staged(reduce(DataFrame.unionByName, own), "lengths")


def check_uniform_length(*frames: DataFrame, col: str = "encode", stats: DataFrame | None = None) -> int:
    """F7. Every encoded row of every table has the same length; returns it. ``stats``: those of the tables, if known."""
    if stats is None:
        stats = length_stats({str(k): f for k, f in enumerate(frames)}, col)
    lengths = {n for r in stats.collect() for n in (r["min_len"], r["max_len"])}  # a row a table
    lengths.discard(None)
    if len(lengths) > 1:
        raise ValueError(f"encoded lengths differ: {sorted(lengths)}")
    return lengths.pop() if lengths else 0


def collate_ragged(aug: DataFrame, clean_batches: DataFrame, group: str = "origin", id_col: str = "aug_id",
                   batch: str = "batch_id", key: str = "index") -> DataFrame:
    """F6 (long form). Augmented rows grouped per clean row, each group expanded
    cyclically to the longest group of its batch.

    Instead of gathering a group into one array (a hot origin could hold a third
    of the rows), member ``r`` of a group of size ``n`` fills slots
    ``r, r+n, r+2n, ... < M`` (``M`` = the batch's largest group): rows
    ``(key, batch, slot, <aug columns>)``.
    """
    from noisesift.operators.ranking import ordered_position

    cb = clean_batches.select(F.col(key).alias(group), batch)
    a = aug.join(cb, group)
    ranked = ordered_position(a, id_col, [group], "__r", "__n")
    m = a.groupBy(group, batch).agg(F.count(F.lit(1)).alias("__n")).groupBy(batch).agg(F.max("__n").alias("__m"))  # no rank needed
    x = ranked.join(m, batch)
    reps = F.ceil((F.col("__m") - F.col("__r")) / F.col("__n")).cast("int")
    x = x.withColumn("__k", F.explode(F.sequence(F.lit(0), reps - 1)))
    return x.withColumn("slot", (F.col("__r") + F.col("__k") * F.col("__n")).cast("bigint")) \
        .withColumnRenamed(group, key).drop("__r", "__n", "__m", "__k")
