"""Projections, schema shaping (B), filters (C) and set operations (I).

Schema decisions are taken once, in the driver, from ``df.columns``; the data
work is plain Catalyst expressions, so filters reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default scores given to rows that carry none.
DEFAULT_READABILITY = 10.0
DEFAULT_COLA = 0.5

# Candidate column-name pairs for two-sided examples, in lookup order.
PAIR_NAMES = [("sentence1", "sentence2"), ("question1", "question2"), ("question", "sentence"), ("hypothesis", "premise")]

# Separators between the two sides of a pair.
PREP_SEPARATOR = "</s></s>"
EVAL_SEPARATOR = " </s> "


# ------------------------------------------------------------------ B: shaping
def score_columns(df: DataFrame, style: str = "any") -> list[str]:
    """B2. ``style='Score'``: names containing ``Score`` (case-sensitive);
    ``style='any'``: names containing ``score`` or ``readability`` in any case."""
    if style == "Score":
        return [c for c in df.columns if "Score" in c]
    return [c for c in df.columns if "score" in c.lower() or "readability" in c.lower()]


def pad_scores(train: DataFrame, aug: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """B1. Give both tables ``readability``/``cola`` when ``aug`` has none.

    Returns ``(train, aug, pair_mode)``; pair mode is on when ``aug`` carries two
    ``*Score*`` columns, which become ``readability1``/``readability2``.
    """
    if "readability" in aug.columns:
        return train, aug, False
    found = score_columns(aug, "Score")
    t = train.withColumns({"readability": F.lit(DEFAULT_READABILITY), "cola": F.lit(DEFAULT_COLA)})
    if not found:
        return t, aug.withColumns({"readability": F.lit(DEFAULT_READABILITY), "cola": F.lit(DEFAULT_COLA)}), False
    if len(found) == 1:
        return t, aug.withColumns({"readability": F.col(found[0]).cast("double"), "cola": F.lit(DEFAULT_COLA)}), False
    a = aug.withColumns({
        "readability": F.lit(DEFAULT_READABILITY),
        "readability1": F.col(found[0]).cast("double"),
        "readability2": F.col(found[1]).cast("double"),
        "cola": F.lit(DEFAULT_COLA),
    })
    return t, a, True


def alias_target(df: DataFrame, task: str | None = None, inverse: bool = False) -> DataFrame:
    """B3. ``class := label`` (or ``label := class`` with ``inverse``); for cola also ``sentence := text``."""
    src, dst = ("class", "label") if inverse else ("label", "class")
    out = df.withColumn(dst, F.col(src)) if src in df.columns else df
    if task == "cola" and "text" in out.columns:
        out = out.withColumn("sentence", F.col("text"))
    return out


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B4. Rename present columns (``sentence -> text`` and the like)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """B4. Remove ``suffix`` (e.g. ``_aug``) from every column name that ends with it."""
    return df.toDF(*[c[: -len(suffix)] if c.endswith(suffix) else c for c in df.columns])


def assign_columns_by_arity(df: DataFrame, split: str) -> DataFrame:
    """B5. Name positional columns by their count and the split."""
    n = len(df.columns)
    if n == 3:
        names = ["index", "label", "text"]
    elif n == 4 and split == "train":
        names = ["index", "label", "text", "readability"]
    elif n == 4:
        names = ["index", "sentence1", "label", "sentence2"]
    elif n == 6:
        names = ["index", "sentence1", "label", "sentence2", "score1", "score2"]
    else:
        raise ValueError(f"no column layout for {n} columns")
    return df.toDF(*names)


def pair_columns(df: DataFrame) -> tuple[str, str]:
    for a, b in PAIR_NAMES:
        if a in df.columns and b in df.columns:
            return a, b
    raise ValueError(f"no pair of text columns among {df.columns}")


def pair_text(df: DataFrame, mode: str = "prep", out: str = "text") -> DataFrame:
    """B6. ``prep``: ``a + '</s></s>' + b`` in one column; ``eval``: ``text1 = a``,
    ``text2 = ' </s> ' + b``. Null on either side gives null (as ``concat``)."""
    a, b = pair_columns(df)
    if mode == "prep":
        return df.withColumn(out, F.concat(F.col(a), F.lit(PREP_SEPARATOR), F.col(b)))
    return df.withColumns({"text1": F.col(a), "text2": F.concat(F.lit(EVAL_SEPARATOR), F.col(b))})


def training_rows(df: DataFrame, layout: str) -> DataFrame:
    """B7. Final projection per split.

    ``eval``: (encode, class); ``aligned``: clean and aug (encode, class);
    ``zipped``: one row a position with its clean, meta and aug row (D7), the scores of the
    clean and the aug one as weight inputs.
    """
    if layout == "eval":
        return df.select("encode", "class")
    if layout == "aligned":
        return df.select("encode_raw", "class_raw", "encode_aug", "class_aug")
    if layout == "zipped":
        return df.select(
            "encode_clean", "class_clean", "readability_clean", "cola_clean", "encode_meta", "class_meta",
            "encode_aug", "class_aug", "readability_aug", "cola_aug",
        )
    raise ValueError(layout)


# ----------------------------------------------------------------- C: filters
def filter_methods(aug: DataFrame, methods: str | Sequence[str] = "all") -> DataFrame:
    """C1. ``'all'`` keeps every row, else ``aug_method IN (...)`` (comma list accepted)."""
    if isinstance(methods, str):
        if methods == "all":
            return aug
        methods = [m.strip() for m in methods.split(",") if m.strip()]
    return aug.where(F.col("aug_method").isin(list(methods)))


def open_interval(c: Column, lo: float, hi: float) -> Column:
    return (c > F.lit(lo)) & (c < F.lit(hi))


def filter_interval(aug: DataFrame, lo: float, hi: float, col: str = "readability") -> DataFrame:
    """C2. Open interval ``lo < x < hi``."""
    return aug.where(open_interval(F.col(col), lo, hi))


def filter_interval_pair(aug: DataFrame, lo: float, hi: float) -> DataFrame:
    """C3. Open interval on both ``readability1`` and ``readability2``."""
    return aug.where(open_interval(F.col("readability1"), lo, hi) & open_interval(F.col("readability2"), lo, hi))


def filter_all_scores(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """C4. Every discovered score column strictly inside (lo, hi)."""
    cols = score_columns(df, "any")
    if not cols:
        return df
    return df.where(reduce(lambda a, b: a & b, [open_interval(F.col(c), lo, hi) for c in cols]))


def require_nonempty(df: DataFrame, what: str = "filtered augmented rows") -> DataFrame:
    """C5. Raise when a filter left nothing (one cheap ``LIMIT 1`` job)."""
    if df.isEmpty():
        raise ValueError(f"no {what} left")
    return df


def tag_has_all(metric: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [metric.contains(p) for p in parts])


def filter_tags(log: DataFrame, parts: Sequence[str] = ("Test",), col: str = "metric", mode: str = "all") -> DataFrame:
    """C6. Metric names containing every one of ``parts`` (``mode='all'``, the selection
    filter) or at least one (``mode='any'``, the loader's ``Test`` / validation-tag filter)."""
    if mode == "any":
        return log.where(reduce(lambda a, b: a | b, [F.col(col).contains(p) for p in parts]))
    return log.where(tag_has_all(F.col(col), parts))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """C7. Drop rows with any null."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


# ------------------------------------------------------------- I: set ops
def union_methods(*frames: DataFrame) -> DataFrame:
    """I1/I2. Stack tables of different columns; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


union_raw_aug = union_methods


def config_difference(a: Column, b: Column, ignore: Sequence[str] = ()) -> Column:
    """I3. Entries of map ``a`` absent from map ``b``, skipping keys that contain an ignored substring."""
    if ignore:
        kept = F.map_filter(a, lambda k, v: ~reduce(lambda x, y: x | y, [k.contains(s) for s in ignore]))
    else:
        kept = a
    return F.array_except(F.map_entries(kept), F.map_entries(b))


def distinct_labels(df: DataFrame, col: str = "label") -> DataFrame:
    """I4. Unique classes."""
    return df.select(col).distinct()
