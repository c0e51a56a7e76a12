"""Periodic runs of words by recompression.

The texts of a batch are one string of word numbers with a letter of its own at every
border. Block compression (equal neighbours become one symbol with a count) and pair
compression (a hash parts the symbols into two sides, neighbours of the first and the
second side become one symbol) take turns until one symbol is left. Both parse alike
wherever the string is alike, so each level leaves at most one symbol, or the rest of
one block, to compare at the border of a common stretch: how far two places agree is
answered by one walk up the levels and one down, for all questions at once.

A run of period ``q`` and length ``4 q`` or more holds a place ``x`` on the grid of step
``3 q`` with ``x + q``. So all pairs ``(x, x + q)`` of equal words are asked how far they
agree to the right and to the left, which gives the run whole. Of the periods found for
one stretch the smallest is its period; the others are multiples of it.

Texts meet in batches of ``BATCH_WORDS`` words (a longer text is a batch of its own) and
memory grows with the longest text alone. No rows move between tasks.

Edge cases: null and empty texts have no words and no runs; repeated rows give the same
row again each, so ids need not be unique or set; ties of length go to the smaller start,
then period; an empty table gives an empty result; other columns are left alone, and
those named like the results do not get in the way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import query, table

BATCH_WORDS = 200_000
#: questions answered together
ASKED = 1 << 18
SPACE = r"\x20\x09-\x0D"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Level:
    """A string of symbols and its parse into phrases: blocks, or pairs and single symbols."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, block: bool):
        self.symbols, self.first, self.block = symbols, first, block
        self.starts = np.append(np.flatnonzero(first), len(symbols))
        self.phrase = np.cumsum(first) - 1

    def room(self, at: np.ndarray, back: bool) -> np.ndarray:
        """Symbols that may be compared as one from a place: the rest of a block, or one."""
        if not self.block:
            return np.ones(len(at), np.int64)
        if back:
            return at - self.starts[self.phrase[at - 1]]
        return self.starts[self.phrase[at] + 1] - at

    def above(self) -> np.ndarray:
        """The string of phrases, each one a number."""
        begin, size = self.starts[:-1], np.diff(self.starts)
        second = size if self.block else np.where(size == 2, self.symbols[np.minimum(begin + 1, len(self.symbols) - 1)] + 1, 0)
        key = self.symbols[begin] * (int(second.max()) + 1) + second
        return pd.factorize(key)[0].astype(np.int64)


class Grammar:
    """Levels of a string whose first and last letters occur once each."""

    def __init__(self, letters: np.ndarray):
        self.levels: list[Level] = []
        s = letters
        while len(s) > 1:
            first = np.append(True, s[1:] != s[:-1])
            if not first.all():
                s = self._push(s, first, True)
                continue
            mixed = (s + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(self.levels) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            side = (mixed >> np.uint64(60)) & np.uint64(1) == 1
            there, back = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
            s = self._push(s, np.append(True, ~(there if there.sum() >= back.sum() else back)), False)

    def _push(self, s: np.ndarray, first: np.ndarray, block: bool) -> np.ndarray:
        self.levels.append(Level(s, first, block))
        return self.levels[-1].above()

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """For each pair of different places: how many letters from there on (or before) are equal."""
        a, b, step, near = i.copy(), j.copy(), -1 if back else 1, 1 if back else 0
        halted = np.full(len(a), -1)
        on = np.arange(len(a))
        for k, level in enumerate(self.levels):
            inside = on[~(level.first[a[on]] & level.first[b[on]])]
            same = level.symbols[a[inside] - near] == level.symbols[b[inside] - near]
            halted[inside[~same]] = k
            inside = inside[same]
            ra, rb = level.room(a[inside], back), level.room(b[inside], back)
            move = np.minimum(ra, rb) * step
            a[inside] += move
            b[inside] += move
            halted[inside[ra != rb]] = k
            on = on[halted[on] < 0]
            if not len(on):
                break
            a[on], b[on] = level.phrase[a[on]], level.phrase[b[on]]
        for k in range(int(halted.max(initial=0)) - 1, -1, -1):
            level, on = self.levels[k], np.flatnonzero(halted > k)
            a[on], b[on] = level.starts[a[on]], level.starts[b[on]]
            on = on[level.symbols[a[on] - near] == level.symbols[b[on] - near]]
            move = np.minimum(level.room(a[on], back), level.room(b[on], back)) * step
            a[on] += move
            b[on] += move
        return np.abs(a - i)


def runs_of(letters: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start, then period; ``longest``: words of the longest text."""
    grammar = Grammar(letters)
    found: list[np.ndarray] = []
    grid: list[np.ndarray] = []
    held = 0

    def answer() -> None:
        x, q = (np.concatenate(c) for c in zip(*grid, strict=True))
        right = grammar.agree(x, x + q)
        left = grammar.agree(x, x + q, back=True)
        length = left + q + right
        ok = length >= np.maximum(6, 4 * q)
        if ok.any():
            found.append(np.unique(np.stack([x - left, length, q])[:, ok], axis=1))
        grid.clear()

    for q in range(1, longest // 4 + 1):
        x = 3 * q * np.flatnonzero(letters[: -q : 3 * q] == letters[q :: 3 * q])
        for part in np.split(x, range(ASKED, len(x), ASKED)) if len(x) else []:
            grid.append((part, np.full(len(part), q)))
            held += len(part)
            if held >= ASKED:
                answer()
                held = 0
    if grid:
        answer()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batch(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each list of words."""
    numbers: dict[bytes, int] = {}
    size = [len(t) for t in texts]
    at = np.cumsum([1, *[n + 1 for n in size]])  # a border before every text and one at the end
    letters = np.empty(at[-1], np.int64)
    for begin, words in zip(at, texts, strict=False):
        letters[begin : begin + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    letters[at - 1] = len(numbers) + np.arange(len(at))
    start, length, period = runs_of(letters, max(size))
    edge = np.zeros(len(letters) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge) == 0
    of = np.searchsorted(start, at)
    runs, collapsed = [], []
    for k, words in enumerate(texts):
        lo, hi = of[k], of[k + 1]
        runs.append([{"start": int(s - at[k]), "length": int(n), "period": int(q)} for s, n, q in zip(start[lo:hi], length[lo:hi], period[lo:hi], strict=True)])
        if lo < hi:
            words = [words[i] for i in np.flatnonzero(kept[at[k] : at[k] + len(words)])]
        collapsed.append(b" ".join(words).decode())
    return runs, collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """One row a document: its id (as ``doc_id``), ``runs`` (structs of start, length and period, by start,
    then period) and ``collapsed``: its words joined by one space, of each run its first period only."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.col(text_col) if isinstance(text_col, str) else text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            done = 0
            texts: list[list[bytes]] = []
            words = 0
            for k, text in enumerate(b.column(1)):
                texts.append((text.as_py() or "").encode().split())
                words += len(texts[-1])
                if words >= BATCH_WORDS or k == b.num_rows - 1:
                    runs, collapsed = _batch(texts)
                    yield pa.RecordBatch.from_arrays([b.column(0)[done : k + 1], pa.array(runs, RUN), pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])
                    done, texts, words = k + 1, [], 0

    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """Documents with the words of every tenth (by checksum of the id) repeated from one place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    hit = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), 0)).alias("words"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = hit.select("*", n.alias("n"), g.alias("g"), F.when(n > 0, g % n).alias("a"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    as_int = lambda c: c.cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", as_int(F.col("a") + 1), as_int(F.col("p"))), as_int(F.ceil((F.col("n") - F.col("a")) / F.col("p")))))
    changed = F.concat(F.slice("words", F.lit(1), as_int(F.col("a"))), F.slice(again, F.lit(1), as_int(F.col("n") - F.col("a"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-most.start).alias("start"),
        most.length.alias("length"),
        (-most.period).alias("period"),
        F.floor(1000 * most.length / -most.period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
