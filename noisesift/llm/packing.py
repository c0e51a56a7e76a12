"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The
program "fewest sequences covering the length histogram" is solved by
multiplicative weights: every length carries a weight, a knapsack dynamic
program over the capacity prices the configurations, the best ones
get a step of sequences, and the weights of the lengths they covered fall, until all
demand is covered. The fractional solution is rounded by its running sum, and the few
pieces left go to the fullest bins that hold them (best fit on the histogram). A dual
bound tells how far the plan can be from the least number of sequences.

Only the histogram (at most ``capacity`` numbers) and the plan (patterns and
their counts, bounded by the pricing rounds, whose number grows with the logarithm of the rows) are ever on the driver;
the pieces are tokenised, ranked within their length and mapped to
``(sequence_id, offset)`` on the executors. A hot length is split by a salt
before it is ranked.

Defined results: null text counts as empty; an empty text is one piece holding
only the end id; repeated rows are packed once each; an empty table gives an
empty result; very long texts are cut into whole pieces of ``capacity`` ids,
of which only the first may be shorter.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisesift.llm.common import query, staged, table

CAPACITY = 1024
END_ID = 2
CACHE_WORDS = 600_000
CACHE_CHARS = 30_000_000  # of the cached words
TAIL = ".,;:!?*%$#&|)]}>"
SHARPNESS = 4.0  # of the weights
STEP = 0.2  # of what is left
LEAP = 0.04  # of a length's demand
SLACK = 0.01  # configurations of nearly the best value
TOGETHER = 64
DONE = 1e-6  # of a length's demand
ROUNDED_SHARES = (1.0, 0.98, 0.9, 0.75, 0.5, 0.0)  # of the fractional solution; best fit does the rest
ROWS_PER_SALT = 50_000

_tokenizers: dict = {}  # path -> WordCache, one per Python worker


class WordCache:
    """Token ids of whole texts, joined from the cached ids of their words.

    A byte-level BPE never merges across a space between two non-space
    characters, nor between a letter or digit and the punctuation after it, so
    such a text is the concatenation of its space-led words, and these of their
    bodies and tails. New words are encoded together, as one line of text: a
    token that starts with a space opens the next word. A text with any other
    white space around a space is encoded as a whole.
    """

    ODD = b"\xff\xff\xff\xff"  # no id; marks a text that has to be encoded as a whole

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.chars = 0
        self.tails: dict[str, bytes] = {}
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        enc = self.tok.encode_batch_fast if hasattr(self.tok, "encode_batch_fast") else self.tok.encode_batch
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in enc(texts, add_special_tokens=False)]

    def _line(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it."""
        out: list[bytes] = []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = np.frombuffer(self._ids([" " + " ".join(part)])[0], dtype="<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part):
                raw = ids.tobytes()
                cut = [*(4 * at).tolist(), len(raw)]
                out += [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            else:
                out += self._ids([" " + w for w in part])
        return out

    def _learn(self, new: list[str]) -> None:
        words, bodies = self.words, {}
        for w in new:
            if not w or w[0].isspace() or w[-1].isspace() or "<|" in w:
                words[w] = self.ODD
                continue
            body = w.rstrip(TAIL)
            if len(body) == len(w) or not body or not body[-1].isalnum():
                body = w
            bodies[w] = body
        fresh = [x for x in dict.fromkeys(bodies.values()) if x not in words]
        words.update(zip(fresh, self._line(fresh), strict=True))
        for w, body in bodies.items():
            if len(body) < len(w):
                tail = w[len(body) :]
                if tail not in self.tails:
                    if len(self.tails) > CACHE_WORDS:
                        self.tails.clear()
                    self.tails[tail] = self._ids([tail])[0]
                words[w] = words[body] + self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        seen: set[str] = set()
        for ws in split:
            seen.update(ws)
        new = seen.difference(self.words)
        more = sum(map(len, new))
        if len(self.words) + len(new) > CACHE_WORDS or self.chars + more > CACHE_CHARS:
            self.words.clear()
            self.tails.clear()
            self.chars, new = 0, seen
            more = sum(map(len, new))
        self.chars += more
        self._learn(list(new))
        firsts = self._ids([ws[0] for ws in split])
        get = self.words.__getitem__
        out, whole = [], []
        for k, ws in enumerate(split):
            if len(ws) > 1:
                rest = b"".join(map(get, ws[1:]))
                if not ws[0] or ws[0][-1].isspace() or "<|" in ws[0] or self.ODD in rest:
                    whole.append(k)
                    rest = b""
                out.append(firsts[k] + rest)
            else:
                out.append(firsts[k])
        for k, b in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = b
        return out


def _slices(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    """Cut a batch where its texts reach so many characters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids themselves on request)."""
    fields = [pa.field("id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        cache = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, WordCache(tokenizer_path))
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for s in _slices(texts):
                rows: list[tuple] = []
                for i, raw in zip(ids[s], cache.encode(texts[s]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = n % capacity or min(n, capacity)
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        part = raw[4 * cuts[k] : 4 * cuts[k + 1]]
                        rows.append((i, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype("i8"),) if with_ids else ()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def _price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the largest weight within each capacity, and the length taken last (0: one place is left free)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    back = weights[1:]
    for c in range(1, capacity + 1):
        gain = back[:c] + best[c - 1 :: -1]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], choice[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, choice


def _trace(choice: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration behind a capacity's best weight."""
    out: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if choice[c]:
            out[int(choice[c])] += 1
        c -= int(choice[c]) or 1
    return out


def lower_bound(demand: np.ndarray, prices: np.ndarray, best: float) -> float:
    """A bound on the program's optimum from below: prices under which no configuration is worth more than 1.

    The given prices over their best configuration's value, or prices by size: 1 for lengths
    that leave less than ``a`` of a sequence, none for lengths under ``a``, the share of a sequence for those between.
    """
    capacity = len(demand) - 1
    area = np.concatenate([[0.0], np.cumsum(demand * np.arange(capacity + 1))]) / capacity
    count = np.concatenate([[0.0], np.cumsum(demand)])
    a = np.arange(1, capacity // 2 + 1)
    by_size = count[-1] - count[capacity - a + 1] + area[capacity - a + 1] - area[a]
    return max(float((prices * demand).sum()) / best if best > 0 else 0.0, float(by_size.max()))


def solve_configurations(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Fractional solution of the configuration program, covering all pieces: ``[(configuration, sequences)]``, and
    a lower bound on its optimum.

    A length's weight is its size times ``exp(SHARPNESS * share left)``. Each round one knapsack table prices all
    configurations; those of nearly the best value, one through each length that lags, take a step together. It
    empties no length more than ``STEP`` of what is left, or moves no length by more than ``LEAP`` of its demand, so the rounds grow
    with the logarithm of the demand and run until nothing is left.
    """
    demand = np.zeros(capacity + 1)
    for length, n in hist.items():
        demand[length] = n
    full, demand[capacity] = demand[capacity], 0
    left, inverse = demand.copy(), np.divide(1.0, demand, out=np.zeros(capacity + 1), where=demand > 0)
    out: dict[tuple, float] = defaultdict(float)
    share = np.arange(capacity + 1) / capacity
    worth = share + 0.3 / capacity * share**2  # among equally full configurations the long pieces go first
    bound = 0.0
    while (live := np.flatnonzero(left)).size:
        lag = left * inverse
        y = np.where(left > 0, worth * np.exp(SHARPNESS * (lag - lag.max())), 0)
        best, choice = _price(y, capacity)
        if not bound:  # at the start all lengths have a price
            bound = lower_bound(demand, y, best[capacity])
        value = y[live] + best[capacity - live]
        good = live[value >= (1 - SLACK) * best[capacity]]
        steps: dict[tuple, float] = {}
        used = np.zeros(capacity + 1)
        for length in good[np.argsort(-lag[good], kind="stable")][:TOGETHER]:
            config = _trace(choice, capacity - int(length))
            config[int(length)] += 1
            key = tuple(sorted(config.items()))
            if key not in steps:
                steps[key] = min(left[a] / k for a, k in key)
                for a, k in key:
                    used[a] += steps[key] * k
        on = used > 0
        empties = float((left[on] / used[on]).min())
        step = min(empties, max(STEP * empties, LEAP / float((used * inverse).max())))
        for key, x in steps.items():
            out[key] += step * x
        left -= step * used
        left[left < DONE * demand] = 0
    return ([({capacity: 1}, float(full))] if full else []) + [(dict(k), x) for k, x in out.items()], bound + full


def round_and_fill(hist: dict[int, int], solution: list[tuple[dict[int, int], float]], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Round the fractional sequences to whole ones; best fit for the lengths still open.

    Configurations of like lengths stand together, and each takes the whole numbers that the running sum of
    sequences passes in it. One whose pieces are no longer all there keeps those that are, and room.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in hist.items():
        left[length] = n
    plan: dict[tuple, int] = defaultdict(int)
    partial: list[list] = []
    at = 0.5
    for config, x in sorted(solution, key=lambda s: sorted(s[0].items(), reverse=True), reverse=True):
        n, at = math.floor(at + x) - math.floor(at), at + x
        while n > 0:
            config = {length: k for length, k in ((length, min(k, int(left[length]))) for length, k in config.items()) if k}
            if not config:
                break
            m = min([n, *(int(left[length]) // k for length, k in config.items())])
            for length, k in config.items():
                left[length] -= m * k
            if sum(length * k for length, k in config.items()) == capacity:
                plan[tuple(sorted(config.items()))] += m
            else:
                partial.append([config, m])
            n -= m
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [configuration, how many]
    for config, m in partial:
        open_bins[capacity - sum(length * k for length, k in config.items())].append([config, m])
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for room in range(length, capacity):
            while n and open_bins.get(room):
                config, many = open_bins[room].pop()
                each = min(room // length, n)
                used = min(many, n // each)
                if used < many:
                    open_bins[room].append([config, many - used])
                open_bins[room - each * length].append([{**config, length: config.get(length, 0) + each}, used])
                n -= used * each
        if n:
            each = capacity // length
            if n // each:
                open_bins[capacity - each * length].append([{length: each}, n // each])
            if n % each:
                open_bins[capacity - (n % each) * length].append([{length: n % each}, 1])
    for groups in open_bins.values():
        for config, many in groups:
            plan[tuple(sorted(config.items()))] += many
    return [(dict(k), n) for k, n in plan.items()]


def plan_sequences(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """The whole plan for a histogram: (configuration, whole sequences of it); the best of some roundings."""
    solution, _ = solve_configurations(hist, capacity)
    plans = [round_and_fill(hist, [(c, share * x) for c, x in solution], capacity) for share in ROUNDED_SHARES]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (columns ``piece``, ``length``)."""
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_sequences(hist, capacity)
    keys, bases, counts, seqs, offsets = [], [], [], [], []
    first_seq, taken = 0, defaultdict(int)
    for config, n in plan:
        at = 0
        for length, k in sorted(config.items(), reverse=True):
            keys.append(length)
            bases.append(taken[length])
            counts.append(k)
            seqs.append(first_seq)
            offsets.append(at)
            taken[length] += n * k
            at += k * length
        first_seq += n
    order = np.lexsort((np.array(bases, dtype=np.int64), np.array(keys, dtype=np.int64))) if keys else np.array([], dtype=np.int64)
    plan_cols = [np.array(x, dtype=np.int64)[order] for x in (keys, bases, counts, seqs, offsets)]
    shared = pieces.sparkSession.sparkContext.broadcast(plan_cols)  # bounded by the rounds, not by the rows

    salts = F.array(*[F.lit(1 + hist.get(length, 0) // ROWS_PER_SALT) for length in range(1, capacity + 1)])  # only common lengths are split
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.element_at(salts, F.col("length").cast("int"))).cast("int"))
    sizes = salted.groupBy("length", "_salt").count()
    before = sizes.select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(F.col(id_col).asc_nulls_first(), "piece")) - 1
    ranked = salted.withColumn("_n", within.cast("long")).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_n") + F.col("_before"))
    cols = [c for c in pieces.columns]
    ranked = ranked.select(*cols, "_rank")

    def place(batches):
        keys, bases, counts, seqs, offsets = shared.value
        starts = np.searchsorted(keys, np.arange(capacity + 2))
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            row = np.empty(len(length), dtype=np.int64)
            for v in np.unique(length):
                m = length == v
                lo, hi = starts[v], starts[v + 1]
                row[m] = lo + np.searchsorted(bases[lo:hi], rank[m], side="right") - 1
            local = rank - bases[row]
            sequence = seqs[row] + local // counts[row]
            offset = offsets[row] + (local % counts[row]) * length
            kept = b.select(cols)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*cols, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, ddl)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs(doc_id, text)``: one row per piece with its place."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(staged(tokenize_pieces(docs, tokenizer_path, capacity=capacity), "pieces"), capacity=capacity)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
