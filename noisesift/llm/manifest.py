"""Merkle manifest of a table: levels of runs of three, proofs by a recursive climb.

``H`` is lower-case hex sha256, digests go in as hex text. A row's leaf is ``H`` over its
fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a
group (``source``) stand in the order of their ids; while a level has several nodes, every
three neighbours become their ``H``; the last one is the group's subroot. The subroots, by
group name (null first, then bytewise), are the leaves of one more tree of that kind, whose
end is the root.

* ``build`` numbers the leaves by a range sort (a hot group spreads over the ranges), then
  writes one table a level: a run of three is a group of its own, so no task gathers more.
  Each node is a row with its number, its parent's number and its neighbours' digests on
  either side. Numbers are ``level * 2**40`` plus the number of the first leaf below (up to
  2**40 leaves); the tree of subroots counts its levels from ``TOP``.
* ``climb`` is Spark's recursive query over those rows. Every leaf starts with the digest
  shown for it; each step joins the parent's row, folds its digest in and appends one
  row with the neighbours passed. A leaf's rows are put together once, at the end, so what a step
  moves does not grow with the height.

Edge cases: null values are fields like any other (a null id sorts first); repeated rows have equal
leaves, and each keeps its own place and proof, so ids may repeat (equal ids are ordered by
leaf); texts of any length are hashed whole; an empty table gives an empty result and no
root; a table of one row has its leaf as the root and an empty proof; other columns are left
alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisesift.llm.common import query, staged, table
from noisesift.session import scratch_dir

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = 32
BITS = 40
#: groups whose subroots a join may broadcast (about 100 bytes each)
BROADCAST_GROUPS = 100_000
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf(**fields: Column) -> Column:
    """H over the fields in their order."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _hex(c: str | Column) -> Column:
    return F.lower(F.hex(c))


def _numbered(df: DataFrame, order: list[str], to: str, name: str) -> DataFrame:
    """A stored table with its rows' places (from 0) in the given order."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id())  # spreads equal rows over ranges
    rows = rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    rows = staged(rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = rows.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    out = rows.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return out.withColumn(to, F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_off", "_at")


@dataclass
class Manifest:
    leaves: DataFrame  #: place, the id, group, leaf, shown (hex); start of the group
    nodes: DataFrame  #: level, node, parent, before, after (digests next to it, binary)
    subroots: DataFrame  #: start, subroot
    root: str | None


def _levels(rows: DataFrame, height: int, base: int, path: str) -> DataFrame:
    """Write the runs of each level of trees ``(start, n, i, node, digest)``; the last nodes ``(start, node, digest)``."""
    spark, last = rows.sparkSession, rows.where("n = 1").select("start", "node", "digest")
    for k in range(height):
        run = F.floor(F.col("i") / 3).alias("i")
        runs = rows.where("n > 1").groupBy("start", "n", run).agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("place"), "node", "digest"))).alias("run"))
        number = F.lit((base + k + 1) << BITS) + F.col("start") + F.col("i") * F.lit(3 ** (k + 1))
        digest = F.unhex(F.sha2(F.array_join(F.transform("run.digest", lambda d: _hex(d)), ""), 256))
        at = f"{path}/level={base + k}"
        runs.select("start", "n", "i", "run", number.alias("node"), digest.alias("digest")).write.parquet(at)
        rows = spark.read.parquet(at).select("start", F.ceil(F.col("n") / 3).alias("n"), "i", "node", "digest")
        last = last.unionByName(rows.where("n = 1").select("start", "node", "digest"))
    return last


def _height(most: int) -> int:
    k = 0
    while most > 1:
        most, k = -(-most // 3), k + 1
    return k


def build(docs: DataFrame, shown: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS) -> Manifest:
    """``shown``: columns to be read otherwise in the digests that the climb starts from."""
    spark = docs.sparkSession
    own = {c: F.col(c) for c in fields}
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf(**own).alias("leaf"), leaf(**(own | (shown or {}))).alias("shown"))
    rows = _numbered(staged(rows, "leaves"), ["grp", "id", "leaf"], "place", "leaves")
    groups = staged(rows.groupBy("grp").agg(F.min("place").alias("start"), F.count("*").alias("n")), "groups")
    total, most = groups.agg(F.count("*"), F.max("n")).first()
    side = F.broadcast(groups) if total <= BROADCAST_GROUPS else groups
    side = side.withColumnRenamed("grp", "_grp")
    leaves = staged(rows.join(side, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp"), "leaves")
    path = scratch_dir(spark, "nodes")
    cells = leaves.select("start", "n", (F.col("place") - F.col("start")).alias("i"), F.col("place").alias("node"), F.unhex("leaf").alias("digest"))
    last = staged(_levels(cells, _height(most or 0), 0, path), "subroots")
    top = _numbered(last, ["start"], "i", "subroots").select(F.lit(0).cast("long").alias("start"), F.lit(total).cast("long").alias("n"), "i", "node", "digest")
    end = _levels(top, _height(total), TOP, path).first()  # one row
    if total and (total > 1 or most > 1):
        runs = spark.read.option("basePath", path).parquet(path).withColumnRenamed("node", "parent")
    else:  # a lone leaf, or none
        runs = spark.createDataFrame([], "level int, parent long, run array<struct<place: bigint, node: bigint, digest: binary>>")
    joined = lambda part: F.array_join(F.transform(part, lambda x: _hex(x.digest)), "")
    nodes = runs.select("level", "parent", "run", F.posexplode("run").alias("_k", "_own")).select(
        "level", F.col("_own.node").alias("node"), "parent",
        F.unhex(joined(F.slice("run", F.lit(1), F.col("_k")))).alias("before"),
        F.unhex(joined(F.slice("run", F.col("_k") + 2, F.lit(3)))).alias("after"),
    )
    subroots = last.select("start", _hex("digest").alias("subroot"))
    return Manifest(leaves, staged(nodes, "nodes"), subroots, bytes(end["digest"]).hex() if end else None)


CLIMB = """
WITH RECURSIVE climb(place, step, up, folded, passed) AS (
  SELECT l.place, 0, n.parent,
         unhex(sha2(concat(lower(hex(coalesce(n.before, X''))), l.shown, lower(hex(coalesce(n.after, X'')))), 256)),
         concat(n.before, n.after)
  FROM {leaves} l JOIN {first} n ON n.node = l.place
  UNION ALL
  SELECT c.place, c.step + 1, n.parent,
         unhex(sha2(concat(lower(hex(n.before)), lower(hex(c.folded)), lower(hex(n.after))), 256)),
         concat(n.before, n.after)
  FROM climb c JOIN {above} n ON n.node = c.up
)
SELECT place, step, folded, passed FROM climb
"""


def climb(m: Manifest) -> DataFrame:
    """One row a leaf: place, ``folded_root`` and ``proof`` (the neighbours' digests up to the root, hex)."""
    spark = m.leaves.sparkSession
    nodes, low = m.nodes, F.lit(1 << BITS)
    kept = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        steps = spark.sql(CLIMB, leaves=m.leaves.select("place", "shown"), first=nodes.where(F.col("node") < low), above=nodes.where(F.col("node") >= low))
        steps = staged(steps, "steps")
    finally:
        if kept is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, kept)
    path = F.sort_array(F.collect_list(F.struct("step", "passed")))
    return steps.groupBy("place").agg(F.max_by("folded", "step").alias("folded"), path.alias("path")).select(
        "place", _hex("folded").alias("folded_root"), F.array_join(F.transform("path", lambda s: _hex(s.passed)), "").alias("proof")
    )


def verify(m: Manifest) -> DataFrame:
    """One row a leaf: id, leaf, subroot, root, proof, folded_root, verified."""
    few = m.subroots.count() <= BROADCAST_GROUPS
    rows = m.leaves.join(climb(m), "place", "left").join(F.broadcast(m.subroots) if few else m.subroots, "start")
    folded = F.coalesce("folded_root", "shown")  # a lone leaf has nothing to climb
    return rows.select("id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), F.coalesce("proof", F.lit("")).alias("proof"), folded.alias("folded_root"), (folded == F.lit(m.root)).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
ORACLE = f"""
WITH RECURSIVE
bits AS (
  SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY k) AS t
  FROM range(256) AS r(k)
), summed AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM documents d, bits
), leaves AS (
  SELECT doc_id, source, coalesce('s' || source, '-') AS g, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
         sha256({_LEAF} || {_FIELD.format("cut")}) AS shown
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM summed)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaves
), low AS (
  SELECT 0 AS l, g, p AS i, n, leaf AS h FROM placed
  UNION ALL
  SELECT l + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY l, g, n, i // 3
), subroots AS (SELECT g, l AS height, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS l, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM subroots
  UNION ALL
  SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, n, i // 3
), ranks AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS r FROM subroots),
nodes AS (
  SELECT g, l, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT g, l, i, n, h FROM low UNION ALL SELECT '', l, i, n, h FROM high) WHERE n > 1
  WINDOW w AS (PARTITION BY g, l, i // 3 ORDER BY i)
), climb AS (
  SELECT g, p, 0 AS l, p AS i, shown AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.g, c.p, c.l + 1, c.i // 3, sha256(before || h || after), proof || before || after
  FROM climb c JOIN nodes n ON n.g = c.g AND n.l = c.l AND n.i = c.i
), over AS (
  SELECT c.g, c.p, 0 AS l, r AS i, c.h, c.proof FROM climb c JOIN ranks s ON s.g = c.g AND s.height = c.l
  UNION ALL
  SELECT c.g, c.p, c.l + 1, c.i // 3, sha256(before || h || after), proof || before || after
  FROM over c JOIN nodes n ON n.g = '' AND n.l = c.l AND n.i = c.i
), root AS (SELECT l, h FROM high WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = root.h AS verified
FROM placed p JOIN subroots s USING (g) JOIN root ON true JOIN over o ON o.g = p.g AND o.p = p.p AND o.l = root.l
"""


@query("op12_merkle_manifest", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = verify(build(docs, {"text": cut}))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
