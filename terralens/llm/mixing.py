"""Mixing sources to target weights (DataFrame only).

The token budget runs down a tree domain - language - source. At each node the
children share it by weight; a child that cannot use its share keeps what it can
hold and its siblings take the rest by weight, so a shortage leaves a node only
when all of the node is used up. A leaf's budget is met from seeded epochs: whole
ones first, then a prefix, in tokens, of the next epoch's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralens.llm.common import stash

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Production parameters of the query and of the pipeline's stage.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 2}, "source": {"src0": 3}}
SEED = 17


def source_domain(source: Column | str) -> Column:
    """Domain of a source: four groups by the first hex digit of its MD5."""
    s = F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit(""))
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(s.cast("binary")), 1, 1), 16, 10).cast("int") % 4).cast("string"))


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        if int(w) != w or w < 1:
            raise ValueError(f"weights are positive whole numbers, not {w!r}")
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _leveled(df: DataFrame, domain: Column, text_col: str, id_col: str) -> list[Column]:
    """Level columns and the seeded order's ingredients of a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [
        domain.alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.md5(text.cast("binary")).alias("digest"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
    ]


def _order(seed: int, epoch: str = "epochs") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.col("key"), F.col("digest")).cast("binary"))


def share_out(nodes: DataFrame, budgets: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """Budgets of the children: ``nodes`` has (parent..., level, cap), ``budgets``
    (parent..., budget). Rows here are nodes of the tree, not documents."""
    # the root's budget is one number
    rows = nodes.join(budgets, parent) if parent else nodes.withColumn("budget", budgets.select("budget").scalar())
    rows = rows.withColumn("w", _weight(level, weights))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    family = Window.partitionBy(*parent)
    order = family.orderBy((F.col("cap") / F.col("w")).asc(), F.col(level))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("full", big("cap") * big("open") <= (big("budget") - big("capped")) * big("w"))
    rows = rows.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
    rows = rows.withColumn("rest", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(family))
    rows = rows.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("CAST((CAST(left AS DECIMAL(38,0)) * w) div rest AS BIGINT)")))
    # what rounding down left over goes out one token each
    rows = rows.withColumn("spare", F.col("budget") - F.sum("part").over(family))
    rows = rows.withColumn("nth", F.row_number().over(family.orderBy("full", level)))
    part = F.col("part") + F.when(~F.col("full") & (F.col("nth") <= F.col("spare")), 1).otherwise(0)
    return rows.select(*parent, level, part.cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, share: float, weights: dict, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, epochs, rest): how many whole epochs each leaf
    gives and how many tokens of the next one. ``leaves`` has the levels and tokens."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    millionths = round(share * 1_000_000)
    root = F.expr(f"CAST((CAST(sum(tokens) AS DECIMAL(38,0)) * {millionths}) div 1000000 AS BIGINT)")
    budgets = leaves.agg(F.least(root, F.sum("tokens") * max_epochs).alias("budget")).select(F.coalesce("budget", F.lit(0)).alias("budget"))
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[: i + 1])
        budgets = share_out(caps.groupBy(*path).agg(F.sum("cap").alias("cap")), budgets, path[:-1], level, weights)
    out = leaves.join(budgets, list(LEVELS))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    return out.withColumn("epochs", whole.cast("int")).select(*LEVELS, "tokens", "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"))


#: Hex digits of the order by which a leaf is cut into runs, once and again.
RUN = 3


def _ends(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(levels, rest, end, before, copies, picked): where the started epoch of each leaf
    ends. ``end`` is the order of the last rows that begin before the rest is used up;
    of ``copies`` rows with that order (rows of equal id and text) ``picked`` are taken,
    and ``before`` tokens lie ahead of them.

    A leaf is cut into 4096 runs of its order, whose totals give prefix sums; the run
    in which the rest ends is cut so again; and of the rows left, a sixteen-millionth
    of the leaf, equal ones are counted before they are put in order.
    """
    rows = slim.join(plan.filter("rest > 0").select(*LEVELS, "epochs", "rest"), list(LEVELS)).withColumn("order", _order(seed))
    cut = plan.filter("rest > 0").select(*LEVELS, "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("prefix"))
    leaf = Window.partitionBy(*LEVELS)
    for level in (1, 2):
        known = cut.select(*LEVELS, F.col("before").alias("base"), "prefix")
        inside = rows.join(known, list(LEVELS)).filter(F.col("order").startswith(F.col("prefix")))
        runs = inside.groupBy(*LEVELS, "rest", "base", F.substring("order", 1, RUN * level).alias("run")).agg(F.sum("tokens").alias("sum"))
        upto = F.sum("sum").over(leaf.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
        runs = runs.withColumn("before", F.col("base") + F.coalesce(upto, F.lit(0))).filter("before < rest")
        last = F.max(F.struct("run", "before"))
        cut = stash(runs.groupBy(*LEVELS, "rest").agg(last.alias("m")).select(*LEVELS, "rest", "m.before", F.col("m.run").alias("prefix")), "mix-runs")
    known = cut.select(*LEVELS, F.col("before").alias("base"), "prefix")
    inside = rows.join(known, list(LEVELS)).filter(F.col("order").startswith(F.col("prefix")))
    same = inside.groupBy(*LEVELS, "rest", "base", "order", "tokens").agg(F.count(F.lit(1)).alias("copies"))
    upto = F.sum(F.col("tokens") * F.col("copies")).over(leaf.orderBy("order", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("before", F.col("base") + F.coalesce(upto, F.lit(0))).filter("before < rest")
    last = F.max(F.struct("order", "before", "tokens", "copies"))
    found = same.groupBy(*LEVELS, "rest").agg(last.alias("m")).select(*LEVELS, "rest", F.col("m.order").alias("end"), "m.before", "m.tokens", "m.copies")
    needed = F.when(F.col("tokens") > 0, F.expr("(rest - before + tokens - 1) div tokens")).otherwise(F.col("copies"))
    return stash(found.withColumn("picked", F.least("copies", needed)).drop("tokens"), "mix-ends")


def _numbered(ties: DataFrame, keys: list[str]) -> DataFrame:
    """With ``nth``, the place of a row among those of equal keys, from 1. Rows are
    numbered within the partition that ``row``, their number in a written table, came
    from, and the partitions' counts give the rest; so no group meets in one task."""
    ties = ties.withColumn("part", F.shiftright("row", 33))
    counts = ties.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inner = Window.partitionBy(*keys, "part").orderBy("row")
    return ties.join(counts, [*keys, "part"]).withColumn("nth", F.col("ahead") + F.row_number().over(inner)).drop("part", "ahead")


def _selection(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows of the started epoch that begin before the leaf's rest is used up, with
    the tokens taken."""
    ends = _ends(slim, plan, seed)
    rows = slim.join(plan.select(*LEVELS, "epochs"), list(LEVELS)).withColumn("order", _order(seed)).join(ends, list(LEVELS))
    whole = rows.filter("order < end").withColumn("taken", F.col("tokens"))
    last = _numbered(rows.filter("order = end"), list(LEVELS)).filter("nth <= picked")
    last = last.withColumn("taken", F.least(F.col("tokens"), F.col("rest") - F.col("before") - (F.col("nth") - 1) * F.col("tokens")))
    cols = ["id", *LEVELS, "epochs", "taken"]
    return whole.select(*cols).unionByName(last.select(*cols))


def _planned(df: DataFrame, domain: Column, share: float, weights: dict, max_epochs: int, id_col: str, text_col: str):
    # the regular expression counts the words; texts are read once, for ids, counts and digests
    tokens = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    slim = df.select(F.col(id_col).alias("id"), *_leveled(df, domain, text_col, id_col), tokens.alias("tokens"), F.monotonically_increasing_id().alias("row"))
    slim = stash(slim, "mix")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    return slim, stash(leaf_budgets(leaves, share, weights, max_epochs), "mix-plan")


def mix(df: DataFrame, domain: Column, share: float, weights: dict, max_epochs: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, domain, lang, source, epoch, tokens) of every row that the mix takes, once
    per epoch; of the last row of a leaf's prefix only ``tokens`` of its words.

    ``share`` is the budget over all tokens; it may exceed 1, up to ``max_epochs``.
    A value without a weight has weight 1. Null or empty languages and sources are
    the value ''. A null text has no tokens; rows without tokens are taken where
    their place in the order lies before the budget's end. Repeated rows are rows
    of their own. An empty table gives an empty result. Other columns are not read.
    """
    slim, plan = _planned(df, domain, share, weights, max_epochs, id_col, text_col)
    part = _selection(slim, plan, seed).select("id", *LEVELS, F.col("epochs").alias("epoch"), F.col("taken").alias("tokens"))
    whole = slim.join(plan.filter("epochs > 0").select(*LEVELS, "epochs"), list(LEVELS))
    whole = whole.select("id", *LEVELS, F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), "tokens")
    return whole.unionByName(part).withColumnRenamed("id", id_col)


def mix_rows(df: DataFrame, domain: Column, share: float, weights: dict, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows of ``df`` that one epoch of the mix takes, all columns.

    Per leaf the prefix ends at one place of the order; a row is kept if its own
    place is not behind. So the texts meet only a row per leaf and aren't sorted.
    Where the prefix ends among rows of equal id and text, as many of them are kept
    as it takes; which ones is open, since nothing the mix reads tells them apart.
    """
    slim, plan = _planned(df, domain, share, weights, 1, id_col, text_col)
    ends = _ends(slim, plan, seed).select(*LEVELS, "end", "copies", "picked")
    cuts = plan.join(ends, list(LEVELS), "left").filter("epochs > 0 OR end IS NOT NULL")
    # written, so that its size is known when the join is planned and the texts aren't dealt out by leaf
    cuts = stash(cuts.select(*LEVELS, "epochs", "end", "copies", "picked").coalesce(1), "mix-cuts")
    # the row travels as one struct, so no column name of its own can clash
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("content"), *_leveled(df, domain, text_col, id_col))
    met = keyed.join(cuts, list(LEVELS)).withColumn("order", _order(seed))
    split = "epochs = 0 AND order = end AND picked < copies"
    kept = met.filter(f"(epochs > 0 OR order <= end) AND NOT coalesce({split}, false)").select("content.*")
    if cuts.filter("epochs = 0 AND picked < copies").isEmpty():
        return kept
    ties = stash(met.filter(split).select("content", *LEVELS, "picked", F.monotonically_increasing_id().alias("row")), "mix-ties")
    return kept.unionAll(_numbered(ties, list(LEVELS)).filter("nth <= picked").select("content.*"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, source_domain("source"), 0.8, WEIGHTS, max_epochs=2)


def _sql_weight(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + " ELSE 1 END"


def _sql_level(i: int) -> str:
    path, parent, level = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i]), LEVELS[i]
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
n{i} AS (SELECT {path}, sum(tokens * 2)::HUGEINT AS cap, ({_sql_weight(level)})::HUGEINT AS w FROM leaves GROUP BY ALL),
o{i} AS (SELECT n{i}.*, budget,
  coalesce(sum(cap) OVER ({by} ORDER BY cap::BIGINT::DOUBLE / w::BIGINT::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER ({by} ORDER BY cap::BIGINT::DOUBLE / w::BIGINT::DOUBLE, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM n{i} {f"JOIN b{i} USING ({parent})" if parent else "CROSS JOIN b0"}),
f{i} AS (SELECT *, cap * open <= (budget - capped) * w AS full_ FROM o{i}),
l{i} AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({by}) AS left_, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({by}) AS rest_ FROM f{i}),
p{i} AS (SELECT *, CASE WHEN full_ THEN cap ELSE (left_ * w) // rest_ END AS part FROM l{i}),
s{i} AS (SELECT *, budget - sum(part) OVER ({by}) AS spare, row_number() OVER ({by} ORDER BY full_, {level}) AS nth FROM p{i}),
b{i + 1} AS (SELECT {path}, part + CASE WHEN NOT full_ AND nth <= spare THEN 1 ELSE 0 END AS budget FROM s{i})"""


SQL = f"""
WITH slim AS (SELECT doc_id, 'd' || (CAST('0x' || substr(md5(coalesce(source, '')), 1, 1) AS INTEGER) % 4) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS digest,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM slim GROUP BY ALL),
b0 AS (SELECT coalesce(least(sum(tokens) * 800000 // 1000000, sum(tokens) * 2), 0)::HUGEINT AS budget FROM leaves),
{",".join(_sql_level(i) for i in range(3))},
plan AS (SELECT l.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget FROM leaves l JOIN b3 USING (domain, lang, source)),
rows_ AS (SELECT s.*, epochs::INTEGER AS epochs, budget - epochs * p.tokens AS rest,
  md5('{SEED}:' || epochs::INTEGER || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest) AS ord
  FROM slim s JOIN plan p USING (domain, lang, source)),
upto AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM rows_)
SELECT doc_id, domain, lang, source, epochs AS epoch, least(tokens, rest - upto + tokens)::BIGINT AS tokens FROM upto WHERE upto - tokens < rest
UNION ALL
SELECT doc_id, domain, lang, source, unnest(range(epochs))::INTEGER AS epoch, tokens FROM rows_ WHERE epochs > 0
"""
