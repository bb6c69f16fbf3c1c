"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights are summed up to cells (a value of each dimension), which combines before the shuffle. Cells get
probabilities whose expected tokens meet each dimension's target shares: the margins are scaled to their goals in turn,
again and again, with no probability above one, until all of them hold. The sample has SHARE of all tokens; a value that
has fewer than its target of that is kept whole, its dimension's other values share out what it lacks, and margins() names
it. A document's probability is its cell's, and a hash of its id and text decides, so a sample is repeatable row by row.

The number of cells is bounded by the targets: values that a target does not name fall into one rest category, so there
are at most product(len(target) + 1) cells however many documents and sources there are. That proven bound (checked
against MOST_CELLS before anything runs) allows the raking to run as one expression over one row, and its result to
be broadcast.

The topic of a text is that of TOPICS centroids which its vocabulary is nearest to: each distinct word has a weight from 0
to 15 for each centroid, the hexadecimal digits of its MD5, and the topic is the centroid with the greatest sum.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

MOST_CELLS = 50_000
#: Rounds of raking, after which no margin should miss its goal by more than TOLERANCE of all tokens.
ROUNDS = 400
TOLERANCE = 1e-4
#: Tokens of the sample as a share of all.
SHARE = 0.25
TOPICS = 4
SEED = "mixture-1"
REST = "*"

#: Production targets: shares of tokens.
TARGETS = {
    "source": {"src0": 4.0} | {f"src{i}": 1.0 for i in range(1, 20)},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13},
    "topic": {"t0": 0.4, "t1": 0.3, "t2": 0.2, "t3": 0.1},
}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """t0, t1, ...: the centroid nearest to the words of the whole text, the first of equals; null without words."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    digits = F.transform(words, lambda w: F.conv(F.substring(F.md5(F.encode(w, "UTF-8")), 1, TOPICS), 16, 10).cast("int"))

    def weight(h: Column, bit: int) -> Column:
        return F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + F.shiftright(x, bit).bitwiseAND(F.lit(15)))

    def nearest(h: Column) -> Column:
        sums = F.array(*[weight(h, 4 * (TOPICS - 1 - k)) for k in range(TOPICS)])
        # transform over an array of one element binds a value that is used more than once
        return F.get(F.transform(F.array(sums), lambda s: F.concat(F.lit("t"), (F.array_position(s, F.array_max(s)) - 1).cast("string"))), F.lit(0))

    return F.get(F.transform(F.array(digits), lambda h: F.when(F.size(h) > 0, nearest(h))), F.lit(0))


def _category(name: str, target: dict[str, float]) -> Column:
    named = [F.lit(x) for x in sorted(target)]
    return F.coalesce(F.array_position(F.array(*named), F.col(name)).cast("int") - 1, F.lit(-1))


def rake(cells: DataFrame, dims: dict[str, dict[str, float]], share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """cells (_0, _1, ... category numbers, weight) -> the same with probability, and error: the largest miss of a goal.

    A dimension's goals are its targets' shares of the sample, among the values that occur and up to what they have; the
    rest category keeps the share that it has. The error is in shares of all tokens.
    """
    k = len(dims)
    one = cells.agg(F.array_sort(F.collect_list(F.struct(*[f"_{d}" for d in range(k)], "weight"))).alias("c"))
    one = one.select("c", F.expr("aggregate(c, 0D, (s, x) -> s + x.weight)").alias("total"))
    one = one.withColumn("p", F.expr(f"transform(c, x -> {float(share)!r}D)"))
    # places of the cells of each category of dimension d, 0 .. m - 1 and the rest, and what they have at probabilities p
    places = lambda d, m: f"transform(sequence(0, {m}), v -> filter(sequence(0, size(c) - 1), i -> c[i]._{d} = IF(v = {m}, -1, v)))"
    margins = lambda p, d: f"transform(at{d}, l -> aggregate(l, 0D, (s, i) -> s + {p}[i] * c[i].weight))"
    one = one.where("size(c) > 0")
    for d, (name, target) in enumerate(dims.items()):
        shares = ", ".join(f"{float(target[x])!r}D" for x in sorted(target))
        m = len(target)
        one = one.withColumn(f"at{d}", F.expr(places(d, m)))
        one = one.withColumn(f"seen{d}", F.expr(f"transform(at{d}, l -> aggregate(l, 0D, (s, i) -> s + c[i].weight))"))
        one = one.withColumn(f"t{d}", F.expr(f"zip_with(array({shares}), slice(seen{d}, 1, {m}), (t, s) -> IF(s > 0, t, 0D))"))
        one = one.withColumn(f"size{d}", F.expr(f"{float(share)!r}D * (total - seen{d}[{m}])"))
        # The goals are least(what there is, target * level): the level at which they add up to the sample.
        scarce = f"(seen{d}[v] * t{d}[u] < seen{d}[u] * t{d}[v])"
        kept = f"aggregate(sequence(0, {m - 1}), 0D, (s, v) -> s + IF(t{d}[v] > 0 AND {scarce}, seen{d}[v], 0D))"
        others = f"aggregate(sequence(0, {m - 1}), 0D, (s, v) -> s + IF(t{d}[v] > 0 AND NOT {scarce}, t{d}[v], 0D))"
        one = one.withColumn(f"level{d}", F.expr(f"coalesce(array_max(transform(sequence(0, {m - 1}), u -> IF(t{d}[u] > 0, (size{d} - {kept}) / {others}, NULL))), 0D)"))
        one = one.withColumn(f"goal{d}", F.expr(f"concat(zip_with(t{d}, slice(seen{d}, 1, {m}), (t, s) -> least(s, t * level{d})), array({float(share)!r}D * seen{d}[{m}]))"))
    step = "p"
    for d, target in enumerate(dims.values()):
        m = len(target)
        place = f"IF(x._{d} < 0, {m}, x._{d})"
        scaled = f"zip_with(p{d}, c, (a, x) -> least(1D, a * coalesce(try_divide(goal{d}[{place}], g{d}[{place}]), 0D)))"
        step = f"transform(array({step}), p{d} -> transform(array({margins(f'p{d}', d)}), g{d} -> {scaled})[0])[0]"
    step = step.replace("array(p)", "array(w)", 1)
    one = one.withColumn("raked", F.expr(f"aggregate(sequence(1, {rounds}), p, (w, i) -> {step})"))
    misses = [f"array_max(zip_with({margins('raked', d)}, goal{d}, (g, a) -> abs(g - a)))" for d in range(k)]
    error = F.expr(f"coalesce(try_divide(greatest({', '.join(misses)}, 0D), total), 0D)")
    out = one.select(F.explode(F.expr("zip_with(c, raked, (x, r) -> named_struct('cell', x, 'p', r))")).alias("z"), error.alias("error"))
    return out.select(*[F.col(f"z.cell._{d}") for d in range(k)], F.col("z.cell.weight").alias("weight"), F.when(F.col("z.cell.weight") > 0, F.col("z.p")).otherwise(0.0).alias("probability"), "error")


def _numbered(rows: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    return rows.select("*", *[_category(name, t).alias(f"_{d}") for d, (name, t) in enumerate(targets.items())])


def fitted(rows: DataFrame, targets: dict[str, dict[str, float]], weight_col: str, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """The raked cells of rows (a written table). rows need the targets' columns as strings.

    Targets can contradict each other, above all where few rows are to fill many cells; a warning says by how much
    margins miss, and margins() which. A smaller share leaves more room.
    """
    bound = math.prod(len(t) + 1 for t in targets.values())
    if bound > MOST_CELLS:
        raise ValueError(f"the targets allow {bound} cells; the bound is {MOST_CELLS}")
    keys = [f"_{d}" for d in range(len(targets))]
    cells = written(_numbered(rows, targets).groupBy(*keys).agg(F.sum(F.col(weight_col)).cast("double").alias("weight")), "mixture-cells")
    raked = written(rake(cells, targets, share, rounds), "mixture-raked")
    # one number
    error = raked.agg(F.max("error")).first()[0] or 0.0
    if error > TOLERANCE:
        warnings.warn(f"margins miss their goals by up to {error:.6f} of all tokens after {rounds} rounds")
    return raked


def margins(raked: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """dimension, value (REST for all that has no target), target (share), available and expected (tokens), share, whole.

    share is the value's part of the expected sample; whole tells that all of it is kept, so that its target is out of reach.
    """
    out = None
    for d, (name, target) in enumerate(targets.items()):
        values = F.array(*[F.lit(x) for x in sorted(target)])
        shares = F.array(*[F.lit(float(target[x]) / sum(target.values())) for x in sorted(target)])
        sums = raked.groupBy(f"_{d}").agg(F.sum("weight").alias("available"), F.sum(F.col("weight") * F.col("probability")).alias("expected"))
        total = raked.agg(F.sum(F.col("weight") * F.col("probability")).alias("all"))
        # one row
        rows = sums.join(F.broadcast(total)).select(F.lit(name).alias("dimension"), F.coalesce(F.get(values, F.col(f"_{d}")), F.lit(REST)).alias("value"), F.get(shares, F.col(f"_{d}")).alias("target"), "available", "expected", F.try_divide("expected", "all").alias("share"), (F.col("expected") >= F.col("available") * (1 - 1e-6)).alias("whole"))
        out = rows if out is None else out.unionByName(rows)
    return out


def calibrated(rows: DataFrame, raked: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """rows with _probability."""
    keys = [f"_{d}" for d in range(len(targets))]
    # At most MOST_CELLS rows.
    return _numbered(rows, targets).join(F.broadcast(raked.select(*keys, F.col("probability").alias("_probability"))), keys, "left").drop(*keys)


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the columns."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _draw(seed: str, id_: Column, text: Column) -> Column:
    return uniform(seed, id_, F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, sampled: one row per document.

    Tokens are words. factor is the probability over share. Null source, lang or topic (no words) count as the rest
    category, as do values that the targets do not name; texts without words have no weight, and probability that of
    their cell (0 if the cell has no weight). Very long texts are read whole. Rows that repeat in id and text share their
    fate; a null id is an empty one, so such rows are drawn by their texts. Other columns are not read. An empty table
    gives no rows.
    """
    targets = TARGETS if targets is None else targets
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic(text).alias("topic"), n_words(text).alias("n_tokens"), _draw(seed, F.col(id_col).cast("long"), text).alias("_draw"))
    # Read twice from here on; texts are read once.
    rows = written(rows, "mixture-rows")
    p = F.coalesce("_probability", F.lit(0.0))
    found = calibrated(rows, fitted(rows, targets, "n_tokens", share), targets)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round(p / share, 6).alias("factor"), F.round(p, 6).alias("probability"), (F.col("_draw") < p).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of docs that the mixture keeps, columns as they were; the decision is that of mix(), row by row."""
    targets = TARGETS if targets is None else targets
    names = docs.columns
    text = F.col(f"_whole_row.`{text_col}`").cast("string")
    own = F.col(f"_whole_row.`{id_col}`").cast("long")
    rows = docs.select(F.struct("*").alias("_whole_row")).select("_whole_row", F.col("_whole_row.source").cast("string").alias("source"), F.col("_whole_row.lang").cast("string").alias("lang"), topic(text).alias("topic"))
    raked = fitted(rows.withColumn("n_tokens", n_words(text)), targets, "n_tokens", share)
    kept = calibrated(rows, raked, targets).where(_draw(seed, own, text) < F.coalesce("_probability", F.lit(0.0)))
    return kept.select(*[F.col(f"_whole_row.`{c}`").alias(c) for c in names])


def sql(targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, seed: str = SEED, documents: str = "documents", share: float = SHARE) -> str:
    """The rows of mix() in DuckDB SQL: raking as a recursion over the cells."""
    targets = TARGETS if targets is None else targets
    values = lambda t: ", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in sorted(t.items()))
    names = list(targets)
    tables = ", ".join(f"t_{n}(k, v) AS (VALUES {values(targets[n])})" for n in names)
    cat = ", ".join(f"CASE WHEN {n} IN (SELECT k FROM t_{n}) THEN {n} ELSE '{REST}' END AS c_{n}" for n in names)
    cells = ", ".join(f"c_{n}" for n in names)
    seen = ", ".join(f"s_{n} AS (SELECT c_{n} AS c, sum(w) AS w FROM cells GROUP BY 1)" for n in names)
    goals = ", ".join(
        f"a_{n} AS (SELECT s.c, s.w, t.v FROM s_{n} s JOIN t_{n} t ON t.k = s.c WHERE s.w > 0), "
        f"l_{n} AS (SELECT max(({share}::DOUBLE * (SELECT sum(w) FROM s_{n} WHERE c <> '{REST}') - coalesce((SELECT sum(y.w) FROM a_{n} y WHERE y.w * x.v < x.w * y.v), 0)) / (SELECT sum(y.v) FROM a_{n} y WHERE NOT y.w * x.v < x.w * y.v)) AS level FROM a_{n} x), "
        f"g_{n} AS (SELECT s.c, CASE WHEN s.c = '{REST}' THEN {share}::DOUBLE * s.w ELSE least(s.w, t.v * (SELECT level FROM l_{n})) END AS goal FROM s_{n} s LEFT JOIN t_{n} t ON t.k = s.c)"
        for n in names
    )
    inner = "r"
    for i, n in enumerate(names):
        count = "i + 1 AS i" if i == 0 else "i"
        where = f" WHERE i < {rounds}" if i == 0 else ""
        inner = f"(SELECT {count}, {', '.join('x.c_' + m for m in names)}, w0, least(1.0::DOUBLE, p * coalesce(goal / nullif(sum(p * w0) OVER (PARTITION BY x.c_{n}), 0), 0)) AS p FROM {inner} x JOIN g_{n} ON g_{n}.c = x.c_{n}{where})"
    digit = "list_sum(list_transform(v, lambda x: ('0x' || substr(x, {k}, 1))::BIGINT))"
    sums = ", ".join(digit.format(k=k + 1) for k in range(TOPICS))
    return f"""
WITH RECURSIVE {tables}, d0 AS (
  SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
    list_transform(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')), lambda x: md5(x)) AS v,
    ('0x' || substr(md5(concat('{seed}:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw FROM {documents}
), d1 AS (SELECT doc_id, source, lang, n_tokens, draw, CASE WHEN len(v) > 0 THEN [{sums}] END AS sums FROM d0),
d2 AS (SELECT *, CASE WHEN sums IS NOT NULL THEN 't' || (list_position(sums, list_max(sums)) - 1) END AS topic FROM d1),
d AS (SELECT *, {cat} FROM d2),
cells AS (SELECT {cells}, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY {cells}), {seen}, {goals},
r AS (
  SELECT 0 AS i, {cells}, w AS w0, {share}::DOUBLE AS p FROM cells
  UNION ALL
  SELECT i, {cells}, w0, p FROM {inner} y
), p AS (SELECT {cells}, CASE WHEN w0 > 0 THEN p ELSE 0 END AS p FROM r WHERE i = {rounds})
SELECT doc_id, source, lang, topic, n_tokens, round(p / {share}::DOUBLE, 6) AS factor, round(p, 6) AS probability, draw < p AS sampled
FROM d JOIN p USING ({cells})
"""
