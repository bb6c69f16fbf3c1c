"""Connected components of many small or large graphs at once, without a task that holds one of them.

A round hooks every node to its least neighbour, follows two such steps, and contracts the links to what their ends were
hooked to; the least node of a component stays itself throughout, so it names the component. Rounds are written to the
shared folder, which cuts the lineage, and the driver learns only whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import removed, stored


def components(links: DataFrame, by: list[str], a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """by..., node, root for every node of a link: root is the least node of its component in the graph `by`.

    Links need not be distinct; self links and nulls are ignored; without links the result is empty.
    """
    both = links.where(F.col(a) != F.col(b)).select(*by, F.col(a).alias("u"), F.col(b).alias("v"))
    edges = stored(both.unionByName(both.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    named = None
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        hooked = edges.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, F.col("u").alias("node"), F.least("u", "m").alias("to"))
        on = hooked.select(*by, F.col("node").alias("to"), F.col("to").alias("next"))
        moved = stored(hooked.join(on, [*by, "to"]).select(*by, "node", F.col("next").alias("to")), "hooks")
        last = named
        if named is None:
            named = stored(moved.withColumnRenamed("to", "root"), "roots")
        else:
            named = stored(named.join(moved.withColumnRenamed("node", "root"), [*by, "root"], "left").select(*by, "node", F.coalesce("to", "root").alias("root")), "roots")
        left, right = (moved.select(*by, F.col("node").alias(x), F.col("to").alias(f"_{x}")) for x in "uv")
        contracted = edges.join(left, [*by, "u"]).join(right, [*by, "v"]).where("_u <> _v").select(*by, F.col("_u").alias("u"), F.col("_v").alias("v"))
        before, edges = edges, stored(contracted.distinct(), "links")
        removed(before, moved, *([last] if last is not None else []))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if named is None:
        return edges.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
    return named.select(*by, "node", "root")
