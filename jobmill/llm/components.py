"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import cut, free


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): root is the smallest node that links reach. Nodes without links are absent.

    Each round hooks every node to its smallest neighbour, follows the hooks
    once more, and replaces the links by those between what nodes hook to; the
    links left shrink until none is. A node with very many links is summed
    before the shuffle. Tables are cut after each round. Links with a null end
    link nothing; links may repeat.
    """
    e = cut(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b"), F.col("a"))).distinct())
    roots = None
    while not e.isEmpty():
        hook = e.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        h = hook.select(F.col("a").alias("to"), F.col("to").alias("further"))
        hook = cut(hook.join(h, "to", "left").select("a", F.coalesce("further", "to").alias("to")))
        last = roots
        if roots is None:
            roots = cut(hook.select(F.col("a").alias("node"), F.col("to").alias("root")))
        else:
            roots = cut(roots.join(hook.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        x, y = hook.select("a", F.col("to").alias("p")), hook.select(F.col("a").alias("b"), F.col("to").alias("q"))
        more = cut(e.join(x, "a").join(y, "b").filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
        free(last, hook, e)
        e = more
    if roots is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    free(e)
    return roots
