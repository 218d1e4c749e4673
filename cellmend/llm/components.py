"""Groups of records linked directly or through others, by hash-to-min.

Every vertex v holds a cluster: itself and its neighbours. In a round it sends the cluster to the
cluster's smallest member and that member to all others; the clusters of the next round are unions of
what arrives. What v and m tell each other is one link between them, so the clusters of all vertices are
kept as links (a, b) with a < b, each once and none from a vertex to itself. A vertex is in its own cluster
as long as it is the smaller end of a link: only then has it itself to tell.

Only what may still change is sent again. A vertex that is linked to one smaller vertex alone holds the
smallest that it can learn by itself: it is settled, its link is put aside, and it takes the group of that
vertex in the end. The vertex it is put aside to is never settled in the same round, so the links put
aside are resolved from the last round to the first, each round's once. All is done once no link is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmend.session import BROADCAST_ROWS, Stages, broadcast_if_small

#: vertices with more than this share of all ends of links, a thousand at most, are joined by broadcast
HOT_SHARE = 0.001
HOT_LEAST = 10_000
#: rounds whose settled vertices are resolved in one go, where they are few
TOGETHER = 4


def _told(links: DataFrame, end: str, smallest: DataFrame, space: list[str], n: int, known: int) -> DataFrame:
    """links with m_<end>, deg_<end>: what `smallest` (one row per vertex, `known` in all) says of one end."""
    told, key = smallest.select(*space, "v", "m", "deg"), [*space, "v"]
    links = links.withColumnRenamed(end, "v")
    if known <= BROADCAST_ROWS:
        found = links.join(F.broadcast(told), key)
    else:
        # links of hot vertices stay where they are
        hot = told.where(F.col("deg") > max(HOT_LEAST, int(n * HOT_SHARE)))
        found = links.join(F.broadcast(hot), key).unionByName(links.join(F.broadcast(hot.select(*key)), key, "left_anti").join(told, key))
    return found.withColumnsRenamed({"v": end, "m": f"m_{end}", "deg": f"deg_{end}"})


def hash_to_min(spark: SparkSession, edges: DataFrame, left: str, right: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., vertex, component): every vertex of an edge between two vertices, and its smallest connected vertex.

    within: columns that split the graph into separate ones. Edges with a null in any of the columns
    and loops link nothing; repeated edges do no harm; an empty table gives an empty result. The vertex
    type must be ordered, and its order decides which vertex is smallest.
    """
    stages, space = Stages(spark, "components"), list(within)
    linked = edges.where(F.col(left) != F.col(right))
    linked = linked.dropna(subset=space) if space else linked
    links, path = stages.write(linked.select(*space, F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct())
    rounds = []
    while True:
        both = links.select(*space, F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))))
        smallest = stages.keep(both.groupBy(*space, "v").agg(F.least("v", F.min("u")).alias("m"), F.count("*").alias("deg"), (F.max("u") > F.col("v")).alias("holds")))
        known, n = smallest.agg(F.count("*"), F.coalesce(F.sum("deg"), F.lit(0))).first()
        if not known:
            break
        settled = (F.col("deg") == 1) & (F.col("m") < F.col("v"))
        rounds.append((known, smallest.where(settled).select(*space, F.col("v").alias("vertex"), F.col("m").alias("component"))))
        # only the larger end of a link can be settled
        active = _told(links, "b", smallest, space, n, known).where((F.col("deg_b") > 1) | (F.col("m_b") >= F.col("b"))).drop("deg_b")
        sent = [F.struct(F.col("m_a").alias("a"), F.col("b")), F.struct(F.col("m_b").alias("a"), F.col("a").alias("b"))]
        spread = _told(active, "a", smallest, space, n, known).select(*space, F.inline(F.array(*sent)))
        own = smallest.where("holds").select(*space, F.col("m").alias("a"), F.col("v").alias("b"))
        new, new_path = stages.write(spread.unionByName(own).where("a < b").distinct())
        stages.drop(path)
        links, path = new, new_path
    stages.drop(path)
    if not rounds:
        return linked.select(*space, F.col(left).alias("vertex"), F.col(right).alias("component")).limit(0)
    top = lambda df: df.select(*space, F.col("vertex").alias("component"), F.col("component").alias("_top"))
    done: list[DataFrame] = []
    rest = rounds[::-1]
    while rest:
        # as many rounds at once as have few vertices together, one at least
        take = 1
        while take < min(TOGETHER, len(rest)) and sum(n for n, _ in rest[: take + 1]) <= BROADCAST_ROWS:
            take += 1
        # settled vertices are many where one vertex has many: what later rounds say of it is counted, and broadcast if little
        later = broadcast_if_small(reduce(DataFrame.unionByName, done)) if done else None
        here: list[DataFrame] = []
        for _, aside in rest[:take]:
            said = [*here, *([later] if later is not None else [])]
            for known in said:
                aside = aside.join(top(F.broadcast(known) if known is not later else known), [*space, "component"], "left").select(*space, "vertex", F.coalesce("_top", "component").alias("component"))
            here.append(aside)
        done.append(stages.keep(reduce(DataFrame.unionByName, here)))
        rest = rest[take:]
    groups = reduce(DataFrame.unionByName, done)
    return groups.unionByName(groups.select(*space, F.col("component").alias("vertex"), "component").distinct())


#: two row positions that a bracket, blank or other separator doesn't part; decimals only where they are zero
PAIR = r"""(?<![\w.\-])['"]?(\d+)(?:\.0*)?['"]?\s*[,:\-]\s*['"]?(\d+)(?:\.0*)?['"]?(?![\w.])"""
#: a number of such a pair, without its decimals
NUMBER = r"(?<![\d.])(\d+)"


def row_links(error_log: DataFrame, fd_components: DataFrame) -> DataFrame:
    """(dataset, a, b): links between row positions.

    From each pair that tuple_pairs holds in any of its notations, and from each component, whose rows
    (of row_indices and cell_ids together) are all linked to the smallest of them. Texts without a whole
    pair, null lists and null data sets link nothing.
    """
    number = lambda text: text.try_cast("int")
    # a pair is cut out once, and its two numbers out of it
    found = F.transform(F.regexp_extract_all("tuple_pairs", F.lit(PAIR), F.lit(0)), lambda p: F.regexp_extract_all(p, F.lit(NUMBER), F.lit(1)))
    pairs = error_log.where(F.col("tuple_pairs").rlike(r"\d")).select("dataset", F.explode(found).alias("p")).select("dataset", number(F.col("p")[0]).alias("a"), number(F.col("p")[1]).alias("b"))
    of_cells = F.transform(F.coalesce("cell_ids", F.array().cast("array<string>")), lambda c: number(F.regexp_extract(c, r":(\d+):\d+\s*$", 1)))
    rows = F.array_distinct(F.filter(F.concat(F.coalesce("row_indices", F.array().cast("array<int>")), of_cells), lambda x: x.isNotNull()))
    stars = fd_components.select("dataset", rows.alias("rows")).where(F.size("rows") > 1).select("dataset", F.array_min("rows").alias("a"), F.explode("rows").alias("b"))
    return pairs.unionByName(stars)


def conflict_groups(spark: SparkSession, error_log: DataFrame, fd_components: DataFrame) -> DataFrame:
    """(dataset, row_idx, group_row) of every row in conflict with another."""
    found = hash_to_min(spark, row_links(error_log, fd_components), "a", "b", within=("dataset",))
    return found.select("dataset", F.col("vertex").alias("row_idx"), F.col("component").alias("group_row"))
