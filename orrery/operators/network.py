"""Co-occurrence graphs as edge tables (a < b, n), and measures on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import small, store


def co_occurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, n): how many keys hold both items.

    A key of m distinct items has m (m - 1) / 2 pairs, which are counted where
    they are made; a key of very many can be split over tasks.
    """
    s = df.select(F.col(key).alias("k"), F.col(item).alias("i")).where("k is not null and i is not null").distinct()
    a, b = (s.select(F.col("k").alias(f"k_{x}"), F.col("i").alias(x)) for x in "ab")
    return a.join(b, (F.col("k_a") == F.col("k_b")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def term_pairs(df: DataFrame, key: str, toks: Column, support: float, most: float = 1.0) -> DataFrame:
    """(a, b, n, jaccard): pairs of terms in at least the share ``support`` of all rows together; terms in over ``most`` of them are left out.

    A term of a pair has that support itself, so the others go before any pair
    is made. There are 1 / support such terms at most for each term of a row on
    average, whatever the rows.
    """
    total = df.agg(F.count("*").alias("docs"))  # one row
    d = df.select(key, F.explode(F.array_distinct(toks)).alias("term"))
    v = d.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).where((F.col("df") >= support * F.col("docs")) & (F.col("df") <= most * F.col("docs")))
    v = store(v, "terms")
    lookup = small(v.select("term"), 64)
    e = co_occurrence(d.join(lookup, "term"), key, "term").join(F.broadcast(total)).where(F.col("n") >= support * F.col("docs"))
    a, b = (small(v.select(F.col("term").alias(x), F.col("df").alias(f"df_{x}")), 64) for x in "ab")
    return e.join(a, "a").join(b, "b").select("a", "b", "n", F.round(F.col("n") / (F.col("df_a") + F.col("df_b") - F.col("n")), 6).alias("jaccard"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, weighted): number of neighbours, and of shared keys."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("n").alias("weighted"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient): the share of a node's pairs of neighbours that are linked; 0 under two neighbours.

    Each triangle is found once, from its least node, by two joins.
    """
    ab, bc, ac = (edges.select(F.col("a").alias(x), F.col("b").alias(y)) for x, y in ("ab", "bc", "ac"))
    corners = ab.join(bc, "b").join(ac, ["a", "c"]).select(F.explode(F.array("a", "b", "c")).alias("node"))
    found = corners.groupBy("node").agg(F.count("*").alias("triangles"))
    d = degrees(edges).select("node", "degree").join(found, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return d.select("node", "degree", "triangles", F.when(pairs > 0, F.round(F.col("triangles") / pairs, 6)).otherwise(0.0).alias("coefficient"))


def strong(edges: DataFrame, times: float) -> DataFrame:
    """Edges of at least ``times`` the mean count."""
    return edges.join(F.broadcast(edges.agg(F.avg("n").alias("mean"))), F.col("n") >= F.col("mean") * times).drop("mean")  # one row


def communities(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node that can be reached; labels halve their distance each round."""
    links = store(both_ways(edges).select("a", "b"), "links")
    labels = store(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        heard = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(heard, F.col("node") == F.col("a"), "left").select("node", F.least("component", "m").alias("component"))
        up = new.select(F.col("node").alias("k"), F.col("component").alias("c"))
        new = store(new.join(up, F.col("component") == F.col("k")).select("node", F.least("component", "c").alias("component")), "labels")
        if new.join(labels, ["node", "component"], "left_anti").isEmpty():
            return new
        labels = new


def betweenness(edges: DataFrame, pivots: int | None = None) -> DataFrame:
    """(node, betweenness): share of shortest paths through a node, summed over pairs.

    Breadth-first levels from all sources at once, then dependencies back from
    the last level. Without ``pivots`` every node is a source and the result is
    exact, but rows grow with the square of the nodes. With them so many nodes,
    those of the smallest hashes, are sources and sums are scaled by nodes over
    pivots: rows grow with pivots times nodes. A node's value is then off by
    more than e n (n - 2) / 2 with a probability of at most 2 exp(-2 e^2 pivots)
    (Hoeffding's bound), n being the number of nodes.
    """
    links = store(both_ways(edges).select("a", "b"), "links")
    nodes = store(links.select(F.col("a").alias("s")).distinct(), "nodes")
    n = nodes.count()
    scale = 1.0
    if pivots is not None and pivots < n:
        nodes, scale = store(nodes.orderBy(F.xxhash64("s"), "s").limit(pivots), "pivots"), n / pivots
    seen = nodes.select("s", F.col("s").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    level, depth = seen, 0
    while True:
        depth += 1
        nxt = level.join(links, F.col("v") == F.col("a")).groupBy("s", "b").agg(F.sum("paths").alias("paths"))
        nxt = nxt.join(seen.select("s", F.col("v").alias("b")), ["s", "b"], "left_anti").select("s", F.col("b").alias("v"), F.lit(depth).alias("d"), "paths")
        level = store(nxt, "level")
        if level.isEmpty():
            break
        seen = store(seen.union(level), "seen")
    credit = seen.select("s", "v", "d", "paths", F.lit(0.0).alias("dep"))
    for d in range(depth - 1, 0, -1):
        below = credit.where(F.col("d") == d).select(F.col("s").alias("s1"), F.col("v").alias("w"), F.col("paths").alias("wp"), F.col("dep").alias("wd"))
        above = credit.where(F.col("d") == d - 1).join(links, F.col("v") == F.col("a")).join(below, (F.col("s") == F.col("s1")) & (F.col("b") == F.col("w")))
        add = above.groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("wp") * (1 + F.col("wd"))).alias("add"))
        credit = store(credit.join(add, ["s", "v"], "left").select("s", "v", "d", "paths", (F.col("dep") + F.coalesce("add", F.lit(0.0))).alias("dep")), "credit")
    got = credit.groupBy(F.col("v").alias("node")).agg(F.sum(F.when(F.col("s") != F.col("v"), F.col("dep")).otherwise(0.0)).alias("sum"))
    every = links.select(F.col("a").alias("node")).distinct().join(got, "node", "left")
    return every.select("node", F.round(F.coalesce("sum", F.lit(0.0)) * scale / 2, 6).alias("betweenness"))


def constraint(edges: DataFrame) -> DataFrame:
    """(node, constraint): how far a node's ties lead back to one another; a low value is a broker between groups.

    With p the share of a tie in all of a node's, the sum over its neighbours j
    of (p_ij + the sum over their common neighbours q of p_iq p_qj) squared.
    Common neighbours come from triangles. A triangle is found once, from its
    end of fewest ties by two joins, so that a hub's ties are not paired with
    one another.
    """
    degree = store(degrees(edges), "degrees")
    d = lambda x: degree.select(F.col("node").alias(x), F.struct("degree", "node").alias(f"r{x}"), F.col("weighted").alias(f"w{x}"))
    ties = store(edges.join(d("a"), "a").join(d("b"), "b"), "ties")
    share = ties.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("n") / F.col("wa")).alias("p")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), (F.col("n") / F.col("wb")).alias("p")))).alias("e")).select("e.*")
    up = F.col("ra") < F.col("rb")
    low, high = (F.when(up, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    oriented = store(ties.select(low.alias("u"), high.alias("v"), F.when(up, F.col("rb")).otherwise(F.col("ra")).alias("rv")), "oriented")
    first, second = oriented.select("u", "v", "rv"), oriented.select(F.col("u").alias("u2"), F.col("v").alias("w"), F.col("rv").alias("rw"))
    wedges = first.join(second, (F.col("u") == F.col("u2")) & (F.col("rv") < F.col("rw"))).select("u", "v", "w")
    closed = wedges.join(oriented.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    # Each corner in turn is the common neighbour of the other two, both ways round.
    ways = [F.struct(F.col(i).alias("i"), F.col(q).alias("q"), F.col(j).alias("j")) for i, q, j in ("uvw", "uwv", "vuw", "vwu", "wuv", "wvu")]
    paths = closed.select(F.explode(F.array(*ways)).alias("t")).select("t.*")
    share = store(share, "shares")
    one, two = share.select("i", F.col("j").alias("q"), F.col("p").alias("p1")), share.select(F.col("i").alias("q"), "j", F.col("p").alias("p2"))
    through = paths.join(one, ["i", "q"]).join(two, ["q", "j"]).groupBy("i", "j").agg(F.sum(F.col("p1") * F.col("p2")).alias("through"))
    every = share.join(through, ["i", "j"], "left").withColumn("x", F.col("p") + F.coalesce("through", F.lit(0.0)))
    return every.groupBy(F.col("i").alias("node")).agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("constraint"))


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Of (a, b, n), every tie both ways, and (node, community): the share of ties within communities over that expected by degrees."""
    own = links.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    per = own.groupBy(F.col("ca").alias("c")).agg(F.sum("n").cast("double").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)).cast("double").alias("inside"))
    r = per.agg(F.sum("all").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("all") * F.col("all")).alias("s")).first()  # one row
    return r["i"] / r["m"] - r["s"] / r["m"] ** 2 if r["m"] else 0.0


def _moved(links: DataFrame, rounds: int, patience: int = 3) -> tuple[DataFrame, float]:
    """((node, community), modularity) after local moves: in each round half of the nodes, by hash, go where that gains most."""
    tot = store(links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("k")), "nodes")
    m = tot.agg(F.sum("k")).first()[0]
    labels = store(tot.select("node", F.col("node").alias("community")), "labels")
    best, score, idle = labels, modularity(links, labels), 0
    for r in range(rounds):
        sizes = store(labels.join(tot, "node").groupBy("community").agg(F.sum("k").alias("all")), "sizes")
        turn = labels.where(F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2).join(tot, "node")
        heard = links.where("a <> b").join(labels.select(F.col("node").alias("b"), F.col("community").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("n").alias("toward"))
        ways = turn.join(heard, "node")
        # Staying is a way too, where no neighbour is in the node's own community.
        stay = turn.select("node", "community", "k", F.col("community").alias("to"), F.lit(0).cast(heard.schema["toward"].dataType).alias("toward"))
        ways = ways.select("node", "community", "k", "to", "toward").union(stay).groupBy("node", "community", "k", "to").agg(F.max("toward").alias("toward"))
        ways = ways.join(sizes.withColumnRenamed("community", "to"), "to")
        rest = F.col("all") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0)
        gain = F.round(F.col("toward") - F.col("k") * rest / m, 9)
        # Of equal gains staying counts first, then the smallest community.
        pick = F.max_by("to", F.struct(gain, F.col("to") == F.col("community"), -F.col("to")))
        chosen = store(ways.groupBy("node").agg(pick.alias("to")), "chosen")
        new = store(labels.join(chosen, "node", "left").select("node", F.coalesce("to", "community").alias("community")), "labels")
        now = modularity(links, new)
        idle = 0 if now > score + 1e-9 else idle + 1
        if now > score + 1e-9:
            best, score = new, now
        labels = new
        if idle >= patience:
            break
    return best, score


def modular_communities(edges: DataFrame, rounds: int = 20, levels: int = 8) -> DataFrame:
    """(node, community): groups with more ties inside than their degrees would have by chance, named by their smallest node.

    ``edges`` (a, b, n) of numbered nodes. Nodes move to the neighbouring
    community that raises modularity most, half of them at a time, so that
    neighbours seldom swap places; of all rounds the best one is kept. Then a
    community becomes a node and its ties a tie to itself, and all begins
    anew, as long as modularity rises. Rounds are joins and grouped sums; the
    driver sees one number a round. The same edges give the same communities.
    """
    links = store(both_ways(edges), "links")
    found, score = None, float("-inf")
    for _ in range(levels):
        labels, now = _moved(links, rounds)
        if found is not None and now <= score + 1e-9:
            break
        score = now
        found = labels if found is None else store(found.join(labels.select(F.col("node").alias("community"), F.col("community").alias("up")), "community").select("node", F.col("up").alias("community")), "labels")
        own = lambda x, y: labels.select(F.col("node").alias(x), F.col("community").alias(y))
        links = store(links.join(own("a", "ca"), "a").join(own("b", "cb"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("n").alias("n")), "links")
    names = store(found.groupBy("community").agg(F.min("node").alias("least")), "names")
    return found.join(names, "community").select("node", F.col("least").alias("community"))
