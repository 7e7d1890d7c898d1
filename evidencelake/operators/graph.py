"""The link graph: edges, degrees, neighbours, spreading activation, components, supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Spreading: share passed on, factor of a link followed backwards, degree from which a node is a hub, least activation,
#: most active nodes (fixed values).
DECAY, BACK, HUB, LEAST, NODES = 0.5, 0.8, 24, 0.005, 64


def page_links(pages: DataFrame) -> DataFrame:
    """(src, href, line): the links of HTML pages, with the line they stand on."""
    each = pages.select(F.col("page_id").alias("src"), F.posexplode(F.split("html", "\n")).alias("at", "row"))
    href = F.regexp_extract_all("row", F.lit('href="([^"]*)"'), F.lit(1))
    return each.select("src", (F.col("at") + 1).alias("line"), F.explode(href).alias("href"))


def page_names(pages: DataFrame) -> DataFrame:
    """(name, page_id): the names under which a page can be linked: its address, and the first word of its title."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    first = F.lower(F.regexp_extract(title, r"^[\p{L}\p{N}]+", 0))
    names = pages.select("page_id", F.explode(F.array(F.col("url"), first)).alias("name"))
    return names.filter("name <> ''").distinct()


def resolve(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with dst, candidates and reason: the whole address, else the last part of the path as a name. One page is
    an edge, several are ambiguous."""
    path = F.regexp_replace(F.regexp_replace("href", r"[?#].*$", ""), "/+$", "")
    tail = F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"[^\p{L}\p{N}]+$", ""))
    known = page_names(pages).groupBy("name").agg(F.min("page_id").alias("page"), F.count("*").alias("n"))
    both = links.withColumn("tail", tail).join(known.toDF("href", "by_url", "n_url"), "href", "left").join(known.toDF("tail", "by_tail", "n_tail"), "tail", "left")
    n = F.coalesce("n_url", "n_tail", F.lit(0))
    reason = F.when(n == 0, "missing").when(n > 1, "ambiguous").otherwise("resolved")
    return both.select("src", "href", "line", F.when(n == 1, F.coalesce("by_url", "by_tail")).alias("dst"), n.cast("long").alias("candidates"), reason.alias("reason"))


def edges_of(resolved: DataFrame) -> DataFrame:
    """(src, dst, line) without links to the own page; parallel edges stay."""
    return resolved.filter("dst is not null and src <> dst").select("src", "dst", "line")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree): distinct pairs; nodes without links have zeros."""
    pairs = edges.select("src", "dst").distinct()
    both = pairs.select(F.col("src").alias("node"), F.col("dst").alias("o"), F.lit("out").alias("way")).union(pairs.select("dst", "src", F.lit("in")))
    count = both.groupBy("node").agg(F.count_if(F.col("way") == "out").alias("out_degree"), F.count_if(F.col("way") == "in").alias("in_degree"), F.countDistinct("o").alias("degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(count, "node", "left").select("node", zero("out_degree"), zero("in_degree"), zero("degree"))


def spread(seeds: DataFrame, edges: DataFrame, degree: DataFrame, hops: int = 1) -> DataFrame:
    """(node, activation) after up to ``hops`` steps from seeds (node, activation). A hub passes nothing on; of several
    links between two nodes the strongest counts; only nodes reached anew pass on in the next step."""
    pairs = edges.select("src", "dst").distinct()
    ways = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w"))
    ways = ways.union(pairs.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(BACK).alias("w"))).groupBy("u", "v").agg(F.max("w").alias("w"))
    deg = degree.select("node", F.greatest("degree", F.lit(1)).alias("d"))
    ways = ways.join(deg.toDF("u", "du"), "u").join(deg.toDF("v", "dv"), "v").filter(F.col("du") <= HUB)
    active, front = seeds.select("node", "activation"), seeds.select("node", "activation")
    for _ in range(hops):
        gain = front.join(ways, front["node"] == ways["u"]).select("v", (F.col("activation") * DECAY * F.col("w") / F.col("du") / F.sqrt("dv")).alias("c"))
        gained = gain.filter(F.col("c") >= LEAST).groupBy(F.col("v").alias("node")).agg(F.sum("c").alias("gain"))
        front = gained.join(active, "node", "left_anti").select("node", F.least(F.lit(1.0), F.col("gain")).alias("activation"))
        merged = active.join(gained, "node", "full_outer")
        active = merged.select("node", F.least(F.lit(1.0), F.coalesce("activation", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("activation"))
    return active


def _contributions(front: DataFrame, links: DataFrame, degree: DataFrame) -> DataFrame:
    """(u, du, v, c, via): what each node of front (node, activation, via) would pass on over links (src, dst, rel): the
    strongest way to each neighbour, followed backwards at BACK, and twice its relevance more."""
    factor = 1 + 2 * F.col("rel")
    ways = links.select(F.col("src").alias("u"), F.col("dst").alias("v"), factor.alias("w")).union(links.select("dst", "src", BACK * factor))
    deg = degree.select("node", F.greatest("degree", F.lit(1)).alias("d"))
    ways = ways.groupBy("u", "v").agg(F.max("w").alias("w")).join(deg.toDF("u", "du"), "u").join(deg.toDF("v", "dv"), "v")
    met = front.join(ways, front["node"] == ways["u"])
    return met.select("u", "du", "v", (F.col("activation") * DECAY * F.col("w") / F.col("du") / F.sqrt("dv")).alias("c"), "via")


def _hop(active: DataFrame, front: DataFrame, links: DataFrame, degree: DataFrame) -> DataFrame:
    """(node, gain, via, known): what nodes gain in a step, the way of the largest part, and whether they were active."""
    c = _contributions(front, links, degree).filter((F.col("du") <= HUB) & (F.col("c") >= LEAST))
    gained = c.groupBy(F.col("v").alias("node")).agg(F.sum("c").alias("gain"), F.max_by(F.concat("via", F.lit(">"), F.col("v").cast("string")), "c").alias("via"))
    return gained.join(active.select("node", F.lit(True).alias("known")), "node", "left")


def spread_traced(seeds: DataFrame, links: DataFrame, degree: DataFrame, hops: int = 2, most: int = NODES) -> DataFrame:
    """(node, activation, hop, via) after ``hops`` steps from seeds (node, activation) over links (src, dst, rel). A step
    that would make more than ``most`` nodes active is undone and is the last."""
    active = cut(seeds.select("node", "activation", F.lit(0).alias("hop"), F.col("node").cast("string").alias("via")))
    front = active
    for k in range(1, hops + 1):
        gained = cut(_hop(active, front, links, degree))
        new = gained.filter("known is null").select("node", F.least(F.lit(1.0), F.col("gain")).alias("activation"), F.lit(k).alias("hop"), "via")
        if active.count() + new.count() > most:
            break
        stronger = active.join(gained.select("node", "gain"), "node", "left").select("node", F.least(F.lit(1.0), F.col("activation") + F.coalesce("gain", F.lit(0.0))).alias("activation"), "hop", "via")
        active, front = cut(stronger.union(new)), new
    return active


def spread_counters(seeds: DataFrame, links: DataFrame, degree: DataFrame, most: int = NODES) -> DataFrame:
    """One row for the first step: hubs among the seeds, contributions below the threshold, nodes reached anew, and
    whether they are few enough."""
    front = seeds.select("node", "activation", F.col("node").cast("string").alias("via"))
    hubs = seeds.join(degree, "node").agg(F.count_if(F.greatest("degree", F.lit(1)) > HUB).alias("hubs"))
    c = _contributions(front, links, degree).filter(F.col("du") <= HUB)
    weak = c.agg(F.count_if(F.col("c") < LEAST).alias("below_threshold"))
    new = _hop(seeds, front, links, degree).agg(F.count_if(F.col("known").isNull()).alias("reached"))
    total = seeds.agg(F.count("*").alias("seeds"))
    one = hubs.crossJoin(weak).crossJoin(new).crossJoin(total)  # one row each
    return one.select("hubs", "below_threshold", "reached", (F.col("seeds") + F.col("reached") <= most).alias("fits"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes of strongly connected components of more than one node, named by their least. Labels only, no
    paths: nodes that cannot be in a cycle go first; then the largest node that reaches a node colours it, the nodes of a
    colour that reach their colour's node are one component, and the rest goes on within its colours."""
    rest = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    found: DataFrame | None = None
    while not rest.isEmpty():
        while True:  # nodes without a way in or out
            ends = rest.select(F.col("src").alias("node")).intersect(rest.select(F.col("dst").alias("node")))
            kept = cut(rest.join(ends.toDF("src"), "src", "left_semi").join(ends.toDF("dst"), "dst", "left_semi").select("src", "dst"))
            if kept.count() == rest.count():
                break
            rest = kept
        if rest.isEmpty():
            break
        color = cut(rest.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")))
        while True:
            came = rest.join(color.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("c"))
            now = cut(color.join(came, "node", "left").select("node", F.col("color").alias("was"), F.greatest("color", F.coalesce("c", "color")).alias("color")))
            done = now.filter("was <> color").isEmpty()
            color = now.select("node", "color")
            if done:
                break
        inside = cut(rest.join(color.toDF("src", "color"), "src").join(color.toDF("dst", "other"), "dst").filter("color = other").select("src", "dst", "color"))
        back = cut(color.filter("node = color"))
        while True:
            more = inside.join(back.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "color")
            now = cut(back.union(more).distinct())
            if now.count() == back.count():
                break
            back = now
        part = back.groupBy("color").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).filter("n > 1")
        part = back.join(part, "color").select("node", "cycle")
        found = cut(part if found is None else found.union(part))
        rest = cut(inside.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)


def store(pages: DataFrame, path: str) -> None:
    """Writes the nodes, resolved links, edges and degrees of pages below path."""
    spark = pages.sparkSession
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    pages.select(F.col("page_id").alias("node"), "url", F.sha2("html", 256).alias("sha256")).write.parquet(f"{path}/nodes")
    resolve(page_links(pages), pages).write.parquet(f"{path}/resolved")
    edges_of(read("resolved")).write.parquet(f"{path}/edges")
    degrees(read("nodes").select("node"), read("edges")).write.parquet(f"{path}/degrees")


class Links:
    """A stored link graph."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (src, dst), in either direction, connect it with. Each round takes
    the least label of the neighbours and then the label of that label, so long chains need few rounds."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "other").distinct())
    label = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label.toDF("other", "c"), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = label.join(near, "node", "left").select("node", "component", F.least("component", "c").alias("to"))
        jump = step.join(label.toDF("to", "root"), "to", "left")
        now = cut(jump.select("node", "component", F.least("to", "root").alias("now")))
        label = now.select("node", F.col("now").alias("component"))
        if now.filter("now <> component").isEmpty():
            return label
