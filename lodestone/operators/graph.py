"""Relationship queries over a directed multigraph: nodes(id, ...) and edges(src, dst, relation, ...).

Bounded traversals are unrolled joins that keep one row for each node and level, so plans stay lazy and their size is
the depth asked for. Open-ended ones (components) iterate with tables cut off from their lineage in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import OTHER_IMPACT, OTHER_VERB, RELATION_LABELS, RELATIONS, STD_TYPES, WORD_IMPACTS, WORD_VERBS
from ..sources.shared import cut

def reverse(edges: DataFrame) -> DataFrame:
    turned = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(turned.get(c, c)).alias(c) for c in edges.columns))


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges into targets (id), one row for each."""
    return edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")


def callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """id and the least depth (1 or more) at which it is reached along edges from roots (id)."""
    step = edges.select("src", "dst")  # parallel edges fall together with what they reach
    front, levels = roots.select("id").distinct(), []
    for d in range(1, depth + 1):
        front = front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id")).distinct()
        levels.append(front.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.min("depth").alias("depth"))


def impact(edges: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """What depends on targets, directly or not; the targets themselves are left out."""
    return reachable(reverse(edges), targets, depth).join(targets.select("id"), "id", "left_anti")


def risk(count: Column) -> Column:
    return F.when(count <= 5, "low").when(count <= 20, "medium").when(count <= 50, "high").otherwise("critical")


def call_chain(edges: DataFrame, source: DataFrame, target: DataFrame, depth: int | None = None) -> DataFrame:
    """The shortest path (array of ids) from source's nodes to each of target's; the smallest of equal ones.

    Levels go on until every target is found or no node is new, however long the chains are; depth, if given, is the
    most edges that are asked for. A node keeps one path, for one level; what has been passed keeps its id alone."""
    step = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    ends = target.select(F.col("id").alias("at")).distinct()
    front = cut(source.select(F.col("id").alias("at"), F.array("id").alias("path")).dropDuplicates(["at"]))
    seen, left, found = cut(front.select("at")), cut(ends), []
    d = 0
    while (depth is None or d < depth) and left.take(1):
        d += 1
        nxt = front.join(step, front["at"] == step["src"]).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(nxt.groupBy("at").agg(F.min("path").alias("path")).join(seen, "at", "left_anti"))
        if not front.take(1):
            break
        found.append(front.join(left, "at", "left_semi").select(F.col("at").alias("id"), F.lit(d).alias("hops"), "path"))
        left = cut(left.join(front.select("at"), "at", "left_anti"))
        seen = cut(seen.unionByName(front.select("at")))
    return reduce(DataFrame.unionByName, found) if found else front.limit(0).select(F.col("at").alias("id"), F.lit(0).alias("hops"), "path")


def impact_paths(edges: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """id, hops and path (from a target, the smallest of the shortest) for what depends on targets; a node is expanded once."""
    step = reverse(edges).select("src", "dst").filter("src <> dst").distinct()
    seen = targets.select(F.col("id").alias("at"), F.array("id").alias("path"), F.lit(0).alias("hops")).dropDuplicates(["at"])
    front = seen
    for d in range(1, depth + 1):
        nxt = front.join(step, front["at"] == step["src"]).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        front = nxt.groupBy("at").agg(F.min("path").alias("path")).join(seen.select("at"), "at", "left_anti").withColumn("hops", F.lit(d))
        seen = seen.unionByName(front)
    return seen.filter("hops > 0").select(F.col("at").alias("id"), "hops", "path")


def _starts(nodes: DataFrame, edges: DataFrame, step: DataFrame, roots: bool) -> DataFrame:
    """Searches (root, id at level 1): of nodes that point to the same nodes one is enough, since nothing leads back to a
    root. The sets are compared by two sums of hashes and their size, so that none is gathered."""
    if not roots:
        return step.select(F.col("src").alias("root"), F.col("dst").alias("id"))
    first = step.join(unused(nodes, edges).select(F.col("id").alias("src")), "src", "left_semi")
    wide = "decimal(38,0)"
    sets = first.groupBy("src").agg(F.sum(F.xxhash64("dst").cast(wide)).alias("x"), F.sum(F.xxhash64("dst", F.lit(1)).cast(wide)).alias("y"), F.count("*").alias("n"))
    one = sets.groupBy("x", "y", "n").agg(F.min("src").alias("src")).select("src")
    return first.join(one, "src", "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("id"))


def max_depth(nodes: DataFrame, edges: DataFrame, roots: bool = True) -> int:
    """The longest of the shortest ways from a root (a node that nothing points to), or with roots=False from any node.

    Each round keeps a row for each search and node that it newly reaches, and ends when none is new."""
    step = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    front = cut(_starts(nodes, edges, step, roots))
    seen, depth = front, 0
    while front.take(1):
        depth += 1
        new = front.join(step, front["id"] == step["src"]).select("root", F.col("dst").alias("id")).filter("id <> root").distinct()
        front = cut(new.join(seen, ["root", "id"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return depth


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean_out, components of two strongly connected nodes or more, and depth. All of it reads the
    edges, so they are made once; nodes that come of edges should come of edges that are cut."""
    edges = cut(edges.select("src", "dst"))
    loops = strong_components(edges).groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("strong"))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(loops)  # one row each
    return counts.select("nodes", "edges", (F.col("edges") / F.col("nodes")).alias("mean_out"), "strong", F.lit(max_depth(nodes, edges)).alias("depth"))


def bridge_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over nodes (id, file) and edges: as graph_stats(), but strong counts every strong component, one of a single
    node too, depth is from any node, and imports are the edges between different files. Depth has a row a pair of nodes
    that reach each other: for graphs of a repository's size."""
    edges = cut(edges.select("src", "dst"))  # once: all of it reads them
    here = nodes.select(F.col("id").alias("src"), F.col("file").alias("f"))
    there = nodes.select(F.col("id").alias("dst"), F.col("file").alias("g"))
    imports = edges.join(here, "src").join(there, "dst").filter(~F.col("f").eqNullSafe(F.col("g"))).agg(F.count("*").alias("imports"))
    strong = strong_components(edges)
    lone = nodes.select("id").join(strong.select("id"), "id", "left_anti").agg(F.count("*").alias("lone"))
    loops = strong.agg(F.countDistinct("component").alias("strong"))
    counts = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(imports).crossJoin(loops).crossJoin(lone)  # one row each
    mean = F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0)
    return counts.select("nodes", "edges", "files", "imports", (F.col("strong") + F.col("lone")).alias("strong"), F.lit(max_depth(nodes, edges, roots=False)).alias("depth"), mean.alias("mean_out"))


def limited(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows, each with truncated: whether there are more."""
    total = rows.agg((F.count("*") > limit).alias("truncated"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one row


def from_dependents(symbols: DataFrame) -> DataFrame:
    """Calls from each of a symbol's dependents (id, dependents) to it."""
    return symbols.select(F.explode("dependents").alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("relation"))


def described(edges: DataFrame) -> DataFrame:
    """Edges with a sentence for a caller and one for an impact."""
    return edges.withColumn("caller", F.concat_ws(" ", "src", F.lower(caller_verb(F.col("relation"))), "dst")).withColumn("impact", impact_label(F.col("relation")))


def simple_paths(edges: DataFrame, source: DataFrame, target: DataFrame, depth: int = 10, limit: int | None = None) -> DataFrame:
    """Every path without a repeated node of at most depth edges, with its number of nodes."""
    step = edges.select("src", "dst").distinct()
    front, found = source.select(F.col("id").alias("at"), F.array("id").alias("path")), []
    ends = target.select(F.col("id").alias("at"))
    for _ in range(depth):
        front = front.join(step, front["at"] == step["src"]).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        found.append(front.join(ends, "at", "left_semi"))
        front = front.join(ends, "at", "left_anti")
    out = reduce(DataFrame.unionByName, found).select("path", F.size("path").alias("length"))
    return out if limit is None else out.orderBy("length", "path").limit(limit)


def closure(edges: DataFrame) -> DataFrame:
    """src, dst for every pair joined by a path of any length. It has a row a pair: for small graphs alone."""
    pairs, before = cut(edges.select("src", "dst").distinct()), -1
    while (now := pairs.count()) != before:
        more = pairs.select("src", F.col("dst").alias("m")).join(pairs.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst")
        pairs, before = cut(pairs.unionByName(more).distinct()), now
    return pairs


def cycles(edges: DataFrame) -> DataFrame:
    """component (its smallest node) and id, for strongly connected components of two nodes or more, of any length."""
    strong = strong_components(edges)
    named = strong.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return strong.join(named, "component").select(F.col("least").alias("component"), "id")


def strong_components(edges: DataFrame) -> DataFrame:
    """component (its largest node) and id for every node, for graphs of any size.

    Nodes rank by hash, so that a chain falls apart at many places a round, however its nodes are named. Each round finds
    for every node the greatest rank that reaches it and the greatest that it reaches. Where both are one, that node's
    component is whole and leaves; edges between nodes whose pairs differ are in no cycle and leave too. Nodes without
    edges in and out are components of their own. Rounds go on until no node is left."""
    known = cut(edges.select("src", "dst").distinct())  # once: what makes the edges may be dear
    ids = known.select(F.col("src").alias("id")).unionByName(known.select(F.col("dst").alias("id"))).distinct()
    nodes, left, done = cut(ids), known.filter("src <> dst"), []
    while nodes.take(1):
        inner = cut(left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")), "id", "left_semi"))
        done.append(cut(nodes.join(inner, "id", "left_anti").select(F.col("id").alias("component"), "id")))
        left = cut(left.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(inner.select(F.col("id").alias("dst")), "dst", "left_semi"))
        own = inner.withColumn("c", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("root")))
        both = cut(_spread(own, left).join(_spread(own, reverse(left)).withColumnRenamed("c", "b"), "id"))
        whole = both.filter("c = b")
        done.append(cut(whole.join(whole.groupBy("c").agg(F.max("id").alias("component")), "c").select("component", "id")))
        rest = both.filter("c <> b")
        here, there = rest.select(F.col("id").alias("src"), "c", "b"), rest.select(F.col("id").alias("dst"), F.col("c").alias("c2"), F.col("b").alias("b2"))
        left = cut(left.join(here, "src").join(there, "dst").filter("c = c2 and b = b2").select("src", "dst"))
        nodes = cut(rest.select("id"))
    return reduce(DataFrame.unionByName, done) if done else nodes.select(F.col("id").alias("component"), "id")


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's largest label among those that reach it.

    What reaches the root of a node's label reaches the node, so labels also jump to their root's label: a long chain
    takes rounds in the logarithm of its length."""
    before = None
    while True:
        sent = edges.join(labels.select(F.col("id").alias("src"), "c"), "src").select(F.col("dst").alias("id"), "c")
        higher = labels.select("c").distinct().join(labels.select(F.col("id").alias("r"), F.col("c").alias("up")), F.col("c.root") == F.col("r")).filter("up > c").select("c", "up")
        jumped = labels.join(higher, "c").select("id", F.col("up").alias("c"))
        labels = cut(labels.unionByName(sent).unionByName(jumped).groupBy("id").agg(F.max("c").alias("c")))
        now = labels.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its smallest node), by labels that jump to their own label's label."""
    both = edges.select("src", "dst").unionByName(reverse(edges).select("src", "dst")).distinct()
    labels, before = cut(nodes.select("id", F.col("id").alias("c"))), None
    both = cut(both)
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "c")
        least = labels.unionByName(near).groupBy("id").agg(F.min("c").alias("c"))
        jumped = least.join(labels.select(F.col("id").alias("c"), F.col("c").alias("c2")), "c", "left").select("id", F.least("c", "c2").alias("c"))
        labels = cut(jumped)
        now = labels.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.select("id", F.col("c").alias("component"))
        before = now


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def unused(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return unused(nodes, edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def hot(edges: DataFrame, limit: int = 10) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("references")).orderBy(F.desc("references"), "id").limit(limit)


def coupled(edges: DataFrame, least: int = 10) -> DataFrame:
    """Nodes at the ends of more than least edges; a self edge counts once."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.filter("src <> dst").select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("edges")).filter(F.col("edges") > least)


def subgraph(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Edges that leave the roots or what they reach within depth."""
    seen = reachable(edges, roots, depth).select("id").unionByName(roots.select("id")).distinct()
    return edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi")


def relation_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("node_type") == kind)


def edges_of(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """The edges out of ids (id), into them, or both; one at both ends once."""
    out = F.lit(direction in ("out", "both"))
    into = F.lit(direction in ("in", "both"))
    ends = ids.select("id").distinct()
    marked = edges.join(ends.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ends.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    return marked.filter(out & F.col("_s").isNotNull() | into & F.col("_d").isNotNull()).select(*edges.columns)


def node_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By node_type: nodes, mean degrees, and how many stand alone."""
    d = degrees(nodes, edges)
    return d.groupBy("node_type").agg(F.count("*").alias("nodes"), F.avg("in_degree").alias("mean_in"), F.avg("out_degree").alias("mean_out"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("alone"))


def update_edges(edges: DataFrame, where: Column, relation: str) -> DataFrame:
    return edges.withColumn("relation", F.when(where, relation).otherwise(F.col("relation")))


def insert_nodes(nodes: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Nodes with new ones; of those with one id the last by order stays, an old one only where no new one has its id."""
    latest = F.max(F.struct(F.col("_new"), F.col(order), F.struct(*nodes.columns).alias("row")))["row"].alias("row")
    both = nodes.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("id").agg(latest).select("row.*")


def insert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with new ones between known nodes; a multigraph, so equal edges stand side by side."""
    ids = nodes.select("id").distinct()
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(known.select(*edges.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without gone's nodes (id) and every edge at them."""
    ids = gone.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept


def containers(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """For each reference (ref, file, line) the narrowest of spans (id, file, start, end) around it; null if none.

    A span falls apart into the cells of 2 ** level lines that it fills, the widest that fit and two a level at the most,
    and each cell keeps its narrowest span. A line asks the cells around it, one a level. So rows grow with spans and
    lines and not with their pairs, however many spans lie over each other."""
    a, b = F.col("start").cast("bigint"), F.col("end").cast("bigint") + 1
    whole = spans.filter(F.col("end") >= F.col("start")).groupBy("file", a.alias("a"), b.alias("b")).agg(F.min("id").alias("id"))
    levels = lambda n: F.explode(F.sequence(F.lit(0), F.length(F.bin(n)) - 1)).alias("level")
    cut = whole.select("*", levels(F.col("b") - F.col("a"))).withColumns({"lo": F.expr("-shiftright(-a, level)"), "hi": F.expr("shiftright(b, level)")}).filter("lo < hi")
    ends = F.array_compact(F.array(F.when(F.expr("lo & 1") == 1, F.col("lo")), F.when(F.expr("hi & 1") == 1, F.col("hi") - 1)))
    filled = cut.select("file", "level", F.explode(ends).alias("cell"), F.struct((F.col("b") - F.col("a")).alias("w"), "id").alias("s")).groupBy("file", "level", "cell").agg(F.min("s").alias("s"))
    widest = whole.agg(F.max(F.col("b") - F.col("a")).alias("n"))  # one row
    lines = refs.filter("line is not null").select("file", "line").distinct().crossJoin(F.broadcast(widest))
    asked = lines.select("file", "line", levels(F.col("n"))).withColumn("cell", F.expr("shiftright(cast(line as bigint), level)"))
    best = asked.join(filled, ["file", "level", "cell"]).groupBy("file", "line").agg(F.min("s")["id"].alias("container"))
    return refs.join(best, ["file", "line"], "left").select(*refs.columns, "container")


#: Parts that a name many references use is dealt in.
SALT = 16


def resolve(refs: DataFrame, names: DataFrame, imports: DataFrame | None = None, avoid_tests: bool = False) -> DataFrame:
    """For each reference (ref, name) a symbol (id, qualified): an exact name first, then by the imports of its file, then a
    standard type, then the shortest name that ends in it (with avoid_tests those outside test and example modules first).

    imports(file, path, items, alias, wildcard) needs refs to have a file. A name keeps its best symbol before references
    meet it, and what many references share is dealt in SALT parts, so no key gathers references times symbols."""
    named = names.groupBy("qualified").agg(F.min("id").alias("id"))
    cuts = F.split("qualified", "::")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(cuts), F.lit(2))), lambda i: F.array_join(F.slice(cuts, i, F.size(cuts)), "::"))
    test = F.col("qualified").rlike("::(test|example)") if avoid_tests else F.lit(False)
    ends = named.filter(F.size(cuts) > 1).select(F.explode(tails).alias("name"), F.struct(test.alias("t"), F.length("qualified").alias("n"), "qualified", "id").alias("b"))
    ends = ends.groupBy("name").agg(F.min("b").alias("b")).select("name", F.lit(3).alias("p"), F.col("b.qualified").alias("qualified"), F.col("b.id").alias("id"))
    full = named.select(F.col("qualified").alias("name"), F.lit(0).alias("p"), "qualified", "id")
    std = named.join(F.broadcast(refs.sparkSession.createDataFrame([(t, f"std::{t}") for t in STD_TYPES], "name string, qualified string")), "qualified").select("name", F.lit(2).alias("p"), "qualified", "id")
    known = full.unionByName(std).unionByName(ends).groupBy("name").agg(F.min(F.struct("p", "qualified", "id")).alias("b"))
    asked = refs.select("ref", "name", F.pmod(F.xxhash64("ref"), F.lit(SALT)).alias("salt"))
    used = known.join(refs.select("name").distinct(), "name", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    found = asked.join(used, ["name", "salt"]).select("ref", F.col("b.p").alias("p"), F.col("b.id").alias("id"))
    if imports is not None:
        way = _imported(refs, imports)
        salted = named.select("qualified", "id").join(way.select("qualified").distinct(), "qualified", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
        by_import = way.withColumn("salt", F.pmod(F.xxhash64("ref"), F.lit(SALT))).join(salted, ["qualified", "salt"])
        found = found.unionByName(by_import.groupBy("ref").agg(F.min(F.struct("at", "qualified", "id")).alias("b")).select("ref", F.lit(1).alias("p"), F.col("b.id").alias("id")))
    best = found.groupBy("ref").agg(F.min(F.struct("p", "id")).alias("b"))
    how = F.get(F.array(*map(F.lit, ("exact", "import", "standard", "suffix"))), F.col("b.p"))
    return refs.join(best.select("ref", F.col("b.id").alias("target"), how.alias("how")), "ref", "left")


def _imported(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """ref, at (the import's line) and the qualified name that an import of its file makes of a reference's name.

    An import says under which first word its names go: its items, its alias, the last word of its path, or any (*)."""
    word, path = F.substring_index("name", "::", 1), F.col("path")
    base = F.regexp_replace(path, r"(::)?\*?$", "")
    entry = lambda w, rest: F.struct(w.alias("word"), rest.alias("to"))
    # to: what stands for the first word
    items = F.transform("items", lambda i: entry(i, F.concat(path, F.lit("::"), i)))
    last = F.array(entry(F.element_at(F.split(path, "::"), -1), path))
    alias = F.when(F.col("alias").isNotNull(), F.array(entry(F.col("alias"), path))).otherwise(F.array_except(last, last))
    ways = imports.filter("not wildcard").select("file", F.col("line").alias("at"), F.explode(F.concat(F.coalesce(items, F.array_except(last, last)), alias, last)).alias("e")).select("file", "at", "e.*").distinct()
    rest = F.expr("substring(name, length(substring_index(name, '::', 1)) + 1, length(name))")
    asked = refs.select("ref", "file", "name", word.alias("word"))
    plain = asked.join(ways, ["file", "word"]).select("ref", "at", F.concat("to", rest).alias("qualified"))
    stars = imports.filter("wildcard").select("file", F.col("line").alias("at"), base.alias("base")).distinct()
    return plain.unionByName(asked.join(stars, "file").select("ref", "at", F.concat("base", F.lit("::"), "name").alias("qualified")))


def build_edges(refs: DataFrame, spans: DataFrame, names: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """src, dst, relation: references with the symbol around them and the symbol they name, without self edges."""
    placed = containers(refs, spans).select("ref", "container", "relation")
    aimed = resolve(refs, names, imports).select("ref", "target")
    return placed.join(aimed, "ref").filter("container is not null and target is not null and container <> target").select(F.col("container").alias("src"), F.col("target").alias("dst"), "relation")


def relation_of(reference_type: Column, descriptive: bool = False) -> Column:
    names = F.create_map(*(F.lit(x) for kind, both in RELATIONS.items() for x in (kind, both[descriptive])))
    return F.coalesce(F.try_element_at(names, reference_type), F.lit("references"))


def _labelled(relation: Column, part: int, words: dict[str, str], other: Column) -> Column:
    known = F.try_element_at(F.create_map(*(F.lit(x) for name, both in RELATION_LABELS.items() for x in (name, both[part]))), relation)
    found = F.coalesce(*(F.when(relation.contains(w) | relation.contains(w.capitalize()), label) for w, label in words.items()))
    return F.coalesce(known, found, other)


def caller_verb(relation: Column) -> Column:
    return _labelled(relation, 0, WORD_VERBS, F.lit(OTHER_VERB))


def impact_label(relation: Column) -> Column:
    return _labelled(relation, 1, WORD_IMPACTS, F.concat(F.lit(f"{OTHER_IMPACT} ("), relation, F.lit(")")))
