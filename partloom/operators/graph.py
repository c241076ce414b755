"""Graph patterns over quads, links between top-level parts, PageRank and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from partloom.session import shared_folder

TYPE, TOP_LEVEL = "type", "topLevel"
#: About so many targets of a node are in one list.
LIST = 1024


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration in the shared folder named by spark.checkpoint.dir (a local one only where unset)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def top_levels(quads: DataFrame, predicate: str = TOP_LEVEL) -> DataFrame:
    """Subjects that name themselves as top level."""
    return quads.where((F.col("p") == predicate) & (F.col("s") == F.col("o"))).select("s").distinct()


def restrict(quads: DataFrame, graphs: list[str] | None) -> DataFrame:
    return quads.where(F.col("g").isin(graphs)) if graphs else quads


def with_criteria(subjects: DataFrame, quads: DataFrame, criteria: list[tuple[str, str]]) -> DataFrame:
    """Subjects (column s) that have every (predicate, object)."""
    for p, o in criteria:
        subjects = subjects.join(quads.where((F.col("p") == p) & (F.col("o") == o)).select("s"), "s", "left_semi")
    return subjects


def parts(quads: DataFrame, optional: dict[str, str], type_predicate: str = TYPE, top: str = TOP_LEVEL, criteria: list[tuple[str, str]] | None = None, indexing: bool = False) -> DataFrame:
    """Basic pattern (type and top level) with optional fields: a row for each combination of values, nulls where unbound.

    optional maps output columns to predicates. Values are first gathered by subject for each field, in one aggregation
    over one shuffle, and then spread again, which gives the fan-out of repeated left joins without a join for each.
    """
    has_type = quads.where(F.col("p") == type_predicate).select("s", F.col("o").alias("type"), *([F.col("g").alias("graph")] if indexing else [])).distinct()
    subjects = with_criteria(top_levels(quads, top), quads, criteria or [])
    base = has_type.join(subjects, "s", "left_semi")
    wanted = {p: c for c, p in optional.items()}
    values = quads.where(F.col("p").isin(list(wanted))).join(subjects, "s", "left_semi").groupBy("s").agg(*(F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(c) for p, c in wanted.items()))
    out = base.join(values, "s", "left")
    for c in optional:
        out = out.withColumn(c, F.explode_outer(c))
    if not indexing:
        out = out.withColumn("graph", F.lit(None).cast("string"))
    return out.withColumnRenamed("s", "subject").distinct()


def one_row_each(parts_: DataFrame) -> DataFrame:
    """The first row of each subject by (type, role, sboltype, name, description, version), nulls last."""
    order = [F.struct(*(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in ("type", "role", "sboltype", "name", "description", "version")))]
    row = F.struct(*parts_.columns)
    return parts_.groupBy("subject").agg(F.min_by(row, order[0]).alias("r")).select("r.*")


def links(quads: DataFrame, top: DataFrame) -> DataFrame:
    """Distinct (parent, child): top-level parts one or two statements apart, whatever the predicates, loops included."""
    from_top = quads.join(top, "s", "left_semi").select(F.col("s").alias("parent"), "o").distinct()
    ends = top.select(F.col("s").alias("child"))
    one = from_top.join(ends, F.col("o") == F.col("child"), "left_semi").select("parent", F.col("o").alias("child"))
    last = quads.join(ends, F.col("o") == F.col("child"), "left_semi").select("s", F.col("o").alias("child")).distinct()
    two = from_top.join(last, F.col("o") == F.col("s")).select("parent", "child")
    return one.union(two).distinct()


def out_degrees(nodes: DataFrame, edges: DataFrame, multi: bool = False) -> DataFrame:
    """(id, degree) of every node, 0 for dangling ones."""
    e = edges if multi else edges.distinct()
    return nodes.join(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float | None = 1e-4, iterations: int | None = None, static_dangling: bool = False, multi: bool = False, most: int = 200, dropped: Observation | None = None) -> DataFrame:
    """(id, rank). Stops when the L1 change is at most tolerance, or after so many iterations.

    Raises RuntimeError where it has not settled after `most` passes. Edges (src, dst) with unknown ends are dropped, and
    counted on the way (edges, dropped) where there is an observation. No nodes give no rows. static_dangling keeps the
    first pass's dangling share; multi lets repeated edges count.
    """
    nodes = nodes.select("id").distinct().cache()
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    end = lambda c: nodes.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}"))
    given = edges.select("src", "dst") if multi or dropped is not None else edges.select("src", "dst").distinct()  # once, before they are moved to either end
    each = given.join(end("dst"), "dst", "left").join(end("src"), "src", "left").withColumn("_known", F.col("_src").isNotNull() & F.col("_dst").isNotNull())
    if dropped is not None:
        each = each.observe(dropped, F.count(F.lit(1)).alias("edges"), F.count_if(~F.col("_known")).alias("dropped"))
    known = each.where("_known").select("src", "dst")
    # repeated edges are one with a number, so a list holds a target once
    known = checkpointed(known.groupBy("src", "dst").agg(F.count("*").alias("m")) if multi else (known if dropped is None else known.distinct()).withColumn("m", F.lit(1)))
    degree = checkpointed(known.groupBy("src").agg(F.sum("m").alias("degree")))
    # edges do not change: lists of targets, of a bounded length, are far fewer rows to hold and to join in each pass
    lists = known.join(degree, "src").withColumn("_part", F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / LIST))).groupBy("src", "degree", "_part").agg(F.collect_list(F.struct("dst", "m") if multi else F.col("dst")).alias("to"))
    weighted = checkpointed(lists.select("src", "to", (1.0 / F.col("degree")).alias("w")).repartition("src"))
    ranks = checkpointed(nodes.join(degree, F.col("id") == F.col("src"), "left").select("id", F.lit(1.0 / n).alias("rank"), F.col("degree").isNull().alias("dangling")))
    done, fixed = 0, None
    while done < (iterations if iterations is not None else most):
        loose = fixed if fixed is not None else ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] / n
        if static_dangling:
            fixed = loose
        shares = weighted.join(ranks, F.col("src") == F.col("id")).select(F.explode("to").alias("to"), (F.col("rank") * F.col("w")).alias("share"))
        shares = shares.select("to.dst", (F.col("share") * F.col("to.m")).alias("share")) if multi else shares.withColumnRenamed("to", "dst")
        flow = shares.groupBy("dst").agg(F.sum("share").alias("flow"))
        raw = ranks.join(flow, F.col("id") == F.col("dst"), "left").select("id", "dangling", F.col("rank").alias("old"), (damping * (F.coalesce("flow", F.lit(0.0)) + loose) + (1 - damping) / n).alias("raw"))
        raw = checkpointed(raw)
        total = raw.agg(F.sum("raw")).first()[0]
        done += 1
        moved = raw.agg(F.sum(F.abs(F.col("raw") / total - F.col("old")))).first()[0] if iterations is None else None
        ranks = raw.select("id", (F.col("raw") / total).alias("rank"), "dangling")
        if moved is not None and tolerance is not None and moved <= tolerance:
            break
    else:
        if iterations is None:
            raise RuntimeError(f"PageRank did not settle in {most} passes")
    return ranks.select("id", "rank")


def connected_components(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) with the smallest id reachable, by minimum labels and pointer jumping."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    both = both.union(both.select("b", "a")).distinct().cache()
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(most):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        low = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        low = checkpointed(low)
        jumped = low.join(low.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"))
        jumped = checkpointed(jumped)
        changed = jumped.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _having(quads: DataFrame, p: str, o: str) -> DataFrame:
    return quads.where((F.col("p") == p) & (F.col("o") == o)).select("s").distinct()


def _linked(quads: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return quads.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o)).distinct()


def sequence_chain(quads: DataFrame, sequence: str = "sequence", elements: str = "elements", kind: str = "ComponentDefinition", sequence_kind: str = "Sequence", type_predicate: str = TYPE) -> DataFrame:
    """(subject, sequence): the elements of each sequence of each definition; both ends must have their type."""
    own = _linked(quads, sequence, "subject", "seq").join(_having(quads, type_predicate, kind).withColumnRenamed("s", "subject"), "subject", "left_semi")
    known = _linked(quads, elements, "seq", "sequence").join(_having(quads, type_predicate, sequence_kind).withColumnRenamed("s", "seq"), "seq", "left_semi")
    return own.join(known, "seq").select("subject", "sequence")


def component_usage(quads: DataFrame, component: str = "component", definition: str = "definition", derived: str = "wasDerivedFrom", kind: str = "ComponentDefinition", type_predicate: str = TYPE) -> DataFrame:
    """Distinct (parent, origin, child): what a definition uses, once for each origin that the definition derives from."""
    parents = _having(quads, type_predicate, kind).withColumnRenamed("s", "parent")
    uses = _linked(quads, component, "parent", "part").join(_linked(quads, definition, "part", "child"), "part").select("parent", "child").distinct()
    origins = _linked(quads, derived, "parent", "origin").join(parents, "parent", "left_semi")
    return uses.join(origins, "parent").select("parent", "origin", "child")


def component_pairs(quads: DataFrame, component: str = "component", definition: str = "definition", kind: str = "ComponentDefinition", type_predicate: str = TYPE) -> DataFrame:
    """Distinct (parent, child) with one to three components between them; both ends must have the type."""
    # both kinds of statements are dealt by the component once, and made distinct where they lie
    link = lambda p, s, o: quads.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o)).where(F.col(s).isNotNull() & F.col(o).isNotNull()).repartition("part").distinct()
    steps = link(component, "parent", "part").join(link(definition, "part", "child"), "part").select("parent", "child")
    return containment(steps, _having(quads, type_predicate, kind))


def either_end(pairs: DataFrame, quads: DataFrame, criteria: list[tuple[str, str]]) -> DataFrame:
    """Distinct pairs of which the parent or the child has every (predicate, object)."""
    chosen = with_criteria(quads.select("s").distinct(), quads, criteria)
    # the pairs are read once and each end is marked
    end = lambda c: chosen.select(F.col("s").alias(c), F.lit(True).alias(f"_{c}"))
    marked = pairs.select("parent", "child").distinct().join(end("parent"), "parent", "left").join(end("child"), "child", "left")
    return marked.where("_parent is not null or _child is not null").select("parent", "child")


def containment(components: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Distinct (parent, child) one, two or three steps apart, of those whose ends are both in ends (column s), if given;
    components: (parent, child).

    Steps are dealt by parent once. Only parents that are children too lead on, and what lies below these is gathered first,
    so all steps meet it in one join and neither two nor three steps are moved before the last distinct.
    """
    a = components.select("parent", "child")
    if ends is not None:  # nulls are no ends; said once, so that Spark moves the steps once for all uses
        a = a.where("parent is not null and child is not null")
    a = a.repartition("parent").distinct()
    b = a.join(a.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
    two = b.join(b.select(F.col("parent").alias("child"), F.col("child").alias("next")), "child").select("parent", F.col("next").alias("child"))
    below = b.union(two).distinct()
    near = a
    if ends is not None:
        child = ends.select(F.col("s").alias("child"))
        a = a.join(ends.select(F.col("s").alias("parent")), "parent", "left_semi")
        near, below = a.join(child, "child", "left_semi").select("parent", "child"), below.join(child, "child", "left_semi").select("parent", "child")
    far = a.join(below.select(F.col("parent").alias("child"), F.col("child").alias("next")), "child").select("parent", F.col("next").alias("child"))
    return near.union(far).distinct()


def force_graph(pairs: DataFrame, root: str = "root") -> tuple[DataFrame, DataFrame]:
    """(nodes: id, group) and (links: source, target, value) with a root linked to every node."""
    ids = pairs.select(F.explode(F.array("parent", "child")).alias("id")).distinct()
    spark = pairs.sparkSession
    nodes = ids.select("id", F.lit(1).alias("group")).union(spark.createDataFrame([(root, 2)], "id string, `group` int"))
    links_ = pairs.select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit(1.0).alias("value")).distinct().union(ids.select(F.lit(root), "id", F.lit(0.01)))
    return nodes, links_
