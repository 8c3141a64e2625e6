"""Query verbs over evidence records. UMIs are distinct classes, cells distinct cells."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import kleene_any, overlap
from ..sources.archive import stored
from ..sources.evidence import CHUNK, TILE, junction_rows, junctions, placements, span_end, span_start

MOST_REQUESTS = 100_000
#: Requests by tile, and geometries, that are sent to all tasks; more of them meet the records in a shuffle.
MOST_TILES, MOST_SHAPES = 1_000_000, 50_000


def umis() -> Column:
    return F.count_distinct("umi_class").alias("umis")


def cells() -> Column:
    return F.count_distinct("cell").alias("cells")


def distinct_counts(rows: DataFrame, by: list[str], others: DataFrame | None = None) -> DataFrame:
    """umis and cells of each group (with the others' columns of that group), counted apart, so that no task holds a row's keys twice."""
    out = rows.select(*by).distinct() if others is None else others
    for column, name in (("umi_class", "umis"), ("cell", "cells")):
        n = rows.where(F.col(column).isNotNull()).select(*by, column).distinct().groupBy(*by).agg(F.count("*").alias(f"__{name}"))
        same = F.lit(True)
        for c in by:
            same &= out[c].eqNullSafe(n[c])
        out = out.join(n, same, "left").select(*[out[c] for c in out.columns], F.coalesce(f"__{name}", F.lit(0)).alias(name))
    return out


def in_region(rows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records whose anchor lies in [start, end)."""
    return rows.where((F.col("chrom") == chrom) & (F.col("anchor") >= start) & (F.col("anchor") < end))


def region(rows: DataFrame, chrom: str, start: int, end: int, by: list[str]) -> DataFrame:
    return in_region(rows, chrom, start, end).groupBy(*by).agg(F.count("*").alias("molecules"), umis(), cells())


def chunk_index(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chrom", (F.floor(F.col("anchor") / CHUNK) * CHUNK).alias("bin_start")).agg(F.count("*").alias("n_mols"), F.max("anchor").alias("max_anchor"))


def junction_catalogue(rows: DataFrame, by: list[str] | None = None, mm: bool = True) -> DataFrame:
    """Junctions with how many stored placements carry them."""
    return junction_rows(rows, mm).groupBy(*(by or []), "chrom", "donor", "acceptor").agg(F.count("*").alias("supporting_children"))


def junction(rows: DataFrame, chrom: str, donor: int, acceptor: int, by: list[str]) -> DataFrame:
    hit = (F.col("chrom") == chrom) & (F.col("donor") == donor) & (F.col("acceptor") == acceptor)
    return junction_rows(rows.where(F.col("chrom") == chrom)).where(hit).groupBy(*by).agg(umis(), cells())


def annotation_junctions(tx: DataFrame) -> DataFrame:
    return tx.select("chrom", F.explode(junctions(F.col("exons"))).alias("j")).select("chrom", "j.donor", "j.acceptor").distinct()


def junction_table(rows: DataFrame, tx: DataFrame, chrom: str, start: int, end: int, min_support: int = 1, either: bool = False) -> DataFrame:
    """Junctions of a window with support, UMIs, cells and whether the annotation has the junction, its donor, its acceptor."""
    d, a = (F.col(c).between(start, end - 1) for c in ("donor", "acceptor"))
    found = junction_rows(rows.where(F.col("chrom") == chrom)).where(d | a if either else d & a).groupBy("chrom", "donor", "acceptor").agg(F.count("*").alias("supporting_children"), umis(), cells()).where(F.col("supporting_children") >= min_support)
    known = annotation_junctions(tx)
    flags = [(known, ["chrom", "donor", "acceptor"], "exact"), (known.select("chrom", "donor").distinct(), ["chrom", "donor"], "donor_known"), (known.select("chrom", "acceptor").distinct(), ["chrom", "acceptor"], "acceptor_known")]
    for table, keys, name in flags:
        found = found.join(table.withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return found


def batch(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Region and junction requests (id, kind, chrom, start, end) answered in one pass; requests without evidence have zeros."""
    if (n := plan.count()) > MOST_REQUESTS:
        raise ValueError(f"{n} requests; {MOST_REQUESTS} are allowed")
    # requests are spread over the tiles that they touch, so that a record meets those of its own tile alone
    first, last = F.floor(F.col("start") / TILE), F.floor((F.col("end") - 1) / TILE)
    wide = plan.where("kind = 'region'")
    tiles = wide.agg(F.sum(last - first + 1)).first()[0] or 0
    wide = wide.withColumn("tile", F.explode(F.sequence(first, last)))
    wide = F.broadcast(wide) if tiles <= MOST_TILES else wide  # records of a tile are not gathered: a full one would be one task
    inside = (F.col("anchor") >= F.col("start")) & (F.col("anchor") < F.col("end"))
    regions = rows.select("chrom", "anchor", "umi_class", "cell", F.floor(F.col("anchor") / TILE).alias("tile")).join(wide, ["chrom", "tile"]).where(inside).select("id", "umi_class", "cell")
    at = plan.where("kind = 'junction'").select("id", "chrom", F.col("start").alias("donor"), F.col("end").alias("acceptor"))
    points = junction_rows(rows).join(F.broadcast(at), ["chrom", "donor", "acceptor"]).select("id", "umi_class", "cell")  # MOST_REQUESTS rows at most
    counts = regions.union(points).groupBy("id").agg(umis(), cells())
    return plan.select("id", "kind").join(counts, "id", "left").select("id", "kind", F.col("umis").isNotNull().alias("present"), F.coalesce("umis", F.lit(0)).alias("umis"), F.coalesce("cells", F.lit(0)).alias("cells"))


def sides(hits: DataFrame, by: list[str]) -> DataFrame:
    """Classes of each group by the sides (1 include, 2 exclude, OR-ed) that they support, and usage."""
    masks = hits.groupBy(*by, "umi_class", "cell").agg(F.bit_or("side").alias("mask"))
    count = lambda m: F.count_if(F.col("mask") == m)
    out = masks.groupBy(*by).agg(count(1).alias("include_only"), count(2).alias("exclude_only"), count(3).alias("both"), F.count_distinct("cell").alias("cells"))
    informative = F.col("include_only") + F.col("exclude_only")
    return out.withColumn("informative_umis", informative).withColumn("usage_fraction", F.try_divide(F.col("include_only").cast("double"), informative))


def jset(rows: DataFrame, include: list[tuple], exclude: list[tuple], by: list[str]) -> DataFrame:
    """Include and exclude junctions (chrom, donor, acceptor), as many as the caller names; none may be on both sides."""
    if set(include) & set(exclude):
        raise ValueError("a junction is on both sides")
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(*j, 1) for j in include] + [(*j, 2) for j in exclude], "chrom string, donor long, acceptor long, side int")
    return sides(junction_rows(rows).join(F.broadcast(wanted), ["chrom", "donor", "acceptor"]), by)


def discover_events(catalogue: DataFrame, by: list[str] | None = None, min_support: int = 2, strict: bool = False) -> DataFrame:
    """Components of alternative acceptor, alternative donor and cassette events: event_id, kind, chrom, donor, acceptor, side.

    strict: a cassette's inner exon must have a length above zero.
    """
    by = by or []
    c = catalogue.where(F.col("supporting_children") >= min_support).select(*by, "chrom", "donor", "acceptor")
    a, b = (c.select(*by, "chrom", F.col("donor").alias(f"{n}d"), F.col("acceptor").alias(f"{n}a")) for n in "ab")
    keys = [*by, "chrom"]
    near = a.join(b.withColumn("ad", F.col("bd")), [*keys, "ad"]).where("aa < ba").select(*keys, F.lit("alt-acceptor").alias("kind"), F.array("ad", "aa", "bd", "ba").alias("x"))
    far = a.join(b.withColumn("aa", F.col("ba")), [*keys, "aa"]).where("ad < bd").select(*keys, F.lit("alt-donor").alias("kind"), F.array("ad", "aa", "bd", "ba").alias("x"))
    s = c.select(*by, "chrom", F.col("donor").alias("sd"), F.col("acceptor").alias("sa"))
    left, right = a.withColumn("sd", F.col("ad")).where("true"), b.withColumn("sa", F.col("ba"))
    inner = F.col("bd") > F.col("aa") if strict else F.col("bd") >= F.col("aa")
    cassette = s.join(left, [*keys, "sd"]).where("aa < sa").join(right, [*keys, "sa"]).where(inner & (F.col("bd") > F.col("sd"))).select(*keys, F.lit("cassette").alias("kind"), F.array("ad", "aa", "bd", "ba", "sd", "sa").alias("x"))
    events = near.union(far).union(cassette)
    pairs = F.transform(F.sequence(F.lit(0), F.size("x") - 1, F.lit(2)), lambda i: F.concat_ws("-", F.get("x", i), F.get("x", i + 1)))
    events = events.withColumn("event_id", F.concat_ws(":", "kind", "chrom", F.array_join(pairs, ":")))
    # the first junction of a pair and both flanks of a cassette include, the other and the skip exclude
    side = F.when(F.col("kind") == "cassette", F.when(F.col("i") < 2, 1).otherwise(2)).otherwise(F.col("i") + 1)
    out = events.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1)))
    return out.select(*by, "event_id", "kind", "chrom", F.get("x", F.col("i") * 2).alias("donor"), F.get("x", F.col("i") * 2 + 1).alias("acceptor"), side.cast("int").alias("side"))


def counted(listed: DataFrame, by: list[str], shared) -> DataFrame:  # noqa: ANN001
    """Of units (by, js: their junctions' numbers), how many of each group show an event's include side, exclude side, or both.

    shared: starts of each junction's components, their events, sides (1, 2), and the number of events. A unit's junctions
    are looked up where the unit lies, so that units times events are in no table.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        starts, event, side, n = shared.value
        for batch in batches:
            js = batch.column(len(by))
            flat, cut = js.flatten().to_numpy(), js.offsets.to_numpy()
            unit = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            size = starts[flat + 1] - starts[flat]
            at = np.repeat(starts[flat] - np.cumsum(size) + size, size) + np.arange(size.sum())
            key = np.repeat(unit, size) * n + event[at]
            order = np.argsort(key, kind="stable")
            key, mask = key[order], side[at][order]
            first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
            key, mask = key[first], np.bitwise_or.reduceat(mask, first) if len(first) else mask
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(*[batch.column(k).to_pylist() for k in range(len(by))], strict=True)] if by else np.zeros(batch.num_rows), np.int64)
            got, count = np.unique((group[key // n] * n + key % n) * 4 + mask, return_counts=True)
            keys = list(names) or [()]
            where = (got // 4 // n).tolist()
            columns = [pa.array([keys[g][k] for g in where], batch.schema.field(k).type) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got // 4 % n), *[pa.array(np.where(got % 4 == m, count, 0)) for m in (1, 2, 3)]], [*by, "e", "include_only", "exclude_only", "both"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in listed.select(*by).schema)
    found = listed.select(*by, "js").mapInArrow(run, f"{kinds}e long, include_only long, exclude_only long, both long")
    return found.groupBy(*by, "e").agg(*[F.sum(c).alias(c) for c in ("include_only", "exclude_only", "both")])


def events(rows: DataFrame, by: list[str] | None = None, min_support: int = 2, min_informative: int = 1) -> DataFrame:
    """Counts of every discovered event.

    Junctions are found once for each geometry, and events among the junctions; each class, and each cell, then brings the
    set of its junctions, which is met with the events in its place (see counted).
    """
    import numpy as np

    by, spark, at = by or [], rows.sparkSession, ["chrom", "donor", "acceptor"]
    placed = stored(junction_rows(rows.groupBy("chrom", "reps", "mms").agg(F.count("*").alias("n")).withColumns({"r": F.col("reps"), "m": F.col("mms")})).select(*at, "n", "r", "m"))
    catalogue = placed.groupBy(*at).agg(F.sum("n").alias("supporting_children"))
    parts = stored(discover_events(catalogue, min_support=min_support))

    def numbered(df: DataFrame, to: str) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return stored(spark.createDataFrame(df.distinct().rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), f"{kinds}, {to} long"))

    names, known = numbered(parts.select("event_id", "kind"), "e"), numbered(parts.select(*at), "j")
    table = parts.join(names, ["event_id", "kind"]).join(known, at).select("j", "e", "side").orderBy("j").toArrow()
    j, e, side = (table.column(k).to_numpy() for k in range(3))
    shared = spark.sparkContext.broadcast((np.searchsorted(j, np.arange(known.count() + 1)), e, side.astype(np.int64), max(1, names.count())))
    shapes = stored(placed.join(known, at).groupBy("chrom", "r", "m").agg(F.collect_set("j").alias("js")))
    shapes = F.broadcast(shapes) if shapes.count() <= MOST_SHAPES else shapes.hint("merge")
    held = rows.join(shapes.withColumnRenamed("chrom", "c"), (F.col("chrom") == F.col("c")) & (F.col("reps") == F.col("r")) & (F.col("mms") == F.col("m"))).select(*by, "umi_class", "cell", F.explode("js").alias("j"))
    sets = lambda df, keys: df.repartition(*keys).groupBy(*keys).agg(F.collect_set("j").alias("js"))
    masks = counted(sets(held, [*by, "umi_class", "cell"]), by, shared)
    seen = counted(sets(held.where("cell is not null").select(*by, "cell", "j").distinct(), [*by, "cell"]), by, shared).select(*by, "e", (F.col("include_only") + F.col("exclude_only") + F.col("both")).alias("cells"))
    informative = F.col("include_only") + F.col("exclude_only")
    same = F.col("x.e") == F.col("y.e")
    for c in by:
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = masks.alias("x").join(seen.alias("y"), same, "left").select("x.*", F.coalesce("y.cells", F.lit(0)).alias("cells")).where(informative >= min_informative)
    out = both.join(names, "e").select(*by, "event_id", "kind", "include_only", "exclude_only", "both", "cells", informative.alias("informative_umis"))
    return out.withColumn("usage_fraction", F.try_divide(F.col("include_only").cast("double"), F.col("informative_umis")))


def splice_paths(rows: DataFrame, chrom: str, start: int, end: int, min_support: int = 1) -> DataFrame:
    """Path fragments: the sets of supported junctions that classes hold in the window, per strand."""
    inside = junction_rows(rows.where(F.col("chrom") == chrom)).where((F.col("donor") >= start) & (F.col("acceptor") < end))
    good = inside.groupBy("donor", "acceptor").count().where(F.col("count") >= min_support).select("donor", "acceptor")
    path = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("donor", "acceptor"))), lambda j: F.concat_ws("-", j["donor"], j["acceptor"])), ",")
    per = inside.join(good, ["donor", "acceptor"]).groupBy("strand_rev", "umi_class", "cell").agg(path.alias("path"))
    return per.groupBy("strand_rev", "path").agg(F.count_distinct("umi_class").alias("umis"), cells())


def splice_edges(rows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    inside = junction_rows(rows.where(F.col("chrom") == chrom)).where((F.col("donor") >= start) & (F.col("acceptor") < end))
    source, target = (F.when(F.col("strand_rev"), F.col(x)).otherwise(F.col(y)) for x, y in (("acceptor", "donor"), ("donor", "acceptor")))
    return inside.groupBy("strand_rev", source.alias("source"), target.alias("target")).agg(umis(), cells())


def coverage(rows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Coverage of the aligned blocks of the region's records, per strand, as runs (bedGraph)."""
    b = placements(in_region(rows, chrom, start, end), mm=False).select("strand_rev", F.explode("blocks").alias("b"))
    steps = b.select("strand_rev", F.col("b.start").alias("at"), F.lit(1).alias("d")).union(b.select("strand_rev", "b.end", F.lit(-1))).groupBy("strand_rev", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("strand_rev").orderBy("at")
    out = steps.select("strand_rev", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    return out.where("depth > 0")


def three_prime(rows: DataFrame) -> DataFrame:
    """The record's 3' point: the last end on the forward, the first start on the reverse strand."""
    all_ = F.concat("reps", "mms")
    point = F.when(F.col("strand_rev"), F.array_min(F.transform(all_, span_start))).otherwise(F.array_max(F.transform(all_, span_end)))
    return rows.withColumn("point", point)


def islands(rows: DataFrame, by: list[str], at: str, gap: int, to: str = "island") -> DataFrame:
    """Single-linkage clusters: a point at most `gap` beyond the one before belongs to its cluster."""
    w = Window.partitionBy(*by).orderBy(at)
    start = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", start).withColumn(to, F.sum("__new").over(w)).drop("__new")


def apa_sites(rows: DataFrame, chrom: str, start: int, end: int, gap: int = 24) -> DataFrame:
    """3' sites of a window: clusters of points, counted once per point, strand, cell and class, with the modal point."""
    points = three_prime(rows.where(F.col("chrom") == chrom)).where(F.col("point").between(start, end - 1)).select("strand_rev", "point", "cell", "umi_class").distinct()
    # clusters are found over distinct points, not over all molecules
    counted = points.groupBy("strand_rev", "point").agg(F.count("*").alias("n"))
    sites = islands(counted, ["strand_rev"], "point", gap)
    mode = sites.groupBy("strand_rev", "island").agg(F.min("point").alias("start"), F.max("point").alias("last"), F.max_by("point", F.struct("n", -F.col("point"))).alias("cleavage"), F.sum("n").alias("umis"))
    held = points.join(sites.select("strand_rev", "point", "island"), ["strand_rev", "point"]).groupBy("strand_rev", "island").agg(cells())
    return mode.join(held, ["strand_rev", "island"]).select("strand_rev", "start", (F.col("last") + 1).alias("end"), "cleavage", "umis", "cells")


def discover(rows: DataFrame, tx: DataFrame, gap: int = 1000, min_umis: int = 10) -> DataFrame:
    """Runs of records that overlap no transcript, merged over gaps."""
    all_ = F.concat("reps", "mms")
    spans = rows.select("chrom", F.array_min(F.transform(all_, span_start)).alias("s"), F.array_max(F.transform(all_, span_end)).alias("e"), "umi_class", "cell")
    from .replay import interval_join

    genes = tx.select("chrom", span_start(F.col("exons")).alias("bstart"), span_end(F.col("exons")).alias("bend")).distinct()
    seen = spans.select("chrom", F.col("s").alias("start"), F.col("e").alias("end")).distinct()
    claimed = interval_join(seen, genes, ["chrom"]).select("chrom", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    free = spans.join(claimed, ["chrom", "s", "e"], "left_anti")
    shapes = free.groupBy("chrom", "s", "e").count()
    w = Window.partitionBy("chrom").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = shapes.withColumn("new", F.coalesce((F.col("s") > reach + gap).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w)).select("chrom", "s", "e", "run")
    out = free.join(runs, ["chrom", "s", "e"]).groupBy("chrom", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"), umis(), cells())
    return out.where(F.col("umis") >= min_umis).drop("run")


def cooccur(rows: DataFrame, predicates: dict[str, Column], universe: str) -> DataFrame:
    """Records of the universe by the states of the predicates (true, false, unknown): units, umis and cells."""
    states = {n: F.when(p, "true").when(~p, "false").otherwise("unknown") for n, p in predicates.items()}
    return rows.where(predicates[universe]).select("umi_class", "cell", *[s.alias(f"{n}_state") for n, s in states.items()]).groupBy(*[f"{n}_state" for n in states]).agg(F.count("*").alias("units"), umis(), cells())


def class_states(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Predicates over classes: OR over the class's records in three-valued logic."""
    return rows.select("umi_class", "cell", *[p.alias(n) for n, p in predicates.items()]).groupBy("umi_class", "cell").agg(*[kleene_any(F.col(n)).alias(n) for n in predicates])


def within(rows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Records of which any representative or signature overlaps the region."""
    hit = lambda blocks: overlap(blocks, start, end) >= 1
    return rows.where((F.col("chrom") == chrom) & (F.exists("reps", hit) | F.exists("mms", hit)))


def closure(rows: DataFrame, chosen: DataFrame, unit: str) -> DataFrame:
    """All records of the units that own a chosen record."""
    return rows.join(chosen.select(unit).distinct(), unit, "left_semi")


def tally(rows: DataFrame, predicates: dict[str, Column], by: list[str]) -> DataFrame:
    states = [F.when(p, "true").when(~p, "false").otherwise("unknown").alias(f"{n}_state") for n, p in predicates.items()]
    return rows.select(*by, *states).groupBy(*by, *[f"{n}_state" for n in predicates]).agg(F.count("*").alias("count"))


def support_reads(rows: DataFrame, holds) -> DataFrame:  # noqa: ANN001
    """rows with lower and upper bounds of the reads for which holds(blocks) is true.

    A lone representative stands for all reads of its chain; of two each stands for one read, and the reads left over are
    unknown unless both agree on a junction-only predicate, which the caller states by `holds` of each.
    """
    n, w = F.size("reps"), F.col("weight")
    each = F.when(n == 1, w).otherwise(1)
    true = F.aggregate("reps", F.lit(0).cast("long"), lambda s, b: s + F.when(holds(b), each).otherwise(0).cast("long"))
    rest = F.when(n > 1, w - n).otherwise(0)
    agree = F.forall("reps", holds)
    mm = F.aggregate("mms", F.lit(0).cast("long"), lambda s, b: s + F.when(holds(b), w).otherwise(0).cast("long"))
    lower = true + F.when(agree, rest).otherwise(0) + mm
    upper = true + F.when(F.exists("reps", holds), rest).otherwise(0) + mm
    return rows.withColumn("lower", lower).withColumn("upper", upper).withColumn("status", F.when(lower == upper, "exact").otherwise("bounded"))
