"""Registered queries and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import ingest
from ..operators import queries as Q
from ..operators import replay as R
from ..sources import archive as A
from ..sources import evidence as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Evidence as common tables; al: all placements (representatives and primary multimapper placements), aj: their junctions.
COMMON = """with base as (
 select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_linestatus, c.c_custkey, c.c_mktsegment, r.r_name
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
      join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey),
rec as (
 select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_linestatus) - 1 as record_id,
        r_name as sample, c_custkey as cell, c_mktsegment as grp, l_orderkey as umi_class,
        case l_partkey % 3 when 0 then 'chr1' when 1 then 'chr2' else 'chr3' end as chrom,
        l_linestatus = 'F' as strand_rev, (l_suppkey % 20) * 200 + 80 as pos, cast(l_linenumber as bigint) as weight,
        cast(l_quantity as bigint) % 3 as n_junc, l_partkey % 4 as jsel, l_tax > 0.075 as is_mm, l_discount > 0.085 as has_tail
 from base),
al as (
 select record_id, sample, cell, grp, umi_class, chrom, strand_rev, weight, n_junc, pos as anchor, is_mm, has_tail, 0 as rep_idx, case when is_mm then 0 when weight > 1 then 2 else 1 end as n_reps,
        pos as s1, pos + 20 as e1, pos + 100 + 100*jsel as s2, pos + 120 + 100*jsel as e2, pos + 200 + 100*jsel as s3, pos + 220 + 100*jsel as e3
 from rec
 union all
 select record_id, sample, cell, grp, umi_class, chrom, strand_rev, weight, n_junc, pos, is_mm, has_tail, 1, 2,
        pos + 5, pos + 20 + case when n_junc = 0 then 2 else 0 end, pos + 100 + 100*jsel, pos + 120 + 100*jsel + case when n_junc = 1 then 3 else 0 end,
        pos + 200 + 100*jsel, pos + 223 + 100*jsel
 from rec where not is_mm and weight > 1),
pl as (select *, row_number() over () as row_id, case n_junc when 0 then e1 when 1 then e2 else e3 end as pend from al),
aj as (
 select record_id, sample, cell, grp, umi_class, chrom, strand_rev, is_mm, e1 as donor, s2 as acceptor from al where n_junc >= 1
 union all select record_id, sample, cell, grp, umi_class, chrom, strand_rev, is_mm, e2, s3 from al where n_junc = 2),
tx as (
 select chrom, k, j, concat(chrom, ':g', cast(cast(floor(k/2) as bigint) as varchar)) as gene_id, concat(chrom, ':t', cast(k as varchar), '.', cast(j as varchar)) as transcript_id,
        cast(floor(k/2) as bigint) % 2 = 1 as strand_rev,
        k*200 + 50 as x1s, k*200 + 100 as x1e, k*200 + 180 + 100*j as x2s, k*200 + 200 + 100*j as x2e, k*200 + 280 + 100*j as x3s, k*200 + 340 + 100*j as x3e
 from range(20) a(k) cross join range(3) b(j) cross join (select 'chr1' as chrom union all select 'chr2' union all select 'chr3') ch),
ti as (select distinct chrom, x1e as donor, x2s as acceptor from tx union select distinct chrom, x2e, x3s from tx),
cat as (select chrom, donor, acceptor, count(*) as n from aj group by all),
"""


def register(name: str, sql: str | None = None, common: bool = True):  # noqa: ANN201
    """Register the function of stored records (or of spark and sf_dir, if it takes two) under the name; sql is its main part."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f if f.__code__.co_argcount == 2 else lambda spark, sf_dir: f(A.evidence(spark, sf_dir))
        if sql:
            ORACLES[name] = COMMON + sql if common else sql
        return f

    return add


def tx_of(rows: DataFrame, slots: int = 20, isoforms: int = 3) -> DataFrame:
    return E.annotation(rows.sparkSession, slots, isoforms)


@register("src_archive", "z as (select 1) select chrom, strand_rev, count(*) as records, count(distinct umi_class) as umis, count(distinct cell) as cells, cast(sum(weight) as bigint) as reads from rec group by all")
def src_archive(rows: DataFrame) -> DataFrame:
    by = ["chrom", "strand_rev"]
    return Q.distinct_counts(rows, by, rows.groupBy(*by).agg(F.count("*").alias("records"), F.sum("weight").alias("reads")))


@register("src_chunk_index", "z as (select 1) select chrom, cast(floor(pos / 4000000) * 4000000 as bigint) as bin_start, count(*) as n_mols, cast(max(pos) as bigint) as max_anchor from rec group by all")
def src_chunk_index(rows: DataFrame) -> DataFrame:
    return Q.chunk_index(rows)


@register("src_junc_catalogue", "z as (select 1) select chrom, cast(donor as bigint) as donor, cast(acceptor as bigint) as acceptor, n as supporting_children from cat")
def src_junc_catalogue(rows: DataFrame) -> DataFrame:
    return Q.junction_catalogue(rows)


@register("src_tail_route", "z as (select 1) select chrom, strand_rev, cast(case when strand_rev then pos else case n_junc when 0 then pos + 20 when 1 then pos + 120 + 100 * jsel else pos + 220 + 100 * jsel end end as bigint) as tail, count(distinct umi_class) as umis, count(distinct cell) as cells from rec where has_tail group by all")
def src_tail_route(rows: DataFrame) -> DataFrame:
    return rows.where("tail is not null").groupBy("chrom", "strand_rev", "tail").agg(Q.umis(), Q.cells())


@register("src_gene_spans", "z as (select 1) select chrom, gene_id, count(*) as transcripts, cast(min(x1s) as bigint) as start, cast(max(x3e) as bigint) as end_ from tx group by all")
def src_gene_spans(rows: DataFrame) -> DataFrame:
    return tx_of(rows).groupBy("chrom", "gene_id").agg(F.count("*").alias("transcripts"), F.min(E.span_start(F.col("exons"))).alias("start"), F.max(E.span_end(F.col("exons"))).alias("end_"))


for _by in ("grp", "sample", "cell"):

    @register(f"q_region_{_by}", f"z as (select 1) select {_by}, count(*) as molecules, count(distinct umi_class) as umis, count(distinct cell) as cells from rec where chrom = 'chr1' and pos >= 280 and pos < 1080 group by {_by}")
    def q_region(rows: DataFrame, by: str = _by) -> DataFrame:
        return Q.region(rows, "chr1", 280, 1080, [by])

    QUERIES[f"q_region_{_by}"] = lambda spark, sf_dir, by=_by: Q.region(A.stored_region(spark, A.evidence_path(spark, sf_dir), "chr1", 280, 1080), "chr1", 280, 1080, [by])


@register("q_junction", "z as (select 1) select grp, count(distinct umi_class) as umis, count(distinct cell) as cells from aj where chrom = 'chr1' and donor = 300 and acceptor = 480 group by grp")
def q_junction(rows: DataFrame) -> DataFrame:
    return Q.junction(rows, "chr1", 300, 480, ["grp"])


@register("fed_junction", "z as (select 1) select sample, count(distinct umi_class) as umis, count(distinct cell) as cells from aj where chrom = 'chr2' and donor = 300 and acceptor = 380 group by sample")
def fed_junction(rows: DataFrame) -> DataFrame:
    return Q.junction(rows, "chr2", 300, 380, ["sample"])


@register("q_junctions", """f as (select chrom, donor, acceptor, count(*) as supporting_children, count(distinct umi_class) as umis, count(distinct cell) as cells from aj where chrom = 'chr1' and donor >= 200 and donor < 3000 and acceptor >= 200 and acceptor < 3000 group by all having count(*) >= 3)
select chrom, cast(donor as bigint) as donor, cast(acceptor as bigint) as acceptor, supporting_children, umis, cells, exists (select 1 from ti where ti.chrom = f.chrom and ti.donor = f.donor and ti.acceptor = f.acceptor) as exact,
 exists (select 1 from ti where ti.chrom = f.chrom and ti.donor = f.donor) as donor_known, exists (select 1 from ti where ti.chrom = f.chrom and ti.acceptor = f.acceptor) as acceptor_known from f""")
def q_junctions(rows: DataFrame) -> DataFrame:
    return Q.junction_table(rows, tx_of(rows), "chr1", 200, 3000, min_support=3)


PLAN = [("a", "region", "chr1", 280, 1080), ("b", "junction", "chr1", 300, 480), ("c", "region", "chr9", 0, 100), ("d", "junction", "chr3", 300, 380), ("e", "region", "chr2", 0, 500)]
PLAN_SQL = ", ".join(map(str, PLAN))


@register("q_batch", f"""plan as (select * from (values {PLAN_SQL}) v(id, kind, chrom, s, e)),
h as (select id, umi_class, cell from plan join rec on rec.chrom = plan.chrom and pos >= s and pos < e where kind = 'region' union all select id, umi_class, cell from plan join aj on aj.chrom = plan.chrom and donor = s and acceptor = e where kind = 'junction')
select plan.id, kind, count(h.id) > 0 as present, count(distinct umi_class) as umis, count(distinct cell) as cells from plan left join h on h.id = plan.id group by plan.id, kind""")
def q_batch(rows: DataFrame) -> DataFrame:
    return Q.batch(rows, rows.sparkSession.createDataFrame(PLAN, "id string, kind string, chrom string, start long, end long"))


SIDES = """m as (select {by}, umi_class, cell, bit_or(side) as mask from hits group by all),
cn as (select {by}, count(*) filter (mask = 1) as include_only, count(*) filter (mask = 2) as exclude_only, count(*) filter (mask = 3) as both, count(distinct cell) as cells from m group by all)
select *, include_only + exclude_only as informative_umis, case when include_only + exclude_only > 0 then cast(include_only as double) / (include_only + exclude_only) end as usage_fraction from cn"""
INCLUDE, EXCLUDE = [("chr1", 300, 380), ("chr1", 500, 580)], [("chr1", 300, 480), ("chr1", 500, 680)]
HITS = "hits as (select grp, sample, umi_class, cell, case when acceptor - donor = 80 then 1 else 2 end as side from aj where chrom = 'chr1' and donor in (300, 500) and acceptor - donor in (80, 180)),"


@register("q_jset", HITS + SIDES.format(by="grp"))
def q_jset(rows: DataFrame) -> DataFrame:
    return Q.jset(rows, INCLUDE, EXCLUDE, ["grp"])


@register("col_jset", HITS + SIDES.format(by="sample"))
def col_jset(rows: DataFrame) -> DataFrame:
    return Q.jset(rows, INCLUDE, EXCLUDE, ["sample"])


#: Events over a catalogue c(chrom, donor, acceptor): a row for each component.
EVENTS = """ev as (
 select 'alt-acceptor:' || a.chrom || ':' || a.donor || '-' || a.acceptor || ':' || b.donor || '-' || b.acceptor as event_id, 'alt-acceptor' as kind, a.chrom, [(a.donor, a.acceptor, 1), (b.donor, b.acceptor, 2)] as comp from c a join c b on a.chrom = b.chrom and a.donor = b.donor and a.acceptor < b.acceptor
 union all
 select 'alt-donor:' || a.chrom || ':' || a.donor || '-' || a.acceptor || ':' || b.donor || '-' || b.acceptor, 'alt-donor', a.chrom, [(a.donor, a.acceptor, 1), (b.donor, b.acceptor, 2)] from c a join c b on a.chrom = b.chrom and a.acceptor = b.acceptor and a.donor < b.donor
 union all
 select 'cassette:' || s.chrom || ':' || a.donor || '-' || a.acceptor || ':' || b.donor || '-' || b.acceptor || ':' || s.donor || '-' || s.acceptor, 'cassette', s.chrom, [(a.donor, a.acceptor, 1), (b.donor, b.acceptor, 1), (s.donor, s.acceptor, 2)]
 from c s join c a on a.chrom = s.chrom and a.donor = s.donor and a.acceptor < s.acceptor join c b on b.chrom = s.chrom and b.acceptor = s.acceptor and b.donor >= a.acceptor and b.donor > s.donor),
co as (select event_id, kind, chrom, unnest(comp) as x from ev),
comp as (select event_id, kind, chrom, x[1] as donor, x[2] as acceptor, x[3] as side from co),
"""


@register("q_events", "c as (select * from cat where n >= 2), " + EVENTS + "hits as (select event_id, kind, umi_class, cell, side from comp join aj using (chrom, donor, acceptor)), " + SIDES.format(by="event_id, kind") + " where include_only + exclude_only >= 1")
def q_events(rows: DataFrame) -> DataFrame:
    return Q.events(rows)


@register("coh_events", "c as (select * from cat where n >= 2), " + EVENTS + "hits as (select sample, event_id, kind, umi_class, cell, side from comp join aj using (chrom, donor, acceptor)), " + SIDES.format(by="sample, event_id, kind") + " where include_only + exclude_only >= 1")
def coh_events(rows: DataFrame) -> DataFrame:
    return Q.events(rows, ["sample"])


@register("q_events_discover", "c as (select * from cat where n >= 2), " + EVENTS + "z as (select 1) select kind, chrom, count(distinct event_id) as events, count(*) as components from comp group by all")
def q_events_discover(rows: DataFrame) -> DataFrame:
    return Q.discover_events(Q.junction_catalogue(rows)).groupBy("kind", "chrom").agg(F.count_distinct("event_id").alias("events"), F.count("*").alias("components"))


@register("col_find_junctions", """u as (select chrom, donor, acceptor, sample, count(distinct umi_class) as umis, count(distinct cell) as cells from aj where not is_mm group by all)
select chrom, cast(donor as bigint) as donor, cast(acceptor as bigint) as acceptor, count(*) as exact_samples, cast(sum(umis) as bigint) as exact_umi_classes, cast(sum(cells) as bigint) as exact_cells from u
where not exists (select 1 from ti where ti.chrom = u.chrom and ti.donor = u.donor and ti.acceptor = u.acceptor) group by all having count(*) >= 5 and sum(umis) >= 20""")
def col_find_junctions(rows: DataFrame) -> DataFrame:
    """Junctions of unique evidence that no transcript has and enough samples share."""
    per = E.junction_rows(rows, mm=False).groupBy("chrom", "donor", "acceptor", "sample").agg(Q.umis(), Q.cells())
    total = per.groupBy("chrom", "donor", "acceptor").agg(F.count("*").alias("exact_samples"), F.sum("umis").alias("exact_umi_classes"), F.sum("cells").alias("exact_cells"))
    return total.where("exact_samples >= 5 and exact_umi_classes >= 20").join(Q.annotation_junctions(tx_of(rows)), ["chrom", "donor", "acceptor"], "left_anti")


@register("q_splice_paths", """w as (select * from aj where chrom = 'chr1' and donor >= 0 and acceptor < 2000),
g as (select donor, acceptor from w group by all having count(*) >= 3),
p as (select strand_rev, umi_class, cell, array_to_string(list_transform(list_sort(list_distinct(list((donor, acceptor)))), lambda x: x[1] || '-' || x[2]), ',') as path from w join g using (donor, acceptor) group by all)
select strand_rev, path, count(distinct umi_class) as umis, count(distinct cell) as cells from p group by all""")
def q_splice_paths(rows: DataFrame) -> DataFrame:
    return Q.splice_paths(rows, "chr1", 0, 2000, min_support=3)


@register("q_splice_edges", "z as (select 1) select strand_rev, cast(case when strand_rev then acceptor else donor end as bigint) as source, cast(case when strand_rev then donor else acceptor end as bigint) as target, count(distinct umi_class) as umis, count(distinct cell) as cells from aj where chrom = 'chr1' and donor >= 0 and acceptor < 2000 group by all")
def q_splice_edges(rows: DataFrame) -> DataFrame:
    return Q.splice_edges(rows, "chr1", 0, 2000)


@register("q_region_tracks", """b as (select strand_rev, s1 as s, e1 as e from al where not is_mm and chrom = 'chr1' and anchor >= 280 and anchor < 1080 union all select strand_rev, s2, e2 from al where not is_mm and n_junc >= 1 and chrom = 'chr1' and anchor >= 280 and anchor < 1080 union all select strand_rev, s3, e3 from al where not is_mm and n_junc = 2 and chrom = 'chr1' and anchor >= 280 and anchor < 1080),
d as (select strand_rev, x, sum(d) as d from (select strand_rev, s as x, 1 as d from b union all select strand_rev, e, -1 from b) group by all),
r as (select strand_rev, x as start, lead(x) over w as end_, sum(d) over w as depth from d window w as (partition by strand_rev order by x))
select strand_rev, cast(start as bigint) as start, cast(end_ as bigint) as "end", cast(depth as bigint) as depth from r where depth > 0""")
def q_region_tracks(rows: DataFrame) -> DataFrame:
    return Q.coverage(rows, "chr1", 280, 1080)


THREE = "p3 as (select record_id, umi_class, cell, strand_rev, chrom, case when strand_rev then min(s1) else max(pend) end as point from pl group by record_id, umi_class, cell, strand_rev, chrom),"


@register("fn_three_prime", THREE + " z as (select 1) select chrom, strand_rev, cast(point as bigint) as point, count(*) as n from p3 group by all")
def fn_three_prime(rows: DataFrame) -> DataFrame:
    return Q.three_prime(rows).groupBy("chrom", "strand_rev", "point").agg(F.count("*").alias("n"))


@register("q_apa", THREE + """d as (select distinct strand_rev, point, cell, umi_class from p3 where chrom = 'chr1' and point >= 0 and point < 5000),
k as (select strand_rev, point, count(*) as n from d group by all),
f as (select *, case when point - lag(point) over (partition by strand_rev order by point) > 24 then 1 else 0 end as new from k),
i as (select *, sum(new) over (partition by strand_rev order by point) as island from f),
m as (select strand_rev, island, min(point) as start, max(point) + 1 as end_, sum(n) as umis, arg_max(point, n * 1000000 - point) as cleavage from i group by all),
c as (select strand_rev, island, count(distinct cell) as cells from d join i using (strand_rev, point) group by all)
select strand_rev, cast(start as bigint) as start, cast(end_ as bigint) as "end", cast(cleavage as bigint) as cleavage, cast(umis as bigint) as umis, cells from m join c using (strand_rev, island)""")
def q_apa(rows: DataFrame) -> DataFrame:
    return Q.apa_sites(rows, "chr1", 0, 5000)


@register("q_discover", """s as (select record_id, chrom, umi_class, cell, min(s1) as s, max(pend) as e from pl group by all),
f as (select * from s where not exists (select 1 from tx where k < 10 and tx.chrom = s.chrom and s.s < x3e and s.e > x1s)),
u as (select distinct chrom, s, e from f),
n as (select *, case when s > max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) + 150 then 1 else 0 end as new from u),
r as (select *, sum(new) over (partition by chrom order by s, e) as run from n)
select chrom, cast(min(s) as bigint) as start, cast(max(e) as bigint) as "end", count(distinct umi_class) as umis, count(distinct cell) as cells from f join r using (chrom, s, e) group by chrom, run having count(distinct umi_class) >= 10""")
def q_discover(rows: DataFrame) -> DataFrame:
    return Q.discover(rows, tx_of(rows, slots=10), gap=150)


#: Three predicates of the co-occurrence query; a record without representatives has no unique evidence and is unknown.
FLAGS = """o as (select record_id, umi_class, cell, grp, sample, bool_or(not is_mm) as uniq, bool_or(not is_mm and donor = 300) as d, bool_or(not is_mm and acceptor - donor = 80) as a from aj where chrom = 'chr1' group by all),
fl as (select rec.*, coalesce(o.d, false) as d, coalesce(o.a, false) as a, case when rec.is_mm then null else coalesce(o.a, false) end as u from rec left join o using (record_id) where rec.chrom = 'chr1' and rec.pos < 1500),
"""


def predicates() -> dict:
    unique = lambda f: F.exists("reps", lambda b: F.exists(E.junctions(b), f))
    near = unique(lambda j: j["acceptor"] - j["donor"] == 80)
    return {"d": unique(lambda j: j["donor"] == 300), "a": near, "u": F.when(F.size("reps") > 0, near)}


STATE = "case when {0} is null then 'unknown' when {0} then 'true' else 'false' end as {0}_state"


@register("q_cooccur", FLAGS + f"z as (select 1) select {STATE.format('d')}, {STATE.format('a')}, {STATE.format('u')}, count(*) as units, count(distinct umi_class) as umis, count(distinct cell) as cells from fl where a group by all")
def q_cooccur(rows: DataFrame) -> DataFrame:
    return Q.cooccur(rows.where("chrom = 'chr1' and anchor < 1500"), predicates(), "a")


@register("gq_tally", FLAGS + f"z as (select 1) select grp, {STATE.format('d')}, {STATE.format('u')}, count(*) as count from fl group by all")
def gq_tally(rows: DataFrame) -> DataFrame:
    p = predicates()
    return Q.tally(rows.where("chrom = 'chr1' and anchor < 1500"), {n: p[n] for n in "du"}, ["grp"])


@register("co_unit_class", FLAGS + "k as (select umi_class, cell, bool_or(d) as d, case when count(*) filter (u) > 0 then true when count(*) filter (u is null) > 0 then null else false end as u from fl group by all) select d, u, count(*) as classes, count(distinct cell) as cells from k group by all")
def co_unit_class(rows: DataFrame) -> DataFrame:
    p = predicates()
    states = Q.class_states(rows.where("chrom = 'chr1' and anchor < 1500"), {n: p[n] for n in "du"})
    return states.groupBy("d", "u").agg(F.count("*").alias("classes"), Q.cells())


OVER = "ov as (select distinct record_id from al where chrom = 'chr2' and (s1 < 700 and e1 > 450 or n_junc >= 1 and s2 < 700 and e2 > 450 or n_junc = 2 and s3 < 700 and e3 > 450)),"


@register("gq_within", OVER + " z as (select 1) select sample, count(*) as records, count(distinct umi_class) as umis, cast(sum(weight) as bigint) as reads from rec join ov using (record_id) group by sample")
def gq_within(rows: DataFrame) -> DataFrame:
    return Q.within(rows, "chr2", 450, 700).groupBy("sample").agg(F.count("*").alias("records"), Q.umis(), F.sum("weight").alias("reads"))


@register("j_semi_closure", OVER + " z as (select distinct umi_class from rec join ov using (record_id)) select chrom, count(*) as records, count(distinct umi_class) as umis from rec where umi_class in (select umi_class from z) group by chrom")
def j_semi_closure(rows: DataFrame) -> DataFrame:
    return Q.closure(rows, Q.within(rows, "chr2", 450, 700), "umi_class").groupBy("chrom").agg(F.count("*").alias("records"), Q.umis())


@register("gq_summarize", "z as (select 1) select sample, count(*) as n, cast(sum(case when is_mm then 0 else weight end) as bigint) as reads_unique, cast(sum(case when is_mm then weight else 0 end) as bigint) as reads_multimapping, count(distinct cell) as cells, count(*) filter (has_tail) as n_true, count(*) filter (not has_tail) as n_false from rec group by sample")
def gq_summarize(rows: DataFrame) -> DataFrame:
    tailed = F.col("tail").isNotNull()
    unique = F.size("reps") > 0
    return rows.groupBy("sample").agg(F.count("*").alias("n"), F.sum(F.when(unique, F.col("weight")).otherwise(0)).alias("reads_unique"), F.sum(F.when(~unique, F.col("weight")).otherwise(0)).alias("reads_multimapping"), Q.cells(), F.count_if(tailed).alias("n_true"), F.count_if(~tailed).alias("n_false"))


@register("gq_sort_take", "z as (select cell, count(*) as n from rec group by cell) select cast(cell as bigint) as cell, n from z order by n, cell limit 25")
def gq_sort_take(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count("*").alias("n")).orderBy(F.col("n").asc_nulls_first(), F.col("cell").asc_nulls_first()).limit(25)


@register("gq_junctions", "z as (select 1) select cast(donor as bigint) as donor, cast(acceptor as bigint) as acceptor, count(distinct record_id) as records, count(distinct umi_class) as classes, count(distinct cell) as cells from aj where not is_mm and chrom = 'chr1' and donor >= 280 and acceptor <= 1080 group by all")
def gq_junctions(rows: DataFrame) -> DataFrame:
    inside = rows.where("chrom = 'chr1'").withColumn("js", F.array_distinct(F.flatten(F.transform("reps", E.junctions))))
    exploded = inside.withColumn("j", F.explode("js")).where("j.donor >= 280 and j.acceptor <= 1080")
    return exploded.groupBy("j.donor", "j.acceptor").agg(F.count("*").alias("records"), F.count_distinct("umi_class").alias("classes"), Q.cells())


@register("x_support", """h as (select record_id, sample, weight, is_mm, n_reps, count(*) filter (ok) as t, count(*) as n from (select *, coalesce(n_junc >= 1 and s2 - e1 in (80, 180), false) or (n_junc = 2 and s3 - e2 in (80, 180)) as ok from al) group by all),
b as (select sample, case when is_mm then case when t > 0 then weight else 0 end else t * case when n = 1 then weight else 1 end + case when n > 1 and t = n then weight - n else 0 end end as lo, case when is_mm then case when t > 0 then weight else 0 end else t * case when n = 1 then weight else 1 end + case when n > 1 and t > 0 then weight - n else 0 end end as hi from h)
select sample, cast(sum(lo) as bigint) as lower, cast(sum(hi) as bigint) as upper, count(*) filter (lo = hi) as exact from b group by sample""")
def x_support(rows: DataFrame) -> DataFrame:
    holds = lambda b: F.exists(E.junctions(b), lambda j: (j["acceptor"] - j["donor"]).isin(80, 180))
    return Q.support_reads(rows, holds).groupBy("sample").agg(F.sum("lower").alias("lower"), F.sum("upper").alias("upper"), F.count_if(F.col("status") == "exact").alias("exact"))


@register("p_overlaps", "z as (select chrom, sum(case when is_mm then 0 else greatest(0, least(e1, 500) - greatest(s1, 300)) + case when n_junc >= 1 then greatest(0, least(e2, 500) - greatest(s2, 300)) else 0 end + case when n_junc = 2 then greatest(0, least(e3, 500) - greatest(s3, 300)) else 0 end end) as bases from al group by chrom) select chrom, cast(bases as bigint) as bases from z")
def p_overlaps(rows: DataFrame) -> DataFrame:
    return E.placements(rows, mm=False).groupBy("chrom").agg(F.sum(G.total_overlap(F.col("blocks"), 300, 500)).alias("bases"))


@register("p_path", "z as (select 1) select chrom, count(*) filter (n_junc = 2 and e1 = 300 and s2 = 380 and e2 = 400 and s3 = 480) as paths, count(*) filter (n_junc >= 1 and abs(e1 - 301) <= 1 and abs(s2 - 378) <= 2 or n_junc = 2 and abs(e2 - 301) <= 1 and abs(s3 - 378) <= 2) as near from al group by chrom")
def p_path(rows: DataFrame) -> DataFrame:
    b = F.col("blocks")
    return E.placements(rows).groupBy("chrom").agg(F.count_if(G.has_path(b, [(300, 380), (400, 480)])).alias("paths"), F.count_if(G.has_junction(b, 301, 378, 1, 2)).alias("near"))


@register("q_any_all_unique", "h as (select record_id, sample, bool_or(pend - s1 > 120) as a, bool_and(pend - s1 > 120) as b from pl where not is_mm group by all) select sample, count(*) filter (a) as any_true, count(*) filter (b) as all_true, count(*) as n from h group by sample")
def q_any_all_unique(rows: DataFrame) -> DataFrame:
    long = lambda b: E.span_end(b) - E.span_start(b) > 120
    return rows.where(F.size("reps") > 0).groupBy("sample").agg(F.count_if(F.exists("reps", long)).alias("any_true"), F.count_if(F.forall("reps", long)).alias("all_true"), F.count("*").alias("n"))


def cand(strand: str, extra: str = "") -> str:
    fits = "(n_junc = 0 and (s1 >= x1s and e1 <= x1e or s1 >= x2s and e1 <= x2e or s1 >= x3s and e1 <= x3e) or n_junc = 1 and (s1 >= x1s and e1 = x1e and s2 = x2s and e2 <= x2e or s1 >= x2s and e1 = x2e and s2 = x3s and e2 <= x3e) or n_junc = 2 and s1 >= x1s and e1 = x1e and s2 = x2s and e2 = x2e and s3 = x3s and e3 <= x3e)"
    return f"cd as (select distinct pl.row_id, pl.sample, pl.cell, pl.umi_class, pl.weight, tx.gene_id from pl join tx on pl.chrom = tx.chrom and {strand} and {fits} {extra}), og as (select row_id, any_value(sample) as sample, any_value(cell) as cell, any_value(umi_class) as umi_class, any_value(weight) as weight, min(gene_id) as gene_id from cd group by row_id having count(*) = 1),"


FORWARD = "pl.strand_rev = tx.strand_rev"
COUNTS = """sw as (select cell, umi_class, gene_id, sum(weight) as w from og group by all),
bg as (select * from sw qualify row_number() over (partition by cell, umi_class order by w desc, gene_id) = 1),
ed as (select a.cell, a.umi_class as a, b.umi_class as b from (select distinct cell, umi_class from rec) a join (select distinct cell, umi_class from rec) b on a.cell = b.cell and a.umi_class <> b.umi_class and bit_count((xor(a.umi_class, b.umi_class) | (xor(a.umi_class, b.umi_class) >> 1)) & 5592405) = 1),
ab as (select distinct x.cell, x.gene_id, x.umi_class from bg x join ed on ed.cell = x.cell and ed.a = x.umi_class join bg y on y.cell = x.cell and y.gene_id = x.gene_id and y.umi_class = ed.b where y.w > x.w or y.w = x.w and y.umi_class < x.umi_class),
"""


@register("rp_assign", cand(FORWARD) + " z as (select 1) select gene_id, count(*) as rows_, count(distinct umi_class) as umis, cast(sum(weight) as bigint) as reads from og group by gene_id")
def rp_assign(rows: DataFrame) -> DataFrame:
    return R.gene_rows(rows, tx_of(rows)).groupBy("gene_id").agg(F.count("*").alias("rows_"), Q.umis(), F.sum("weight").alias("reads"))


@register("rp_assign_reverse", cand("pl.strand_rev <> tx.strand_rev") + " z as (select 1) select gene_id, count(*) as rows_, count(distinct umi_class) as umis from og group by gene_id")
def rp_assign_reverse(rows: DataFrame) -> DataFrame:
    return R.gene_rows(rows, tx_of(rows), "reverse").groupBy("gene_id").agg(F.count("*").alias("rows_"), Q.umis())


@register("rp_best_gene", cand(FORWARD) + COUNTS + "z as (select 1) select gene_id, count(*) as classes, cast(sum(w) as bigint) as w from bg group by gene_id")
def rp_best_gene(rows: DataFrame) -> DataFrame:
    return R.best_gene(R.gene_rows(rows, tx_of(rows))).groupBy("gene_id").agg(F.count("*").alias("classes"), F.sum("w").alias("w"))


@register("rp_collapse", cand(FORWARD) + COUNTS + "z as (select 1) select cast(cell as bigint) as cell, gene_id, count(*) as umis from bg where not exists (select 1 from ab where ab.cell = bg.cell and ab.gene_id = bg.gene_id and ab.umi_class = bg.umi_class) group by all")
def rp_collapse(rows: DataFrame) -> DataFrame:
    return R.gene_counts(rows, tx_of(rows))


@register("rp_genefull", """ge as (select chrom, gene_id, strand_rev, min(x1s) as gs, max(x3e) as ge_ from tx group by all),
cd as (select pl.row_id, pl.cell, pl.umi_class, pl.weight, ge.gene_id from pl join ge on pl.chrom = ge.chrom and pl.strand_rev = ge.strand_rev and (s1 < ge_ and e1 > gs or n_junc >= 1 and s2 < ge_ and e2 > gs or n_junc = 2 and s3 < ge_ and e3 > gs)),
og as (select row_id, any_value(umi_class) as umi_class, any_value(weight) as weight, min(gene_id) as gene_id from cd group by row_id having count(*) = 1)
select gene_id, count(*) as rows_, count(distinct umi_class) as umis, cast(sum(weight) as bigint) as reads from og group by gene_id""")
def rp_genefull(rows: DataFrame) -> DataFrame:
    return R.gene_rows(rows, tx_of(rows), full=True).groupBy("gene_id").agg(F.count("*").alias("rows_"), Q.umis(), F.sum("weight").alias("reads"))


@register("ing_umi_edges", COUNTS.split("ed as")[0] and "ed as" + COUNTS.split("ed as")[1].split("ab as")[0] + " z as (select 1) select cast(cell as bigint) as cell, cast(a as bigint) as a, cast(b as bigint) as b from ed where a < b")
def ing_umi_edges(rows: DataFrame) -> DataFrame:
    return R.umi_edges(rows)


@register("ing_locus", """k as (select distinct cell, chrom, strand_rev, pos from rec),
f as (select *, case when pos - lag(pos) over (partition by cell, chrom, strand_rev order by pos) > 600 then 1 else 0 end as new from k),
i as (select *, sum(new) over (partition by cell, chrom, strand_rev order by pos) as locus from f),
l as (select cell, chrom, strand_rev, locus, count(*) as n from i group by all)
select chrom, strand_rev, count(*) as loci, max(n) as largest from l group by all""")
def ing_locus(rows: DataFrame) -> DataFrame:
    by = ["cell", "chrom", "strand_rev"]
    loci = Q.islands(rows.select(*by, "anchor").distinct(), by, "anchor", 600).groupBy(*by, "island").agg(F.count("*").alias("n"))
    return loci.groupBy("chrom", "strand_rev").agg(F.count("*").alias("loci"), F.max("n").alias("largest"))


@register("ing_cell_renumber", "z as (select cell, count(*) as n from rec group by cell) select cast(cell as bigint) as cell, n from z qualify row_number() over (order by n desc, cell) <= 40")
def ing_cell_renumber(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "cell").limit(40)


@register("ing_cell_ids", "z as (select cell, count(*) as n from rec group by cell) select cast(cell as bigint) as cell, n, row_number() over (order by n desc, cell) - 1 as new_id from z")
def ing_cell_ids(rows: DataFrame) -> DataFrame:
    return ingest.cell_numbers(rows)


@register("s_top_cells", "k as (select grp, cell, count(distinct umi_class) as umis from rec group by all) select grp, cast(cell as bigint) as cell, umis from k qualify row_number() over (partition by grp order by umis desc, cell) <= 20")
def s_top_cells(rows: DataFrame) -> DataFrame:
    w = Q.Window.partitionBy("grp").orderBy(F.col("umis").desc(), "cell")
    return rows.groupBy("grp", "cell").agg(F.count_distinct("umi_class").alias("umis")).withColumn("r", F.row_number().over(w)).where("r <= 20").drop("r")


@register("j_cross_zero", "s as (select distinct sample from rec), d as (select distinct donor, acceptor from aj where chrom = 'chr1' and acceptor < 1500), k as (select sample, donor, acceptor, count(distinct umi_class) as umis from aj where chrom = 'chr1' and acceptor < 1500 group by all) select s.sample, cast(d.donor as bigint) as donor, cast(d.acceptor as bigint) as acceptor, coalesce(k.umis, 0) as umis from s cross join d left join k on k.sample = s.sample and k.donor = d.donor and k.acceptor = d.acceptor")
def j_cross_zero(rows: DataFrame) -> DataFrame:
    """Edges with a value for every sample: each edge carries the list of samples, so no table crosses another."""
    counts = E.junction_rows(rows.where("chrom = 'chr1'")).where("acceptor < 1500").groupBy("sample", "donor", "acceptor").agg(Q.umis())
    samples = sorted(r[0] for r in rows.select("sample").distinct().collect())
    grid = counts.select("donor", "acceptor").distinct().withColumn("sample", F.explode(F.array(*map(F.lit, samples))))
    return grid.join(counts, ["sample", "donor", "acceptor"], "left").fillna(0, ["umis"])


@register("a_median", "k as (select grp, cell, count(*) as n from rec group by all) select grp, median(n) as median from k group by grp")
def a_median(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "cell").agg(F.count("*").alias("n")).groupBy("grp").agg(F.median("n").alias("median"))


@register("w_bh", "k as (select cell, 1.0 / (1 + count(*)) as p from rec where chrom = 'chr1' group by cell), r as (select *, row_number() over (order by p, cell) as r, count(*) over () as n from k) select cast(cell as bigint) as cell, round(p, 9) as p, round(least(1.0, min(p * n / r) over (order by r desc rows unbounded preceding)), 9) as q from r")
def w_bh(rows: DataFrame) -> DataFrame:
    p = rows.where("chrom = 'chr1'").groupBy("cell").agg((F.lit(1.0) / (1 + F.count("*"))).alias("p"))
    return R.benjamini_hochberg(p, "p").select("cell", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@register("ann_compare", cand(FORWARD, "and k < 20") + COUNTS + """na as (select cell, gene_id, count(*) as n from bg where not exists (select 1 from ab where ab.cell = bg.cell and ab.gene_id = bg.gene_id and ab.umi_class = bg.umi_class) group by all),
""" + (cand(FORWARD, "and k < 18") + COUNTS).replace("cd ", "cd2 ").replace("og ", "og2 ").replace("sw ", "sw2 ").replace("bg ", "bg2 ").replace("ed ", "ed2 ").replace("ab ", "ab2 ").replace("ed.", "ed2.") + """nb as (select cell, gene_id, count(*) as n from bg2 where not exists (select 1 from ab2 where ab2.cell = bg2.cell and ab2.gene_id = bg2.gene_id and ab2.umi_class = bg2.umi_class) group by all)
select cast(coalesce(na.cell, nb.cell) as bigint) as cell, coalesce(na.gene_id, nb.gene_id) as gene_id, coalesce(na.n, 0) as annotation_a_count, coalesce(nb.n, 0) as annotation_b_count, coalesce(nb.n, 0) - coalesce(na.n, 0) as signed_delta_b_minus_a from na full join nb on na.cell = nb.cell and na.gene_id = nb.gene_id where coalesce(na.n, 0) <> coalesce(nb.n, 0)""")
def ann_compare(rows: DataFrame) -> DataFrame:
    return R.compare(rows, tx_of(rows), tx_of(rows, slots=18))


@register("fn_scalars", "select c_custkey, case when c_custkey % 2 = 0 then struct_pack(s := cast(c_custkey as bigint), e := cast(c_custkey + 10 as bigint)).s end as start, c_custkey * 1000 + c_nationkey as packed_sum, 'ENSG' || cast(c_custkey as varchar) as gene from customer", common=False)
def fn_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    end = F.when(k % 2 == 0, k + 10).otherwise(k - 1)
    locus = G.parse_locus(F.concat(F.lit("chr1:"), F.format_number(k, 0), F.lit("-"), end.cast("string")))
    return c.select("c_custkey", locus["start"].alias("start"), (k * 1000 + F.col("c_nationkey")).alias("packed_sum"), G.unversion(F.concat(F.lit("ENSG"), k.cast("string"), F.lit(".12"))).alias("gene"))
