"""Further registered queries: ingest, ends, candidate sets, populations, labels, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ends as N
from ..operators import ingest as I
from ..operators import queries as Q
from ..operators import replay as R
from ..sources import archive as A
from ..sources import evidence as E
from . import pipeline_language as L
from .catalogue import COUNTS, EVENTS, FORWARD, ORACLES, OVER, THREE, cand, register, tx_of

SQL = "z as (select 1) "
CHAIN = "n_junc, case when n_junc >= 1 then e1 end, case when n_junc >= 1 then s2 end, case when n_junc = 2 then e2 end, case when n_junc = 2 then s3 end"


@register("ing_order", "k as (select distinct chrom, pos, cell, umi_class, strand_rev from rec), o as (select *, row_number() over (order by chrom, pos, cell, umi_class, strand_rev) - 1 as ordinal from k) select chrom, cast(pos as bigint) as anchor, cast(cell as bigint) as cell, cast(umi_class as bigint) as umi_class, strand_rev, ordinal from o")
def ing_order(rows: DataFrame) -> DataFrame:
    return I.ordinals(rows)


@register("ing_chain_reduce", f"c as (select chrom, arg_min(pend, s1 * 1000000 - pend) as fe, min(s1) as fs, arg_max(s1, s1 * 1000000 - pend) as ls, arg_max(pend, s1 * 1000000 - pend) as le, count(*) as seen from pl where not is_mm group by cell, umi_class, chrom, strand_rev, {CHAIN}) select chrom, count(*) as chains, cast(sum(fs + 3 * fe) as bigint) as firsts, cast(sum(ls + 3 * le) as bigint) as lasts, cast(sum(seen) as bigint) as seen from c group by chrom")
def ing_chain_reduce(rows: DataFrame) -> DataFrame:
    mark = lambda c: F.sum(E.span_start(F.col(c)) + 3 * E.span_end(F.col(c)))
    return I.chains(rows).groupBy("chrom").agg(F.count("*").alias("chains"), mark("first").alias("firsts"), mark("last").alias("lasts"), F.sum("seen").alias("seen"))


@register("ing_geom_fidelity", f"g as (select chrom, count(*) as seen from pl where not is_mm group by cell, umi_class, chrom, strand_rev, s1, pend, {CHAIN}) select chrom, count(*) as geometries, max(seen) as most, cast(sum(seen) as bigint) as seen from g group by chrom")
def ing_geom_fidelity(rows: DataFrame) -> DataFrame:
    return I.geometries(rows).groupBy("chrom").agg(F.count("*").alias("geometries"), F.max("seen").alias("most"), F.sum("seen").alias("seen"))


@register("ing_mm_agg", f"g as (select chrom, sum(weight) as w from pl where is_mm group by cell, umi_class, chrom, strand_rev, s1, pend, {CHAIN}) select chrom, count(*) as signatures, cast(max(w) as bigint) as most, cast(sum(w) as bigint) as weight from g group by chrom")
def ing_mm_agg(rows: DataFrame) -> DataFrame:
    return I.signatures(rows).groupBy("chrom").agg(F.count("*").alias("signatures"), F.max("weight").alias("most"), F.sum("weight").alias("weight"))


@register("ing_sjdb", SQL + "select distinct chrom, strand_rev, cast(x1e as bigint) as donor, cast(x2s as bigint) as acceptor from tx union select distinct chrom, strand_rev, cast(x2e as bigint), cast(x3s as bigint) from tx")
def ing_sjdb(rows: DataFrame) -> DataFrame:
    return I.splice_table(tx_of(rows))


@register("ing_cigar", "select l_partkey % 7 as gap, count(*) as n, cast(sum(l_suppkey + 32) as bigint) as donors, cast(sum(l_suppkey + 32 + 100 + l_partkey % 7) as bigint) as acceptors, cast(sum(l_suppkey + 32 + 100 + l_partkey % 7 + 19) as bigint) as ends from lineitem group by 1", common=False)
def ing_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("l_partkey") % 7
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(gap.alias("gap"), F.concat(F.lit("5S20M2D10M"), (gap + 100).cast("string"), F.lit("N15M3I4=2S1H")).alias("cigar"), "l_suppkey")
    b = lines.withColumn("b", I.cigar_blocks(F.col("l_suppkey"), F.col("cigar")))
    j = F.get(E.junctions(F.col("b")), F.lit(0))
    return b.groupBy("gap").agg(F.count("*").alias("n"), F.sum(j["donor"]).alias("donors"), F.sum(j["acceptor"]).alias("acceptors"), F.sum(E.span_end(F.col("b"))).alias("ends"))


@register("ing_bc_correct", """with wl as (select (c_custkey * 2654435761) % 4294967296 as code from customer),
rd as (select o_orderkey as read, xor((o_custkey * 2654435761) % 4294967296, case when o_orderkey % 4 = 0 then (1 + o_orderkey % 3) << cast(2 * (15 - o_orderkey % 16) as int) else 0 end) as code from orders),
ct as (select wl.code, count(rd.read) as n from wl left join rd on rd.code = wl.code group by wl.code),
df as (select read, rd.code, ct.code as cell, n, xor(rd.code, ct.code) as d from rd join ct on bit_count((xor(rd.code, ct.code) | (xor(rd.code, ct.code) >> 1)) & 1431655765) = 1 where rd.code not in (select code from wl)),
w as (select *, (n + 1) * pow(10.0, -least(33, 10 + (read + 15 - cast(floor(log2(d) / 2) as bigint)) % 30) / 10.0) as w from df),
b as (select read, arg_max(cell, w) as cell from w group by read having max(w) / sum(w) > 0.975)
select cell, count(*) as reads, count(*) filter (kind = 1) as corrected from (select code as cell, 0 as kind from rd where code in (select code from wl) union all select cell, 1 from b) group by cell""", common=False)
def ing_bc_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.col(c).cast("long") * 2654435761 % 4294967296
    k = F.col("o_orderkey").cast("long")
    wrong = F.when(k % 4 == 0, (1 + k % 3) * F.pow(F.lit(4.0), 15 - k % 16).cast("long")).otherwise(0)
    quals = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((10 + (k + i) % 30)).cast("int"))
    reads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("read"), code("o_custkey").bitwiseXOR(wrong).alias("code"), quals.alias("quals"))
    listed = spark.read.parquet(f"{sf_dir}/customer.parquet").select(code("c_custkey").alias("code"))
    return I.correct_barcodes(reads, listed).groupBy("cell").agg(F.count("*").alias("reads"), F.count_if(F.col("cell") != F.col("code")).alias("corrected"))


#: Rows of equal content count apart, as in the SQL each has its own number.
SETS = cand(FORWARD).split("og as")[0] + "nf as (select pl.row_id, pl.cell, pl.umi_class, pl.weight, (select count(*) from cd where cd.row_id = pl.row_id) as k from pl), "


@register("rp_audit", SETS + SQL + "select case when k = 0 then 'none' when k = 1 then 'single' else 'multi' end as bucket, count(*) as rows_, cast(sum(weight) as bigint) as reads from nf group by 1")
def rp_audit(rows: DataFrame) -> DataFrame:
    return R.audit(rows, tx_of(rows))


@register("rp_stats", SETS + "f as (select cell, umi_class, bool_or(k = 1) as one, bool_or(k > 1) as more from nf group by all) select case when one and more then 'mixed' when one then 'single' when more then 'multi_only' else 'no_gene' end as fate, count(*) as classes, count(distinct cell) as cells from f group by 1")
def rp_stats(rows: DataFrame) -> DataFrame:
    return R.fates(rows, tx_of(rows))


@register("q_transcript_ecs", cand(FORWARD).split("og as")[0].replace("tx.gene_id", "tx.transcript_id") + """u as (select pl.cell, pl.umi_class, count(*) as n, count(*) filter (cd0.row_id is null) as unmatched from pl left join (select distinct row_id from cd) cd0 on cd0.row_id = pl.row_id group by all),
h as (select cell, umi_class, transcript_id, count(*) as k from cd group by all),
t as (select u.cell, u.umi_class, string_agg(transcript_id, ',' order by transcript_id) as ts, count(*) as m from h join u on h.cell = u.cell and h.umi_class = u.umi_class where k = n - unmatched group by all),
s as (select u.cell, u.umi_class, case when unmatched > 0 then 'no_compatible' when t.ts is null then 'conflict' else 'assigned' end as status, case when unmatched = 0 then ts end as ts, case when unmatched = 0 then m end as m from u left join t on t.cell = u.cell and t.umi_class = u.umi_class)
select status, sha256(ts) as ec_id, cast(coalesce(m, 0) as int) as transcripts, count(*) as classes, count(distinct cell) as cells from s group by all""")
def q_transcript_ecs(rows: DataFrame) -> DataFrame:
    return R.equivalence_classes(rows, tx_of(rows))


@register("q_apa_test", THREE + """gw as (select chrom, gene_id, strand_rev, min(x1s) as gs, max(x3e) as ge_ from tx group by all),
pt as (select distinct chrom, strand_rev, point, grp, p3.cell, p3.umi_class from p3 join (select distinct record_id as rid, grp from rec) on rid = record_id),
pg as (select gene_id, point, grp, count(*) as n from pt join gw on gw.chrom = pt.chrom and gw.strand_rev = pt.strand_rev and point >= gs and point < ge_ group by all),
f as (select gene_id, point, case when point - lag(point) over (partition by gene_id order by point) > 24 then 1 else 0 end as new from (select distinct gene_id, point from pg)),
i as (select gene_id, point, sum(new) over (partition by gene_id order by point) as site from f),
tb as (select gene_id, site, grp, sum(n) as n from pg join i using (gene_id, point) group by all),
bs as (select gene_id, site, sum(n) as m from tb group by all having sum(n) >= 5),
gk as (select gene_id, count(*) as sites, sum(m) as umis from bs group by all having sum(m) >= 20 and count(*) >= 2),
k as (select tb.* from tb join bs using (gene_id, site) join gk using (gene_id)),
w as (select *, sum(n) over (partition by gene_id, site) as r, sum(n) over (partition by gene_id, grp) as c, sum(n) over (partition by gene_id) as t from k)
select gene_id, round(greatest(0, sum(2 * n * ln(n * t / (r * c)))), 6) as g, (count(distinct site) - 1) * (count(distinct grp) - 1) as df, any_value(sites) as sites, cast(any_value(umis) as bigint) as umis from w join gk using (gene_id) group by gene_id""")
def q_apa_test(rows: DataFrame) -> DataFrame:
    return N.end_tests(rows, tx_of(rows)).withColumn("g", F.round("g", 6))


@register("w_anchor_window", THREE + """d as (select distinct chrom, strand_rev, point from p3),
w as (select chrom, strand_rev, min(point) as start from d group by all union all
 select w.chrom, w.strand_rev, (select min(point) from d where d.chrom = w.chrom and d.strand_rev = w.strand_rev and d.point > w.start + 60) from w where w.start is not null)
select w.chrom, w.strand_rev, cast(start as bigint) as start, cast(max(point) + 1 as bigint) as "end", count(*) as points from w join d on d.chrom = w.chrom and d.strand_rev = w.strand_rev and point >= start and point <= start + 60 group by all""")
def w_anchor_window(rows: DataFrame) -> DataFrame:
    return N.anchored_windows(Q.three_prime(rows), ["chrom", "strand_rev"], "point", 60)


ORACLES["w_anchor_window"] = ORACLES["w_anchor_window"].replace("with base", "with recursive base", 1)


@register("j_nearest", THREE + "s as (select distinct chrom, strand_rev, case when strand_rev then x1s else x3e end as site from tx), d as (select distinct chrom, strand_rev, point from p3) select chrom, strand_rev, cast(point as bigint) as point, cast(min(abs(point - site)) as bigint) as distance from d join s using (chrom, strand_rev) group by all")
def j_nearest(rows: DataFrame) -> DataFrame:
    sites = tx_of(rows).select("chrom", "strand_rev", F.when(F.col("strand_rev"), E.span_start(F.col("exons"))).otherwise(E.span_end(F.col("exons"))).alias("site")).distinct()
    return N.nearest(Q.three_prime(rows).select("chrom", "strand_rev", "point").distinct(), sites, ["chrom", "strand_rev"])


@register("col_tails", """t as (select distinct chrom, strand_rev, case when strand_rev then pos else case n_junc when 0 then pos + 20 when 1 then pos + 120 + 100 * jsel else pos + 220 + 100 * jsel end end as a, umi_class, cell, sample from rec where has_tail),
k as (select chrom, strand_rev, a, count(distinct umi_class) as n from t group by all),
f as (select *, case when a - lag(a) over (partition by chrom, strand_rev order by a) > 25 then 1 else 0 end as new from k),
i as (select *, sum(new) over (partition by chrom, strand_rev order by a) as c from f)
select i.chrom, i.strand_rev, cast(min(i.a) as bigint) as start, cast(max(i.a) + 1 as bigint) as "end", cast(arg_max(i.a, i.n * 1000000 - i.a) as bigint) as summit, count(distinct umi_class) as umis, count(distinct cell) as cells, count(distinct sample) as samples from i join t on t.chrom = i.chrom and t.strand_rev = i.strand_rev and t.a = i.a group by i.chrom, i.strand_rev, c""")
def col_tails(rows: DataFrame) -> DataFrame:
    return N.tail_clusters(rows)


@register("j_left_meta", "select case when c_custkey % 3 <> 0 then c_mktsegment end as cell_type, count(*) as records, count(distinct l_orderkey) as umis from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1", common=False)
def j_left_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by an optional column of the cells' metadata; cells without it keep a group of their own."""
    meta = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("long").alias("cell"), F.col("c_mktsegment").alias("cell_type"))
    return A.evidence(spark, sf_dir).join(meta, "cell", "left").groupBy("cell_type").agg(F.count("*").alias("records"), Q.umis())


@register("a_populations", OVER + SQL + "select sample, count(*) filter (ov.record_id is not null) as population_units, count(*) as source_scope_units, count(distinct cell) as source_scope_cells from rec left join ov using (record_id) group by sample")
def a_populations(rows: DataFrame) -> DataFrame:
    """Denominators by group, before any filter on evidence: units that the region witnesses, and all of the source."""
    seen = Q.within(rows, "chr2", 450, 700).groupBy("sample").agg(F.count("*").alias("population_units"))
    return rows.groupBy("sample").agg(F.count("*").alias("source_scope_units"), F.count_distinct("cell").alias("source_scope_cells")).join(seen, "sample", "left").fillna(0, ["population_units"])


@register("set_region_union", "x as (select distinct chrom, s, e from (select chrom, x1s as s, x1e as e from tx union all select chrom, x2s, x2e from tx union all select chrom, x3s, x3e from tx)), f as (select *, case when s > max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from x), i as (select *, sum(new) over (partition by chrom order by s, e) as g from f) select chrom, cast(min(s) as bigint) as start, cast(max(e) as bigint) as \"end\" from i group by chrom, g")
def set_region_union(rows: DataFrame) -> DataFrame:
    """Exons of an annotation, touching ones merged."""
    x = tx_of(rows).select("chrom", F.explode("exons").alias("x")).select("chrom", "x.start", "x.end").distinct()
    w = Q.Window.partitionBy("chrom").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Q.Window.unboundedPreceding, -1))
    runs = x.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("g", F.sum("new").over(w))
    return runs.groupBy("chrom", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


@register("q_event_labels", "c as (select * from cat where n >= 2), " + EVENTS + "ai as (select chrom, x1e as donor, x2s as acceptor, gene_id from tx union select chrom, x2e, x3s, gene_id from tx), an as (select chrom, donor, acceptor, min(gene_id) as gene_id from ai group by all) select event_id, kind, count(*) as components, count(an.gene_id) as annotated, min(an.gene_id) as gene_id from comp left join an on an.chrom = comp.chrom and an.donor = comp.donor and an.acceptor = comp.acceptor group by event_id, kind")
def q_event_labels(rows: DataFrame) -> DataFrame:
    """Events with how many of their junctions the annotation has, and a gene of those."""
    known = tx_of(rows).select("chrom", "gene_id", F.explode(E.junctions(F.col("exons"))).alias("j")).groupBy("chrom", F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor")).agg(F.min("gene_id").alias("gene_id"))
    return Q.discover_events(Q.junction_catalogue(rows)).join(known, ["chrom", "donor", "acceptor"], "left").groupBy("event_id", "kind").agg(F.count("*").alias("components"), F.count("gene_id").alias("annotated"), F.min("gene_id").alias("gene_id"))


@register("fed_status", "s as (select sample, bool_or(chrom = 'chr2') as has from rec group by all), k as (select sample, count(distinct umi_class) as umis from aj where chrom = 'chr2' and donor = 300 and acceptor = 380 group by all) select s.sample, case when not has then 'chromosome_absent' when umis is null then 'junction_absent' else 'present' end as status, coalesce(umis, 0) as umis from s left join k using (sample)")
def fed_status(rows: DataFrame) -> DataFrame:
    there = rows.groupBy("sample").agg(F.max(F.col("chrom") == "chr2").alias("has"))
    found = Q.junction(rows, "chr2", 300, 380, ["sample"]).select("sample", "umis")
    status = F.when(~F.col("has"), "chromosome_absent").when(F.col("umis").isNull(), "junction_absent").otherwise("present")
    return there.join(found, "sample", "left").select("sample", status.alias("status"), F.coalesce("umis", F.lit(0)).alias("umis"))


@register("snk_mex", cand(FORWARD) + COUNTS + "n as (select cell, gene_id, count(*) as umis from bg where not exists (select 1 from ab where ab.cell = bg.cell and ab.gene_id = bg.gene_id and ab.umi_class = bg.umi_class) group by all) select cast(dense_rank() over (order by gene_id) as int) as feature, cast(dense_rank() over (order by cell) as int) as barcode, umis from n")
def snk_mex(rows: DataFrame) -> DataFrame:
    """Entries of the sparse matrix of features and barcodes, both numbered from 1 in order."""
    n = R.gene_counts(rows, tx_of(rows))
    number = lambda c, to: n.select(c).distinct().withColumn(to, F.row_number().over(Q.Window.orderBy(c)))
    return n.join(number("gene_id", "feature"), "gene_id").join(number("cell", "barcode"), "cell").select("feature", "barcode", "umis")


FROM, TO = "abcdefghijklmnopqrstuvwxyz", "AACACCGGGTTTCACGTACTGACGTA"


@register("fn_ip", f"""with s as (select doc_id, translate(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g'), '{FROM}', '{TO}') as q from documents),
w as (select doc_id, substr(q, 101, 140) as b, substr(q, 41, 55) as u from s)
select doc_id, length(left(b, 20)) - length(replace(left(b, 20), 'A', '')) as a20, coalesce(list_max(list_transform(string_split(regexp_replace(b, '[^A]', ' ', 'g'), ' '), lambda x: length(x))), 0) as run,
 case {" ".join(f"when contains(u, '{m}') then '{m}'" for m in N.PAS)} end as motif from w""", common=False)
def fn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal priming and signals at base 100 of a stand-in for a genome: the letters of the documents."""
    text = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", ""), FROM, TO)
    p = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("q"))
    ip = N.priming(F.col("q"), F.lit(100))
    return p.select("doc_id", ip["a20"].alias("a20"), ip["run"].alias("run"), N.signal(F.col("q"), F.lit(100)).alias("motif"))


def ov(a: str, b: str) -> str:
    return f"greatest(0, least({b}, 420) - greatest({a}, 300))"


#: Records that a placement puts into chr1:280-1080.
SEEN = "sn as (select distinct record_id from al where chrom = 'chr1' and (s1 < 1080 and e1 > 280 or n_junc >= 1 and s2 < 1080 and e2 > 280 or n_junc = 2 and s3 < 1080 and e3 > 280)),"
WHOLE = f"greatest({ov('s1', 'e1')}, case when n_junc >= 1 then {ov('s2', 'e2')} else 0 end, case when n_junc = 2 then {ov('s3', 'e3')} else 0 end)"
#: The omitted alignment of two representatives that start apart: what it overlaps at least and at most.
LEAST = f"case n_junc when 0 then 0 when 1 then greatest({ov('s1', 'e1')}, {ov('s2', 's2 + 1')}) else greatest({ov('s1', 'e1')}, {ov('s2', 'e2')}, {ov('s3', 's3 + 1')}) end"
MOST = f"case n_junc when 0 then {ov('s1 - 5', '1e9')} when 1 then greatest({ov('s1 - 5', 'e1')}, {ov('s2', '1e9')}) else greatest({ov('s1 - 5', 'e1')}, {ov('s2', 'e2')}, {ov('s3', '1e9')}) end"


def program(name: str, text: str, sql: str) -> None:
    register(name, sql)(lambda rows: L.query(text, rows))


program(
    "gq_run_tally",
    """header {gq = 1} # states of a record's predicates, jointly
    let RO = j[chr1:300..480]
    fn covers(r, least) = overlaps(r, min: least)
    from @x.records
    |> within g[chr1:280..1080]
    |> derive { ra = any unique { covers(g[chr1:300..420], 12bp) }, ro = any unique { RO }, st = all stored { !RO } }
    |> tally {ra, ro, st} by {sample}""",
    SEEN + f"""o as (select record_id, {WHOLE} >= 12 as p, n_junc >= 1 and e1 = 300 and s2 = 480 or n_junc = 2 and e2 = 300 and s3 = 480 as q from al where not is_mm and chrom = 'chr1'
    union all select record_id, case when {LEAST} >= 12 then true when {MOST} < 12 then false end, false from al where rep_idx = 1 and weight > 2 and chrom = 'chr1'),
    r as (select record_id, case when count(*) filter (p) > 0 then 'true' when count(*) filter (p is null) > 0 then 'unknown' else 'false' end as ra, bool_or(q) as ro from o group by record_id)
    select sample, coalesce(ra, 'false') as ra_state, case when coalesce(ro, false) then 'true' else 'false' end as ro_state, case when coalesce(ro, false) then 'false' else 'true' end as st_state, count(*) as count from rec join sn using (record_id) left join r using (record_id) group by all""",
)
program(
    "gq_run_classes",
    """header {gq = 1}
    from @x.classes |> within j[chr1:300..480]
    |> where any record { any unique { j[chr1:300..480] & !near(j[chr1:500..681], left: 0bp, right: 1bp) } } & reads.total >= 3u64
    |> summarize {n = count(), reads = sum(reads.total), unique = sum(reads.unique)} by {sample}""",
    """w as (select distinct sample, cell, umi_class from aj where chrom = 'chr1' and donor = 300 and acceptor = 480),
    p as (select distinct sample, cell, umi_class from al where not is_mm and chrom = 'chr1' and (n_junc >= 1 and e1 = 300 and s2 = 480 or n_junc = 2 and e2 = 300 and s3 = 480) and not (n_junc >= 1 and e1 = 500 and abs(s2 - 681) <= 1 or n_junc = 2 and e2 = 500 and abs(s3 - 681) <= 1)),
    u as (select rec.sample, sum(weight) as t, sum(case when is_mm then 0 else weight end) as q from rec join w on w.cell = rec.cell and w.umi_class = rec.umi_class join p on p.cell = rec.cell and p.umi_class = rec.umi_class group by rec.sample, rec.cell, rec.umi_class having sum(weight) >= 3)
    select sample, count(*) as n, cast(sum(t) as bigint) as reads, cast(sum(q) as bigint) as unique from u group by sample""",
)
program(
    "gq_run_select",
    """header {gq = 1}
    from @x.cells |> within all
    |> derive {u = fraction(reads.unique, denominator: reads.total)}
    |> select {unit.id, reads.total, u} |> sort {reads.total} |> take 30""",
    "c as (select sample, cell, sum(weight) as t, sum(case when is_mm then 0 else weight end) as q from rec group by all) select sample || ':' || cell as unit_id, cast(t as bigint) as reads_total, cast(q as double) / t as u from c order by reads_total, unit_id, u limit 30",
)
program(
    "gq_run_junctions",
    "header {gq = 1} from junctions(@x, within: g[chr1:280..1080]) |> support(unit: class, by: {sample})",
    SQL + "select sample, cast(donor as bigint) as donor, cast(acceptor as bigint) as acceptor, count(distinct umi_class) as support from aj where not is_mm and chrom = 'chr1' and donor >= 280 and acceptor <= 1080 group by all",
)
