"""A typed pipeline language over evidence, compiled to one DataFrame plan.

    header {gq=1}  let A = j[chr1:300..380:+]  fn f(r) = overlaps(r, min: 12bp)
    from @x.records |> within g[chr1:0..900] |> derive {a = any unique {A & f(g[chr1:0..400])}} |> tally {a} by {sample}

Predicates are true, false or unknown (null). Where two representatives stand for more reads, `unique` also ranges over
one omitted alignment: it has the same junctions, starts between the representatives' starts, and ends between their ends
if the starts agree, else anywhere beyond its last acceptor. It is kept as a smallest and a largest geometry.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import has_path, has_subpath, kleene_all, kleene_any
from ..sources.evidence import junctions, span_end, span_start

TOKEN = re.compile(r"\s+|#[^\n]*|(?P<t>[gj]\[[^\]]*\]|\"[^\"]*\"|[0-9]+(?:\.[0-9]+)?(?:bp|u64)?|@?[A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*)*|\|>|>>|~>|->|[=!<>]=|[-=!<>&|+*/(){}\[\],:.])")
#: End of an omitted alignment that nothing bounds; nesting that an expression may have.
FAR, DEEPEST = 1 << 32, 64
DOMAINS = ("unique", "stored", "multimap", "alternative", "record")
UNITS = {"records": [], "classes": ["sample", "cell", "umi_class"], "cells": ["sample", "cell"]}


class QueryError(ValueError):
    pass


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"byte {at}: unexpected {text[at]!r}")
        if m["t"]:
            out.append(m["t"])
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i, self.depth = tokens(text), 0, 0
        self.lets: dict[str, tuple] = {}
        self.fns: dict[str, tuple[list[str], tuple]] = {}

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def next(self, *wanted: str) -> str:
        x = self.peek()
        if not x or wanted and x not in wanted:
            raise QueryError(f"expected {' or '.join(wanted) or 'more'}, found {x or 'the end'}")
        self.i += 1
        return x

    def took(self, x: str) -> bool:
        if self.peek() == x:
            self.i += 1
            return True
        return False

    def fields(self, named: bool) -> list[tuple[str, tuple]]:
        """{a = e, b = e}, or {a, b} where names need not be given."""
        out: list[tuple[str, tuple]] = []
        self.next("{")
        while not self.took("}"):
            if self.i + 1 < len(self.t) and self.t[self.i + 1] == "=":
                name = self.next()
                self.next("=")
                out.append((name, self.expr()))
            elif named:
                raise QueryError(f"{self.peek()} needs a name")
            else:
                out.append((self.peek(), self.expr()))
            if self.peek() != "}":
                self.next(",")
        return out

    def document(self) -> dict:
        self.next("header")
        header = {n: e[-1] for n, e in self.fields(True)}
        if header.get("gq") != 1:
            raise QueryError("header needs gq = 1")
        while self.peek() in ("let", "fn", "export"):
            exported = self.took("export")
            if self.next() == "let":
                name = self.next()
                self.next("=")
                self.lets[name] = self.expr()
                continue
            name, params = self.next(), []
            self.next("(")
            while not self.took(")"):
                params.append(self.next())
                if exported or self.peek() == ":":
                    self.next(":")
                    self.kind()
                if self.peek() != ")":
                    self.next(",")
            if exported or self.peek() == "->":
                self.next("->")
                self.kind()
            self.next("=")
            self.fns[name] = (params, self.expr())
        self.next("from")
        source, stages = self.next(), []
        if source == "junctions":
            self.next("(")
            self.next()
            for x in (",", "within", ":"):
                self.next(x)
            source, stages = "junctions", [("within", self.expr())]
            self.next(")")
        else:
            source = source.rpartition(".")[2]
            if source not in UNITS:
                raise QueryError(f"unknown unit {source}")
        while self.took("|>"):
            stages.append(self.stage())
        if self.peek():
            raise QueryError(f"unexpected {self.peek()}")
        return {"header": header, "source": source, "stages": stages}

    def kind(self) -> None:
        """A type: a name, with parameters in angle brackets."""
        self.next()
        if self.took("<"):
            while not self.took(">"):
                self.next()

    def stage(self) -> tuple:
        kind = self.next("within", "where", "derive", "select", "tally", "summarize", "sort", "take", "support")
        if kind in ("within", "where"):
            return kind, self.expr()
        if kind == "take":
            return kind, int(self.next())
        if kind == "support":
            for x in ("(", "unit", ":"):
                self.next(x)
            unit, by = self.next("record", "class", "cell"), []
            if self.took(","):
                self.next("by")
                self.next(":")
                by = self.fields(False)
            self.next(")")
            return kind, unit, by
        out = self.fields(kind in ("derive", "summarize"))
        by = self.fields(False) if kind in ("tally", "summarize") and self.took("by") else []
        return kind, out, by

    def binary(self, lower, *ops: str) -> tuple:  # noqa: ANN001
        x = lower()
        while self.peek() in ops:
            x = (self.next(), x, lower())
        return x

    def expr(self) -> tuple:
        self.depth += 1
        if self.depth > DEEPEST:
            raise QueryError("nested too deeply")
        out = self.binary(lambda: self.binary(self.inverse, "&"), "|")
        self.depth -= 1
        return out

    def inverse(self) -> tuple:
        n = 0
        while self.took("!"):
            n += 1
        x = self.compare()
        return ("!", x) if n % 2 else x

    def compare(self) -> tuple:
        x = self.paths()
        if self.peek() in ("==", "!=", "<", "<=", ">", ">="):
            return self.next(), x, self.paths()
        out = self.peek() == "not" and self.took("not")
        if out or self.peek() == "in":
            self.next("in")
            self.next("[")
            items = []
            while not self.took("]"):
                items.append(self.primary())
                if self.peek() != "]":
                    self.next(",")
            return ("!", ("in", x, items)) if out else ("in", x, items)
        return x

    def paths(self) -> tuple:
        return self.binary(lambda: self.binary(lambda: self.binary(self.primary, "*", "/"), "+", "-"), ">>", "~>")

    def primary(self) -> tuple:
        x = self.next()
        if x == "(":
            out = self.expr()
            self.next(")")
            return out
        if x == "-":
            return "neg", self.primary()
        if x[0] == '"':
            return "string", x[1:-1]
        if x[0].isdigit():
            n = re.match(r"[0-9.]+", x)[0]
            return ("count", int(n)) if x.endswith(("bp", "u64")) else ("number", float(n))
        if x[:2] in ("g[", "j["):
            m = re.fullmatch(r"([^:]+):([0-9]+)\.\.([0-9]+)(?::([+-]))?", re.sub(r"[\s,]", "", x[2:-1]))
            if not m or int(m[2]) >= int(m[3]):
                raise QueryError(f"not a coordinate: {x}")
            return ("region" if x[0] == "g" else "junction"), m[1], int(m[2]), int(m[3]), m[4]
        if x in ("any", "all") and self.peek() in DOMAINS:
            domain = self.next()
            self.next("{")
            out = self.expr()
            self.next("}")
            return x, domain, out
        if x in ("true", "false", "unknown", "null"):
            return (x,)
        if not re.match(r"[A-Za-z_]", x):
            raise QueryError(f"unexpected {x}")
        if not self.took("("):
            return "name", x
        args, named = [], {}
        while not self.took(")"):
            if self.i + 1 < len(self.t) and self.t[self.i + 1] == ":":
                name = self.next()
                self.next(":")
                named[name] = self.expr()
            else:
                args.append(self.expr())
            if self.peek() != ")":
                self.next(",")
        return "call", x, args, named


def placed(blocks: Column, inner: Column | None = None, chrom: Column | None = None, rev: Column | None = None) -> Column:
    return F.struct((F.col("chrom") if chrom is None else chrom).alias("chrom"), (F.col("strand_rev") if rev is None else rev).alias("rev"), (blocks if inner is None else inner).alias("inner"), blocks.alias("outer"))


def moved(blocks: Column, start: Column, end: Column) -> Column:
    """The blocks with another start and end."""
    n = F.size(blocks)
    return F.transform(blocks, lambda b, i: F.struct(F.when(i == 0, start).otherwise(b["start"]).alias("start"), F.when(i == n - 1, end).otherwise(b["end"]).alias("end")))


def observed(rows: DataFrame) -> DataFrame:
    """rows with the domains: stored and unique alignments, and multimapping signatures as lists of alternatives.

    A row without `alternatives` (a list of such lists: chrom, strand_rev, blocks) has its primary placements alone.
    """
    starts, ends, first = F.transform("reps", span_start), F.transform("reps", span_end), F.get("reps", F.lit(0))
    low, high = F.array_min(starts), F.array_max(starts)
    floor = F.when(F.size(first) > 1, F.element_at(first, -1)["start"]).otherwise(low) + 1
    least, most = F.when(low == high, F.array_min(ends)).otherwise(floor), F.when(low == high, F.array_max(ends)).otherwise(F.lit(FAR))
    omitted = placed(moved(first, low, most), moved(first, high, least))
    stored = F.transform("reps", lambda b: placed(b))
    unique = F.when((F.size("reps") > 1) & (F.col("weight") > F.size("reps")), F.concat(stored, F.array(omitted))).otherwise(stored)
    alternatives = F.transform("alternatives", lambda s: F.transform(s, lambda a: placed(a["blocks"], chrom=a["chrom"], rev=a["strand_rev"]))) if "alternatives" in rows.columns else F.transform("mms", lambda b: F.array(placed(b)))
    return rows.withColumn("__stored", stored).withColumn("__unique", unique).withColumn("__multimap", alternatives)


def on_strand(a: Column, x: tuple) -> Column:
    here = a["chrom"] == x[1]
    return here & (a["rev"] == (x[4] == "-")) if x[4] else here


class Compiler:
    def __init__(self, text: str) -> None:
        p = Parser(text)
        self.doc, self.lets, self.fns = p.document(), p.lets, p.fns
        stages = self.doc["stages"]
        if not stages or stages[0][0] != "within" or any(s[0] == "within" for s in stages[1:]):
            raise QueryError("within comes first, and once")
        for i, s in enumerate(stages):
            if s[0] == "take" and (i < len(stages) - 1 or stages[i - 1][0] != "sort"):
                raise QueryError("take comes last, behind sort")
        #: Predicates over records that queries of classes and cells fold.
        self.folds: list[tuple[str, Column]] = []

    def resolve(self, e: tuple, seen: tuple = ()) -> tuple:
        """Names and calls of definitions put in line."""
        if e[0] == "name" and e[1] in self.lets:
            if e[1] in seen:
                raise QueryError(f"{e[1]} refers to itself")
            return self.resolve(self.lets[e[1]], (*seen, e[1]))
        if e[0] == "call" and e[1] in self.fns:
            params, body = self.fns[e[1]]
            if e[1] in seen or len(params) != len(e[2]):
                raise QueryError(f"{e[1]}: wrong arguments, or it refers to itself")
            given = dict(zip(params, e[2], strict=True))
            put = lambda x: given[x[1]] if isinstance(x, tuple) and x[:1] == ("name",) and x[1] in given else tuple(map(put, x)) if isinstance(x, tuple) else [put(y) for y in x] if isinstance(x, list) else {k: put(v) for k, v in x.items()} if isinstance(x, dict) else x
            return self.resolve(put(body), (*seen, e[1]))
        return e

    def junction_list(self, e: tuple) -> tuple[list[tuple], str]:
        e = self.resolve(e)
        if e[0] == "junction":
            return [e], ">>"
        if e[0] in (">>", "~>"):
            (x, a), (y, b) = self.junction_list(e[1]), self.junction_list(e[2])
            if {op for part, op in ((x, a), (y, b)) if len(part) > 1} - {e[0]}:
                raise QueryError("a path has one kind of arrow")
            return x + y, e[0]
        raise QueryError("a path is made of junctions")

    def value(self, e: tuple, env: dict, a: Column | None = None, mm: Column | None = None) -> tuple[str, Column]:
        """Type (truth, count, number, string, bounds) and column of an expression; a: the alignment, mm: the signature at hand."""
        e = self.resolve(e)
        op, sub = e[0], lambda x: self.value(x, env, a, mm)
        if op in ("true", "false", "unknown", "null"):
            return ("null" if op == "null" else "truth"), F.lit({"true": True, "false": False}.get(op)).cast("string" if op == "null" else "boolean")
        if op in ("count", "number", "string"):
            return op, F.lit(e[1]).cast({"count": "long", "number": "double", "string": "string"}[op])
        if op in ("&", "|", "!"):
            x = [sub(y) for y in e[1:]]
            if any(k != "truth" for k, _ in x):
                raise QueryError(f"{op} needs predicates")
            return "truth", ~x[0][1] if op == "!" else x[0][1] & x[1][1] if op == "&" else x[0][1] | x[1][1]
        if op in ("==", "!=", "<", "<=", ">", ">="):
            (j, x), (k, y) = sub(e[1]), sub(e[2])
            if j != k and "null" not in (j, k):
                raise QueryError(f"{op} compares {j} with {k}")
            return "truth", {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if op == "in":
            k, x = sub(e[1])
            if any(y[0] != k for y in e[2]):
                raise QueryError(f"in needs a list of {k}")
            return "truth", x.isin([y[1] for y in e[2]])
        if op == "neg":
            k, x = sub(e[1])
            return "number", -x.cast("double")
        if op in ("+", "-", "*", "/"):
            (j, x), (k, y) = sub(e[1]), sub(e[2])
            if j != k or j not in ("count", "number"):
                raise QueryError(f"{op} needs two counts or two numbers")
            if j == "count":
                wrong = F.raise_error(F.lit(f"{op} of counts has no result"))
                return j, F.when(x < y, wrong).otherwise(x - y) if op == "-" else F.when(y == 0, wrong).otherwise(F.floor(x / y)).cast("long") if op == "/" else x + y if op == "+" else x * y
            endless = F.raise_error(F.lit(f"{op} of numbers has no finite result"))
            z = F.when(y == 0, endless).otherwise(F.try_divide(x, y)) if op == "/" else x + y if op == "+" else x - y if op == "-" else x * y
            return j, F.when(z.isNull() | (F.abs(z) < float("inf")), z).otherwise(endless)
        if op in ("any", "all"):
            return "truth", self.quantified(op, e[1], e[2], env, mm)
        if op in ("junction", ">>", "~>"):
            return "truth", self.path(e, a)
        if op == "name":
            if e[1] not in env:
                raise QueryError(f"unknown name {e[1]}")
            return env[e[1]]
        if op == "call":
            return self.call(e, env, a, mm)
        raise QueryError(f"{op} is not a value")

    def path(self, e: tuple, a: Column | None) -> Column:
        found, kind = self.junction_list(e)
        if a is None:
            raise QueryError("a junction needs an alignment: any unique {...}")
        blocks, steps = a["inner"], [(x[2], x[3]) for x in found]
        here = on_strand(a, found[0])
        return here & (has_path(blocks, steps) if kind == ">>" else has_subpath(blocks, steps))

    def quantified(self, how: str, domain: str, p: tuple, env: dict, mm: Column | None) -> Column:
        fold = F.exists if how == "any" else F.forall
        if domain == "alternative":
            if mm is None:
                raise QueryError("alternative stands inside multimap")
            return fold(mm, lambda x: self.value(p, env, a=x)[1])
        if domain == "record":
            name = f"__fold{len(self.folds)}"
            self.folds.append((name, (kleene_any if how == "any" else kleene_all)(self.value(p, self.record_env)[1])))
            return F.col(name)
        if domain == "multimap":
            return fold(F.col("__multimap"), lambda s: self.value(p, env, mm=s)[1])
        return fold(F.col(f"__{domain}"), lambda x: self.value(p, env, a=x)[1])

    def call(self, e: tuple, env: dict, a: Column | None, mm: Column | None) -> tuple[str, Column]:
        _, name, args, named = e
        if name in ("overlaps", "start_in", "end_in", "near", "tx_strand") and a is None:
            raise QueryError(f"{name} needs an alignment")
        number = lambda k, default: self.value(named[k], env)[1] if k in named else F.lit(default)
        if name == "overlaps":
            x = self.resolve(args[0])
            if x[0] != "region":
                raise QueryError("overlaps needs a region")
            each = lambda blocks: F.transform(blocks, lambda b: F.greatest(F.least(b["end"], F.lit(x[3])) - F.greatest(b["start"], F.lit(x[2])), F.lit(0)))
            size = (lambda b: F.aggregate(each(b), F.lit(0).cast("long"), lambda s, v: s + v)) if named.get("blocks") == ("name", "total") else (lambda b: F.array_max(each(b)))
            least = number("min", 1)
            return "truth", F.when(~on_strand(a, x), False).when(size(a["inner"]) >= least, True).when(size(a["outer"]) < least, False)
        if name in ("start_in", "end_in"):
            x = self.resolve(args[0])
            low, high = (span_start(a["outer"]), span_start(a["inner"])) if name == "start_in" else (span_end(a["inner"]), span_end(a["outer"]))
            return "truth", F.when(~on_strand(a, x), False).when((low >= x[2]) & (high < x[3]), True).when((high < x[2]) | (low >= x[3]), False)
        if name == "near":
            x = self.resolve(args[0])
            left, right = number("left", 0), number("right", 0)
            return "truth", on_strand(a, x) & F.exists(junctions(a["inner"]), lambda j: (F.abs(j["donor"] - x[2]) <= left) & (F.abs(j["acceptor"] - x[3]) <= right))
        if name == "tx_strand":
            rule = self.doc["header"].get("library")
            if rule not in ("same", "opposite"):
                raise QueryError('tx_strand needs library = "same" or "opposite"')
            return "truth", a["rev"] == ((args[0][1] == "-") == (rule == "same"))
        if name == "terminal":
            x = self.resolve(args[0])
            return "truth", F.coalesce(on_strand({"chrom": F.col("chrom"), "rev": F.col("strand_rev")}, x) & (F.col("tail") >= x[2]) & (F.col("tail") < x[3]), F.lit(False))
        if name == "nonempty":
            return "truth", F.size(F.col(f"__{args[0][1]}")) > 0
        if name in ("is_null", "is_unknown"):
            return "truth", self.value(args[0], env, a, mm)[1].isNull()
        if name == "fraction":
            (_, x), (_, y) = self.value(args[0], env, a, mm), self.value(named["denominator"], env, a, mm)
            return "number", F.try_divide(x.cast("double"), y.cast("double"))
        if name == "support_reads":
            return "bounds", self.support(args[0], env)
        raise QueryError(f"unknown function {name}")

    def support(self, p: tuple, env: dict) -> Column:
        """Bounds of the reads for which p holds: a lone representative stands for its chain, of two each stands for a read."""
        n, w = F.size("reps"), F.col("weight")
        holds = lambda x: self.value(p, env, a=x)[1]
        times = lambda i: F.when(n == 1, w).when(i < n, 1).otherwise(w - n).cast("long")
        reach = lambda test: F.aggregate(F.transform("__unique", lambda x, i: F.when(test(holds(x)), times(i)).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        true, false = (lambda t: F.coalesce(t, F.lit(False))), (lambda t: F.coalesce(~t, F.lit(False)))
        lower, upper = reach(true), reach(lambda t: ~false(t))
        sure = F.aggregate(F.transform("__multimap", lambda s: F.when(F.forall(s, holds), w).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        never = F.aggregate(F.transform("__multimap", lambda s: F.when(F.forall(s, lambda x: ~holds(x)), 0).otherwise(w).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        lower, upper = lower + sure, upper + never
        return F.struct(lower.alias("lower"), upper.alias("upper"), F.when(lower == upper, "exact").otherwise("bounded").alias("status"))

    def run(self, rows: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
        """The query over evidence records; metadata names columns of rows by the names that the query uses."""
        rows = observed(rows)
        region = self.resolve(self.doc["stages"][0][1])
        if self.doc["source"] == "junctions":
            return self.enumerate(rows, region, metadata)
        unit, unique = UNITS[self.doc["source"]], F.size("reps") > 0
        reads = {"reads.unique": F.when(unique, F.col("weight")).otherwise(0), "reads.multimapping": F.when(unique, 0).otherwise(F.col("weight")), "reads.total": F.col("weight")}
        fields = {"sample": ("string", F.col("sample")), "cell": ("string", F.concat_ws(":", "sample", "cell")), "cell.id": ("string", F.col("cell").cast("string"))}
        fields |= {n: ("string", F.col(c)) for n, c in (metadata or {}).items()}
        self.record_env = fields | {n: ("count", c.cast("long")) for n, c in reads.items()}
        seen = F.lit(True) if region == ("name", "all") else F.exists("__stored", lambda x: self.touches(region, x)) | F.exists("__multimap", lambda s: F.exists(s, lambda x: self.touches(region, x)))
        chosen = rows.where(seen)
        if not unit:
            return self.stages(chosen, dict(self.record_env))
        kept = [c for c in (metadata or {}).values() if c not in unit]
        df = rows.join(chosen.select(*unit).distinct(), unit, "left_semi") if region != ("name", "all") else rows
        env = fields | {n: ("count", F.col(n.replace(".", "__"))) for n in reads} | {"unit.id": ("string", F.concat_ws(":", "sample", unit[-1]))}
        self.stages(None, dict(env))  # finds the folds
        folds = list(self.folds)
        self.folds = []
        sums = [F.sum(c).cast("long").alias(n.replace(".", "__")) for n, c in reads.items()]
        units = df.groupBy(*unit).agg(*sums, *[c.alias(n) for n, c in folds], *[F.first(c, True).alias(c) for c in kept])
        return self.stages(units, dict(env))

    def touches(self, x: tuple, a: Column) -> Column:
        if x[0] == "region":
            return on_strand(a, x) & F.exists(a["outer"], lambda b: (b["start"] < x[3]) & (b["end"] > x[2]))
        return self.path(x, a)

    def stages(self, df: DataFrame | None, env: dict) -> DataFrame:
        """The stages behind within; without df expressions are only compiled."""
        do = (lambda f: f(df)) if df is not None else (lambda f: None)
        safe = lambda n: n.replace(".", "_")
        for s in self.doc["stages"][1:]:
            if s[0] == "where":
                k, p = self.value(s[1], env)
                if k != "truth":
                    raise QueryError(f"where needs a predicate, not a {k}")
                df = do(lambda d, p=p: d.where(p))
            elif s[0] == "derive":
                for n, e in s[1]:
                    if n in env:
                        raise QueryError(f"{n} is taken")
                    k, x = self.value(e, env)
                    df = do(lambda d, n=n, x=x: d.withColumn(n, x))
                    env[n] = (k, F.col(n))
                    if k == "bounds":
                        env |= {f"{n}.{f}": ("string" if f == "status" else "count", F.col(n)[f]) for f in ("lower", "upper", "status")}
            elif s[0] == "select":
                found = [(safe(n), *self.value(e, env)) for n, e in s[1]]
                df = do(lambda d, found=found: d.select(*[x.alias(n) for n, _, x in found]))
                env = {n: (k, F.col(n)) for n, k, _ in found}
            elif s[0] in ("tally", "summarize"):
                by = [self.value(e, env)[1].alias(safe(n)) for n, e in s[2]]
                if s[0] == "tally":
                    states = [(f"{n}_state", self.value(e, env)[1]) for n, e in s[1]]
                    keys = [*by, *[F.when(p, "true").when(~p, "false").otherwise("unknown").alias(n) for n, p in states]]
                    df = do(lambda d, keys=keys: d.groupBy(*keys).agg(F.count("*").alias("count")))
                    names = [*[safe(n) for n, _ in s[2]], *[n for n, _ in states]]
                    env = {n: ("string", F.col(n)) for n in names} | {"count": ("count", F.col("count"))}
                else:
                    found = [(n, *self.aggregate(e, env)) for n, e in s[1]]
                    df = do(lambda d, by=by, found=found: d.groupBy(*by).agg(*[x.alias(n) for n, _, x in found]))
                    env = {safe(n): ("string", F.col(safe(n))) for n, _ in s[2]} | {n: (k, F.col(n)) for n, k, _ in found}
            elif s[0] == "sort":
                first = [self.value(("name", safe(n)) if safe(n) in env else e, env)[1] for n, e in s[1]]
                df = do(lambda d, first=first: d.orderBy(*[x.asc_nulls_first() for x in first], *[F.col(c).asc_nulls_first() for c in d.columns]))
            elif s[0] == "take":
                df = do(lambda d, n=s[1]: d.limit(n))
        return df

    def aggregate(self, e: tuple, env: dict) -> tuple[str, Column]:
        if e[0] != "call":
            raise QueryError("summarize needs aggregates")
        x = [self.value(y, env) for y in e[2]]
        if e[1] == "count":
            return "count", F.count("*")
        if e[1] == "sum":
            return x[0][0], F.sum(x[0][1])
        if e[1] == "count_distinct":
            return "count", F.count_distinct(x[0][1])
        tests = {"count_true": lambda p: p, "count_false": lambda p: ~p, "count_unknown": lambda p: p.isNull()}
        if e[1] not in tests:
            raise QueryError(f"unknown aggregate {e[1]}")
        return "count", F.count_if(tests[e[1]](x[0][1]))

    def enumerate(self, rows: DataFrame, region: tuple, metadata: dict[str, str] | None) -> DataFrame:
        """Junctions of unique evidence with both ends in the region, and how many units have each."""
        _, unit, by = self.doc["stages"][1]
        keys = [F.col((metadata or {}).get(n, n)).alias(n.replace(".", "_")) for n, _ in by]
        inside = rows.where(F.col("chrom") == region[1]).where((F.col("strand_rev") == (region[4] == "-")) if region[4] else F.lit(True))
        js = inside.withColumn("j", F.explode(F.array_distinct(F.flatten(F.transform("reps", junctions))))).where((F.col("j.donor") >= region[2]) & (F.col("j.acceptor") <= region[3]))
        n = F.count("*") if unit == "record" else F.count_distinct(*UNITS["classes" if unit == "class" else "cells"])
        return js.groupBy(*keys, F.col("j.donor").alias("donor"), F.col("j.acceptor").alias("acceptor")).agg(n.alias("support"))


def query(text: str, rows: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    return Compiler(text).run(rows, metadata)
