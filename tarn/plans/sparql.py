"""SPARQL algebra over a quad table, compiled to DataFrames.

A solution is a row with a column for each variable; a term is one string that starts with its kind:
``<iri``, ``_bnode``, ``Ldatatype\\x01lang\\x01text`` or ``Tsubject\\x01predicate\\x01text``. Equal terms are equal
strings, so joins are equi-joins. Constants filter the raw quad columns and so reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn import model as M
from tarn.plans.ontology import Ontology
from tarn.plans.sparql_parser import Query, QueryError, parse

SEP = "\x01"
WHOLE, BROKEN = [M.INTEGER, M.XSD + "int", M.XSD + "long"], [M.XSD + "double", M.XSD + "float"]
NUMBERS = [*WHOLE, M.DECIMAL, *BROKEN]
EXACT = "decimal(38,9)"


def encoded(t: tuple) -> str:
    if t[0] == "iri":
        return "<" + t[1]
    if t[0] == "triple":
        return "T" + SEP.join((t[1][1], t[2][1], t[3][1]))
    return f"L{t[2]}{SEP}{t[3] or ''}{SEP}{t[1]}"


def literal(text: Column, dt: str = M.STRING) -> Column:
    return F.concat(F.lit(f"L{dt}{SEP}{SEP}"), text)


def lexical(x: Column) -> Column:
    """STR(): the text of a literal, the address of an IRI."""
    cut = F.substring(x, F.lit(2), F.length(x))
    return F.when(x.startswith("L"), F.regexp_replace(x, "(?s)^L[^\x01]*\x01[^\x01]*\x01", "")).when(x.startswith("T"), F.lit(None)).otherwise(cut)


def datatype(x: Column) -> Column:
    return F.when(x.startswith("L"), F.substring_index(F.substring(x, F.lit(2), F.length(x)), SEP, 1))


def number(x: Column) -> Column:
    return F.when(datatype(x).isin(NUMBERS), lexical(x).try_cast("double"))


def rank(x: Column) -> Column:
    """How far a number is from whole: 0 integer, 1 decimal, 2 double; null for what is none."""
    dt = datatype(x)
    return F.when(dt.isin(WHOLE), 0).when(dt == M.DECIMAL, 1).when(dt.isin(BROKEN), 2)


def exact(x: Column) -> Column:
    """An integer or decimal without rounding (nine places)."""
    return F.when(rank(x) < 2, lexical(x).try_cast(EXACT))


def number_literal(n: Column, kind: Column, precise: Column | None = None) -> Column:
    """The literal of a number: by ``precise`` for integers and decimals where it is known, else by the double ``n``."""
    d = F.coalesce(precise, n.try_cast(EXACT)) if precise is not None else n.try_cast(EXACT)
    cut = F.regexp_replace(d.cast("string"), r"(\.\d+?)0+$", "$1")
    whole = F.coalesce(F.floor(d).cast("decimal(38,0)").cast("string"), F.floor(n).cast("string"))
    return F.when(kind == 0, literal(whole, M.INTEGER)).when(kind == 1, literal(F.coalesce(cut, n.cast("string")), M.DECIMAL)).when(kind == 2, literal(n.cast("string"), M.XSD + "double"))


@dataclass
class Part:
    """Solutions, and which variables may be unbound in some of them."""

    df: DataFrame
    names: list[str]
    loose: set[str] = field(default_factory=set)


@dataclass
class Result:
    form: str
    df: DataFrame
    names: list[str]
    notes: list[str]

    def boolean(self) -> bool:
        return bool(self.df.first()["answer"])

    def plain(self) -> DataFrame:
        """The answers as plain texts."""
        return self.df.select(*(lexical(F.col(n)).alias(n) for n in self.names))

    def n_triples(self) -> DataFrame:
        """(line) of a CONSTRUCT or DESCRIBE answer."""
        from tarn.functions.text import escaped

        def term(x: Column) -> Column:
            dt, lang, text = datatype(x), F.split_part(x, F.lit(SEP), F.lit(2)), escaped(lexical(x))
            end = F.when(lang != "", F.concat(F.lit("@"), lang)).when(dt == M.STRING, "").otherwise(F.concat(F.lit("^^<"), dt, F.lit(">")))
            parts = F.split(F.substring(x, F.lit(2), F.length(x)), SEP)
            triple = F.concat(F.lit("<<( <"), F.get(parts, 0), F.lit("> <"), F.get(parts, 1), F.lit('> "'), escaped(F.get(parts, 2)), F.lit('" )>>'))
            return F.when(x.startswith("L"), F.concat(F.lit('"'), text, F.lit('"'), end)).when(x.startswith("T"), triple).when(x.startswith("_"), F.concat(F.lit("_:"), lexical(x))).otherwise(F.concat(x, F.lit(">")))

        return self.df.select(F.concat_ws(" ", *(term(F.col(c)) for c in ("s", "p", "o")), F.lit(".")).alias("line"))

    def to_json(self) -> dict:
        """SPARQL results JSON; unbound variables are left out."""
        if self.form == "ASK":
            return {"head": {}, "boolean": self.boolean()}

        def term(x: str) -> dict:
            if x[0] == "L":
                dt, lang, text = x[1:].split(SEP, 2)
                return {"type": "literal", "value": text} | ({"xml:lang": lang} if lang else {"datatype": dt} if dt != M.STRING else {})
            if x[0] == "T":
                s, p, o = x[1:].split(SEP, 2)
                return {"type": "triple", "value": {"subject": {"type": "uri", "value": s}, "predicate": {"type": "uri", "value": p}, "object": {"type": "literal", "value": o}}}
            return {"type": "uri" if x[0] == "<" else "bnode", "value": x[1:]}

        rows = [{n: term(r[n]) for n in self.names if r[n] is not None} for r in self.df.collect()]
        return {"head": {"vars": self.names}, "results": {"bindings": rows}}


class Store:
    """Quads to ask. With ``union``, a query that names no dataset sees all graphs as one set of triples, the unnamed one too."""

    def __init__(self, quads: DataFrame, ontology: Ontology | None = None, union: bool = True, base: str = M.BASE, prefixes: dict | None = None, buckets: int | None = None):
        self.quads, self.ontology, self.union, self.base, self.buckets = quads, ontology, union, base, buckets
        self.prefixes = {"": base + "graph/", "base": base + "base/", "rdf": M.RDF, "rdfs": M.RDFS, "xsd": M.XSD, "prov": M.PROV, "oa": M.OA, "owl": M.OWL} | (prefixes or {})
        self.spark = quads.sparkSession

    def query(self, text: str) -> Result:
        q = parse(text, self.base, self.prefixes)
        return Run(self, q).result()


class Run:
    def __init__(self, store: Store, q: Query):
        self.store, self.q, self.notes, self.fresh = store, q, [], 0

    # scans
    def scope(self, graph) -> tuple[DataFrame, Column | None]:
        """Quads a pattern sees, and the graph column if it is asked for."""
        q = self.store.quads
        if graph is not None:
            named = q.where("g is not null")
            if self.q.named:
                named = named.where(F.col("g").isin(self.q.named))
            if graph[0] == "iri":
                named = named.where(F.col("g") == graph[1])
                if self.store.buckets and "gb" in q.columns:
                    named = named.where(F.col("gb") == M.graph_bucket(F.lit(graph[1]), self.store.buckets))
            return named, F.col("g")
        if self.q.default:
            return q.where(F.col("g").isin(self.q.default)), None
        if self.q.named or not self.store.union:
            return q.where("g is null"), None
        return q, None

    def pattern(self, t: tuple, graph) -> Part:
        s, p, o = t
        if p[0] not in ("iri", "var"):
            return self.path(s, p, o, graph)
        q, g = self.scope(graph)
        many = False
        if p[0] == "iri":
            names = self.store.ontology.property_names(p[1]) if self.store.ontology else [p[1]]
            many = len(names) > 1
            q = q.where(F.col("p").isin(names) if many else F.col("p") == names[0])
        if o[0] == "iri" and p == ("iri", M.TYPE) and self.store.ontology:
            names = self.store.ontology.class_names(o[1])
            many = many or len(names) > 1
            q = q.where((F.col("o_kind") == "iri") & F.col("o").isin(names))
            o = ("any",)
        if s[0] == "iri":
            q = q.where(F.col("s") == s[1])
        if o[0] == "iri":
            q = q.where((F.col("o_kind") == "iri") & (F.col("o") == o[1]))
        elif o[0] == "lit":
            q = q.where((F.col("o_kind") == "lit") & (F.col("o") == o[1]) & (F.coalesce("dt", F.lit(M.STRING)) == o[2]) & F.col("lang").eqNullSafe(F.lit(o[3])))
        elif o[0] == "triple":
            q = q.where("o_kind = 'triple'")
        cols: list[tuple[str, Column]] = []
        node = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_"), F.substring(c, F.lit(3), F.length(c)))).otherwise(F.concat(F.lit("<"), c))
        dt, lang = F.coalesce("dt", F.lit(M.STRING)), F.coalesce("lang", F.lit(""))
        thing = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"))).when(F.col("o_kind") == "bnode", F.concat(F.lit("_"), F.col("o"))).when(F.col("o_kind") == "triple", F.concat(F.lit("T"), F.concat_ws(SEP, "tt.s", "tt.p", "tt.o"))).otherwise(F.concat(F.lit("L"), F.concat_ws(SEP, dt, lang, F.col("o"))))
        for x, c in ((s, node(F.col("s"))), (p, F.concat(F.lit("<"), F.col("p"))), (o, thing)):
            if x[0] == "var":
                cols.append((x[1], c))
        if o[0] == "triple":
            for x, c in ((o[1], F.col("tt.s")), (o[2], F.col("tt.p")), (o[3], F.col("tt.o"))):
                if x[0] == "var":
                    cols.append((x[1], literal(c) if x is o[3] else F.concat(F.lit("<"), c)))
                else:
                    q = q.where(c == x[1])
        if graph is not None and graph[0] == "var":
            cols.append((graph[1], F.concat(F.lit("<"), g)))
        seen: dict[str, Column] = {}
        for name, c in cols:
            if name in seen:
                q = q.where(seen[name] == c)
            else:
                seen[name] = c
        out = q.select(*(c.alias(n) for n, c in seen.items())) if seen else q.select(F.lit(1).alias("_one"))
        if graph is None and not self.q.default and self.store.union and not self.q.named:
            # a set of triples: what the constants leave open must be distinct
            out = q.select(*(c.alias(n) for n, c in seen.items()), *(F.col(c).alias(f"_q_{c}") for c in ("s", "p", "o_kind", "o", "dt", "lang", "tt"))).dropDuplicates([f"_q_{c}" for c in ("s", "p", "o_kind", "o", "dt", "lang", "tt")]).select(*(seen or ["_q_s"])) if not many else out.distinct()
        elif many:
            out = out.distinct()
        return Part(out, list(seen))

    def path(self, s, p, o, graph) -> Part:
        ends = {k: encoded(x) for k, x in (("a", s), ("b", o)) if x[0] not in ("var", "any")}
        pairs = self.pairs(p, graph, ends).select("a", "b")
        cols = {}
        for x, c in ((s, "a"), (o, "b")):
            if x[0] == "var":
                if x[1] in cols:
                    pairs = pairs.where(F.col("a") == F.col("b"))
                else:
                    cols[x[1]] = c
            else:
                pairs = pairs.where(F.col(c) == encoded(x))
        return Part(pairs.select(*(F.col(c).alias(n) for n, c in cols.items())) if cols else pairs.select(F.lit(1).alias("_one")), list(cols))

    def pairs(self, p, graph, ends: dict | None = None) -> DataFrame:
        """(a, b) of a path. Closures are sets; the others are bags. ``ends`` are constants that the caller filters by; a closure starts from one."""
        kind = p[0]
        if kind == "iri":
            part = self.pattern((("var", "a"), p, ("var", "b")), graph)
            return part.df.select("a", "b")
        if kind == "inv":
            return self.pairs(p[1], graph).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "seq":
            left, right = self.pairs(p[1], graph), self.pairs(p[2], graph)
            return left.select("a", F.col("b").alias("m")).join(right.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        if kind == "alt":
            return self.pairs(p[1], graph).unionByName(self.pairs(p[2], graph))
        if kind == "not":
            every = self.pattern((("var", "a"), ("var", "_p"), ("var", "b")), graph).df
            out = every.where(~F.col("_p").isin(["<" + x for x in p[1]] or [""])).select("a", "b") if p[1] or not p[2] else None
            if p[2]:
                back = every.where(~F.col("_p").isin(["<" + x for x in p[2]])).select(F.col("b").alias("a"), F.col("a").alias("b"))
                out = back if out is None else out.unionByName(back)
            return out
        step = self.pairs(p[1], graph).distinct()
        if kind == "plus":
            return closure(step, ends)
        nodes = self.pattern((("var", "a"), ("var", "_p"), ("var", "b")), graph).df.select(F.explode(F.array("a", "b")).alias("a")).distinct().withColumn("b", F.col("a"))
        if ends:
            for k, v in ends.items():
                nodes = nodes.unionByName(self.store.spark.createDataFrame([(v, v)], "a string, b string")).where(F.col(k) == v)
        return (closure(step, ends) if kind == "star" else step).unionByName(nodes).distinct()

    # joins
    def join(self, left: Part | None, right: Part, how: str = "inner", extra=None) -> Part:
        if left is None:
            return right
        shared = [n for n in left.names if n in right.names]
        self.fresh += 1
        r = right.df.select(*(F.col(n).alias(f"_{self.fresh}_{n}") for n in right.names)) if right.names else right.df.select(F.lit(1).alias(f"_{self.fresh}_"))
        other = {n: F.col(f"_{self.fresh}_{n}") for n in right.names}
        cond = F.lit(True)
        for n in shared:
            same = F.col(n) == other[n]
            cond = cond & (same | F.col(n).isNull() | other[n].isNull() if n in left.loose | right.loose else same)
        if extra is not None:
            cond = cond & extra({n: F.coalesce(F.col(n), other[n]) if n in shared else F.col(n) for n in left.names} | {n: c for n, c in other.items() if n not in shared})
        loose_shared = [n for n in shared if n in left.loose | right.loose]
        if how == "inner" and extra is None and 0 < len(loose_shared) <= 3:
            joined = self.cases(left.df, r, shared, loose_shared, other)
        else:
            joined = left.df.join(r, cond, how)
        names = [*left.names, *(n for n in right.names if n not in left.names)]
        out = joined.select(*(F.coalesce(F.col(n), other[n]).alias(n) if n in shared and n in left.loose else F.col(n) for n in left.names), *(other[n].alias(n) for n in right.names if n not in left.names))
        loose = (left.loose & (right.loose | (set(left.names) - set(right.names)))) | (right.loose - set(left.names)) | ({n for n in right.names if n not in left.names} if how == "left" else set()) | (left.loose if how == "left" else set())
        return Part(out, names, loose)

    def cases(self, left: DataFrame, right: DataFrame, shared: list, loose: list, other: dict) -> DataFrame:
        """An inner join in which some shared variables may be unbound: rows are parted by what is bound on each side, and each part is joined by equality."""
        from itertools import product

        out = None
        for how in product(("both", "left", "right"), repeat=len(loose)):  # bound on both sides, unbound on the left, unbound on the right only
            a, b, keys = left, right, [n for n in shared if n not in loose]
            for n, h in zip(loose, how, strict=True):
                a = a.where(F.col(n).isNull() if h == "left" else F.col(n).isNotNull())
                b = b if h == "left" else b.where(other[n].isNull() if h == "right" else other[n].isNotNull())
                keys = [*keys, n] if h == "both" else keys
            cond = F.lit(True)
            for n in keys:
                cond = cond & (F.col(n) == other[n])
            part = a.join(b, cond)
            out = part if out is None else out.unionByName(part)
        return out

    # groups
    def group(self, items: list, graph=None, left: Part | None = None) -> Part:
        out, filters = left, []
        for item in items:
            kind = item[0]
            if kind == "bgp":
                left_over = list(item[1])
                while left_over:
                    t = self.nearest(left_over, set(out.names) if out else set())
                    left_over.remove(t)
                    out = self.join(out, self.pattern(t, graph))
            elif kind == "filter":
                filters.append(item[1])
            elif kind == "optional":
                inner = [x for x in item[1] if x[0] != "filter"]
                tests = [x[1] for x in item[1] if x[0] == "filter"]
                right = self.group(inner, graph)
                extra = (lambda cols, tests=tests: self.all_true(tests, cols)) if tests else None
                out = self.join(out or self.unit(), right, "left", extra)
            elif kind == "minus":
                right = self.group(item[1], graph)
                shared = [n for n in out.names if n in right.names]
                if set(shared) - {graph[1] if graph else None}:  # without a shared variable nothing is removed; the graph's own doesn't count
                    r = right.df.select(*(F.col(n).alias(f"_m_{n}") for n in shared))
                    cond, met = F.lit(True), F.lit(False)
                    for n in shared:
                        a, b = F.col(n), F.col(f"_m_{n}")
                        cond = cond & ((a == b) | a.isNull() | b.isNull() if n in out.loose | right.loose else a == b)
                        met = met | (a.isNotNull() & b.isNotNull())
                    out = Part(out.df.join(r, cond & met if any(n in out.loose | right.loose for n in shared) else cond, "left_anti"), out.names, out.loose)
            elif kind == "union":
                parts = [self.group(g, graph) for g in item[1]]
                df = parts[0].df
                for p in parts[1:]:
                    df = df.unionByName(p.df, allowMissingColumns=True)
                names = list(dict.fromkeys(n for p in parts for n in p.names))
                loose = {n for n in names if any(n not in p.names or n in p.loose for p in parts)}
                out = self.join(out, Part(df.select(*names), names, loose))
            elif kind == "graph":
                out = self.join(out, self.group(item[2], item[1]))
            elif kind == "group":
                out = self.join(out, self.group(item[1], graph))
            elif kind == "sub":
                out = self.join(out, self.select(item[1]))
            elif kind == "values":
                names, rows = item[1], [[None if t is None else encoded(t) for t in r] for r in item[2]]
                df = self.store.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
                out = self.join(out, Part(df, names, {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}))
            elif kind == "bind":
                out = out or self.unit()
                value = self.term(item[1], {n: F.col(n) for n in out.names})
                out = Part(out.df.withColumn(item[2], value), [*out.names, item[2]], out.loose | {item[2]})
        out = out or self.unit()
        for f in filters:
            out = self.filtered(out, f, graph)
        return out

    def nearest(self, patterns: list, bound: set) -> tuple:
        """The pattern to join next: one that shares a variable with what is there, then the one with the most constants, then as written. A product is made only where nothing connects."""

        def names(x) -> set:
            return {x[1]} if x[0] == "var" else set().union(*(names(y) for y in x[1:])) if x[0] == "triple" else set()

        own = lambda t: names(t[0]) | names(t[1]) | names(t[2])
        fixed = lambda t: sum(x[0] in ("iri", "lit") for x in t)
        return max(patterns, key=lambda t: (bool(own(t) & bound) or not bound, fixed(t), -patterns.index(t)))

    def unit(self) -> Part:
        return Part(self.store.spark.range(1).select(F.lit(1).alias("_one")), [])

    def filtered(self, part: Part, f, graph) -> Part:
        if f[0] == "op" and f[1] == "and":
            return self.filtered(self.filtered(part, f[2], graph), f[3], graph)
        if f[0] == "op" and f[1] == "not" and f[2][0] == "exists":
            f = ("exists", not f[2][1], f[2][2])
        if f[0] == "exists":
            inner = self.group([x for x in f[2] if x[0] != "filter"], graph)
            tests = [x[1] for x in f[2] if x[0] == "filter"]
            r = inner.df.select(*(F.col(n).alias(f"_e_{n}") for n in inner.names)) if inner.names else inner.df
            cond = F.lit(True)
            for n in inner.names:
                if n in part.names:
                    same = F.col(n) == F.col(f"_e_{n}")
                    cond = cond & (same | F.col(n).isNull() if n in part.loose else same)
            if tests:
                cond = cond & self.all_true(tests, {n: F.col(n) for n in part.names} | {n: F.col(f"_e_{n}") for n in inner.names if n not in part.names})
            return Part(part.df.join(r, cond, "left_semi" if f[1] else "left_anti"), part.names, part.loose)
        self.note_names(f)
        return Part(part.df.where(F.coalesce(self.truth(f, {n: F.col(n) for n in part.names}), F.lit(False))), part.names, part.loose)

    def note_names(self, e) -> None:
        """Base names inside expressions stay as written; say so."""
        if isinstance(e, tuple | list):
            if len(e) == 2 and e[0] == "iri" and self.store.ontology and e[1].startswith(self.store.ontology.abstract):
                self.notes.append(f"left as written inside an expression: {e[1]}")
            for x in e:
                self.note_names(x)

    def all_true(self, tests: list, cols: dict[str, Column]) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(self.truth(t, cols), F.lit(False))
        return out

    # expressions: an error is null, and a filter takes null for false
    def truth(self, e, cols) -> Column:
        if e[0] == "op" and e[1] in ("and", "or"):
            a, b = self.truth(e[2], cols), self.truth(e[3], cols)
            return a & b if e[1] == "and" else a | b
        if e[0] == "op" and e[1] == "not":
            return ~self.truth(e[2], cols)
        if e[0] == "op" and e[1] in ("=", "!=", "<", ">", "<=", ">="):
            return self.compared(e[1], self.term(e[2], cols), self.term(e[3], cols))
        if e[0] == "in":
            x = self.term(e[1], cols)
            hit = F.lit(False)
            for item in e[2]:
                hit = hit | self.compared("=", x, self.term(item, cols))
            return ~hit if e[3] else hit
        if e[0] == "call" and e[1] in ("CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "BOUND", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "ISTRIPLE", "SAMETERM", "LANGMATCHES"):
            a = [self.term(x, cols) for x in e[2]]
            t = [lexical(x) for x in a]
            match e[1]:
                case "CONTAINS":
                    return t[0].contains(t[1])
                case "STRSTARTS":
                    return t[0].startswith(t[1])
                case "STRENDS":
                    return t[0].endswith(t[1])
                case "REGEX":
                    flags = e[2][2][1][1] if len(e[2]) > 2 else ""
                    pattern = e[2][1][1][1] if e[2][1][0] == "term" and e[2][1][1][0] == "lit" else None
                    lead = f"(?{flags})" if flags else ""
                    return t[0].rlike(lead + pattern) if pattern is not None else F.regexp_like(t[0], F.concat(F.lit(lead), t[1]))
                case "BOUND":
                    return a[0].isNotNull()
                case "ISIRI" | "ISURI":
                    return a[0].startswith("<")
                case "ISBLANK":
                    return a[0].startswith("_")
                case "ISLITERAL":
                    return a[0].startswith("L")
                case "ISTRIPLE":
                    return a[0].startswith("T")
                case "ISNUMERIC":
                    return F.when(a[0].isNotNull(), number(a[0]).isNotNull())
                case "SAMETERM":
                    return a[0] == a[1]
                case _:
                    return F.when(t[1] == "*", t[0] != "").otherwise(F.lower(t[0]).startswith(F.lower(t[1])))
        x = self.term(e, cols)
        n = number(x)
        return F.when(datatype(x) == M.BOOLEAN, lexical(x) == "true").when(n.isNotNull(), n != 0).when(datatype(x) == M.STRING, lexical(x) != "")

    def compared(self, op: str, a: Column, b: Column) -> Column:
        x, y = number(a), number(b)
        both = x.isNotNull() & y.isNotNull()
        date = lambda c: F.when(datatype(c) == M.DATETIME, F.try_to_timestamp(lexical(c)))
        dates = date(a).isNotNull() & date(b).isNotNull()
        known = a.isNotNull() & b.isNotNull()
        if op in ("=", "!="):
            same = F.when(both, x == y).when(dates, date(a) == date(b)).when(known, a == b)
            return same if op == "=" else ~same
        do = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        alike = known & a.startswith("L") & b.startswith("L") & (datatype(a) == datatype(b))
        return F.when(both, do(x, y)).when(dates, do(date(a), date(b))).when(alike, do(lexical(a), lexical(b)))

    def term(self, e, cols) -> Column:
        if e[0] == "term":
            t = e[1]
            if t[0] == "var":
                return cols.get(t[1], F.lit(None).cast("string"))
            return F.lit(encoded(t))
        if e[0] == "op" and e[1] in ("+", "-", "*", "/"):
            x, y = self.term(e[2], cols), self.term(e[3], cols)
            do = {"+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q, "/": F.try_divide}[e[1]]
            kind = F.greatest(rank(x), rank(y), F.lit(1 if e[1] == "/" else 0))
            kind = F.when(rank(x).isNotNull() & rank(y).isNotNull(), kind)
            return number_literal(do(number(x), number(y)), kind, do(exact(x), exact(y)).try_cast(EXACT))
        if e[0] in ("op", "in") or (e[0] == "call" and e[1] in ("CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "BOUND", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "ISTRIPLE", "SAMETERM", "LANGMATCHES")):
            b = self.truth(e, cols)
            return F.when(b.isNotNull(), literal(b.cast("string"), M.BOOLEAN))
        if e[0] == "agg":
            return cols[repr(e)]
        if e[0] != "call":
            raise QueryError(f"can't evaluate {e[0]}")
        name, a = e[1], [self.term(x, cols) for x in e[2]]
        t = [lexical(x) for x in a]
        match name:
            case "STR":
                return literal(t[0])
            case "DATATYPE":
                return F.concat(F.lit("<"), datatype(a[0]))
            case "LANG":
                return F.when(a[0].startswith("L"), literal(F.split_part(a[0], F.lit(SEP), F.lit(2))))
            case "LCASE":
                return literal(F.lower(t[0]))
            case "UCASE":
                return literal(F.upper(t[0]))
            case "STRLEN":
                return literal(F.length(t[0]).cast("string"), M.INTEGER)
            case "SUBSTR":
                n = number(a[2]).cast("int") if len(a) > 2 else F.length(t[0])
                return literal(F.substring(t[0], number(a[1]).cast("int"), n))
            case "STRBEFORE":
                return literal(F.when(t[0].contains(t[1]), F.split_part(t[0], t[1], F.lit(1))).otherwise(""))
            case "STRAFTER":
                return literal(F.when(t[0].contains(t[1]), F.substring(t[0], F.position(t[1], t[0]) + F.length(t[1]), F.length(t[0]))).otherwise(""))
            case "CONCAT":
                return literal(F.concat(*t))
            case "REPLACE":
                return literal(F.regexp_replace(t[0], F.concat(F.lit("(?"), t[3], F.lit(")"), t[1]) if len(t) > 3 else t[1], t[2]))
            case "IF":
                return F.when(self.truth(e[2][0], cols), a[1]).when(~self.truth(e[2][0], cols), a[2])
            case "COALESCE":
                return F.coalesce(*a)
            case "IRI" | "URI":
                return F.concat(F.lit("<"), t[0])
            case "ABS" | "ROUND" | "CEIL" | "FLOOR":
                return number_literal({"ABS": F.abs, "ROUND": lambda n: F.floor(n + 0.5), "CEIL": F.ceil, "FLOOR": F.floor}[name](number(a[0])).cast("double"), rank(a[0]))
            case "YEAR" | "MONTH" | "DAY":
                k = {"YEAR": (1, 4), "MONTH": (6, 2), "DAY": (9, 2)}[name]
                return literal(F.substring(t[0], *k).cast("int").cast("string"), M.INTEGER)
            case "HOURS" | "MINUTES":
                return literal(F.regexp_extract(t[0], r"T(\d\d):(\d\d)", 1 if name == "HOURS" else 2).try_cast("int").cast("string"), M.INTEGER)
            case "SECONDS":
                return literal(F.regexp_replace(F.nullif(F.regexp_extract(t[0], r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1), F.lit("")), r"^0(?=\d)", ""), M.DECIMAL)
            case "TZ" | "TIMEZONE":
                zone = F.regexp_extract(t[0], r"(Z|[+-]\d\d:\d\d)$", 1)
                if name == "TZ":
                    return literal(zone)
                part = lambda k: F.regexp_extract(zone, r"(\d\d):(\d\d)", k).try_cast("int")
                spelt = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(part(1) > 0, F.concat(part(1).cast("string"), F.lit("H"))).otherwise(""), F.when(part(2) > 0, F.concat(part(2).cast("string"), F.lit("M"))).otherwise(""))
                return F.when(zone != "", literal(F.when((zone == "Z") | zone.isin("+00:00", "-00:00"), "PT0S").otherwise(spelt), M.XSD + "dayTimeDuration"))
            case "ENCODE_FOR_URI":
                coded = F.url_encode(t[0])
                for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
                    coded = F.replace(coded, F.lit(was), F.lit(now))
                return literal(coded)
            case "STRDT":
                return F.when(datatype(a[0]) == M.STRING, F.concat(F.lit("L"), t[1], F.lit(SEP + SEP), t[0]))
            case "STRLANG":
                return F.when(datatype(a[0]) == M.STRING, F.concat(F.lit(f"L{M.LANG}{SEP}"), F.lower(t[1]), F.lit(SEP), t[0]))
            case "NOW":  # one instant for the whole query
                return literal(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), M.DATETIME)
            case "UUID":
                return F.concat(F.lit("<urn:uuid:"), F.uuid())
            case "STRUUID":
                return literal(F.uuid())
            case "RAND":
                return literal(F.rand().cast("string"), M.XSD + "double")
            case "BNODE":  # equal labels in one solution give one node
                return F.concat(F.lit("_"), F.concat(F.lit("n"), F.md5(F.concat(t[0], F.lit("/"), *(F.coalesce(c, F.lit("")) for c in cols.values())))) if t else F.replace(F.uuid(), F.lit("-"), F.lit("")))
            case "TRIPLE":
                return F.when(a[0].startswith("<") & a[1].startswith("<"), F.concat(F.lit("T"), F.concat_ws(SEP, t[0], t[1], t[2])))
            case "SUBJECT" | "PREDICATE" | "OBJECT":
                part = F.split_part(F.substring(a[0], F.lit(2), F.length(a[0])), F.lit(SEP), F.lit(1 if name == "SUBJECT" else 2))
                rest = F.regexp_replace(a[0], "(?s)^T[^\x01]*\x01[^\x01]*\x01", "")
                return F.when(a[0].startswith("T"), literal(rest) if name == "OBJECT" else F.concat(F.lit("<"), part))
            case "MD5" | "SHA1" | "SHA256" | "SHA384" | "SHA512":
                return literal({"MD5": F.md5, "SHA1": F.sha1}.get(name, lambda x: F.sha2(x, int(name[3:])))(t[0]))
        raise QueryError(f"unknown function {name}")

    # solution modifiers
    def aggregates(self, e, found: dict) -> None:
        if isinstance(e, tuple) and e and e[0] == "agg":
            found[repr(e)] = e
        elif isinstance(e, tuple | list):
            for x in e:
                self.aggregates(x, found)

    def aggregate(self, e, cols) -> Column:
        _, name, distinct, arg, sep = e
        if name == "COUNT" and arg is None:
            return literal((F.count_distinct(F.struct(*cols.values())) if distinct else F.count("*")).cast("string"), M.INTEGER)
        x = self.term(arg, cols)
        if name == "COUNT":
            return literal((F.count_distinct(x) if distinct else F.count(x)).cast("string"), M.INTEGER)
        if name in ("SUM", "AVG"):
            n, d, kind = number(x), exact(x), F.coalesce(F.max(rank(x)), F.lit(0))
            add = F.sum_distinct if distinct else F.sum
            many = F.count_distinct(n) if distinct else F.count(n)
            if name == "SUM":
                return number_literal(F.coalesce(add(n), F.lit(0.0)), kind, F.coalesce(add(d), F.lit(0).cast(EXACT)).try_cast(EXACT))
            mean = F.coalesce(F.try_divide(add(n), many), F.lit(0.0))
            return number_literal(mean, F.when(many == 0, 0).otherwise(F.greatest(kind, F.lit(1))))
        if name in ("MIN", "MAX"):
            pick = F.min_by if name == "MIN" else F.max_by
            return pick(x, F.struct(number(x), lexical(x)))
        if name == "SAMPLE":
            return F.min(x)
        texts = F.array_sort(F.collect_set(lexical(x)) if distinct else F.collect_list(lexical(x)))
        return literal(F.array_join(texts, sep))

    def select(self, q: Query) -> Part:
        part = self.group(q.where)
        cols = {n: F.col(n) for n in part.names}
        found: dict = {}
        self.aggregates([e for e, _ in q.select] + q.having + [e for e, _ in q.order], found)
        df = part.df
        if q.group or found:
            keys = [(self.term(e, cols), n) for e, n in q.group]
            aggs = [self.aggregate(e, cols).alias(f"_a{i}") for i, e in enumerate(found.values())]
            grouped = df.groupBy(*(c.alias(n) for c, n in keys))
            df = grouped.agg(*aggs) if aggs else grouped.agg(F.lit(1).alias("_one"))
            cols = {n: F.col(n) for _, n in keys} | {k: F.col(f"_a{i}") for i, k in enumerate(found)}
            for h in q.having:
                df = df.where(F.coalesce(self.truth(h, cols), F.lit(False)))
        star = [n for n in part.names if not n.startswith("_b_")]
        chosen = [(self.term(e, cols), n) for e, n in q.select] if not q.star else [(F.col(n), n) for n in star]
        named = cols | {n: c for c, n in chosen}
        keys = []
        for k, (e, down) in enumerate(q.order):
            x = self.term(e, named)
            for c in (number(x), lexical(x)):
                keys.append((f"_o{len(keys)}", c, down))
        out = df.select(*(c.alias(n) for c, n in chosen), *(c.alias(n) for n, c, _ in keys))
        names = [n for _, n in chosen]
        if q.distinct and keys:  # of equal answers the one that comes first counts, key by key
            out = out.groupBy(*names).agg(*((F.max if down else F.min)(n).alias(n) for n, _, down in keys))
        elif q.distinct:
            out = out.distinct()
        if keys:
            out = out.orderBy(*(F.desc_nulls_last(n) if down else F.asc_nulls_first(n) for n, _, down in keys))
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
        return Part(out.select(*names), names, set(names))

    def result(self) -> Result:
        q = self.q
        if q.form == "SELECT":
            p = self.select(q)
            return Result("SELECT", p.df, p.names, self.notes)
        if q.form == "ASK":
            df = self.group(q.where).df.limit(1).agg((F.count("*") > 0).alias("answer"))
            return Result("ASK", df, ["answer"], self.notes)
        part = self.group(q.where) if q.where else self.unit()
        cols = {n: F.col(n) for n in part.names}
        if q.form == "DESCRIBE":
            every = self.pattern((("var", "s"), ("var", "p"), ("var", "o")), None).df
            told = None
            for e, _ in q.select:
                asked = part.df.select(self.term(e, cols).alias("s")).distinct()
                one = every.join(asked, "s", "left_semi")
                told = one if told is None else told.unionByName(one)
            return Result("DESCRIBE", told.select("s", "p", "o").distinct(), ["s", "p", "o"], self.notes)
        template = q.template or [t for item in q.where if item[0] == "bgp" for t in item[1]]
        rows = F.array(*(F.struct(*(self.term(("term", x), cols).alias(n) for n, x in zip("spo", t, strict=True))) for t in template))
        out = part.df.select(F.explode(rows).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()
        return Result("CONSTRUCT", out, ["s", "p", "o"], self.notes)


def closure(step: DataFrame, ends: dict | None = None) -> DataFrame:
    """(a, b): one or more steps of a distinct relation, cycles included. Lineage is cut by checkpoints.

    From a bound end (a term for ``a`` or ``b``) the steps are followed outward, only new pairs joining in each round. Without
    one, the pairs known are joined with themselves, so the rounds grow with the logarithm of the longest path."""
    spark = step.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        from tarn.sources.shared import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    step = step.where("a is not null and b is not null").checkpoint()
    if not ends:
        seen, n = step, step.count()
        while True:
            further = seen.select("a", F.col("b").alias("m")).join(seen.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
            seen = seen.unionByName(further).distinct().checkpoint()
            n, before = seen.count(), n
            if n == before:
                return seen
    end, far = ("a", "b") if "a" in ends else ("b", "a")
    hop = step.select(F.col(end).alias(far), F.col(far).alias("_next"))
    seen = new = step.where(F.col(end) == ends[end])
    while not new.isEmpty():
        found = new.join(hop, far).select(end, F.col("_next").alias(far)).distinct()
        new = found.join(seen, [end, far], "left_anti").checkpoint()
        seen = seen.unionByName(new).checkpoint()
    return seen
