"""Events, findings and notes as quads. Every projection is a set: repeating it adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn import model as M



def iri(o: Column) -> Column:
    return _object("iri", o, None)


def lit(o: Column, dt: str = M.STRING) -> Column:
    return _object("lit", o, dt)


def triple_term(s: Column, p: Column, o: Column) -> Column:
    tt = F.when(s.isNotNull() & o.isNotNull(), F.struct(s.alias("s"), p.alias("p"), o.alias("o")))
    return F.struct(F.lit("triple").alias("o_kind"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"), tt.alias("tt"))


def _object(kind: str, o: Column, dt: str | None) -> Column:
    return F.struct(F.lit(kind).alias("o_kind"), o.alias("o"), F.lit(dt).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("struct<s:string,p:string,o:string>").alias("tt"))


def quads(df: DataFrame, graph: Column, parts: list[tuple[Column, str, Column]]) -> DataFrame:
    """(graph, subject, predicate, object struct) for each part of each row; a null object gives no quad."""
    rows = F.array(*(F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("x")) for s, p, o in parts))
    out = df.select(graph.alias("g"), F.explode(rows).alias("q")).where("q.x.o is not null or q.x.tt is not null")
    return out.select("g", "q.s", "q.p", "q.x.o_kind", "q.x.o", "q.x.dt", "q.x.lang", "q.x.tt")


def graph_iri(conv_id: Column) -> Column:
    return M.NAMES.graph_term("NamedGraph", M.mangled(conv_id))


def turn_iri(ident: Column) -> Column:
    return M.NAMES.graph_term("Turn", ident)


def turns(events: DataFrame, claim: Column | None = None) -> DataFrame:
    """Turn quads, one graph for each conversation. Ids are checked, never mended. Thinking isn't projected."""
    e = events.withColumn("_s", turn_iri(M.checked_id(F.col("event_id"))))
    s, c = F.col("_s"), lambda name: F.col(name) if name in events.columns else F.lit(None).cast("string")
    parts = [
        (s, M.TYPE, iri(F.lit(M.V("Turn")))), (s, M.V("turnId"), lit(c("event_id"))), (s, M.V("role"), lit(c("role"))), (s, M.V("parentTurn"), iri(turn_iri(c("parent_id")))),
        (s, M.V("timestamp"), lit(c("timestamp"), M.DATETIME)), (s, M.V("text"), lit(c("text"))), (s, M.V("model"), lit(c("model"))), (s, M.V("modelSetting"), lit(c("model_setting"))),
    ]
    if claim is not None:
        own = F.when(F.col("role") == "user", claim)
        names = dict(zip(["from", "pane", "session", "soul", "user"], M.SENDER_PREDICATES, strict=True))
        parts += [(s, M.V(p), lit(own[k])) for k, p in names.items()]
    return quads(e, graph_iri(F.col("conv_id")), parts)


def _le64(n: Column) -> Column:
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, k, 2) for k in range(15, 0, -2))))



def finding_hash(transcript: Column, a: dict[str, Column]) -> Column:
    """16 hex digits over a finding's fields: equal findings get equal addresses."""
    zero, one = F.unhex(F.lit("00")), F.unhex(F.lit("01"))
    b = lambda x: F.encode(x, "UTF-8")
    legs = F.transform(F.array_sort(F.map_entries(a["signal"])), lambda e: F.concat(zero, b(e["key"]), one, F.unhex(F.lpad(F.hex(e["value"]["tag"]), 2, "0")), b(e["value"]["lex"])))
    head = F.concat(b(transcript), zero, b(a["reader"]), zero, b(a["event_type"]), zero, b(a["event_id"]), zero, _le64(a["start"]), _le64(a["end"]), zero, b(F.coalesce(a["source_kind"], F.lit(""))))
    return F.substring(F.sha2(F.aggregate(legs, head, lambda acc, x: F.concat(acc, x)), 256), 1, 16)




def findings(annotations: DataFrame, transcript: str = "conv_id") -> DataFrame:
    """Annotation, target, selector, body and claim quads. A claim is a triple term: it is stated about, never asserted."""
    cols = {c: F.col(c) for c in ("reader", "event_type", "event_id", "start", "end", "source_kind", "signal")}
    a = annotations.withColumn("_h", finding_hash(F.col(transcript), cols))
    node = lambda kind, suffix="": F.concat(F.lit(f"{M.NAMES.base}{kind}/"), F.col("_h"), F.lit(suffix))
    ann, target, selector, body, claim = node("Annotation"), node("Annotation", "/target"), node("Annotation", "/selector"), node("Annotation", "/body"), node("Claim")
    detector = F.concat(F.lit(f"{M.NAMES.base}Detector/"), M.mangled(F.col("reader")))
    turn, kind, name = turn_iri(M.checked_id(F.col("event_id"))), F.col("event_type"), F.col("reader")
    number = lambda c: lit(F.col(c).cast("string"), M.INTEGER)
    fixed = [
        (detector, M.TYPE, iri(F.lit(M.PROV + "SoftwareAgent"))), (detector, M.V("readerName"), lit(name)),
        (ann, M.TYPE, iri(F.lit(M.OA + "Annotation"))), (ann, M.PROV + "wasAttributedTo", iri(detector)), (ann, M.V("detectionType"), lit(kind)),
        (ann, M.PROV + "generatedAtTime", lit(F.col("ts"), M.DATETIME)), (ann, M.V("textOrigin"), lit(F.col("source_kind"))),
        (ann, M.OA + "hasTarget", iri(target)), (target, M.OA + "hasSource", iri(F.concat(F.lit(f"{M.NAMES.base}Transcript/"), M.mangled(F.col(transcript))))), (target, M.OA + "hasSelector", iri(selector)),
        (selector, M.TYPE, iri(F.lit(M.OA + "TextPositionSelector"))), (selector, M.OA + "start", number("start")), (selector, M.OA + "end", number("end")),
        (target, M.V("atTurn"), iri(turn)), (ann, M.PROV + "used", iri(turn)), (ann, M.OA + "hasBody", iri(body)),
        (claim, M.REIFIES, triple_term(turn, F.lit(M.V("exhibits")), kind)), (claim, M.PROV + "wasDerivedFrom", iri(ann)), (claim, M.V("detectorName"), lit(name)), (claim, M.V("detectionType"), lit(kind)),
    ]
    g = graph_iri(F.col(transcript))
    legs = a.select(g.alias("g"), body.alias("s"), F.explode("signal").alias("k", "v"))
    dt = F.when(F.col("v.tag") == M.INT_TAG, M.INTEGER).when(F.col("v.tag") == M.DECIMAL_TAG, M.DECIMAL).otherwise(M.STRING)
    legs = legs.select("g", "s", F.concat(F.lit(M.V("sig_")), M.mangled(F.col("k"))).alias("p"), F.lit("lit").alias("o_kind"), F.col("v.lex").alias("o"), dt.alias("dt"), F.lit(None).cast("string").alias("lang"), NO_TRIPLE_COLUMN())
    return quads(a, g, fixed).unionByName(legs).dropDuplicates(M.QUAD_COLUMNS)


def NO_TRIPLE_COLUMN() -> Column:
    return F.lit(None).cast("struct<s:string,p:string,o:string>").alias("tt")


def numeric(q: DataFrame) -> DataFrame:
    """Adds o_num, the number of numeric literals: comparisons are by number, not by text."""
    return q.withColumn("o_num", F.when(F.col("dt").isin(M.INTEGER, M.DECIMAL), F.expr("try_cast(o as decimal(38,9))")))


def note_id(first_turn: Column, text: Column) -> Column:
    return F.concat(F.lit("m"), F.substring(F.sha2(F.concat(F.encode(first_turn, "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256), 1, 15))


def memory(notes: DataFrame, summaries: DataFrame, graph: str = "memory") -> DataFrame:
    """Quads of notes (level 0) and of the built blocks inside the log, each linked to its turns or halves."""
    from tarn.operators import memory_tree as tree

    node = lambda ident: M.NAMES.graph_term("Memory", ident)
    g, related = F.lit(f"{M.NAMES.root}graph/NamedGraph/{graph}"), M.V("relatedToId")
    number = lambda c: lit(c.cast("string"), M.INTEGER)

    def common(s, ident, level, lo, hi, text, first, last, by):
        return [
            (s, M.TYPE, iri(F.lit(M.V("Memory")))), (s, M.V("memoryId"), lit(ident)), (s, M.V("memoryLevel"), number(level)), (s, M.V("logStart"), number(lo)), (s, M.V("logEnd"), number(hi)),
            (s, M.V("memoryText"), lit(text)), (s, M.V("windowStart"), lit(first, M.DATETIME)), (s, M.V("windowEnd"), lit(last, M.DATETIME)), (s, M.V("memoryModel"), lit(by)),
        ]

    c = F.col
    own = quads(notes, g, common(node(c("id")), c("id"), F.lit(0), c("pos"), c("pos"), c("text"), c("ts"), c("ts"), c("model")))
    cites = quads(notes.select("id", F.explode("turns").alias("t")), g, [(node(c("id")), related, iri(turn_iri(c("t"))))])
    at = notes.select(c("pos"), c("ts").alias("_ts"), c("id").alias("_id"))
    blocks = tree.parsed_blocks(summaries).join(at.select(c("pos").alias("lo"), c("_ts").alias("first")), "lo").join(at.select((c("pos") + 1).alias("hi"), c("_ts").alias("last")), "hi")
    s = node(c("block"))
    built = quads(blocks, g, common(s, c("block"), F.log2((c("hi") - c("lo")).cast("double")).cast("int"), c("lo"), c("hi") - 1, c("text"), c("first"), c("last"), c("model")))
    mid = F.floor((c("lo") + c("hi")) / 2)
    halves = blocks.select("block", F.explode(F.array(F.struct(c("lo").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), c("hi").alias("b")))).alias("h")).select("block", "h.a", "h.b")
    named = halves.join(at.select(c("pos").alias("a"), "_id"), "a", "left").withColumn("half", F.when(c("b") - c("a") == 1, c("_id")).otherwise(tree.block_id(c("a"), c("b"))))
    return own.unionByName(cites).unionByName(built).unionByName(quads(named, g, [(s, related, iri(node(c("half"))))]))


def n_triples(q: DataFrame, graphs: bool = False) -> DataFrame:
    """(line) in N-Triples, or N-Quads with ``graphs``."""
    from tarn.functions.text import escaped

    angle = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    quoted = lambda x: F.concat(F.lit('"'), escaped(x), F.lit('"'))
    typed = F.when((F.col("dt") == M.STRING) | F.col("dt").isNull(), "").otherwise(F.concat(F.lit("^^"), angle(F.col("dt"))))
    literal = F.concat(quoted(F.col("o")), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).otherwise(typed))
    term = F.concat(F.lit("<<( "), angle(F.col("tt.s")), F.lit(" "), angle(F.col("tt.p")), F.lit(" "), quoted(F.col("tt.o")), F.lit(" )>>"))
    o = F.when(F.col("o_kind") == "iri", angle(F.col("o"))).when(F.col("o_kind") == "triple", term).when(F.col("o_kind") == "bnode", F.concat(F.lit("_:"), F.col("o"))).otherwise(literal)
    end = F.concat(F.lit(" "), angle(F.col("g")), F.lit(" .")) if graphs else F.lit(" .")
    return q.select(F.concat(angle(F.col("s")), F.lit(" "), angle(F.col("p")), F.lit(" "), o, end).alias("line"))


# possessive and unrolled: Java loops over these, where repeated alternations recurse for each character
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SUFFIX = r"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?"
TERM = rf"""(<[^>]*>|_:[A-Za-z0-9_.-]+|{QUOTED}{SUFFIX}|<<\( <[^>]*> <[^>]*> (?:<[^>]*>|{QUOTED}{SUFFIX}) \)>>)"""


def unescaped(x: Column) -> Column:
    """The text of a literal as N-Triples writes it. Parted at escaped backslashes, so that the other escapes can't be mistaken."""

    def plain(part: Column) -> Column:
        for coded, text in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            part = F.replace(part, F.lit(coded), F.lit(text))
        return part

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), plain), "\\")


def parse_n_quads(lines: DataFrame, default_graph: str | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads lines of any length; a line that is neither is an error. Triples go to ``default_graph``."""
    from tarn.functions.text import trimmed

    line = trimmed(F.col("line"))
    kept = lines.select(line.alias("line")).where("line <> '' and not startswith(line, '#')")
    pattern = rf"^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+{TERM}\s*(?:<([^>]*)>\s*)?\.$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    bare = lambda x: F.regexp_replace(x, r"^<|>$|^_:", "")
    raw = kept.select("line", part(1).alias("s"), part(2).alias("p"), part(3).alias("t"), part(4).alias("gr"))
    raw = raw.withColumn("t", F.when(F.col("t") == "", F.raise_error(F.concat(F.lit("not a statement: "), F.substring("line", 1, 200)))).otherwise(F.col("t")))
    value = F.regexp_extract("t", rf"^({QUOTED})", 1)
    plain = unescaped(F.substring(value, F.lit(2), F.length(value) - 2))
    kind = F.when(F.col("t").startswith("<<("), "triple").when(F.col("t").startswith("<"), "iri").when(F.col("t").startswith("_:"), "bnode").otherwise("lit")
    lang = F.nullif(F.regexp_extract("t", r"\"@([A-Za-z0-9-]+)$", 1), F.lit(""))
    dt = F.when(kind == "lit", F.when(lang.isNotNull(), M.LANG).otherwise(F.coalesce(F.nullif(F.regexp_extract("t", r"\"\^\^<([^>]*)>$", 1), F.lit("")), F.lit(M.STRING))))
    inner = lambda k: F.regexp_extract("t", rf"^<<\( <([^>]*)> <([^>]*)> (<[^>]*>|{QUOTED}){SUFFIX} \)>>$", k)
    stated = F.when(inner(3).startswith("<"), bare(inner(3))).otherwise(unescaped(F.substring(inner(3), F.lit(2), F.length(inner(3)) - 2)))
    tt = F.when(kind == "triple", F.struct(inner(1).alias("s"), inner(2).alias("p"), stated.alias("o")))
    o = F.when(kind == "lit", plain).when(kind != "triple", bare(F.col("t")))
    return raw.select(F.coalesce(F.nullif("gr", F.lit("")), F.lit(default_graph).cast("string")).alias("g"), bare(F.col("s")).alias("s"), "p", kind.alias("o_kind"), o.alias("o"), dt.alias("dt"), lang.alias("lang"), tt.alias("tt"))


def readdressed(q: DataFrame, old: str, new: str) -> DataFrame:
    """Addresses below ``old`` moved to ``new`` in all places, triple terms too; literals stay."""
    move = lambda x: F.when(x.startswith(old), F.concat(F.lit(new), F.substring(x, F.lit(len(old) + 1), F.length(x)))).otherwise(x)
    tt = F.when(F.col("tt").isNotNull(), F.struct(move(F.col("tt.s")).alias("s"), move(F.col("tt.p")).alias("p"), F.col("tt.o").alias("o")))
    return q.withColumns({"g": move(F.col("g")), "s": move(F.col("s")), "p": move(F.col("p")), "o": F.when(F.col("o_kind") == "iri", move(F.col("o"))).otherwise(F.col("o")), "tt": tt})


def move_report(before: DataFrame, after: DataFrame, old: str, new: str) -> DataFrame:
    """One row: statements, turns and links before and after a move of addresses, what still has the old ones, and whether it may stand."""
    turn, link = M.V("turnId"), M.V("relatedToId")

    def counts(q: DataFrame, root: str, end: str) -> DataFrame:
        return q.agg(F.count("*").alias(f"statements_{end}"), F.count_distinct(F.when(F.col("p").endswith(turn.rsplit("/", 1)[-1]), F.col("s"))).alias(f"turns_{end}"), F.count_if(F.col("p").endswith(link.rsplit("/", 1)[-1])).alias(f"links_{end}"), F.count_if(F.col("s").startswith(root)).alias(f"at_{end}"), F.lit(1).alias("_k"))

    both = counts(before, old, "before").join(counts(after, old, "after"), "_k").drop("_k")
    same = (F.col("statements_before") == F.col("statements_after")) & (F.col("turns_before") == F.col("turns_after")) & (F.col("links_before") == F.col("links_after")) & (F.col("at_after") == 0)
    return both.withColumn("ok", same)
