"""Events to prose turns, the ordered stream, and stretches of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T

STRETCH_BYTES = 24_000


def prose_turns(events: DataFrame) -> DataFrame:
    """(source, conv_id, pos, id, ts, role, text): one vocabulary of roles, own words only, then what was done as lines. Events without a time go."""
    calls = events.select("source", "conv_id", F.posexplode("outcomes").alias("_k", "o"), F.col("pos").alias("_p")).groupBy("source", "conv_id", F.col("o.id").alias("cid")).agg(F.max_by("o", F.struct("_p", "_k")).alias("o"))
    acts = events.select("source", "conv_id", "pos", "event_id", F.posexplode("actions").alias("k", "a")).withColumn("cid", F.col("a.id")).join(calls, ["source", "conv_id", "cid"], "left")
    lines = acts.select("source", "conv_id", "pos", "event_id", "k", T.action_line(F.col("a.kind"), F.col("a.target"), F.col("o")).alias("line"))
    did = lines.groupBy("source", "conv_id", "pos", "event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("did"))
    steps = F.col("source") == "steps"
    role = F.when(steps & (F.col("role") == "USER_EXPLICIT"), "user").when(steps & (F.col("role") == "MODEL"), "assistant").when(~steps, F.col("role"))
    own = T.authored(F.col("text"), F.col("text_provenance"))
    own = F.when(F.regexp_replace(own, r"(?U)^\s+", "").startswith(T.COMPACTION_OPENING), "").otherwise(own)
    e = events.withColumns({"_role": role, "_own": own}).where("_role is not null and timestamp is not null").join(did, ["source", "conv_id", "pos", "event_id"], "left")
    said = F.when(F.col("_role") == "user", F.when(steps, T.request_body(F.col("_own"))).otherwise(T.human_words(F.col("_own")))).otherwise(F.col("_own"))
    full = F.when((F.col("_role") == "assistant") & F.col("did").isNotNull(), F.concat(said, F.when(T.trimmed(said) != "", "\n").otherwise(""), F.col("did"))).otherwise(said)
    return e.select("source", "conv_id", "pos", F.col("event_id").alias("id"), F.col("timestamp").alias("ts"), F.col("_role").alias("role"), full.alias("text"))


def is_action_lines(text: Column) -> Column:
    return (T.trimmed(text) != "") & F.forall(F.split(F.regexp_replace(text, r"\n$", ""), "\n"), lambda l: l.startswith("[") & l.endswith("]"))


def fold_actions(turns: DataFrame, key: str = "conv_id", pos: str = "pos") -> DataFrame:
    """Turns that only act join a turn with words: the speaker's one before, or, where the human spoke last, the next one; else they go.

    Between two turns with words all acting turns have one fate, so the fold is two window passes: each acting turn finds
    the last words before it and the first ones after. It goes back if those before are the assistant's, else forward if
    those after are the assistant's."""
    by = [key] if key == "conv_id" and "source" not in turns.columns else ["source", key]
    w = W.partitionBy(*by).orderBy(pos)
    t = turns.withColumn("_act", (F.col("role") == "assistant") & is_action_lines(F.col("text"))).withColumn("_word", ~F.col("_act") & (T.trimmed(F.col("text")) != ""))
    mark = F.when(F.col("_word"), F.struct(F.col(pos).alias("p"), F.col("role").alias("r")))
    t = t.withColumns({"_b": F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), "_a": F.first(mark, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))})
    goal = F.when(F.col("_b.r") == "assistant", F.col("_b.p")).when(F.col("_a.r") == "assistant", F.col("_a.p"))
    acts = t.where("_act").withColumn("_goal", goal).where("_goal is not null").groupBy(*by, F.col("_goal").alias(pos)).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "text"))).alias("_acts"))
    join = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), "\n")
    out = t.where("not _act").join(acts, [*by, pos], "left")
    early, late = F.filter("_acts", lambda x: x["p"] < F.col(pos)), F.filter("_acts", lambda x: x["p"] > F.col(pos))
    text = F.when(F.col("_acts").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.array(F.nullif(join(early), F.lit("")), F.col("text"), F.nullif(join(late), F.lit(""))), lambda x: x.isNotNull()), "\n"))
    return out.select(*(F.col(c) if c != "text" else text.alias("text") for c in turns.columns))


def stream(turns: DataFrame) -> DataFrame:
    """Turns with words, each id once (where it was first), ordered by the time's text; ties by source, conversation and place."""
    first = W.partitionBy("id").orderBy("source", "conv_id", "pos")
    own = turns.where(T.trimmed(F.col("text")) != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return own.orderBy("ts", "source", "conv_id", "pos")


def stretches(ordered: DataFrame, size: Column, group: str, order: list[str], limit: int = STRETCH_BYTES) -> DataFrame:
    """Adds ``stretch`` from 0: a row that would take its stretch over ``limit`` opens the next one; none is empty.

    A stretch depends on all before it in its group, so a group's sizes are one sorted stream. The fold keeps two numbers and
    reads (group, order, size) batch by batch: a long group spills in its sort and is never held in memory; texts don't go through it."""
    from collections.abc import Iterator

    import pandas as pd

    slim = ordered.select(group, *order, size.cast("long").alias("_n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_n") + ", stretch int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, full, at = object(), 0, 0
        for pdf in batches:
            out = []
            for g, n in zip(pdf[group], pdf["_n"], strict=True):
                if g != now:
                    now, full, at = g, n, 0
                elif full + n > limit:
                    full, at = n, at + 1
                else:
                    full += n
                out.append(at)
            yield pdf.drop(columns="_n").assign(stretch=out)

    placed = slim.repartition(group).sortWithinPartitions(group, *order).mapInPandas(fold, schema)
    return ordered.join(placed, [group, *order])


def unread(turns: DataFrame, read: DataFrame, until: str) -> DataFrame:
    """Turns whose id was not read and that are older than ``until``. Late ones count: nothing is dropped by time of arrival."""
    return turns.join(read.select("id").distinct(), "id", "left_anti").where(F.col("ts") < until)


def backlog(pending: DataFrame) -> DataFrame:
    """(turns, bytes, oldest) of what is unread, long turns counted as clipped."""
    return pending.agg(F.count("*").alias("turns"), F.coalesce(F.sum(T.clipped_bytes(F.col("text"))), F.lit(0)).alias("bytes"), F.min("ts").alias("oldest"))


def accepted_notes(answers: DataFrame, stretch: DataFrame) -> DataFrame:
    """Notes of a writer's answers (n, text, cites) over a stretch (idx from 1, id, ts): citations in order of time, neighbours that repeat once, the first gives the time. Without a valid citation a note goes."""
    cited = answers.select("n", "text", F.explode("cites").alias("idx")).join(stretch, "idx")
    one = cited.groupBy("n", "text").agg(F.array_sort(F.collect_list(F.struct("ts", "idx", "id"))).alias("c"))
    turns = F.transform(F.filter(F.transform("c", lambda x, i: F.struct(x["id"].alias("id"), F.get(F.col("c"), i - 1)["id"].alias("b"))), lambda x: ~x["id"].eqNullSafe(x["b"])), lambda x: x["id"])
    from tarn.operators.project import note_id

    return one.select("n", F.get("c", F.lit(0))["ts"].alias("ts"), "text", turns.alias("turns")).withColumn("id", note_id(F.get("turns", F.lit(0)), F.col("text")))


def where_label(harness: Column, place: Column, session: Column) -> Column:
    return F.concat_ws(" · ", harness, place, F.substring(session, 1, 8))


def label_peers(turns: DataFrame, sends: DataFrame, me: str) -> DataFrame:
    """Conversations that ``me`` opened for a helper go; user turns that a peer sent get kind and peer."""
    from tarn.operators import peers

    t = turns.withColumn("_unix", F.try_to_timestamp(F.col("ts")).cast("long"))
    said = t.where((F.col("role") == "user") & (T.trimmed(F.col("text")) != ""))
    opening = said.groupBy("source", "conv_id").agg(F.min_by(F.struct("text", "_unix"), "pos").alias("o")).select(F.struct("source", "conv_id").alias("id"), F.lit(me).alias("me"), F.col("o._unix").alias("ts"), F.col("o.text").alias("text"))
    mine = peers.spawned(opening, sends).select("id.source", "id.conv_id")
    kept = t.join(mine, ["source", "conv_id"], "left_anti")
    key = F.struct("source", "conv_id", "pos")
    asked = kept.where("role = 'user'").select(key.alias("id"), F.lit(me).alias("receiver"), F.col("_unix").alias("ts"), "text")
    found = peers.senders(asked, sends).select("id.*", "kind", "peer")
    return kept.drop("_unix").join(found, ["source", "conv_id", "pos"], "left")


def speaker_line(role: Column, kind: Column, peer: Column, human: str) -> Column:
    """Who speaks in a turn, for a reader of the stream."""
    p = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    return (
        F.when(role != "user", "you")
        .when(kind == "whole", p(peer, " (another agent, a message to you)"))
        .when(kind == "leading", p(peer, f" (another agent), then more words that arrived with it — {human}'s or another agent's"))
        .when(kind == "embedded", p(f"{human}, then a message from another agent, ", peer, f", that arrived while {human} typed"))
        .otherwise(human)
    )


def stretch_text(turns: DataFrame, group: str, human: str) -> DataFrame:
    """(group, stretch, text): the numbered turns (idx, ts, place, role, kind, peer, text) of each stretch, a stretch being bounded by its bytes."""
    said = F.when((F.col("role") == "user") & F.col("kind").isNull(), T.mark_quote_backs(T.relabel_pastes(T.relabel_channels(F.col("text"))))).otherwise(T.relabel_channels(F.col("text")))
    one = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), "ts", F.lit(" · "), "place", F.lit("\n"), speaker_line(F.col("role"), F.col("kind"), F.col("peer"), human), F.lit(": "), said)
    return turns.select(group, "stretch", "idx", one.alias("t")).groupBy(group, "stretch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def note_prompt(stretch: Column, human: str, wake: Column | None = None) -> Column:
    """What a writer is asked for the notes of a stretch's text (``stretch_text``). A session opens with its ``wake``, the memory's lines, and with
    who speaks how; later stretches, without a wake, follow on."""
    rules = (
        f"Turns of 'you' are your own, turns of '{human}' are {human}'s, but for passages marked as pasted or as another agent's; turns under an agent's name are that agent's. "
        "A line in brackets in your turns is something that you did, with its outcome. The numbers in front are for citing turns only; no note may hold one."
    )
    ask = "Write down what of this is worth remembering, in order, if anything is; name the numbers of the turns that each note rests on."
    opening = F.lit("What comes next.\n\n")
    if wake is not None:
        known = F.when(F.coalesce(wake, F.lit("")) == "", "Nothing is remembered yet.").otherwise(wake)
        first = F.concat(F.lit("You go through your own past in order, as it happened. This is what you remember:\n\n"), known, F.lit(f"\n\nWhat comes next. {rules}\n\n"))
        opening = F.when(wake.isNull(), opening).otherwise(first)
    return F.concat(opening, F.coalesce(stretch, F.lit("")), F.lit(f"\n\n{ask}"))
