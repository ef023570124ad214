"""The whole pipeline against a plain one, row by row, over the small tables with nulls, empty texts and repeated rows added."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tarn.llm import common, mixing, packing, secret_scan
from test_llm_operators import SF, plain_mix, plain_quality, plain_stage, plain_topics

BASE = {0: re.compile(secret_scan.ASSIGN), 1: re.compile("AKIA[A-Z0-9]+"), 2: re.compile("[0-9a-f]+")}
LEAST = {0: 12, 1: 18, 2: 16}


def plain_secrets(rows):
    """Texts with the live-looking values replaced, from rows (doc_id, text, lang, source)."""
    owners, repos, found = defaultdict(set), defaultdict(set), []
    for _, t, lang, source in rows:
        here = []
        for kind, pattern in BASE.items():
            for m in pattern.finditer(t or ""):
                v = m[2] if kind == 0 else m[0]
                if len(v) >= LEAST[kind]:
                    here.append((m.end() - len(v), m.end(), v))
                    owners[v].add(source or "")
                    repos[v].add((source or "", lang or ""))
        found.append(here)
    out = []
    for (_, t, _, _), here in zip(rows, found, strict=True):
        live = sorted({(s, e) for s, e, v in here if len(owners[v]) == 1 and len(repos[v]) < secret_scan.EXAMPLE_REPOS and re.search("[0-9]", v) and re.search("[A-Za-z]", v)})
        groups = []
        for s, e in live:
            if groups and s < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], e)
            else:
                groups.append([s, e])
        for s, e in reversed(groups):
            t = t[:s] + secret_scan.REPLACEMENT + t[e:]
        out.append(t)
    return out


def test_pipeline_equals_a_plain_one(spark):
    docs = common.table(spark, SF, "documents")
    good = common.table(spark, SF, "labels").where("quality = 1").select("doc_id")
    some = [r["text"] for r in docs.join(good, "doc_id", "left_semi").where("length(text) between 400 and 4000").orderBy("doc_id").limit(5).collect()]
    odd = [(900_001, None, "en", "s", 0), (900_002, "", None, None, None), (900_003, " \t\n", "xx", "s", 3), (900_004, some[0] + " " + some[3] + " password = 'a1b2c3d4e5f6a7b8' " + some[4], "en", "only", 1), (900_004, some[1], "en", "only", 1), (900_005, some[2], None, "s", 1), (900_005, some[2], None, "s", 1)]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    cols = ["doc_id", "text", "lang", "source"]
    rows = [tuple(r[c] for c in cols) for r in every.collect()]
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    train = {r[0]: r[1] for r in rows if r[0] < 900_000}
    # texts are scored by the weights that the labelled documents give; rows that share an id need ids of their own here
    named = {10_000_000 + i: t for i, (_, t, _, _) in enumerate(rows)}
    score = plain_quality(train | named, labels)
    tie = 1e-4
    assert all(abs(score[10_000_000 + i] - 0.5) > tie for i in range(len(rows)))

    stages = dict(corpus_pipeline.STAGES)
    at = common.stored(stages["quality"](spark, every, SF), "q")
    kept = [r for i, r in enumerate(rows) if score[10_000_000 + i] >= 0.5]
    flat = lambda df: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert at.columns == every.columns and flat(at) == sorted(kept, key=str) and 0 < len(kept) < len(rows)

    at = common.stored(stages["near_duplicates"](spark, at, SF), "n")
    left = plain_stage([(r[0], r[1]) for r in kept], 5, 80)
    assert sorted(((r[0], r[1]) for r in flat(at)), key=str) == left and len(left) < len(kept)
    before = flat(at)

    at = common.stored(stages["secrets"](spark, at, SF), "s")
    want = sorted(((r[0], t, r[2], r[3]) for r, t in zip(before, plain_secrets(before), strict=True)), key=str)
    assert not (set(flat(at)) ^ set(want)), [(x[0], len(x[1] or "")) for x in sorted(set(flat(at)) ^ set(want), key=str)]
    assert flat(at) == want and want != before
    sizes = {(r["doc_id"], r["text"]): r["n_chars"] for r in at.collect()}
    assert all(n == len(t) for (_, t), n in sizes.items() if t and secret_scan.REPLACEMENT in t)

    at = common.stored(stages["mix"](spark, at, SF), "m")
    topics = plain_topics([r[1] for r in want])
    n = [len((r[1] or "").encode().split()) for r in want]
    cells = Counter()
    for r, topic, k in zip(want, topics, n, strict=True):
        cells[(r[3] or "", r[2] or "", topic)] += k
    weight, _ = plain_mix(cells, corpus_pipeline.MIX_POWERS, mixing.ROUNDS)
    drawn = []
    for r, topic in zip(want, topics, strict=True):
        c = (r[3] or "", r[2] or "", topic)
        prob = round(corpus_pipeline.MIX_BUDGET * sum(n) * weight[c] / cells[c], 6) if cells[c] else 0.0
        if int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32 < prob:
            drawn.append(r)
    assert flat(at) == sorted(drawn, key=str) and 0 < len(drawn) < len(want)

    got = stages["pack"](spark, at, SF).toPandas()
    encode, pieces = packing.Encoder(), Counter()
    for r in drawn:
        pieces[(r[0], len(encode.exact(r[1] or "")) + 1)] += 1
    own = Counter((int(d), int(k)) for d, k in got.groupby(["doc_id"])["length"].sum().items()) if len({r[0] for r in drawn}) == len(drawn) else None
    assert own is None or own == pieces
    assert int(got["length"].sum()) == sum(k * c for (_, k), c in pieces.items())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, stage):
    none = common.table(spark, SF, "documents").limit(0).withColumn("extra", F.lit(1))
    out = dict(corpus_pipeline.STAGES)[stage](spark, common.stored(none, "none"), SF)
    assert out.count() == 0 and (stage == "pack" or out.columns == none.columns)


def test_run_leaves_the_stages_tables_and_those_of_its_answer(spark):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    out = corpus_pipeline.run(spark, SF)
    fresh = {p.name.rsplit("-", 1)[0]: p for p in folder.iterdir() if p.name not in before}
    assert fresh.keys() == {"pieces", "counts", *(f"stage-{n}" for n, _ in corpus_pipeline.STAGES[:-1])}
    mixed = spark.read.parquet(str(fresh["stage-mix"]))
    assert out.count() > 0 and out.where("piece = 0").count() == mixed.count() == spark.read.parquet(str(fresh["stage-secrets"])).join(mixed.select("doc_id"), "doc_id", "left_semi").count()
