"""The pipeline's stages in turn, and the registered queries."""

import math
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnflow.llm import decontamination, neardup, quality
from tarnflow.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import ODD, SCHEMA, WORD, base_spans, brute_components, pieces, slow_best_fit, slow_kneser_ney


def test_stages(spark, sf_medium):
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_medium)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        ids = [r["doc_id"] for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.collect()}
        if name == "quality classifier":
            assert set(ids) == {r["doc_id"] for r in quality.judged(before, spark.read.parquet(f"{sf_medium}/labels.parquet")).where("keep").collect()}
        elif name == "near-duplicates":
            assert set(ids) == {r["doc_id"] for r in neardup.near_duplicates(before).where("kept").collect()}
        elif name == "benchmark decontamination":
            assert decontamination.contaminated(after, spark.read.parquet(f"{sf_medium}/benchmark.parquet")).count() == 0
        else:
            assert len(ids) == before.count() and not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", r["text"]) for r in after.collect())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_medium)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, sf_medium).count() == packed.count()


def brute_quality(rows, labels):
    """Kept rows: perplexity by a slow model of all trusted texts, thresholds from all labelled ones."""
    good = {i for i, q in labels.items() if q == 1}
    langs = {r["lang"] for r in rows if sum(x["lang"] == r["lang"] and x["doc_id"] in good for x in rows) >= quality.FEWEST}
    models = {g: slow_kneser_ney([pieces(r["text"]) for r in rows if r["doc_id"] in good and g in ("", r["lang"])], quality.ORDER) for g in langs | {""}}

    def perplexity(r):
        s, p = pieces(r["text"]), models[r["lang"] if r["lang"] in langs else ""]
        logs = [math.log(p(s[k - quality.ORDER + 1 : k], s[k])) for k in range(quality.ORDER - 1, len(s))]
        return math.exp(-sum(logs) / len(logs)) if logs else None

    value = {r["doc_id"]: perplexity(r) for r in rows}
    at = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]

    def limit(lang):
        some = [r["doc_id"] for r in rows if lang in (None, r["lang"]) and value[r["doc_id"]] is not None]
        yes, no = ([value[i] for i in some if labels.get(i) == q] for q in (1, 0))
        if len(yes) < (quality.FEWEST_LABELS if lang else 1):
            return None
        low, high = at(no, quality.LOW) if no else math.inf, at(yes, quality.HIGH)
        return math.sqrt(low * high) if len(no) >= quality.FEWEST_LABELS and low > high else at(yes, quality.TAIL)

    limits = {g: limit(g) for g in {r["lang"] for r in rows} | {None}}
    return [r for r in rows if value[r["doc_id"]] is not None and value[r["doc_id"]] <= (limits[r["lang"]] or limits[None])]


def test_run_against_brute_force(spark, sf_small):
    """Every stage again in plain loops, over whole tables."""
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    kept = brute_quality(rows, labels)
    near = brute_components(sorted((r["doc_id"], r["text"]) for r in kept), 5)
    kept = [r for r in kept if near[r["doc_id"]][1] == r["doc_id"]]
    runs = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    items = [runs(r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    kept = [r for r in kept if not any(x and len(x & runs(r["text"])) >= 0.8 * len(x) for x in items)]
    library, want, lengths = Tokenizer.from_file(WORD), {}, []
    for r in kept:
        text, cuts = r["text"] or "", sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base_spans(r["text"] or "")))
        for a, b, kind in reversed(cuts):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        want[r["doc_id"]] = len(library.encode(text, add_special_tokens=False).ids) + 1
        lengths += [min(4096, want[r["doc_id"]] - a) for a in range(0, want[r["doc_id"]], 4096)]
    found = corpus_pipeline.run(spark, sf_small).collect()
    sums = {}
    for r in found:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
    assert sums == want and len({r["sequence_id"] for r in found}) == slow_best_fit(lengths, 4096)[0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_and_clashing_tables(spark, sf_small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = spark.createDataFrame([(i, t, g, "s", 0 if t is None else len(t), "clash", "clash") for i, t, g in ODD], SCHEMA)
    clash = odd.withColumnsRenamed({"bucket": "row", "mark": "rank"}).withColumns({c: F.lit(1) for c in ("keep", "turn", "__kept", "cuts", "spans", "k", "i", "start", "length", "offset")})
    last = name == corpus_pipeline.STAGES[-1][0]
    for frame in (odd, odd.limit(0), clash):
        out = stage(spark, frame, sf_small)
        assert last or out.columns == frame.columns
        ids = {r["doc_id"] for r in out.collect()}
        given = {i for i, _, _ in ODD} if not frame.isEmpty() else set()
        assert ids <= given and (ids == given or name not in ("personal data", "packing", "near-duplicates"))
        if name == "quality classifier" and given:
            assert ids <= given - {1, 2, 3}


def test_names():
    assert sorted(n for n in QUERIES if n.startswith("op")) == sorted(QUERIES)[: len(QUERIES) - 1]
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"} and set(ORACLES) <= set(QUERIES)
