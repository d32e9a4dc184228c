"""Readers, the ingestion plan, streaming replays and ANN recall."""

import json
import os

from pyspark.sql import functions as F

from docloom.operators import collection as coll
from docloom.operators.ann import ann_topk, recall_at_k
from docloom.operators.knn import knn_topk
from docloom.operators.prompts import PromptSpec, render_few_shot_prompt
from docloom.plans.ingest import ingest
from docloom.sources.corpus import scan_instruction_set, scan_prompt_specs, scan_text_corpus
from docloom.sources import fixtures as FX
from docloom.streaming.streams import stream_ingest

SF = "/root/testdata/sf0.001"


def test_scan_text_corpus(spark, scratch):
    folder = os.path.join(scratch, "txt")
    os.makedirs(folder)
    docs = {"fdp-letter.pdf": "line one\nline two", "INSSN-pdf.pdf": "x  y"}
    for name, text in docs.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    got = {r.file: r.text for r in scan_text_corpus(spark, folder).collect()}
    assert got == docs


def test_scan_prompt_specs_and_render(spark, scratch):
    spec = {"name": "s1", "instruction": "Judge the question.", "output_format_instruction": "Return JSON.",
            "examples": [{"question": "q?", "output": {"verdict": 1, "feedback": "ok"}}],
            "input_keys": ["question"], "output_key": "output", "output_type": "json", "language": "english"}
    os.makedirs(os.path.join(scratch, "specs"))
    with open(os.path.join(scratch, "specs", "s1.json"), "w") as f:
        json.dump(spec, f, indent=2)
    rows = scan_prompt_specs(spark, os.path.join(scratch, "specs")).collect()
    assert len(rows) == 1 and rows[0].examples[0]["question"] == "q?"
    ps = PromptSpec.from_row(rows[0].asDict(recursive=True))
    assert ps.examples[0]["output"] == {"verdict": 1, "feedback": "ok"}
    df = spark.createDataFrame([("Is it?",)], "question string")
    prompt = render_few_shot_prompt(df, ps).first().prompt
    assert prompt.startswith("Judge the question.\nReturn JSON.\nExamples:\nquestion: q?\noutput: ```")
    assert prompt.endswith("question: Is it?\noutput: ")


def test_scan_instruction_set(spark, scratch):
    path = os.path.join(scratch, "instr")
    FX.instruction_samples(spark, SF).drop("sample_id").withColumn("split", F.lit("train")).write.partitionBy("split").parquet(path)
    assert scan_instruction_set(spark, path).count() == FX.instruction_samples(spark, SF).count()


def test_ingest_twice_inserts_nothing_new(spark, scratch):
    corpus = FX.corpus(spark, SF)
    r1 = ingest(corpus, scratch, "docs", quarantine=os.path.join(scratch, "failed"))
    r2 = ingest(corpus, scratch, "docs")
    rep = r1.report.first()
    assert r1.inserted > 0 and r2.inserted == 0
    assert rep.files_seen == corpus.count()
    assert coll.open_collection(spark, scratch, "docs").count() == r1.inserted


def test_stream_ingest_equals_batch_and_replay_adds_nothing(spark, scratch):
    src = os.path.join(scratch, "incoming")
    FX.corpus(spark, SF).repartition(3).write.parquet(src)
    stream_ingest(spark, src, os.path.join(scratch, "c"), "docs", os.path.join(scratch, "ck"))
    n1 = coll.open_collection(spark, os.path.join(scratch, "c"), "docs").count()
    # a fresh checkpoint replays every file: insert-if-absent keeps the collection unchanged
    stream_ingest(spark, src, os.path.join(scratch, "c"), "docs", os.path.join(scratch, "ck2"))
    n2 = coll.open_collection(spark, os.path.join(scratch, "c"), "docs").count()
    batch = ingest(FX.corpus(spark, SF), os.path.join(scratch, "b"), "docs").inserted
    assert n1 == n2 == batch


def test_ann_recall(spark):
    v = FX.vectors(spark, SF)
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    exact = knn_topk(q, v, k=10)
    full = ann_topk(q, v, k=10, cells=12, nprobe=12, block_rows=40)   # every cell probed, cells split in blocks
    assert recall_at_k(full, exact).agg(F.avg("recall")).first()[0] == 1.0
    part = ann_topk(q, v, k=10, cells=12, nprobe=6, block_rows=40)
    assert recall_at_k(part, exact).agg(F.avg("recall")).first()[0] >= 0.7
