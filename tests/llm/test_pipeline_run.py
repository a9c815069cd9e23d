"""The whole pipeline, through ``run``, on awkward tables; scratch that it leaves."""

import os
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.common import store

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _folder(docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        docs.sparkSession.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _there(spark):
    root = store.shared_root(spark).removeprefix("file://") + "/tidewire"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_run_on_awkward_documents(spark, tmp_path):
    plain = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    good = {r.doc_id for r in corpus_pipeline.quality_rules(spark, plain, DATA).collect()}
    text = {r.doc_id: r.text for r in plain.collect()}
    base = next(text[i] for i in sorted(good) if 200 < len(WORD.findall(text[i])) < 900)
    more = [(9001, None), (9002, ""), (9003, " \n "), (9004, base), (9004, base), (9005, base + " one more word"), (None, base.replace(" ", "  ")), (9006, f"{base} {item}"), (None, None)]
    extra = spark.createDataFrame([(i, t, "en", None, None) for i, t in more], plain.schema)
    clash = {c: F.lit(k) for k, c in enumerate(("quality_", "node", "set_key", "row", "block", "n_tokens", "found"))}
    docs = plain.unionByName(extra).withColumns(clash)
    before = _there(spark)
    got = corpus_pipeline.run(spark, _folder(docs.repartition(3), tmp_path / "a"))
    rows = got.collect()
    assert len(_there(spark) - before) == 1  # the result alone is left
    ids = {r.doc_id for r in rows}
    assert not ids & {9001, 9002, 9003, 9006} and len(ids & {9004, 9005, None, *(i for i in good if text[i] == base)}) <= 1
    # What is left are whole documents of the input, packed without a gap.
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    length = Counter()
    for r in rows:
        length[r.doc_id] += r.length
    assert all(length[i] == len(encode(text[i], add_special_tokens=False).ids) + 1 for i in list(ids & set(text))[:20])
    kept = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    assert len(kept & ids) >= len(kept) - 2 and ids - kept <= {9004, 9005, None, *text}


def test_run_on_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    empty = corpus_pipeline.run(spark, _folder(docs.limit(0), tmp_path / "b"))
    assert empty.count() == 0 and "sequence_id" in empty.columns
    blank = docs.limit(5).withColumn("text", F.lit(None).cast("string"))
    assert corpus_pipeline.run(spark, _folder(blank, tmp_path / "c")).count() == 0
