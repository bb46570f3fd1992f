"""corpus_pipeline stage by stage: each against brute force or its operator's own verdicts on the stage's whole input."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from ebbtide.llm import decontaminate, gam, toxicity
from tests.conftest import SF_SMALL
from tests.llm.test_simhash import brute_components, slow
from tests.llm.test_urls_and_decontamination import brute

ITEMS = [(1, "which of the seven old bridges over the slow green river was built by the miller in the second year"),
         (2, "name the metal that the northern smith would never sell to a stranger before the first snow of winter"),
         (None, "an item without an id still stands in a text and must be found there all the same"), (3, "the")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """200 documents with planted copies, near copies, benchmark passages, nulls and repeated rows."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    r = random.Random(5)
    long = [d for d in docs if len((d[1] or "").split()) > 300][:6]

    def row(key, text, like=docs[0]):
        return (key, text, like[2], like[3], len(text or ""))

    planted = [row(10_000 + k, d[1], d) for k, d in enumerate(long)]  # exact copies
    for k, d in enumerate(long):  # near copies: one word of several hundred differs
        words = d[1].split(" ")
        words[r.randrange(len(words))] = "changed"
        planted.append(row(10_100 + k, " ".join(words), d))
    for k, (_, item) in enumerate(ITEMS[:3]):
        planted.append(row(10_200 + k, docs[20 + k][1] + " " + item + " " + docs[30 + k][1]))
    planted += [row(10_300, None), row(10_301, ""), row(None, docs[3][1]), docs[5], docs[5], row(10_302, "   \n")]
    rows = docs + planted
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    assert schema.names == names
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_every_stage_does_its_whole_job(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "tokens"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    inputs = {"toxicity": docs}
    for name, after in zip(list(stage)[:4], list(stage)[1:], strict=True):
        inputs[after] = corpus_pipeline.written(spark, stage[name](spark, inputs[name], folder), f"test-{name}")
        assert inputs[after].columns == docs.columns
        assert not rows_of(inputs[after]) - rows_of(inputs[name])  # nothing new, nothing altered

    def by_text(verdicts, keep):
        return {r["doc_id"] for r in verdicts.where(keep).collect()}

    # the two classifiers: rows go by the verdict of the operator on the stage's own input
    clean = by_text(toxicity.contract(spark, inputs["toxicity"], labels), "predicted = 0")
    assert {r["doc_id"] for r in inputs["quality"].collect()} == clean and {10_300, 10_301} <= clean
    good = by_text(gam.contract(inputs["quality"], labels), "predicted = 1")
    assert {r["doc_id"] for r in inputs["near_duplicates"].collect()} == good

    # near duplicates: components of fingerprints by brute force
    here = sorted({(r["doc_id"], r["text"]) for r in inputs["near_duplicates"].collect() if r["doc_id"] is not None},
                  key=lambda x: x[0])
    roots = brute_components([slow(t) for _, t in here])
    assert sorted(r["doc_id"] for r in inputs["decontamination"].collect() if r["doc_id"] is not None) == sorted(
        here[i][0] for i in set(roots))

    # decontamination: brute force over all items of five words and more
    here = [(r["doc_id"], r["text"]) for r in inputs["decontamination"].collect()]
    items = [(k if k is not None else -1, t) for k, t in ITEMS if len(t.split()) >= decontaminate.LEAST_WORDS]
    hit = {d for d, *_ in brute([(d, t) for d, t in here if d is not None], items)}
    assert Counter(r["doc_id"] for r in inputs["tokens"].collect()) == Counter(d for d, _ in here if d not in hit)

    # tokens: the tiktoken library
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = stage["tokens"](spark, inputs["tokens"], folder).collect()
    text = {r["doc_id"]: r["text"] or "" for r in inputs["tokens"].collect()}
    assert len(got) == inputs["tokens"].count()
    for r in got:
        ids = own.encode_ordinary(text[r["doc_id"]])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()

    # the whole run is the chain of its stages
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(r["doc_id"] for r in got)


def test_planted_copies_and_passages_go(spark, folder):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in stage["near_duplicates"](spark, docs, folder).collect()}
    assert not kept & set(range(10_000, 10_006)) and None in kept
    left = {r["doc_id"] for r in stage["decontamination"](spark, docs, folder).collect()}
    assert not left & {10_200, 10_201, 10_202} and {10_300, 10_301, None} <= left


def test_empty_tables_pass_all_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("toxicity", "quality", "decontamination"):  # nothing to learn from, nothing to look for: all rows stay
        some = docs.where(F.col("doc_id") < 30)
        assert dict(corpus_pipeline.STAGES)[name](spark, some, str(tmp_path)).count() == some.count()
