"""Cases in which an operator did less than the whole job."""

import random
import string
import uuid

import public_tokenizers
import pytest

import corpus_pipeline
from ectolog.llm import bpe, decontaminate, registry, rows, secret_scan, warc


def test_decontamination_keeps_clean_rows(spark, make):
    item = "the quick brown fox jumps over the lazy dog again"
    rows = [(None, f"first {item} last"), (None, "clean words without an id"), (7, item), (7, "clean words of seven")]
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.kept_rows(make(rows), table).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, kept))) == [
        "(7, 'clean words of seven')",
        "(None, 'clean words without an id')",
    ]


def test_random_letters_are_secrets(make):
    rng = random.Random(3)
    keys = ["".join(rng.choices(string.ascii_letters, k=n)) for n in (20, 32, 40) * 20]
    words = "/static/images/background/header some_long_identifier_name internationalizationSupport"
    rows = [(i, f"key {key} end") for i, key in enumerate(keys)] + [(900, f"{words} {'-' * 40} {'=' * 25}")]
    found = secret_scan.scan(make(rows), registry.PLAIN, public_tokenizers.PATTERN).collect()
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert spans == {i: f"random:4:{4 + len(key)}" for i, key in enumerate(keys)} | {900: ""}


def test_warc_head_without_end_tag():
    page = "<html><head><title>T</title><meta charset=utf-8><style>p{}</style><body><p>One<p>two"
    assert warc.plain_text(page) == "One\ntwo"
    assert warc.plain_text("<head><title>T</title><script>x</script><p>One</p>two") == "One\ntwo"
    assert warc.plain_text("<head><title>T</title><link rel=x></head><title-bar>One</title-bar>") == "One"


@pytest.mark.parametrize("name", ["pipeline", "op5_bpe"])
def test_token_tasks_get_few_rows_at_a_time(spark, make, monkeypatch, tmp_path, name):
    seen = tmp_path / "seen"
    seen.mkdir()

    def noted(batch, most_bytes):
        (seen / f"{batch.num_rows}-{uuid.uuid4().hex}").touch()
        yield batch

    monkeypatch.setattr(rows, "TEXTS_AT_A_TIME", 7)
    monkeypatch.setattr(bpe, "pieces", noted)
    docs = make([(i, f"text number {i}") for i in range(90)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    if name == "pipeline":
        found = corpus_pipeline.token_stage(spark, docs, "")
    else:
        found = registry.op5_bpe(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(90))
    sizes = [int(p.name.split("-")[0]) for p in seen.iterdir()]
    assert sum(sizes) == 180 and max(sizes) <= 7
