"""Tokens by a dictionary of pre-tokens are the library's own."""

import pytest

from millrace.operators import pretokens
from millrace.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", None, "a", "Héllo  wörld's\n\n 123 日本 x🙂", "the the the the", " \t\n", "before <|endoftext|> after", "<|ENDOFTEXT|>", "é é İ İ", "x" * 300, "it's it's " * 2000, "\x00 \x1f​", "😀" * 50, "the the the the"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("head", [1 << 15, 1])
def test_tokens_equal_the_library(spark, monkeypatch, name, head):
    monkeypatch.setattr(pretokens, "HEAD", head)
    rows = [("d", None if i == 3 else "o", i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "domain string, origin string, doc int, text string")
    got = {r["doc"]: (r["origin"], r["tokens"]) for r in pretokens.tokens_by_dictionary(docs, public_tokenizers.path(name), ("domain", "origin", "doc")).collect()}
    whole = library(name)
    assert got == {i: (o, whole.encode(t or "", add_special_tokens=False).ids) for _, o, i, t in rows}
    assert pretokens.tokens_by_dictionary(docs.limit(0), public_tokenizers.path(name), ("domain", "origin", "doc")).count() == 0


def test_each_pre_token_is_merged_once(spark):
    uses = spark.createDataFrame([("hello</w>", False)] * 40 + [("x", False), ("x", True), (None, None)], "entry string, whole boolean")
    found = pretokens.dictionary(uses, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r["entry"], r["whole"], r["n"]) for r in found.collect()) == [("hello</w>", False, 40), ("x", False, 1), ("x", True, 1)]


def test_a_worker_holds_the_entries_of_few_texts():
    """Of a batch of many texts, entries go out every so many characters; all
    of them, with their keys, in order."""
    import pyarrow as pa

    text = "the quick brown fox jumps " * 40
    batch = pa.RecordBatch.from_pydict({"doc": list(range(3000)), "text": [None if i % 100 == 99 else text for i in range(3000)]})
    out = list(pretokens._entries(public_tokenizers.path("word_bpe_49k.json"), ["doc"])(iter([batch])))
    assert max(o.num_rows for o in out) <= 5 * (pretokens.PENDING // len(text) + 1) + 10
    docs = [d for o in out for d in o.column("doc").to_pylist()]
    assert docs == sorted(docs) and set(docs) == set(range(3000))
    assert sum(len(at or []) for o in out for at in o.column("at").to_pylist()) == 2970 * 200


def test_whole_table_equals_the_library(spark):
    whole = library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = [e.ids for e in whole.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)]
    want = {r["doc_id"]: (len(i), ",".join(map(str, i))) for r, i in zip(docs, ids)}
    assert {r["doc_id"]: (r["n_tokens"], r["tokens"]) for r in QUERIES["tokenize_by_dictionary"](spark, SF).collect()} == want


def test_ingestion_by_dictionary_gives_the_same_blocks(spark, tmp_path):
    from millrace.plans.config import IngestConfig
    from millrace.plans.ingest import build_corpus

    for domain in ("a", "b"):
        spark.createDataFrame([(f"{domain} the quick {i} fox's <|endoftext|>" if i % 7 == 0 else f"{domain} jumps over it {i}",) for i in range(60)], "text string").write.parquet(f"{tmp_path}/raw/{domain}/o{domain}")
    found = []
    for by_dictionary in (False, True):
        cfg = IngestConfig(f"{tmp_path}/raw/a/**/*.parquet", f"{tmp_path}/raw/b/**/*.parquet", f"{tmp_path}/out{by_dictionary}", block_size=16, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), by_dictionary=by_dictionary)
        build_corpus(spark, cfg)
        found.append(sorted(map(repr, spark.read.parquet(cfg.out).select("domain", "origin", "block", "token_ids", "n_bytes", "content_hash", "split").collect())))
    assert found[0] == found[1] and len(found[0]) > 40
    with pytest.raises(ValueError, match="json"):
        build_corpus(spark, IngestConfig(f"{tmp_path}/raw/a/**/*.parquet", f"{tmp_path}/raw/b/**/*.parquet", f"{tmp_path}/x", by_dictionary=True))
