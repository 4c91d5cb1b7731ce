"""Tokens: nothing is lost, lengths are exact, offsets join up."""

import pytest
from pyspark.sql import functions as F

from repoweave.operators import tokens
from repoweave.plans.training import training_table
from repoweave.sinks.tokens import write_tokens

TEXTS = ["", " ", "a a a b", "rare wörd\n\n\t 机器  end ", "x" * 50, "a b\r\nc"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string")


def test_word_tokens_give_the_text_back(spark, texts):
    for size in (0, 2, 100):
        vocab = tokens.vocabulary(texts, size)
        ids = tokens.tokenize(texts, tokens.word_tokenizer(vocab))
        back = ids.select("doc_id", tokens.decode_words(F.col("input_ids"), vocab).alias("text"))
        assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(TEXTS))


def test_vocabulary_order(spark, texts):
    rows = tokens.vocabulary(texts, 3).orderBy("token_id").collect()
    assert [r.token_id for r in rows] == [257, 258, 259]
    assert [(-r.n, r.piece) for r in rows] == sorted((-r.n, r.piece) for r in rows)
    assert [(r.piece, r.n) for r in rows] == [("\n", 3), (" ", 3), (" a", 2)]


def test_byte_tokens(spark, texts):
    rows = tokens.tokenize(texts, tokens.byte_tokenizer).collect()
    assert {r.doc_id: bytes(r.input_ids).decode() for r in rows} == dict(enumerate(TEXTS))


@pytest.mark.parametrize("length", [1, 4, 60])
@pytest.mark.parametrize("truncation", [True, False])
def test_pad_truncate(spark, texts, length, truncation):
    df = tokens.tokenize(texts, tokens.byte_tokenizer).select(
        "input_ids",
        tokens.pad_truncate(F.col("input_ids"), length, truncation=truncation).alias("row"),
        tokens.attention_mask(F.col("input_ids"), length, truncation).alias("mask"),
    )
    for ids, row, mask in df.collect():
        kept = ids[:length] if truncation else ids
        blank = max(length - len(kept), 0)
        assert row == kept + [256] * blank
        assert mask == [1] * len(kept) + [0] * blank


def test_training_table_masks_padding(spark, texts):
    row = training_table(texts.filter("doc_id = 2"), tokens.byte_tokenizer, 10).first()
    assert row.input_ids == list(b"a a a b") + [256] * 3
    assert row.attention_mask == [1] * 7 + [0] * 3
    assert row.labels == list(b"a a a b") + [-100] * 3


def test_plugged_in_tokenizer(spark, texts):
    """Any library tokenizer fits behind the factory; it is built on the worker."""

    def create():
        tokenizers = pytest.importorskip("tokenizers")
        words = {"<unk>": 0, "a": 1, "b": 2}
        model = tokenizers.Tokenizer(tokenizers.models.WordLevel(words, unk_token="<unk>"))
        model.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
        return lambda batch: [e.ids for e in model.encode_batch(list(batch))]

    rows = {r.doc_id: r.input_ids for r in tokens.tokenize(texts, create).collect()}
    assert rows[2] == [1, 1, 1, 2] and rows[0] == []


def test_flat_stream(spark, texts, tmp_path):
    ids = tokens.tokenize(texts, tokens.byte_tokenizer)
    flat = [r.token for r in tokens.flatten_tokens(ids, ["-doc_id"]).orderBy("position").collect()]
    assert bytes(flat).decode() == "".join(reversed(TEXTS))
    write_tokens(ids, str(tmp_path / "t"), ["doc_id"])
    rows = spark.read.parquet(str(tmp_path / "t")).orderBy("offset", "doc_id").collect()
    assert bytes(t for r in rows for t in r.input_ids).decode() == "".join(TEXTS)
    assert all(r.n_tokens == len(r.input_ids) for r in rows)


def test_ids_made_in_order_are_placed_without_a_move(spark, tmp_path):
    """The same stream as from ids in any order, also with repeated keys; the ids of a stream pass no shuffle."""
    rows = [(i % 40, f"text {i % 40} " * (i % 7)) for i in range(60)]
    texts = spark.createDataFrame(rows, "doc_id int, content string").repartition(5)
    for order in (["doc_id"], ["-doc_id"]):
        ids = tokens.tokenize(texts, tokens.byte_tokenizer, order_by=order)
        placed = tokens.place_tokens(ids, order)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan
        flat = bytes(r.token for r in tokens.flatten_tokens(ids, order).orderBy("position").collect()).decode()
        assert flat == "".join(t for _, t in sorted(rows, key=lambda r: r[0] if order == ["doc_id"] else -r[0]))
    write_tokens(tokens.tokenize(texts, tokens.byte_tokenizer, order_by=["doc_id"]), str(tmp_path / "t"), ["doc_id"])
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["doc_id", "input_ids", "n_tokens", "offset"]
    with pytest.raises(ValueError, match="changed"):
        tokens.place_tokens(ids.withColumn("input_ids", tokens.F.array(tokens.F.lit(1))), order)
    other = tokens.place_tokens(tokens.tokenize(texts.dropDuplicates(["doc_id"]), tokens.byte_tokenizer, order_by=["doc_id"]), ["-doc_id"])
    assert other.agg({"offset": "min"}).first()[0] == 0 and other.orderBy("doc_id").first().offset > 0


def test_tables_are_dealt_out_only_if_their_splits_are_uneven(spark, tmp_path):
    from repoweave.registry import fixtures

    for name, parts in (("one", 1), ("many", 64)):
        docs = spark.range(6400).selectExpr("id doc_id", "repeat('x', 9000) text").repartition(parts, "doc_id" if parts > 1 else tokens.F.lit(0))
        docs.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/{name}/documents.parquet")
    one, many = (fixtures.table(spark, f"{tmp_path}/{name}", "documents") for name in ("one", "many"))
    moved = ["REPARTITION" in d._jdf.queryExecution().executedPlan().toString() for d in (one, many)]
    assert moved == [True, False] and one.count() == many.count() == 6400
