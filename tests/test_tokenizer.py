"""token_len with a local tokenizer file: an Arrow-batched pandas UDF whose
lengths equal direct encoding."""

from pyspark.sql import functions as F

from tracekit.functions.text import token_len
from tracekit.sources import fixtures as X

from .conftest import SF_SMALL


def test_tokenizer_file_lengths(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    texts = [r.text for r in X.table(spark, SF_SMALL, "benchmark").select("text").collect()]
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=300, special_tokens=["[UNK]"]))
    path = str(tmp_path / "tok.json")
    tok.save(path)

    df = X.table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "text")
    got = {(r.conv_id, r.turn): r.n for r in df.select("conv_id", "turn", token_len(F.col("text"), path).alias("n"))
           .collect()}
    want = {(r.conv_id, r.turn): len(tok.encode(r.text, add_special_tokens=False).ids) for r in df.collect()}
    assert got == want and len(got) > 0
    nulls = spark.createDataFrame([(None,), ("",)], "t string").select(token_len(F.col("t"), path)).collect()
    assert [r[0] for r in nulls] == [0, 0]
