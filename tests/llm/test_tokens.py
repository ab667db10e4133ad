import os
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heatfield.llm import tokens
from heatfield.llm.common import scratch

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN = Tokenizer.from_file(PATH)
WORD = st.text(alphabet="abe'tsé .,\n\t3!<|>", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, max_size=6))
def test_encoder_equals_the_library(texts):
    got = tokens.encoder(PATH).encode([*texts, *texts])
    assert [x.tolist() for x in got] == [PLAIN.encode(t, add_special_tokens=False).ids for t in [*texts, *texts]]


def test_files_give_every_id_back(spark):
    docs = [(5, "one two  three\n\nfour"), (1, None), (9, "x " * 200_000), (2, ""), (7, "日本 <|endoftext|> y"), (9, "dup")]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in docs], "doc_id long, text string, file string, shard int")
    index = tokens.write_tokens(df, PATH, scratch(spark, "t"))
    got = sorted(tokens.read_tokens(index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in docs)
    at = 0
    for r in got:
        wants = [[*PLAIN.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs if d == r.doc_id]
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in wants]
        at += r.n_tokens
    ids, mask = tokens.Shard(index.filter("doc_id = 1").first().file).sequence(0)
    assert len(ids) == tokens.SEQ and len(mask) == tokens.SEQ and not ids.flags.owndata


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_tokens(tokens.write_tokens(df, PATH, scratch(spark, "t"))).count() == 0


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
