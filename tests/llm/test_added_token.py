"""The tokenizer file's added token, against the library as it is loaded."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from sablewatch.llm import attribution, token_store
from sablewatch.session import shared_folder

TEXTS = ["a <|endoftext|> b", "a<|endoftext|>b", "  <|endoftext|>  x", "<|endoftext|><|endoftext|>\n\n y é",
         "é　<|endoftext|>\t<|endoftext", "plain"]


def test_added_token_is_one_id(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    store = token_store.write_store(docs, shared_folder(spark, "store"), shards=2)
    got = {r.key: r for r in token_store.read_store(token_store.stored_keys(docs), store).collect()}
    counts = {r.doc_id: (r.n_chars, r.n_tokens) for r in attribution.token_attribution(docs, ["text"]).collect()}
    at = 0
    for i, text in enumerate(TEXTS):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u2").tolist() == ids + [2], text
        assert got[i].start == at
        assert counts[i] == (len(text), len(ids)), text
        at += len(ids) + 1
