import hashlib

import sentencepiece

import corpus_pipeline
from tessera.llm.common import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_last_stage_writes_the_ids(spark, documents, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc, text, _, source, _ in rows:
        ids = [*lib.encode(text or ""), lib.eos_id()]
        want.append((doc, source, ids, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    got = corpus_pipeline.encode(spark, documents, SF).select("doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
