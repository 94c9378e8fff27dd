import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from rookery.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, decoded long"


def check(texts, rows):
    library = Tokenizer.from_file(FILE)
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, list(r.ids), r.decoded)) for r in rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check([(r.doc_id, r.text) for r in docs.collect()], bpe.encode_and_decode(docs.repartition(4), FILE).collect())


def test_edge_rows(spark):
    texts = [(1, None), (2, ""), (3, "  \n\n x"), (4, "same"), (4, "same"), (None, "<|endoftext|> a<|endoftext|>")]
    texts += [(5, "aaaa" * 20000), (6, "word's 漢字 1½ \x1c \x85\xa0 ́ it'll"), (7, " " * 9 + "x" + "\t\t")]
    frame = spark.createDataFrame([(*t, "x", 1) for t in texts], DOCS)
    check(texts, bpe.encode_and_decode(frame, FILE).collect())
    assert bpe.encode_and_decode(spark.createDataFrame([], DOCS), FILE).collect() == []


def test_random_texts():
    rng, own, library = random.Random(3), bpe.PrefixEncoder(FILE), Tokenizer.from_file(FILE)
    letters = [chr(c) for c in (9, 10, 13, 28, 32, 32, 32, 0x85, 0xA0, 39, 115, 116, 48, 178, 0x301, 0x4E00, 0x1F600, 0x3000)] + list("abcdeth thee 'll")
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert list(array("i", own.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_every_token_encodes_to_itself():
    own = bpe.PrefixEncoder(FILE)
    for token, raw in own.bytes_of.items():
        if token not in own.special.values() and raw.isascii():
            assert list(array("i", own.word(raw.decode()))) == [token]
