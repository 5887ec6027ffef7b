import base64
import hashlib
import random
import struct
import time

import public_tokenizers as tokenizers
import pytest
import tiktoken

from groundframe.llm.bpe import Bpe, Pairs, _cache, _ranks, _Tokens, merge, read_ranks
from groundframe.llm.queries import QUERIES

PATH = tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=_ranks(read_ranks(PATH)), special_tokens={})


def test_query_equals_the_library(spark, sf):
    enc, docs = library(), spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, sf).collect()}
    assert len(out) == len(docs)
    for d in docs:
        ids, r = enc.encode_ordinary(d["text"]), out[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def test_chunks_meet_and_edges(spark):
    enc = library()
    random.seed(3)
    texts = ["".join(random.choices(["a", "bc", " ", "  ", "\n", "é", "'s", "1", "!", "漢"], k=k)) for k in (0, 5, 63, 64, 65, 200, 3000)]
    texts += [None, "", "x" * 1000, " " * 700 + "y", "ab" * 10 + "z" * 500 + " ok", "\n" * 300, texts[-1], texts[-1]]
    df = spark.createDataFrame([(i if i % 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, bpe_key int")
    bpe = Bpe(spark, PATH, tokenizers.PATTERN, chunk=64, overlap=16)
    out = {r["bpe_key"]: r for r in bpe.encode(df).withColumn("back", bpe.decode("ids")).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert bytes(out[i]["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and bytes(out[i]["back"]).decode() == (t or "")
    assert bpe.encode(df.limit(0)).count() == 0
    assert base64.b64decode(read_ranks(PATH).split()[0])


def test_chunks_that_end_in_white_space(spark):
    """A pattern whose matches can join what follows: the last match of a chunk may be another one in the whole text."""
    pattern = r"\s*[\r\n]+|\s+(?!\S)|[^\s]+|\s+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(read_ranks(PATH)), special_tokens={})
    random.seed(5)
    texts = ["".join(random.choices(["a", "bc", " ", "  ", "     ", "\n", "\r\n"], weights=[3, 3, 6, 6, 4, 2, 1], k=600)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bpe = Bpe(spark, PATH, pattern, chunk=64, overlap=16)
    for r in bpe.encode(df).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_merge_side_by_side_in_less_time():
    """Most pieces of a text are words of a few bytes; merging them one by one took most of the encoding."""
    enc, ranks = library(), _ranks(read_ranks(PATH))
    pairs = Pairs(ranks)
    random.seed(7)
    pieces = [("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9)))).encode() for _ in range(20_000)]
    began = time.process_time()
    alone = [struct.pack(f"<{len(x)}I", *x) for x in (merge(p, ranks) for p in pieces)]
    middle = time.process_time()
    assert pairs.merge(pieces) == alone and time.process_time() - middle < 0.6 * (middle - began)
    odd = ["".join(random.choices(letters, k=k)).encode() for k in (1, 2, 3, 20, 63, 64) for letters in ("a", "ab", "ab\u00e9\u6f22 ", "\x00\x01") for _ in range(5)]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in pairs.merge(odd)] == [enc._encode_single_piece(p) for p in odd]


def test_ranks_without_all_bytes():
    """Parts that are no tokens have no pairs: such pieces are merged one by one, and a byte without a token fails."""
    data = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate((b"a", b"b", b"ab", b"abab", b"xy")))
    ids = _cache(data, Pairs(_ranks(data)))
    assert ids.packed([["ab", "ababa", "xy"], []]) == [struct.pack("<4I", 2, 3, 0, 4), b""]
    with pytest.raises(KeyError):
        ids.packed([["ac"]])


def test_decoding_gathers_bytes_and_refuses_unknown_ids():
    data = read_ranks(PATH)
    ranks, tokens = _ranks(data), _Tokens(data)
    random.seed(9)
    some = random.choices(list(ranks), k=150_000)
    assert tokens.decode(struct.pack(f"<{len(some)}I", *map(ranks.get, some))) == b"".join(some) and tokens.decode(b"") == b""
    with pytest.raises(KeyError):
        tokens.decode(struct.pack("<I", max(ranks.values()) + 1))
