"""The packing query's whole result over the smallest tables, against plain tokenisation."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_piece_of_every_document_is_packed(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, total = [], 0
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            expected.append((row["doc_id"], piece, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    rows = QUERIES["op1_pack"](spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        stop = 0
        for offset, length in sorted(held):
            assert offset == stop
            stop += length
        assert stop <= 2048
    # As few as it can: the bound by tokens is met within one in a hundred.
    assert -(-total // 2048) <= len(sequences) <= -(-total // 2048) * 1.01 + 1
