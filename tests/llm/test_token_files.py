import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.queries_op2 import op2_token_files
from millrace.llm.token_files import read_document, read_tokens, store, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_query_against_the_library(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts += [None, "", " ", "  two  spaces ", "x<|endoftext|>y <|endoftext|> z", "a\n\nb \n c", "½ ² Ⅷ 漢字 🙂 \x1c \x85 q", "a" * 5000, "it's we'll  "]
    rows = list(enumerate(texts)) + [(5, "again"), (None, texts[2])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS start", "2 AS id").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in op2_token_files(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == want


def test_one_document_and_the_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"short text {i} of many") for i in range(300)], "doc_id long, text string")
    folder = write_tokens(docs, PATH, 2, f"file://{tmp_path}/set")
    fs, root = store(folder)
    shard = spark.read.parquet(f"{folder}/shards").orderBy("part").first()
    first = read_tokens(spark, folder).orderBy("doc_id").first()
    assert read_document(folder, shard.name, 0).astype("<u4").tobytes() == bytes(first.ids) and first.doc_id == 0
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(b"other")
    with pytest.raises(ValueError, match="dictionary"):
        read_document(folder, shard.name, 0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(spark, write_tokens(docs, PATH, 2)).count() == 0
