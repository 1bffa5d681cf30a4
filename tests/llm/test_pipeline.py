"""Each stage of the pipeline against brute force on its own input, and the run as their chain."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from evq.llm import quality
from evq.llm import queries as llm
from tests.llm.test_operators import brute_contamination, brute_print, brute_units, corpus, edit_similar, plain_normal, roots, words

KIND = "doc_id long, text string, lang string, source string, n_chars long, removed_units string"


def tables(spark, folder, texts, items):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[9:10], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def check_packing(pieces, docs):
    """Each token of each document stands in one piece, sequences are gapless and full but for one."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs}
    rows = Counter(r["doc_id"] for r in docs)
    found, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        found[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences[r["sequence_id"]] += range(r["offset"], r["offset"] + r["length"])
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(list(range(len(ids[d]))) * n) for d, n in rows.items()}
    assert all(sorted(x) == list(range(len(x))) for x in sequences.values())
    assert sorted(map(len, sequences.values()))[1:] == [2048] * (len(sequences) - 1)


def test_stages(spark, tmp_path):
    rng = random.Random(7)
    texts = [t if t is None else t + "\n" + " ".join(words(rng, 25, 5000)) for t in corpus()] + ["", "few words"]
    items = [(1, " ".join(words(rng, 30, 5000))), (2, None)]
    texts += [items[0][1] + " " + " ".join(words(rng, 40, 5000)) for _ in range(2)]
    folder = tables(spark, tmp_path, texts, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = None
    for i, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if i == 4:
            check_packing(out.collect(), before)
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{i}")
        now = docs.collect()
        ids = sorted(r["doc_id"] for r in now)
        plain = {r["doc_id"]: r["text"] for r in before}
        order = sorted(plain)
        if i == 0:
            kept = {r[0] for r in duckdb.sql(quality.ORACLE.replace("FROM documents", f"FROM '{folder}/documents.parquet/*.parquet'")).fetchall() if r[7]}
            assert 0 < len(kept) < len(plain)
            want = [r["doc_id"] for r in before if r["doc_id"] in kept]
        elif i == 1:
            gone = brute_units([plain[d] for d in order], plain_normal, lambda x: len(plain_normal(x).decode()) >= 20, edit_similar)
            left = {}
            for k, d in enumerate(order):
                parts = (plain[d] or "").split("\n")
                kept = [x for no, x in enumerate(parts) if (k, no) not in gone]
                if len(kept) == len(parts):
                    left[d] = plain[d]
                elif any(x.split() for x in kept):
                    left[d] = "\n".join(kept)
            want = [r["doc_id"] for r in before if r["doc_id"] in left]
            assert all(r["text"] == left[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in now)
        elif i == 2:
            prints = [brute_print(plain[d]) for d in order]
            group = roots(range(len(order)), [(a, b) for a in range(len(order)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
            want = [r["doc_id"] for r in before if order[group[order.index(r["doc_id"])]] == r["doc_id"]]
        else:
            bad = brute_contamination([plain[d] for d in order], items)
            want = [r["doc_id"] for r in before if not bad[order.index(r["doc_id"])][3]]
            assert len(want) < len(before)
        assert ids == sorted(want), name
    chained = sorted(map(str, cp.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert chained == sorted(str(r) for r in out.select("doc_id", "start", "length", "ids_crc32").collect())


def test_empty_documents(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [(1, "x")])
    spark.createDataFrame([], KIND).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert cp.run(spark, folder).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert {f"op{i}_" for i in range(1, 11)} == {f"{q.split('_')[0]}_" for q in llm.QUERIES}
    assert set(llm.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(llm.ORACLES) <= set(entry.oracle_sql())
